"""Deduplication, ranking, quotas and deterministic sampling.

Groups are ranked by windows over (group, order), which prune to the first rows before the shuffle; orders come
from hashes of keys, so a selection depends on its rows and seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE, previous, ranges, running_total


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int | Column, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; k may be a column of the group."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, key, order, 1)


def duplicate_provenance(df: DataFrame, key: list[str], order: list[Column], ident: str) -> DataFrame:
    """Every duplicate with the ident of the row that is kept instead. Keys are aggregated before they meet, so a hot one is no one task's."""
    first = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.min(F.struct(*order, F.struct(ident).alias("_v"))).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    paired = df.join(first, same).withColumn("kept_" + ident, F.col("_first._v")[ident])
    return paired.filter(~F.col(ident).eqNullSafe(F.col("kept_" + ident))).drop("_first", "_n", *[f"_k_{k}" for k in key])


def conflict_dedup(df: DataFrame, key: list[str], signature: str, order: list[Column]) -> DataFrame:
    """First row of each key, without keys whose rows have different signatures."""
    rest = [c for c in df.columns if c not in key]
    agreed = df.groupBy(*key).agg(F.min(signature).alias("_a"), F.max(signature).alias("_b"), F.count(signature).alias("_some"), F.count(F.lit(1)).alias("_all"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return agreed.filter("_a <=> _b and (_some = _all or _some = 0)").select(*key, "_r.*").select(*df.columns)


def max_rank(df: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """The row of highest rank of each key, by partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("_r")).select(*key, "_r.*")


def hash_limit(df: DataFrame, order: Column, n: int) -> DataFrame:
    return df.withColumn("_o", order).orderBy("_o").limit(n).drop("_o")


def islands(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Numbers the runs of equal ``group`` in the given order as ``island``, from 1; the stream is one ordered whole, worked on range by range."""
    dealt = previous(ranges(df.withColumn("_g", F.struct(group)), order), order, "_g", "_before")  # the very first row has none
    changed = F.when(F.col("_before").isNotNull() & F.col("_g").eqNullSafe(F.col("_before")), 0).otherwise(1)
    counted = running_total(dealt.withColumn("_c", changed), order, F.col("_c"), "_so_far")
    return counted.withColumn("island", F.col("_so_far") + F.col("_c")).drop("_c", "_g", "_before", "_so_far", RANGE)


def evenly(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each group, evenly spaced in its order, the first and the last among them; fewer where places fall together."""
    w = Window.partitionBy(*group)
    placed = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / float(k - 1)).cast("int"))
    return placed.filter(F.array_contains(spots, F.col("_i"))).drop("_i", "_n")


def cover_then_fill(df: DataFrame, group: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """The first row of each group, then rows in order until there are k; ``out`` is the place. Only the first k rows and one a group reach the last sort."""
    first = top_per_group(df, group, order, 1).withColumn("_turn", F.lit(0))
    rest = df.join(first.select(*df.columns), df.columns, "left_anti").orderBy(*order).limit(k).withColumn("_turn", F.lit(1))
    short = first.unionByName(rest).orderBy("_turn", *order).limit(k)
    return short.withColumn(out, F.row_number().over(Window.orderBy("_turn", *order))).drop("_turn")  # k rows


def shortfall(df: DataFrame, group: list[str], budget: int, cells: DataFrame) -> DataFrame:
    """For each cell how many rows the budget takes and how many are missing; ``cells`` names the wanted ones."""
    have = df.groupBy(*group).agg(F.least(F.count(F.lit(1)), F.lit(budget)).alias("picked"))
    return cells.join(have, group, "left").withColumn("picked", F.coalesce("picked", F.lit(0))).withColumn("shortfall", budget - F.col("picked"))


def patience(df: DataFrame, run: str, order: list[str], value: str) -> DataFrame:
    """run, best_step (the last one above all before it) and stale (steps since)."""
    w = Window.partitionBy(run).orderBy(*order)
    steps = df.withColumns({"_step": F.row_number().over(w), "_before": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    best = F.max(F.when(F.col("_before").isNull() | (F.col(value) > F.col("_before")), F.col("_step")))
    return steps.groupBy(run).agg(best.alias("best_step"), (F.max("_step") - best).alias("stale"))


def decide(history: DataFrame, run: str, step: str, metric: str, least_gain: float, wait: int, budget: int) -> DataFrame:
    """run, best_step, checks_since and stop: the best metric, the earliest of equals, counts only if it gains ``least_gain`` over the best before it;
    a run stops after ``wait`` checks without one, or when ``budget`` steps are used."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    gains = history.withColumn("_before", F.max(metric).over(w))
    gained = F.col("_before").isNull() | (F.col(metric) >= F.col("_before") + least_gain)
    best = gains.groupBy(run).agg(F.max(F.when(gained, F.col(step))).alias("best_step"), F.max(step).alias("_last"))
    since = gains.join(best, run).groupBy(run, "best_step", "_last").agg(F.count(F.when(F.col(step) > F.col("best_step"), 1)).alias("checks_since"))
    return since.select(run, "best_step", "checks_since", ((F.col("checks_since") >= wait) | (F.col("_last") >= budget)).alias("stop"))
