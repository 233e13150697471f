"""Rates, gates, accounting and sizing as DataFrame functions; partial aggregation runs before every shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(condition: Column, among: Column | None = None) -> Column:
    """The share of rows (of those ``among``) that meet a condition; null where there are none."""
    met = F.coalesce(condition, F.lit(False))
    if among is None:
        return F.avg(met.cast("double"))
    return F.avg(F.when(among, met.cast("double")))


def tally(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the bottom is zero."""
    return top.cast("double") / F.when(bottom != 0, bottom)


def micro(df: DataFrame, group: list[str], gold: Column, predicted: Column) -> DataFrame:
    """Precision and recall over all rows of a group, pooled before they are divided."""
    both = tally(gold & predicted)
    return df.groupBy(*group).agg(ratio(both, tally(predicted)).alias("micro_precision"), ratio(both, tally(gold)).alias("micro_recall"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value.cast("double") * weight) / F.sum(weight)


def outcomes(df: DataFrame, group: list[str], win: Column, loss: Column, censored: Column) -> DataFrame:
    """Wins, losses and censored rows, and the wins' share of what is not censored."""
    g = df.groupBy(*group).agg(tally(win).alias("wins"), tally(loss).alias("losses"), tally(censored).alias("censored"), tally(~censored).alias("_n"))
    return g.withColumn("score", ratio(F.col("wins"), F.col("_n"))).drop("_n")


def mask(bits: dict[int, Column]) -> Column:
    """The sum of the bits whose condition holds."""
    return reduce(lambda a, b: a + b, [F.when(c, bit).otherwise(0) for bit, c in bits.items()], F.lit(0))


def merged_counts(df: DataFrame, counts: str) -> DataFrame:
    """k, n: maps of counts added up over all rows."""
    return df.select(F.explode(counts).alias("k", "v")).groupBy("k").agg(F.sum("v").cast("long").alias("n"))


def gate(tasks: DataFrame, n: str, accuracy: str, least_rows: int, least: float, mean: float) -> DataFrame:
    """One row: whether every task has enough rows, the worst one is good enough and the mean is."""
    enough = F.min(n) >= least_rows
    return tasks.agg(F.count(F.lit(1)).alias("n_tasks"), enough.alias("enough"), F.min(accuracy).alias("worst"), (enough & (F.min(accuracy) >= least) & (F.avg(accuracy) >= mean)).alias("pass"))


def mixture_counts(df: DataFrame, key: str, weights: dict[str, float], other: float, anchor: str) -> DataFrame:
    """key, n, wanted: rows of each key that go with all rows of the anchor, by weight; halves go to the even number. The weights are literals."""
    weight = reduce(lambda w, kv: w.when(F.col(key) == kv[0], kv[1]), list(weights.items())[1:], F.when(F.col(key) == next(iter(weights)), next(iter(weights.values())))).otherwise(other)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    base = counts.agg(F.max(F.when(F.col(key) == anchor, F.col("n"))).alias("_base"))
    return counts.crossJoin(base).select(key, "n", F.bround(F.col("_base") * weight / weights[anchor]).cast("long").alias("wanted"))  # one row


def balance(df: DataFrame, stream: str, kept: str, out: list[str]) -> DataFrame:
    """One row: total, the streams' counts, and whether they add up."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[tally(F.col(stream) == s).alias(s) for s in (*out, kept)])
    return one.withColumn("balanced", F.col("total") == reduce(lambda a, b: a + b, [F.col(s) for s in (*out, kept)]))


def throughput(df: DataFrame, size: str, seconds: str, base: int = 1) -> DataFrame:
    """size, n, rate, ratio to the base size's rate."""
    rates = df.groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("_s")).withColumn("rate", F.col("n") / F.col("_s")).drop("_s")
    one = rates.filter(F.col(size) == base).select(F.col("rate").alias("_one"))
    return rates.crossJoin(one).withColumn("ratio", F.col("rate") / F.col("_one")).drop("_one")  # one row


def schedule(counts: DataFrame, n: str, batch: int, wanted: float, most_passes: int, most_steps: int) -> DataFrame:
    """Updates a pass, passes and steps of a training budget."""
    updates = F.ceil(F.col(n) / float(batch)).cast("long")
    return counts.withColumns({"updates_per_pass": updates, "passes": F.least(F.lit(most_passes), F.ceil(wanted / F.col(n)).cast("long")), "steps": F.least(F.lit(most_steps), updates * most_passes)})


def loss_to_best(df: DataFrame, group: list[str], value: str) -> Column:
    from pyspark.sql import Window

    return F.max(value).over(Window.partitionBy(*group)) - F.col(value)
