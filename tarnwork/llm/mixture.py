"""Mixing sources to target weights by capped water-filling.

A source's target is its share of all words by weight, clamped at ``epochs`` times its own words; what
is cut off goes to the others by weight until no target is above its cap. With sources sorted by
cap / weight that fixed point has a closed form, so one pass over the source table finds it.

A document is repeated whole ``floor(target / source size)`` times. The rest of the target is filled by
documents in the order of a seeded hash: each is taken once more in whole until the rest is used up;
the one at the cut gives its first words only (a fractional repetition), so a source's taken words meet
its target to within a few words. The cut is found by narrowing bins of the hash, never by sorting a source.

Null text has size 0, takes nothing and is not in the mixed corpus; null source is a source of its own, last in order. Rows with equal
doc_id and text tie and are treated alike. A very long text at the cut gives its first words like any other. An empty table gives an empty
result. Extra columns stay out of the weights, and go on unchanged in the mixed corpus, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free_names, materialise

WEIGHTS, EPOCHS, SEED = (5.0, 2.0, 1.0), 3, 17
BITS = 12  # of the hash in each narrowing step
MOST_SOURCES = 200_000
SIZE = r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"


def sizes(documents: DataFrame) -> DataFrame:
    """source, size and the seeded hash of each row; the hash is not negative and has 60 bits."""
    return documents.withColumns(
        {
            "_mix_size": F.coalesce(F.expr(SIZE), F.lit(0)).cast("long"),
            "_mix_hash": F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), 4),
        }
    )


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> target: the level at which weight * level, clamped at the cap, uses up all words."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    ranked = by_source.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = capped.withColumns(
        {
            "_level": (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward),
        }
    )
    feasible = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    chosen = level.withColumn("_level", F.min_by(feasible, F.when(feasible.isNotNull(), F.col("_cap") / F.col("_w"))).over(whole))
    return chosen.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and where in hash order the rest ends."""
    small = materialise(rows.select("source", F.col("_mix_size").alias("size"), F.col("_mix_hash").alias("hash")), "mixture-rows")
    by_source = materialise(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "mixture-sources")
    rest = by_source.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = rest.withColumn("left", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    up = (F.col("source_size") > 0) & (F.col("left") >= F.col("source_size"))  # a rest rounded up to the source is one more whole repetition
    rest = rest.withColumns({"whole": F.when(up, F.col("whole") + 1).otherwise(F.col("whole")), "left": F.when(up, F.lit(0).cast("long")).otherwise(F.col("left"))})
    state = rest.select("source", "left", F.lit(0).cast("long").alias("bin"))
    for step in range(1, 60 // BITS + 1):
        shift = 60 - BITS * step
        # Rows of the bin at the cut, split by the next bits: at most 2**BITS sums a source.
        here = small.join(_bounded(state), small["source"].eqNullSafe(state["source"]) & (F.shiftright("hash", shift + BITS) == F.col("bin"))).drop(state["source"])
        bins = here.groupBy("source", F.shiftright("hash", shift).alias("next"), "left").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = bins.withColumn("_upto", F.sum("n").over(upto)).filter(F.col("_upto") > F.col("left"))
        state = materialise(
            cut.groupBy("source").agg(F.min(F.struct("next", (F.col("left") - (F.col("_upto") - F.col("n"))).alias("left"), "n")).alias("c")).select("source", F.col("c.left").alias("left"), F.col("c.next").alias("bin"), F.col("c.n").alias("n")),
            "mixture-cut",
        )
    state = state.select(F.col("source").alias("_s"), F.col("bin").alias("cut"), (F.col("left") / F.col("n")).alias("share"))
    return materialise(rest.join(state, rest["source"].eqNullSafe(state["_s"]), "left").drop("_s", "left"), "mixture-plan")


def _bounded(by_source: DataFrame) -> DataFrame:
    """The source table goes to all executors only when it is small."""
    return F.broadcast(by_source) if by_source.count() <= MOST_SOURCES else by_source


def taken(size: Column, whole: Column, hashed: Column, cut: Column, share: Column) -> Column:
    """Words taken of a row. A source without a cut has no words."""
    more = F.when(cut.isNull(), F.lit(0)).when(hashed < cut, size).when(hashed == cut, F.round(size * share)).otherwise(0)
    return (whole * size + more).cast("long")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The documents' columns with _mix_size, _mix_source_size, _mix_target and _mix_taken, one row per document."""
    rows = sizes(documents)
    by_source = plan(rows, weights, epochs)
    named = _bounded(by_source.select(*[F.col(c).alias(f"_mix_{c}") for c in by_source.columns]))
    joined = rows.join(named, rows["source"].eqNullSafe(named["_mix_source"]), "left")
    return joined.withColumn("_mix_taken", taken(*[F.col(f"_mix_{c}") for c in ("size", "whole", "hash", "cut", "share")]))


def weigh(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(documents.select("doc_id", "text", "source")).select("doc_id", *[F.col(f"_mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def repeat(documents: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken; the fractional repetition holds its first words."""
    clash = [c for c in documents.columns if c.lower().startswith("_mix_")]
    free = dict(zip(clash, free_names(documents.columns, len(clash)), strict=True))
    mixed = mix(documents.withColumnsRenamed(free))
    times = F.when(F.col("_mix_size") > 0, F.ceil(F.col("_mix_taken") / F.col("_mix_size"))).otherwise(0).cast("int")
    many = mixed.withColumn("_mix_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    short = F.col("_mix_taken") - (F.col("_mix_copy") - 1) * F.col("_mix_size")
    text = F.when(short < F.col("_mix_size"), F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), short.cast("string"), F.lit("}+")), F.lit(0))).otherwise(F.col("text"))
    columns = {"text": text} | ({"n_chars": F.when(short < F.col("_mix_size"), F.length(text)).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return many.withColumns(columns).select(*[F.col(free.get(c, c)).alias(c) for c in documents.columns])
