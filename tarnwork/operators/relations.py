"""Joins across sets: coverage, isolation, ownership, leakage, prefixes and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import scratch
from .ranges import number


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """For every key its rows on either side and the verdict: covered, duplicate, missing or foreign."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, key, "full_outer").fillna(0, ["n_left", "n_right"])
    verdict = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "foreign").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate").otherwise("covered")
    return both.withColumn("verdict", verdict)


def isolate(rows: DataFrame, ident: str, footprint: DataFrame, reserved: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): a row is dropped if any position of its footprint (ident, position) is reserved."""
    marked = isolated(rows, ident, footprint, reserved, position, "_kept")
    return marked.filter("_kept").drop("_kept"), marked.filter("not _kept").drop("_kept")


def isolated(rows: DataFrame, ident: str, footprint: DataFrame, reserved: DataFrame, position: str, out: str) -> DataFrame:
    """The rows with a flag: false if any position of the row's footprint is reserved. Rows are joined once."""
    hit = footprint.join(reserved.select(position).distinct(), position, "left_semi").select(ident).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, ident, "left").withColumn(out, F.col("_hit").isNull()).drop("_hit")


def leakage(df: DataFrame, position: str, split: str) -> DataFrame:
    """Positions in more than one split."""
    return df.groupBy(position).agg(F.count_distinct(split).alias("n_splits"), F.min(split).alias("first_split"), F.max(split).alias("last_split")).filter("n_splits > 1")


def priority_isolation(df: DataFrame, position: str, rank: Column) -> DataFrame:
    """Rows whose position no row of a higher-priority split has."""
    ranked = df.withColumn("_k", rank)
    owner = ranked.groupBy(F.col(position).alias("_p")).agg(F.min("_k").alias("_o"))
    return ranked.join(owner, (F.col(position) == F.col("_p")) & (F.col("_k") == F.col("_o")), "left_semi").drop("_k")


def shingles(df: DataFrame, ident: str, text: str, n: int = 8) -> DataFrame:
    """(ident, position): the distinct runs of n words between white space."""
    # The words are bound as a lambda's variable: inside the inner one a column would be split again for every run.
    hashed = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(n)))))
    runs = F.element_at(F.transform(F.array(F.split(F.col(text), r"\s+")), hashed), 1)
    return df.select(ident, F.explode(F.array_distinct(runs)).alias("position"))


def prefixes(df: DataFrame, line: str) -> DataFrame:
    """One row for each non-empty prefix of an array column; other columns travel along."""
    return df.withColumn("prefix", F.explode(F.when(F.size(line) > 0, F.transform(F.sequence(F.lit(1), F.size(line)), lambda i: F.slice(line, F.lit(1), i)))))


def family(lines: DataFrame, line: str, roots: DataFrame, root: str) -> DataFrame:
    """Lines with each root that they begin with. Lines are joined on a prefix a distinct root length, so no pair is tried in vain."""
    lengths = F.array_sort(F.array_distinct(F.collect_set(F.size(root))))
    sized = lines.crossJoin(roots.agg(lengths.alias("_lengths")))  # one row, with one number a length
    cut = sized.withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.size(line)))).withColumn("_prefix", F.slice(F.col(line), F.lit(1), F.col("_n")))
    return cut.join(roots, F.col("_prefix") == F.col(root)).drop("_lengths", "_n", "_prefix")


def originals(revisions: DataFrame, ident: str, parent: str, accepted: str | None = None) -> DataFrame:
    """ident, original, depth, cyclic: each row's last ancestor, by pointer doubling, so rounds grow with the logarithm of the longest chain.

    A parent that has no row is itself the original. Rows whose chain never ends are ``cyclic`` and have no original. With ``accepted`` (a boolean
    column) a chain that passes through a row that is not accepted has no original either.
    """
    good = F.coalesce(F.col(accepted), F.lit(False)) if accepted else F.lit(True)
    state = revisions.select(F.col(ident).alias("id"), F.coalesce(F.col(parent), F.col(ident)).alias("link"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"), good.alias("good"))
    n, reach = state.count(), 1
    while True:
        path = scratch(state.sparkSession)
        state.write.parquet(path)
        state = state.sparkSession.read.parquet(path)
        up = state.select(F.col("id").alias("_id"), F.col("link").alias("_link"), F.col("depth").alias("_depth"), F.col("good").alias("_good"))
        if reach > n or state.join(up, F.col("link") == F.col("_id")).filter("_link <> link").isEmpty():
            break
        state = state.join(up, F.col("link") == F.col("_id"), "left").select("id", F.coalesce("_link", "link").alias("link"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("good") & F.coalesce("_good", F.lit(True))).alias("good"))
        reach *= 2
    # A link that still has a parent lies on a cycle: with n rows every chain has ended by now.
    ends = revisions.select(F.col(ident).alias("_id"), F.col(parent).alias("_parent"))
    done = state.join(ends, F.col("link") == F.col("_id"), "left")
    cyclic = F.col("_parent").isNotNull()
    return done.select(F.col("id").alias(ident), F.when(~cyclic & F.col("good"), F.col("link")).alias("original"), F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def derangement(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Pairs every row with a donor of another key; an error if one key has more than half of the rows.

    Rows are ordered by their key's size and key; each takes the row that lies as many places on as the largest key has rows. Places come from
    ranges of that order, so no task sees all rows.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.max("_n").alias("m"), F.sum("_n").alias("t")).first()
    if top.t and 2 * top.m > top.t:
        raise ValueError(f"one key has {top.m} of {top.t} rows: not every row can have a donor of another key")
    sized = df.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn("_first", -F.col("_n"))
    placed = number(sized, ["_first", key, *order], "_i").drop("_n", "_first")
    donor = placed.select(*[F.col(c).alias(f"donor_{c}") for c in df.columns], F.col("_i").alias("_di"))
    return placed.withColumn("_d", (F.col("_i") + F.lit(top.m or 0)) % F.lit(top.t or 1)).join(donor, F.col("_d") == F.col("_di")).drop("_i", "_d", "_di")
