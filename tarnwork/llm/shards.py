"""Sharding by a k-d tree over metadata, law ``bytes``.

Nodes split along their widest dimension at its byte-weighted median until there are as many leaves as
shards, that is until every leaf holds about the target bytes. A node's width in a dimension is its range
over the whole table's range. Medians are found by narrowing histograms: bins are summed, accumulated and cut in tasks, and one row a
node reaches the driver, so it holds a few numbers a shard however many rows there are. Nodes' numbers go to the rows by broadcast,
at most one row a shard.

All dimensions come from the text (bytes, code points, CRC-32), so equal texts have equal coordinates and
stay in one shard. A split that misses its share by more than ``4 * SLACK``, because one value holds much of the node, gives way to the next widest
dimension if that one is clearly nearer. If a group of copies is so large that no split along any dimension comes within ``UNEVEN`` of its
share, its node is split by doc_id instead (the last dimension): sizes stay near equal, as the law asks, and only then do copies part.

Null text is empty: size 1, CRC-32 0. Rows that tie in every dimension, such as rows repeated in full, are in one shard; their slots follow
doc_id and then CRC-32. A very long text counts whole and is never cut. An empty table gives an empty result. Extra columns, whatever their
names, stay out of it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise, running_total

SHARDS, BINS, SLACK = 8, 4096, 0.002
UNEVEN = 0.1  # share of a node's bytes by which a split may miss before copies part
DIMENSIONS = ("size", "points", "text_crc32", "id_hash")
FROM_TEXT = 3


def measure(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.length(text).cast("long").alias("points"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("id_hash"),
    )


def _value(d: Column | str) -> Column:
    return F.element_at(F.array(*DIMENSIONS), F.col(d) + 1)


def _table(spark: SparkSession, rows: list[tuple], **kinds) -> DataFrame:
    """A few rows as a local relation, whose broadcast needs no job."""
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())}))


def _spans() -> list[Column]:
    return [f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]


def _medians(rows: DataFrame, wanted: list[tuple], slack: float = SLACK) -> dict[int, tuple[int, int]]:
    """For each (node, dimension, low, high, total bytes, share): the largest value of its lower part and that part's bytes."""
    spark = rows.sparkSession
    state = {k: {"d": d, "low": low, "high": high, "before": 0, "aim": total * share, "total": total} for k, d, low, high, total, share in wanted}
    done: dict[int, tuple[int, int]] = {}
    while state:
        steps = {k: max(1, -(-(s["high"] - s["low"] + 1) // BINS)) for k, s in state.items()}
        table = _table(spark, [(k, s["d"], s["low"], s["high"], steps[k], float(s["aim"] - s["before"])) for k, s in state.items()], node=pa.int32(), d=pa.int32(), low=pa.int64(), high=pa.int64(), step=pa.int64(), aim=pa.float64())
        inside = rows.join(F.broadcast(table), "node").withColumn("v", _value("d")).filter("v between low and high")  # at most one row a shard
        sums = inside.groupBy("node", F.floor((F.col("v") - F.col("low")) / F.col("step")).cast("long").alias("bin"), "aim").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows a node
        cut = sums.withColumn("upto", upto).filter("upto >= aim").groupBy("node").agg(F.min(F.struct("bin", "n", "upto")).alias("c"))
        found = {r.node: r.c for r in cut.collect()}  # one row a node
        for k, s in list(state.items()):
            b, n, so_far = (found[k].bin, found[k].n, s["before"] + found[k].upto - found[k].n) if k in found else (0, 0, s["before"])
            low, high = s["low"] + b * steps[k], min(s["high"], s["low"] + (b + 1) * steps[k] - 1)
            if low < high and n > slack * s["total"]:
                s |= {"low": low, "high": high, "before": so_far}
                continue
            # the border before or after this bin, whichever is nearer to the aim
            take = so_far + n - s["aim"] <= s["aim"] - so_far
            done[k] = (high, so_far + n) if take else (low - 1, so_far)
            del state[k]
    return done


def tree(rows: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """The rows with their shard."""
    spark = rows.sparkSession
    spans = rows.agg(*_spans()).first()
    root = {d: max(1, (spans[f"{d}_high"] or 0) - (spans[f"{d}_low"] or 0)) for d in DIMENSIONS}
    here, nodes, level = rows.withColumn("node", F.lit(0)), {0: (0, shards)}, 0
    while any(b - a > 1 for a, b in nodes.values()):
        open_ = {k: x for k, x in nodes.items() if x[1] - x[0] > 1}
        found = {r.node: r for r in here.groupBy("node").agg(F.sum("size").alias("total"), *_spans()).collect() if r.node in open_}  # one row a shard at most
        width = lambda r, i: (r[f"{DIMENSIONS[i]}_high"] - r[f"{DIMENSIONS[i]}_low"]) / root[DIMENSIONS[i]]
        order = {k: sorted(range(FROM_TEXT), key=lambda i, r=r: -width(r, i)) + [FROM_TEXT] for k, r in found.items()}
        share = {k: ((b - a) // 2) / (b - a) for k, (a, b) in open_.items()}
        best: dict[int, tuple[float, int, int]] = {}
        for turn in range(len(DIMENSIONS)):
            limit = UNEVEN if turn == FROM_TEXT else 4 * slack
            again = [k for k in found if k not in best or best[k][0] > limit]
            if not again:
                break
            at = {k: order[k][turn] for k in again}
            cuts = _medians(here, [(k, at[k], found[k][f"{DIMENSIONS[at[k]]}_low"], found[k][f"{DIMENSIONS[at[k]]}_high"], found[k].total, share[k]) for k in again], slack)
            for k, (border, below) in cuts.items():
                off = abs(below / found[k].total - share[k])
                # a later dimension is used only if it is clearly nearer to even
                if k not in best or off < best[k][0] / 4:
                    best[k] = (off, at[k], border)
        splits, grown = [], {}
        for k, (a, b) in nodes.items():
            d, border = best[k][1:] if k in best else (0, 0)
            half = a + (b - a) // 2
            if b - a == 1:  # a leaf goes on as its own left child
                splits.append((k, 0, (1 << 62)))
                grown[2 * k + 1] = (a, b)
            else:
                splits.append((k, d, border))
                grown[2 * k + 1], grown[2 * k + 2] = (a, half), (half, b)
        table = F.broadcast(_table(spark, splits, node=pa.int32(), _d=pa.int32(), _border=pa.int64()))  # at most one row a shard
        here = here.join(table, "node").withColumn("node", 2 * F.col("node") + 1 + (_value("_d") > F.col("_border")).cast("int")).drop("_d", "_border")
        nodes, level = grown, level + 1
        if level % 4 == 0:
            here = materialise(here, "shards-nodes")
    leaves = _table(spark, [(k, a) for k, (a, _) in nodes.items()], node=pa.int32(), shard=pa.int32())
    return here.join(F.broadcast(leaves), "node").drop("node")  # one row a shard


def assign(documents: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under law ``bytes``)."""
    placed = tree(materialise(measure(documents), "shards-measured"), shards, slack)
    slotted = running_total(placed, "shard", ["doc_id", "text_crc32"], F.lit(1), "slot", "shards-ranged")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
