"""Where intermediate tables live, and helpers that keep plans short."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

_local: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="tarnwork-")
    return _local["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def clear(spark: SparkSession) -> None:
    """Deletes every table and file that the operators of this session wrote; results not yet written elsewhere are lost with them."""
    while _made:
        _delete(spark, _made.pop())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote and no later step reads."""
    path = getattr(df, "_written_to", None)
    if path in _made:
        _made.remove(path)
        _delete(df.sparkSession, path)


def free_names(taken: list[str], n: int) -> list[str]:
    """Names that no column has."""
    have, out, i = {c.lower() for c in taken}, [], 0
    while len(out) < n:
        if f"_own{i}" not in have:
            out.append(f"_own{i}")
        i += 1
    return out


def filter_texts(documents: DataFrame, more: list[Column], decide: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], most: int = W.SLICE_BYTES) -> DataFrame:
    """The rows that a function of the text (and ``more`` columns) keeps, with all their columns: one Arrow pass without a shuffle.

    ``decide`` is called once a task and gives a function from (text, more...) to a mask. Columns go by place, so names cannot clash.
    """
    n = 1 + len(more)
    source = documents.select(F.col("text").cast("string").alias("_0"), *[c.alias(f"_{i}") for i, c in enumerate(more, 1)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(documents.columns)])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in source.schema.fields[n:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = decide()
        for batch in batches:
            for part in W.slices(batch, "_0", most):
                yield part.select(range(n, part.num_columns)).filter(pa.array(keep(part)))

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(documents.columns)])


def join_uneven(rows: DataFrame, one_each: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """``rows`` left joined to a table with one row a key, where keys may hold very many rows.

    ``count`` is a column of ``one_each`` with the number of rows of its key. Keys with over 1/``share`` of all rows are at most ``share``
    many, so these go by broadcast; the others are shuffled, where none of them can be hot. Rows without a key, or whose
    key is not in the table, keep nulls. ``rows`` should be a written table, as it is read three times.
    """
    more = [c for c in one_each.columns if c != key]
    bar = rows.count() / share
    heavy = F.broadcast(one_each.filter(F.col(count) > bar))  # at most ``share`` rows
    keyed = rows.filter(F.col(key).isNotNull())
    parts = [
        keyed.join(heavy, key),
        keyed.join(heavy.select(key), key, "left_anti").join(one_each.filter(F.col(count) <= bar), key, "left"),
        rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(one_each.schema[c].dataType).alias(c) for c in more]),
    ]
    names = [*rows.columns, *more]
    return parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def running_total(df: DataFrame, group: str, order: list[str], amount: Column, out: str, name: str) -> DataFrame:
    """Adds, within each group and in ``order``, the sum of ``amount`` over all earlier rows.

    The rows are range partitioned on (group, order), so a hot group spreads over many tasks; only
    one total per (partition, group) crosses to the offsets.
    """
    spark = df.sparkSession
    cut = df.withColumn("_a", amount.cast("long")).repartitionByRange(partitions(spark), group, *order)
    ranged = materialise(cut.withColumn("_p", F.spark_partition_id()), name)
    totals = ranged.groupBy("_p", group).agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.col(group).alias("_g"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (range partition, group): its size follows the number of partitions, not of rows.
    return (
        ranged.withColumn("_w", F.coalesce(F.sum("_a").over(within), F.lit(0)))
        .join(offsets, (ranged["_p"] == offsets["_p"]) & ranged[group].eqNullSafe(offsets["_g"]))
        .withColumn(out, F.col("_w") + F.col("_o"))
        .drop(offsets["_p"]).drop("_w", "_o", "_g", "_p", "_a")
    )
