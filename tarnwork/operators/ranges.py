"""Running totals, numbers and neighbours over one whole order, without one task that sees all rows.

Rows are dealt to ranges of the order and written; each range works by itself, and what crosses from range to range is one row
a range, so the only window over everything has as many rows as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.records import scratch

RANGE = "_range"


def ranges(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """The rows with the number of their range; ranges ascend with the order. Written once, so numbers stay what they are."""
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    path = scratch(spark)
    df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(path)


def running_total(dealt: DataFrame, order: list[str], amount: Column, out: str, group: list[str] | None = None) -> DataFrame:
    """Adds the sum of ``amount`` over all earlier rows (of the group) of a table that ``ranges`` dealt."""
    group = group or []
    rows = dealt.withColumn("_amount", amount)
    w = Window.partitionBy(RANGE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(RANGE, *group).agg(F.sum("_amount").alias("_sum"))
    # One row a range (and group): as many as there are ranges, not rows.
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    same = F.lit(True)
    for c in (RANGE, *group):
        same = same & rows[c].eqNullSafe(before[c])
    joined = rows.withColumn(out, F.coalesce(F.sum("_amount").over(w), F.lit(0))).alias("r").join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (RANGE, *group)])
    return joined.select(*[F.col(f"r.{c}") for c in dealt.columns], (F.col(f"r.{out}") + F.col("b._before")).alias(out))


def number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds each row's place in the order, from 0."""
    return running_total(ranges(df, order), order, F.lit(1).cast("long"), out).drop(RANGE)


def previous(dealt: DataFrame, order: list[str], column: str, out: str) -> DataFrame:
    """Adds the value of ``column`` one row earlier, across ranges too."""
    w = Window.partitionBy(RANGE).orderBy(*order)
    last = dealt.groupBy(RANGE).agg(F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
    carried = last.select(F.col(RANGE).alias("_at"), F.lag("_last").over(Window.orderBy(RANGE)).alias("_carried"))  # one row a range
    placed = dealt.withColumns({"_i": F.row_number().over(w), "_own": F.lag(F.struct(column)).over(w)}).join(carried, F.col(RANGE) == F.col("_at"))
    return placed.withColumn(out, F.when(F.col("_i") == 1, F.col(f"_carried.{column}")).otherwise(F.col(f"_own.{column}"))).drop("_i", "_own", "_at", "_carried")
