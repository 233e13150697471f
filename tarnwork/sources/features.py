"""An append-only store of feature vectors by key: blocks of Parquet under one path, written once each and never changed.

Keys are distinct over all blocks, vectors have one width and hold only numbers that stay finite at half precision. A block appears
with its commit or not at all, so a failed append leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .evidence import atomic_json, exists, read_json

HALF = 65_520.0  # the smallest number that half precision rounds to infinity
ROW = "key string, feature array<float>"


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.width = read_json(spark, f"{self.path}/store.json")["width"]

    def _blocks(self) -> list[int]:
        k = 0
        while exists(self.spark, f"{self.path}/block-{k:06d}/_SUCCESS"):
            k += 1
        return list(range(k))

    def read(self) -> DataFrame:
        """key, feature and the block each key came with."""
        parts = [self.spark.read.schema(ROW).parquet(f"{self.path}/block-{k:06d}").withColumn("block", F.lit(k)) for k in self._blocks()]
        if not parts:
            return self.spark.createDataFrame([], f"{ROW}, block int")
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def append(self, rows: DataFrame, known: str = "error") -> int:
        """Writes (key, vector) as the next block. Keys the store has are an error, or skipped with ``known="skip"``; all else is always an error."""
        key, vector = rows.columns
        new = rows.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("feature"))
        # One pass finds keys that come twice and vectors that are not sound.
        bad = (F.size("feature") != self.width) | F.col("feature").isNull() | F.exists("feature", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= HALF))
        wrong = new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(bad, F.lit(True))).alias("bad")).filter("key is null or n > 1 or bad")
        if not wrong.isEmpty():
            raise ValueError(f"keys must be distinct and vectors of width {self.width} and finite: {wrong.first()}")
        have = self.read().select("key")
        if known == "skip":
            new = new.join(have, "key", "left_anti")
        elif not new.join(have, "key", "left_semi").isEmpty():
            raise ValueError("the store has some of these keys")
        k = len(self._blocks())
        new.write.mode("errorifexists").parquet(f"{self.path}/block-{k:06d}")
        return k

    def extend(self, others: list[FeatureStore]) -> None:
        """Appends other stores' blocks after this one's, each as it is; overlapping keys are an error before anything is written."""
        every = [o.read().select("key") for o in others]
        if any(o.width != self.width for o in others):
            raise ValueError("widths differ")
        keys = self.read().select("key")
        for part in every:
            keys = keys.unionByName(part)
        if not keys.groupBy("key").count().filter("count > 1").isEmpty():
            raise ValueError("stores share keys")
        for other in others:
            for k in other._blocks():
                self.append(other.read().filter(F.col("block") == k).select("key", "feature"))

    def gather(self, rows: DataFrame, carry: list[str], keys: str) -> DataFrame:
        """carry, pos, key, feature for each element of an array of keys, repeats included; a key the store lacks is an error."""
        wanted = rows.select(*carry, F.posexplode(keys).alias("pos", "key"))
        lacking = wanted.select("key").distinct().join(self.read().select("key"), "key", "left_anti")
        if not lacking.isEmpty():
            raise KeyError(f"not in the store: {lacking.first().key}")
        return wanted.join(self.read().select("key", "feature"), "key").select(*carry, "pos", "key", "feature")


def create(spark: SparkSession, path: str, width: int) -> FeatureStore:
    if width < 1 or exists(spark, f"{path}/store.json"):
        raise ValueError("a store needs a positive width and a path of its own")
    atomic_json(spark, f"{path}/store.json", {"width": width})
    return FeatureStore(spark, path)


def extract(store: FeatureStore, histories: DataFrame, key: str, value: str, encode: Callable[[pd.Series], list]) -> int:
    """Encodes each history once, those of the store left out, and appends them as one block. ``encode`` gets batches and gives vectors."""
    ship(store.spark)
    once = histories.groupBy(F.col(key).cast("string").alias("key")).agg(F.min(value).alias("value"))
    fresh = once.join(store.read().select("key"), "key", "left_anti")

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "feature": [[float(x) for x in v] for v in encode(frame["value"])]})

    return store.append(fresh.select("key", "value").mapInPandas(run, ROW))
