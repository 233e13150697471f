"""Queries and their SQL, registered side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers f(tables) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Spark:
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    hexint = staticmethod(lambda x: f"cast(conv({x}, 16, 10) as bigint)")
    unnest = staticmethod(lambda x: f"lateral explode({x})")
    split = staticmethod(lambda x, sep: f"split({x}, '{sep}')")
    join = staticmethod(lambda x, sep=",": f"array_join({x}, '{sep}')")
    strs = staticmethod(lambda x: f"array_join(array_sort(collect_list({x})), ',')")
    ordered = staticmethod(lambda x, o: f"array_join(transform(array_sort(collect_list(struct({o} as o, {x} as x))), s -> s.x), ' ')")
    size = staticmethod(lambda x: f"size({x})")
    extract = staticmethod(lambda x, p, g=0: f"regexp_extract({x}, '{p}', {g})")
    matches = staticmethod(lambda x, p: f"regexp_like({x}, '{p}')")
    json = staticmethod(lambda x, k: f"get_json_object({x}, '$.{k}')")
    item = staticmethod(lambda x, i: f"try_element_at({x}, {i})")
    epoch = staticmethod(lambda x: f"unix_micros({x})")
    text = staticmethod(lambda x: f"cast({x} as string)")
    slice = staticmethod(lambda x, a, n: f"slice({x}, {a}, {n})")
    even = staticmethod(lambda x: f"bround({x})")


class Duck(Spark):
    sha = staticmethod(lambda x: f"sha256({x})")
    hexint = staticmethod(lambda x: f"cast(('0x' || {x}) as bigint)")
    unnest = staticmethod(lambda x: f"unnest({x})")
    split = staticmethod(lambda x, sep: f"string_split({x}, '{sep}')")
    join = staticmethod(lambda x, sep=",": f"array_to_string({x}, '{sep}')")
    strs = staticmethod(lambda x: f"string_agg({x}, ',' order by {x})")
    ordered = staticmethod(lambda x, o: f"string_agg({x}, ' ' order by {o}, {x})")
    size = staticmethod(lambda x: f"len({x})")
    matches = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    json = staticmethod(lambda x, k: f"json_extract_string({x}, '$.{k}')")
    item = staticmethod(lambda x, i: f"({x})[{i}]")
    epoch = staticmethod(lambda x: f"epoch_us({x})")
    text = staticmethod(lambda x: f"cast({x} as varchar)")
    slice = staticmethod(lambda x, a, n: f"list_slice({x}, {a}, {a} + {n} - 1)")
    even = staticmethod(lambda x: f"round_even({x}, 0)")


def shared(name: str, make: Callable[[type[Spark]], str]) -> None:
    """A query in SQL that both engines run, apart from the names of a few functions."""
    spark_sql = make(Spark)

    # Views have names of this package's own, so a user's views stay as they are.
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", spark_sql)]
    own_sql = re.sub(rf"\b(from|join)(\s+)({'|'.join(TABLES)})\b", r"\1\2tarnwork_\3", spark_sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"tarnwork_{t}")
        return spark.sql(own_sql)

    QUERIES[name], ORACLES[name] = run, make(Duck)
