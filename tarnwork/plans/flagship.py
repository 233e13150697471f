"""The end-to-end slice: split, deduplicate, isolate, select, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import relations as R
from ..operators import select as S
from .registry import Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.documents.withColumns({"h": F.sha2("text", 256), "split": K.assigned_split("7", F.col("source"))})
    first = S.first_wins(rows.select("doc_id", "h", "split", "lang", "source"), ["h"], [F.col("doc_id")])
    kept, _ = R.isolate(first, "doc_id", R.shingles(t.documents, "doc_id", "text"), R.shingles(t.benchmark, "item_id", "text"), "position")
    chosen = S.top_per_group(kept.filter("split = 'train'"), ["lang"], [K.hash_order("3", F.col("lang"), F.col("doc_id"))], 40)
    return chosen.groupingSets([[F.col("split")], [F.col("split"), F.col("lang")], [F.col("split"), F.col("source")]], "split", "lang", "source").agg(F.count(F.lit(1)).alias("n"))
