"""The corpus pipeline: language, near duplicates, benchmark leaks, mixture, token files.

Each stage takes all its predecessor kept and returns the columns of its input, whatever these are called; the last one returns the files'
rows. Nulls, empty and very long texts, ties, repeated rows and empty tables have these results:

| stage | null or empty text | very long text | repeated rows, ties | null doc_id |
|-|-|-|-|-|
| language | goes: no letter, so no language | read whole | each judged by itself | judged like any |
| near_duplicates | stays, a group of its own | compared whole | of rows repeated in full one stays; ties by SHA-256 of the text | comes after all others in a group |
| decontamination | stays: no words, no window | searched whole | each judged by itself | judged like any |
| mixture | goes: it has no words to take | cut at a word if it stands at the cut | each is a row of its own | ordered like any |
| tokens | its document holds the end id alone | one task, one shard | each is a document | first in order, doc_id null |

An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import dart_minhash, decontaminate, language, mixture, tokens
from tarnwork.llm.queries import TOKENIZER, table
from tarnwork.llm.store import new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told, by a bidirectional network over bytes. No shuffle."""
    return language.readable(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words a shingle, a similarity of 0.8 or more."""
    return dart_minhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without any window of ten words of a benchmark item. No shuffle."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources meet their target weights, by capped water-filling."""
    return mixture.repeat(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.encode_and_read(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixture", mix_sources),
    ("tokens", write_tokens),
]

#: The network of the first stage and the hashes of later ones have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
