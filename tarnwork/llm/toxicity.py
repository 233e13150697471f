"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic and of low quality (the labels' only order). One weight vector w is
shared by all borders: P(grade <= k) = sigmoid(b_k - w.x), with b_1 < b_2 kept in order by fitting the
logarithm of their distance. Features are hashed words that occur in a text (present or not), so scoring costs one
lookup a word and a text's length adds nothing by itself; buckets seen in fewer than ``SEEN`` sampled documents have no weight.
L1 shrinkage leaves few weights.

Learning uses at most ``SAMPLE`` labels, those with the smallest hash of their id; scoring reads all whole
texts. Null and empty texts have no features and get the grade distribution of an empty text. Repeated rows are
scored one by one; several labels of one id are each an example, and of several documents of one id the one with the smallest hash
of its text is learned from. Without labels every score is 0. An empty table gives an empty result. Extra columns, whatever their
names, stay out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import words as W

BITS, SAMPLE, SEEN = 18, 8_000, 8
GRADES, SEED = 3, 9
ROUNDS, RATE, SHRINK = 300, 0.5, 1e-4
TOXIC = 0.25  # expected severity from which a document counts as toxic


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    borders: np.ndarray  # ascending

    def grades(self, score: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-(self.borders[None, :] - score[:, None])))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of each distinct word of each text."""
    found = W.find_words(texts)
    bucket = (found.hash >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique((found.text_of() << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, n_columns: int) -> Model:
    """Proximal adaptive gradient steps (AdaGrad) on the mean log likelihood; rows and columns are the ones of a sparse matrix."""
    n = len(grade)
    w, squares = np.zeros(n_columns), np.zeros(n_columns)
    base, logs = 0.0, np.zeros(GRADES - 2)
    border_squares = np.zeros(GRADES - 1)

    def ends(b):
        full = np.concatenate([[-np.inf], b, [np.inf]])
        return full[grade], full[grade + 1]

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(ROUNDS):
        b = base + np.concatenate([[0.0], np.cumsum(np.exp(logs))])
        score = np.bincount(rows, w[columns], n)
        low, high = ends(b)
        f_low, f_high = sigmoid(low - score), sigmoid(high - score)
        f_low[grade == 0], f_high[grade == GRADES - 1] = 0.0, 1.0
        p = np.maximum(f_high - f_low, 1e-9)
        d_low, d_high = f_low * (1 - f_low), f_high * (1 - f_high)
        d_score = (d_high - d_low) / p / n  # of the loss, by the score
        g = np.bincount(columns, d_score[rows], n_columns)
        d_b = np.array([-(d_high[grade == k] / p[grade == k]).sum() + (d_low[grade == k + 1] / p[grade == k + 1]).sum() for k in range(GRADES - 1)]) / n
        squares += g * g
        rate = RATE / np.sqrt(squares + 1e-12)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK, 0)
        steps = np.array([d_b.sum(), *(d_b[k + 1 :].sum() * np.exp(logs[k]) for k in range(GRADES - 2))])
        border_squares += steps * steps
        steps *= RATE / np.sqrt(border_squares + 1e-12)
        base -= steps[0]
        logs -= steps[1:]
    return Model(w, base + np.concatenate([[0.0], np.cumsum(np.exp(logs))]))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from at most ``sample`` labelled documents."""
    ship(documents.sparkSession)
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    chosen = labels.filter("toxic is not null and doc_id is not null").select("doc_id", grade.alias("grade"), F.xxhash64(F.lit(SEED), "doc_id").alias("h")).orderBy("h", "grade").limit(sample)
    chosen = chosen.groupBy("doc_id", "grade", "h").agg(F.count(F.lit(1)).alias("times"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                row, bucket = buckets(part.column(0))
                at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], ["h", "grade", "times", "tie", "words"])

    # At most ``sample`` small rows are sent to all executors, whatever the tables' sizes, and as many come back.
    source = documents.filter("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    joined = source.join(F.broadcast(chosen), "doc_id").select("text", "h", "grade", "times", F.xxhash64("text").alias("tie"))
    coded = joined.mapInArrow(encode, "h long, grade int, times long, tie long, words array<int>")
    found = coded.groupBy("h", "grade", "times").agg(F.min_by("words", "tie").alias("words")).orderBy("h", "grade").toArrow()
    if found.num_rows == 0:
        return None
    times = np.repeat(np.arange(found.num_rows), found.column("times").to_numpy())
    words = found.column("words").combine_chunks().take(pa.array(times))
    lengths = np.array([len(x) for x in words])
    rows, columns = np.repeat(np.arange(len(lengths)), lengths), words.flatten().to_numpy()
    often = np.bincount(columns, minlength=1 << BITS) >= SEEN
    keep = often[columns]
    named = np.flatnonzero(often)
    model = fit_ordinal(rows[keep], np.searchsorted(named, columns[keep]), found.column("grade").to_numpy()[times].astype(np.int64), len(named))
    weights = np.zeros(1 << BITS)
    weights[named] = model.weights
    return Model(weights, model.borders)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, p_grade_1 and p_grade_2 (at least that grade), severity (expected grade), toxic."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in W.slices(batch):
                n = part.num_rows
                p = np.zeros((n, GRADES))
                if own is not None:
                    row, bucket = buckets(part.column(0))
                    p = own.grades(np.bincount(row, own.weights[bucket], n))
                severity = p @ np.arange(GRADES)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(p[:, 1:].sum(axis=1)), pa.array(p[:, 2]), pa.array(severity), pa.array(severity >= TOXIC)], ["doc_id", "p_grade_1", "p_grade_2", "severity", "toxic"])

    source = documents.select(F.col("text").cast("string").alias("text"), "doc_id")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, p_grade_1 double, p_grade_2 double, severity double, toxic boolean")
