"""Benchmark decontamination as a prefix-filtered set join.

Every window (ten consecutive words of an item; a shorter item is one window) is a set of word
shingles that a document must contain whole. For exact containment one prefix token is enough, so a
window is filed under its rarest shingle, rarity being counted over all documents. A document
looks up its own shingles among those prefix tokens; a match fixes where the window would start
(positional bound), which must leave room for all its words (length bound); what is left is verified
by comparing the words' bytes, so hashes only propose. Windows go to the executors in blocks of ``block_windows``, so what is
broadcast is bounded whatever the benchmark's size; the driver holds one block at a time, and blocks' results, which are written
to the shared folder, are merged by document.

Null and empty texts, and items without words, have no windows and hit nothing. Very long texts are read whole, one at a time.
Repeated documents are judged one by one, repeated items each count. An empty benchmark hits nothing, an empty table
gives no row. Extra columns, whatever their names, stay out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import words as W
from .store import filter_texts, materialise, new_path

WINDOW, TOKEN = 10, 3  # words of a window, and of the shingles that make up its set
BLOCK_WINDOWS = 200_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SCHEMA = "row string, doc_id long, n_words long, hits array<int>, items array<long>"


class Windows:
    """The distinct windows of benchmark items: shingle hashes, bytes (a space after each word), and owners."""

    def __init__(self, rows: list[tuple], window: int, token: int):
        self.token = token
        found = W.find_words(pa.array([t for _, t in rows], pa.string()))
        plain, at = found.plain()
        whole = plain.tobytes()
        keys: dict[bytes, int] = {}
        owners: list[dict] = []
        hashes: list[np.ndarray] = []
        for k, (item, _) in enumerate(rows):
            low, high = int(found.first[k]), int(found.first[k + 1])
            for i in range(low, low + max(high - low - window + 1, min(high - low, 1))):
                j = min(i + window, high)
                own = keys.setdefault(whole[at[i] : at[j]], len(keys))
                if own == len(owners):
                    owners.append({})
                    hashes.append(found.hash[i:j])
                owners[own][item] = None
        self.items = [list(x) for x in owners]
        self.words = hashes
        self.n_words = np.array([len(x) for x in hashes], np.int64)
        self.n_bytes = np.array([len(x) for x in keys], np.int64)
        self.bytes = np.frombuffer(b"".join(keys), np.uint8)
        self.begins = np.cumsum(self.n_bytes) - self.n_bytes

    def equal(self, plain: np.ndarray, at: np.ndarray, k: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
        """Whether window k[i] stands at plain[at[i]:], all bytes compared, about ``chunk`` of them at once."""
        out = np.ones(len(k), bool)
        n = self.n_bytes[k]
        upto = np.cumsum(n)
        start = 0
        while start < len(k):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + chunk)))
            size = n[start:end]
            which = np.repeat(np.arange(len(size)), size)
            byte = np.arange(len(which)) - (np.cumsum(size) - size)[which]
            wrong = which[plain[at[start:end][which] + byte] != self.bytes[self.begins[k[start:end]][which] + byte]]
            out[start + wrong] = False
            start = end
        return out

    def tokens(self, k: int) -> np.ndarray:
        h = self.words[k]
        size = min(self.token, len(h))
        starts = np.arange(len(h) - size + 1)
        return W.windows_hash(h, starts, starts + size, W.STEP)

    def by_size(self) -> dict[int, np.ndarray]:
        sets: dict[int, set] = {}
        for k, h in enumerate(self.words):
            sets.setdefault(min(self.token, len(h)), set()).update(self.tokens(k).tolist())
        return {n: np.array(sorted(x), np.uint64) for n, x in sets.items()}

    def prefix(self, counts: dict[int, int]) -> dict[int, dict]:
        """By size of the prefix token: its sorted hashes with the windows filed under each."""
        filed: dict[int, dict[int, list]] = {}
        for k, h in enumerate(self.words):
            tokens = self.tokens(k)
            at = min(range(len(tokens)), key=lambda i: (counts.get(int(tokens[i]), 0), int(tokens[i])))
            filed.setdefault(min(self.token, len(h)), {}).setdefault(int(tokens[at]), []).append((k, at))
        out = {}
        for size, table in filed.items():
            keys = np.array(sorted(table), np.uint64)
            flat = [x for key in keys.tolist() for x in table[key]]
            n = np.array([len(table[key]) for key in keys.tolist()])
            out[size] = {"keys": keys, "first": np.cumsum(n) - n, "n": n, "window": np.array([x[0] for x in flat]), "shift": np.array([x[1] for x in flat])}
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, gate: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in values that hold a key, and which key; a bitmap keeps most values from the binary search."""
    maybe = np.flatnonzero(gate[(values >> np.uint64(64 - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
    good = keys[at] == values[maybe]
    return maybe[good], at[good]


def _gate(keys: np.ndarray) -> tuple[np.ndarray, int]:
    bits = min(22, max(12, int(len(keys)).bit_length() + 6))
    gate = np.zeros(1 << bits, bool)
    gate[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return gate, bits


def _frequency(documents: DataFrame, tokens: dict[int, np.ndarray]) -> dict[int, int]:
    """How often each benchmark shingle occurs in all documents; only those shingles are counted and sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gates = {size: _gate(keys) for size, keys in tokens.items()}
        total = {size: np.zeros(len(keys), np.int64) for size, keys in tokens.items()}
        for batch in batches:
            for part in W.slices(batch):
                found = W.find_words(part.column(0))
                for size, keys in tokens.items():
                    values, _ = W.shingles(found, size)
                    _, which = _lookup(keys, values, *gates[size])
                    total[size] += np.bincount(which, minlength=len(keys))
        for size, keys in tokens.items():
            some = np.flatnonzero(total[size])
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[size][some])], ["token", "n"])

    counted = documents.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {row.token & W.MASK: row.n for row in counted.toLocalIterator()}


class Finder:
    """Where windows occur in texts."""

    def __init__(self, windows: Windows, filed: dict):
        self.windows, self.filed = windows, filed
        self.gates = {size: _gate(table["keys"]) for size, table in filed.items()}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' numbers of words; for each occurrence its text, the word where it begins, and its window."""
        lengths, found = self.windows.n_words, W.find_words(texts)
        counts, plain = np.diff(found.first), None
        texts_, starts, which = [], [], []
        for size, table in self.filed.items():
            per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
            began = np.cumsum(per) - per
            values, text = W.shingles(found, size)
            place, key = _lookup(table["keys"], values, *self.gates[size])
            if not len(place):
                continue
            plain = plain or found.plain()
            n = table["n"][key]
            pick = np.repeat(table["first"][key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(place, n)
            doc, k = text[place], table["window"][pick]
            start = place - began[doc] - table["shift"][pick]  # word of the document where the window would begin
            fits = np.flatnonzero((start >= 0) & (start + lengths[k] <= counts[doc]))
            doc, k, start = doc[fits], k[fits], start[fits]
            word = found.first[doc] + start
            fits = plain[1][word + lengths[k]] - plain[1][word] == self.windows.n_bytes[k]
            doc, k, start, word = doc[fits], k[fits], start[fits], word[fits]
            same = self.windows.equal(plain[0], plain[1][word], k)
            texts_.append(doc[same]), starts.append(start[same]), which.append(k[same])
        doc, start, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (texts_, starts, which))
        return counts, doc, start, k


def _judge(documents: DataFrame, windows: Windows, filed: dict, keep_all: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((windows, filed))  # at most one block of windows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value[0]
        find = Finder(*shared.value)
        for batch in batches:
            for part in W.slices(batch):
                counts, doc, start, k = find(part.column(2))
                hits: dict[int, tuple[set, set]] = {}
                for d, s, w in zip(doc.tolist(), start.tolist(), k.tolist(), strict=True):
                    places, own = hits.setdefault(d, (set(), set()))
                    places.update(range(s, s + int(windows.n_words[w])))
                    own.update(windows.items[w])
                rows = range(part.num_rows) if keep_all else sorted(hits)
                take = pa.array(list(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), part.column(1).take(take), pa.array(counts[list(rows)].astype(np.int64)),
                        pa.array([sorted(hits[r][0]) if r in hits else [] for r in rows], pa.list_(pa.int32())),
                        pa.array([sorted(hits[r][1]) if r in hits else [] for r in rows], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n_words", "hits", "items"],
                )

    return documents.select("row", "doc_id", "text").mapInArrow(judge, SCHEMA)


def _blocks(benchmark: DataFrame, block_windows: int) -> Iterator[tuple[list[tuple], bool]]:
    """Items in blocks of about ``block_windows`` words, and whether a block is the last; one at least, which may be empty."""
    block, size = [], 0
    for row in benchmark.filter("text is not null").select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        if size >= block_windows:
            yield block, False
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += row.text.count(" ") + 1
    yield block, True


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, token: int = TOKEN, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ship(documents.sparkSession)
    # With one block no merge is needed, so rows need no key of their own.
    source = documents.select(F.lit("").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, path = None, None
    for k, (rows, last) in enumerate(_blocks(benchmark, block_windows)):
        if k == 0 and not last:
            source, path = materialise(source.withColumn("row", F.expr("uuid()")), "decontaminate-rows"), new_path(source.sparkSession, "decontaminate-hits")
        windows = Windows(rows, window, token)
        sets = windows.by_size()
        filed = windows.prefix(_frequency(source, sets)) if sets else {}
        found = _judge(source, windows, filed, keep_all=k == 0)
        if path is not None:
            found.write.mode("append").parquet(path)
    if path is not None:
        found = source.sparkSession.read.schema(SCHEMA).parquet(path).groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, token: int = TOKEN, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns; each row is judged by its own text, without a shuffle."""
    ship(documents.sparkSession)
    kept = documents
    for rows, _ in _blocks(benchmark, block_windows):
        windows = Windows(rows, window, token)
        sets = windows.by_size()
        if sets:
            kept = _without(kept, windows, windows.prefix(_frequency(documents.select(F.col("text").cast("string").alias("text")), sets)))
    return kept


def _without(documents: DataFrame, windows: Windows, filed: dict) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((windows, filed))  # at most one block of windows

    def decide():
        find = Finder(*shared.value)

        def keep(part: pa.RecordBatch) -> np.ndarray:
            out = np.ones(part.num_rows, bool)
            out[find(part.column(0))[1]] = False
            return out

        return keep

    return filter_texts(documents, [], decide)
