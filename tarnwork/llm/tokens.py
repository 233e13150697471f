"""Token ids in binary shards, compressed by a Re-Pair grammar.

Texts are encoded with a public tokenizer; each document ends with an end id. Documents go in ascending order of
doc_id (null first; repeated ids by a hash of their text) to ranges, and each range is cut into shards of about ``SHARD_IDS``
ids (a longer document is one shard). A shard has its own grammar and is one binary payload:

    magic "RPB2", then five unsigned 32-bit counts: documents, ids, rules, symbols, first nonterminal
    documents: doc_id (signed 64-bit), null flag (1 byte), number of ids (64-bit)
    rules: all left symbols and then all right ones, expansion lengths (unsigned 32-bit each)
    symbols: the sequence (unsigned 32-bit)

Of unsigned 32-bit numbers all low halves are stored before all high ones. The grammar replaces repeated neighbours
by nonterminals, again and again. Each round replaces all pairs above a falling bar at once; of pairs that overlap the
more frequent one goes first. It ends when no pair is there twice without overlap. Expansion lengths let
``Shard.ids(start, end)`` decode any stretch without the rest, and ``fetch`` single documents. Payloads are kept as rows of a Parquet
table (part, shard, n_ids, lowest, highest, payload) in the shared folder, so writing is atomic and any file system will do.

Null text is empty: its document holds the end id alone. An empty table writes no shard. Rows repeated in full are written as
often as they occur. Very long texts are encoded whole, within one task. Extra columns stay out of the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from . import words as W
from .store import new_path, partitions

END, SHARD_IDS = 1, 1 << 20
LEAST, FALL = 2, 0.5  # occurrences a pair must have at last, and how much lower each round's bar is
MIX32 = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
MAGIC = b"RPB2"
MOST_CACHED = 2_000_000  # distinct pieces a worker remembers, about 60 bytes each
LONG = 64  # bytes of the longest piece that is looked up
#: Bytes of texts that byte rules alone can cut: white space, printable ASCII, and Latin-1 letters (0xC3 and one more byte).
PLAIN = np.array([c in (9, 10, 13) or 32 <= c < 127 for c in range(256)])
SECOND = np.array([0x80 <= c <= 0xBF and c not in (0x97, 0xB7) for c in range(256)])
#: The characters that stand for bytes in byte-level models: printable Latin-1 for itself, the rest in order from 256 on.
OWN = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
BYTE_CHARACTERS = {c: c for c in OWN} | {c: 256 + i for i, c in enumerate(sorted(set(range(256)) - set(OWN)))}
SPACE, LETTER, DIGIT, SIGN = range(4)
KIND = np.array([SPACE if c in (9, 10, 13, 32) else DIGIT if 48 <= c <= 57 else LETTER if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else SIGN for c in range(256)], np.int8)


def unusual(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts with other scripts, control characters or marks of special tokens."""
    bad = ~PLAIN[data]
    far = np.flatnonzero(bad)
    if len(far):
        first = data[far] == 0xC3
        after = (far > 0) & (data[far - 1] == 0xC3) & SECOND[data[far]]
        before = first & SECOND[data[np.minimum(far + 1, len(data) - 1)]]
        far = far[~(after | before)]
    angle = np.flatnonzero(data == 60)
    angle = angle[data[np.minimum(angle + 1, len(data) - 1)] == 124]
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, np.concatenate([far, angle]), side="right") - 1] = True
    return out


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's own pre-tokens in usual texts: runs of letters, single digits, runs of signs, and an
    apostrophe that begins a run of signs by itself together with s, t, re, ve, m, ll or d after it."""
    n = len(data)
    kind = np.full(n + 1, SPACE, np.int8)
    kind[:n] = KIND[data]
    new = np.ones(n + 1, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= kind == DIGIT
    new[at] = True
    edges = np.flatnonzero(new)  # n is one of them
    starts, ends = edges[:-1], edges[1:]
    inked = kind[starts] != SPACE
    starts, ends = starts[inked], ends[inked]
    alone = np.flatnonzero((ends - starts == 1) & (data[starts] == 39))
    alone = alone[alone + 1 < len(starts)]
    alone = alone[(starts[alone + 1] == ends[alone]) & (kind[starts[alone + 1]] == LETTER)]
    # A text's border between apostrophe and letters parts them.
    alone = alone[~np.isin(ends[alone], at)] if len(alone) else alone
    if len(alone):
        follow = starts[alone + 1]
        first = W.LOWER[data[follow]]
        second = np.where(ends[alone + 1] - follow > 1, W.LOWER[data[np.minimum(follow + 1, n - 1)]], 0)
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        some, taken = alone[one | two], np.where(one, 1, 2)[one | two]
        ends[some] += taken
        starts[some + 1] += taken
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class Pieces:
    """What is known of each distinct piece. An open-addressing table finds pieces by a hash, and every find is compared with
    the piece's own bytes, so pieces of equal hash stay apart."""

    WORD, LENGTH, N, FIRST, REST = range(5)  # first 8 bytes, bytes, ids, where these begin, where the other 8-byte words begin

    def __init__(self) -> None:
        self.size, self.n_ids, self.n_rest = 0, 0, 0
        self.hash, self.rows = np.zeros(1 << 12, np.uint64), np.zeros((1 << 12, 5), np.uint64)
        self.ids, self.rest = np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.uint64)
        self.bits = 15
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def keys(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list]:
        return W.eights(data, starts, lengths)

    def find(self, h: np.ndarray, words: list, lengths: np.ndarray) -> np.ndarray:
        """The number of each piece; -1 where it is not known, -2 where another piece has its hash, first word and length."""
        size = lengths.astype(np.uint64)

        def look(slot: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found = self.slots[slot]
            row = self.rows.take(found, 0, mode="wrap")
            same = (row[:, self.WORD] == word) & (row[:, self.LENGTH] == n)
            return found, same & (found >= 0), np.flatnonzero(~same & (found >= 0))

        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found, same, left = look(slot, words[0], size)
        out = np.where(same, found, np.int32(-1))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            found, same, more = look(slot[left], words[0][left], size[left])
            out[left[same]] = found[same]
            left = left[more]
        for j, (some, word) in enumerate(words[1:]):
            own = out[some]
            known = np.flatnonzero(own >= 0)
            wrong = self.rest[self.rows[own[known], self.REST].astype(np.int64) + j] != word[known]
            out[some[known[wrong]]] = -2
        return out

    def add(self, h: np.ndarray, words: list, lengths: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Pieces of different hashes, none of them known."""
        k, upto = self.size, self.size + len(h)
        more = np.maximum((lengths.astype(np.int64) + 7) // 8 - 1, 0)
        self.hash, self.rows = _room(self.hash, upto), _room(self.rows, upto)
        self.ids, self.rest = _room(self.ids, self.n_ids + len(ids)), _room(self.rest, self.n_rest + int(more.sum()) + 1)
        first, rest = self.n_ids + np.cumsum(counts, dtype=np.int64) - counts, self.n_rest + np.cumsum(more) - more
        self.hash[k:upto] = h
        for column, values in ((self.WORD, words[0]), (self.LENGTH, lengths), (self.N, counts), (self.FIRST, first), (self.REST, rest)):
            self.rows[k:upto, column] = values
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        for j, (some, word) in enumerate(words[1:]):
            self.rest[rest[some] + j] = word
        self.n_ids, self.n_rest, self.size = self.n_ids + len(ids), self.n_rest + int(more.sum()), upto
        if 3 * self.size > len(self.slots):
            self.bits = (4 * self.size).bit_length()
            self.slots, k = np.full(1 << self.bits, -1, np.int32), 0
        new = np.arange(k, upto, dtype=np.int32)
        slot = (self.hash[k:upto] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            lost = self.slots[slot] != new
            new, slot = new[lost], (slot[lost] + 1) & (len(self.slots) - 1)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros((max(n, 2 * len(x)), *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


def _of(words: list, rows: np.ndarray) -> list:
    """The words of some rows alone, given in ascending order."""
    out = []
    for some, word in words:
        at = np.searchsorted(rows, some)
        mine = np.flatnonzero(rows[np.minimum(at, len(rows) - 1)] == some)
        out.append((at[mine], word[mine]))
    return out


class Encoder:
    """ids of texts. Pre-tokens are encoded by themselves, so each distinct one is encoded once a worker; texts with anything
    unusual, and those with a piece of over ``LONG`` bytes, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def codes(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids. The model takes a byte as one character."""
        tokenize = self.tokenizer.model.tokenize
        found = [[x.id for x in tokenize(p.encode().decode("latin-1").translate(BYTE_CHARACTERS))] for p in pieces]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32)

    def _numbers(self, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each piece; unknown ones are learned."""
        h, words = self.pieces.keys(low, starts, lengths)
        place = self.pieces.find(h, words, lengths)
        new = np.flatnonzero(place == -1)
        if len(new):
            keys, example, group = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[example]
            text = [low[a : a + n].tobytes().decode().lower() for a, n in zip(starts[one].tolist(), lengths[one].tolist(), strict=True)]
            before = self.pieces.size
            _, own = self.pieces.keys(low, starts[one], lengths[one])
            self.pieces.add(keys, own, lengths[one], *self.codes(text))
            place[new] = before + group
            # A piece that is not its group's example has the example's hash by chance alone.
            again = self.pieces.find(h[new], [words[0][new], *_of(words[1:], new)], lengths[new])
            place[new] = np.where(again == before + group, again, -2)
        return place

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """texts has no null."""
        if self.pieces.size > MOST_CACHED:
            self.pieces = Pieces()
        data, at = W.raw(texts)
        usual = ~unusual(data, at)
        starts, ends = cut(data, at)
        lengths = ends - starts
        usual[np.searchsorted(at, starts[lengths > LONG], side="right") - 1] = False
        inside = np.repeat(usual, np.diff(np.searchsorted(starts, at)))
        starts, lengths = (starts, lengths) if usual.all() else (starts[inside], lengths[inside])
        low = np.zeros(len(data) + 8, np.uint8)
        low[: len(data)] = W.LOWER[data]
        place = self._numbers(low, starts, lengths)
        # A piece whose hash another piece has (never seen but in tests) sends its text to the tokenizer.
        usual[np.searchsorted(at, starts[place == -2], side="right") - 1] = False
        row = self.pieces.rows.take(place, 0, mode="wrap").view(np.int64)
        n, upto = row[:, Pieces.N], np.zeros(len(place) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        ids = self.pieces.ids[np.repeat(row[:, Pieces.FIRST] - upto[:-1], n) + np.arange(upto[-1])]
        borders = upto[np.searchsorted(starts, at)].tolist()
        return [ids[borders[i] : borders[i + 1]] if ok else self.whole(texts[i].as_py()) for i, ok in enumerate(usual.tolist())]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, so that what a task learns serves the next ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair at least how often it is there: the count of its bin."""
    bits = max(10, min(22, len(a).bit_length() + 1))
    h = a.view(np.uint32) * MIX32[0]
    h ^= h >> np.uint32(15)
    h += b.view(np.uint32)
    h *= MIX32[1]
    h ^= h >> np.uint32(13)
    h *= MIX32[0]
    h >>= np.uint32(32 - bits)
    return np.bincount(h, minlength=1 << bits).astype(np.int32)[h]


def _every_second(at: np.ndarray, same: np.ndarray) -> np.ndarray:
    """False for pairs of equal symbols that overlap the one before in a run, which is counted."""
    out = np.ones(len(at), bool)
    some = np.flatnonzero(same)
    if len(some):
        p = at[some]
        new = np.ones(len(p), bool)
        new[1:] = np.diff(p) > 1
        began = p[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        out[some] = (p - began) % 2 == 0
    return out


def repair(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, rules (pairs) and the first nonterminal. No pair of symbols is left ``LEAST`` times without overlap.

    Two old symbols never become neighbours, so a pair's count only falls after the round in which it was made. Each
    position therefore keeps a bound of its pair's count, and a round counts exactly only pairs whose bound reaches the bar.
    """
    first = int(ids.max(initial=0)) + 1
    if first + len(ids) >= 1 << 31:
        raise ValueError("token ids are too large for 31-bit symbols")
    symbols, bounds = ids.astype(np.int32), np.zeros(len(ids), np.int32)  # bounds: of the pair that begins here
    if len(ids) > 1:
        bounds[:-1] = _bound(symbols[:-1], symbols[1:])
    rules, n_rules = [np.zeros((0, 2), np.int64)], 0
    bar = max(LEAST, int(bounds.max(initial=0) * FALL))
    while True:
        at = np.flatnonzero(bounds >= bar)
        a, b = symbols[at], symbols[at + 1]  # the last position has bound 0
        if len(at):
            bound = _bound(a, b)
            bounds[at] = bound
            able = bound >= bar
            at, a, b = at[able], a[able], b[able]
        good = np.zeros(1, bool)
        if len(at):
            pairs = a.astype(np.int64) << 32 | b
            order = np.argsort(pairs)
            pairs = pairs[order]
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            which = np.empty(len(pairs), np.int32)
            which[order] = np.cumsum(new, dtype=np.int32) - 1
            keys = pairs[new]
            apart = _every_second(at, a == b)
            n = np.bincount(which[apart], minlength=len(keys))
            bounds[at] = n[which]
            # More frequent pairs go first, equal ones in hash order, else an ascending passage would fall one pair a round.
            rank = np.empty(len(keys), np.int32)
            rank[np.argsort(n.astype(np.uint64) << np.uint64(32) | (keys.view(np.uint64) * W.FOLD[0]) >> np.uint64(32))] = np.arange(len(keys), dtype=np.int32)
            rank[n < bar] = -1
            own = np.where(apart, rank[which], -1)
            near = np.flatnonzero(np.diff(at) == 1)
            left, right = np.full(len(at), -1), np.full(len(at), -1)
            left[near + 1], right[near] = own[near], own[near + 1]
            won = (own >= 0) & (own > left) & (own > right)
            good = np.bincount(which[won], minlength=len(keys)) >= LEAST
        if good.any():
            won &= good[which]
            chosen, place = keys[good], at[won]
            rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1))
            symbols[place] = first + n_rules - 1 + np.cumsum(good)[which[won]]
            n_rules += len(chosen)
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, bounds = symbols[keep], bounds[keep]
            # Pairs before and after each new symbol are new; they are as many times there as they were made now.
            place -= np.arange(len(place))
            made = np.stack([place - 1, place], 1).ravel()
            fresh = np.ones(len(made), bool)
            fresh[1:] = made[1:] != made[:-1]
            made = made[fresh & (made >= 0) & (made < len(symbols) - 1)]
            bounds[-1] = 0
            if len(made):
                bounds[made] = _bound(symbols[made], symbols[made + 1])
        elif bar == LEAST:
            break
        bar = max(LEAST, int(bar * FALL))
    return symbols.astype(np.int64), np.concatenate(rules), first


def _halves(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as all their low 16 bits, then all their high ones, which compress well."""
    return x.astype("<u4").reshape(-1, 1).view("<u2").T.tobytes()


def _whole(payload: bytes, n: int, at: int) -> np.ndarray:
    low, high = np.frombuffer(payload, "<u2", 2 * n, at).reshape(2, n)
    return low | high.astype("<u4") << 16


def pack(doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts)
    symbols, rules, first = repair(ids)
    side = np.where(rules < first, len(rules), rules - first)
    lengths, before = np.ones(len(rules) + 1, np.int64), None
    while before is None or (lengths != before).any():  # as often as rules are nested
        before, lengths = lengths, np.append(lengths[side].sum(1), 1)
    docs = np.zeros(len(parts), [("id", "<i8"), ("null", "u1"), ("n", "<i8")])
    docs["id"], docs["null"], docs["n"] = [d or 0 for d in doc_ids], [d is None for d in doc_ids], [len(p) for p in parts]
    head = MAGIC + struct.pack("<5I", len(parts), len(ids), len(rules), len(symbols), first)
    return head + docs.tobytes() + _halves(rules.T.ravel()) + _halves(lengths[:-1]) + _halves(symbols)


class Shard:
    """A payload, read."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        n_docs, self.n_ids, n_rules, n_symbols, self.first = struct.unpack_from("<5I", payload, 4)
        at = 24
        kind = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8")])
        self.docs = np.frombuffer(payload, kind, n_docs, at)
        at += n_docs * kind.itemsize
        self.rules = _whole(payload, 2 * n_rules, at).reshape(2, n_rules).T
        self._left, self._right = self.rules[:, 0].astype(np.int64), self.rules[:, 1].astype(np.int64)
        at += 8 * n_rules
        self.lengths = _whole(payload, n_rules, at)
        at += 4 * n_rules
        self.symbols = _whole(payload, n_symbols, at)
        self._sizes = np.append(self.lengths.astype(np.int64), 1)  # -1, which is the last one, stands for an id
        self._ends: np.ndarray | None = None

    def doc_ids(self) -> pa.Array:
        return pa.array(self.docs["id"].astype(np.int64), mask=self.docs["null"] == 1)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        return self._sizes[np.maximum(symbols - self.first, -1)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        n = self.sizes(symbols)
        at, out = np.cumsum(n) - n, np.empty(int(n.sum()), "<u4")
        while len(symbols):  # ids go to their places; sides of rules wait for the next turn
            rule = symbols >= self.first
            plain = ~rule
            out[at[plain]] = symbols[plain]
            pair, at = symbols[rule] - self.first, at[rule]
            left = self._left[pair]
            symbols, at = np.concatenate([left, self._right[pair]]), np.concatenate([at, at + self.sizes(left)])
        return out

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids start to end: only symbols that reach into this stretch are expanded."""
        if end <= start:
            return np.zeros(0, "<u4")
        if self._ends is None:
            self._ends = np.cumsum(self.sizes(self.symbols.astype(np.int64)))
        a, b = np.searchsorted(self._ends, start, side="right"), np.searchsorted(self._ends, end, side="left") + 1
        before = int(self._ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : end - before]


def _bounds(documents: DataFrame, n: int) -> list[int]:
    """At most n - 1 values of doc_id that cut the table in parts of about as many rows."""
    if n < 2:
        return []
    cuts = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def write(documents: DataFrame, tokenizer: str, path: str, parts: int | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encodes whole texts and writes the shards to ``path``."""
    spark = documents.sparkSession
    ship(spark)
    bounds = np.array(_bounds(documents, parts or partitions(spark)), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for some in W.slices(batch):
                codes = [np.append(x, np.uint32(end)).astype("<u4", copy=False).tobytes() for x in encoder.encode(some.column(2).fill_null(""))]
                part = np.searchsorted(bounds, some.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), some.column(0), some.column(1), pa.array(codes, pa.binary())], ["part", "doc_id", "tie", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, docs, codes, n = None, 0, [], [], 0

        def flush():
            known = [d for d in docs if d is not None]
            row = [(part, pa.int32()), (shard, pa.int32()), (n, pa.int64()), (min(known, default=None), pa.int64()), (max(known, default=None), pa.int64()), (pack(docs, codes), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in row], ["part", "shard", "n_ids", "lowest", "highest", "payload"])

        for batch in batches:
            for p, d, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if docs and (p != part or n >= shard_ids):
                    yield flush()
                    docs, codes, n, shard = [], [], 0, shard + 1
                if p != part:
                    part, shard = p, 0
                ids = np.frombuffer(code.as_buffer(), "<u4")
                docs.append(d), codes.append(ids)
                n += len(ids)
        if docs:
            yield flush()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    coded = source.mapInArrow(encode, "part int, doc_id long, tie long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    made = dealt.select("part", "doc_id", "ids").mapInArrow(shards, "part int, shard int, n_ids long, lowest long, highest long, payload binary")
    made.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``."""
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, s, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = Shard(payload.as_py())
                ids = own.ids(0, own.n_ids)
                ends = np.cumsum(own.docs["n"])
                starts = ends - own.docs["n"]
                crc = [zlib.crc32(memoryview(ids[i:j])) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.as_py()] * n, pa.int32()), pa.array([s.as_py()] * n, pa.int32()), own.doc_ids(), pa.array(starts), pa.array(own.docs["n"].astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    files = spark.read.parquet(path)
    decoded = files.select("part", "shard", "payload").mapInArrow(decode, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Where each shard begins: sums by part first, so no window holds more than the parts or one part's shards.
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("_p"), earlier(Window.orderBy("part")).alias("_pa"))
    shard = files.select(F.col("part").alias("_sp"), F.col("shard").alias("_s"), F.col("n_ids").alias("n")).withColumn("_sa", earlier(Window.partitionBy("_sp").orderBy("_s")))
    at = shard.join(part, shard["_sp"] == part["_p"]).select("_sp", "_s", (F.col("_pa") + F.col("_sa")).alias("_at"))
    placed = decoded.join(at, (decoded["part"] == at["_sp"]) & (decoded["shard"] == at["_s"]))
    return placed.select("doc_id", (F.col("_at") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the named documents. Shards that cannot hold them are not read, and of the others only
    the symbols that reach into a wanted document are expanded."""
    ship(spark)
    wanted = np.unique(np.array(doc_ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                own = Shard(payload.as_py())
                ends = np.cumsum(own.docs["n"])
                some = np.flatnonzero(np.isin(own.docs["id"], wanted) & (own.docs["null"] == 0))
                ids = [own.ids(int(ends[i] - own.docs["n"][i]), int(ends[i])).tolist() for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([own.doc_ids().take(pa.array(some)), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    near = reduce(or_, [(F.col("lowest") <= d) & (F.col("highest") >= d) for d in wanted.tolist()], F.lit(False))
    return spark.read.parquet(path).filter(near).select("payload").mapInArrow(run, "doc_id long, ids array<long>")


def encode_and_read(documents: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(documents.sparkSession, "token-shards")
    write(documents, tokenizer, path)
    return read(documents.sparkSession, path)
