"""Words and rolling hashes over the bytes of Arrow string arrays, without a Python loop over words.

A word is a maximal run of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters; in UTF-8
that is a rule on single bytes, so numpy finds all words of a batch at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so invertible modulo 2**64
WORD_BYTE = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
FILL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a word of eight
FOLD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LONG = 4096  # bytes of the longest run that is hashed eight bytes a step


def eights(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list]:
    """A hash of each run of bytes, scrambled after every eight of them, so that no rule on the bytes makes two runs meet; and
    the runs' words of eight bytes: of all runs the first, then (which runs, their next words). data ends with eight more bytes."""
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    first = eight[starts] & FILL[np.minimum(lengths, 8)]
    h = mix(first ^ (lengths.astype(np.uint64) * FOLD[0]))
    words, some, at = [first], np.flatnonzero(lengths > 8), 8
    while len(some):
        word = eight[starts[some] + at] & FILL[np.minimum(lengths[some] - at, 8)]
        h[some] = mix((h[some] + FOLD[1]) ^ word)
        words.append((some, word))
        at += 8
        some = some[lengths[some] > at]
    return h, words


def runs_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash of ``eights``; of runs longer than ``LONG`` the start of a BLAKE2b digest."""
    out, long = np.empty(len(starts), np.uint64), np.flatnonzero(lengths > LONG)
    short = np.flatnonzero(lengths <= LONG) if len(long) else slice(None)
    out[short] = eights(data, starts[short], lengths[short])[0]
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + lengths[i]], digest_size=8).digest(), "little")
    return out


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        m = 1 << (m - 1).bit_length()
        inverse = pow(base, -1, 1 << 64)
        up, down = np.empty(m, np.uint64), np.empty(m, np.uint64)
        for out, b in ((up, base), (down, inverse)):
            out[0] = 1
            k = 1
            while k < m:
                out[k : 2 * k] = out[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
        _powers[base] = have = (up, down)
    return have


def windows_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each window, whatever its place."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    hash: np.ndarray  # of each word
    first: np.ndarray  # for each text its first word's index; one more at the end
    n_texts: int
    low: np.ndarray  # all bytes in lower case, and eight more
    starts: np.ndarray  # of each word
    ends: np.ndarray

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """All words' bytes with a space after each, and where each word begins; one more at the end."""
        n = self.ends - self.starts
        upto = np.cumsum(n)
        at = np.concatenate([[0], upto + np.arange(1, len(n) + 1)])
        out = np.full(at[-1], 32, np.uint8)
        which = np.repeat(np.arange(len(n)), n)
        byte = np.arange(len(which))
        out[byte + which] = self.low[byte + (self.starts - (upto - n))[which]]
        return out, at

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.first))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and their offsets, without a copy; null is empty."""
    if pa.types.is_string(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    i = batch.schema.get_field_index(column)
    _, at = raw(batch.column(i))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, min(end, n) - start)
        start = end


def find_words(texts: pa.Array) -> Words:
    data, at = raw(texts)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = WORD_BYTE[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    before[at[:-1]] = False  # a text's first byte may start a word
    starts = np.flatnonzero(inside & ~before)
    # a word ends where the run ends or the next text begins
    ends_here = before | False
    ends_here[1:] = inside[:n]
    after = inside.copy()
    after[at[1:]] = False
    ends = np.flatnonzero(ends_here & ~after)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = LOWER[data]
    return Words(runs_hash(low, starts, ends - starts), np.searchsorted(starts, at), len(texts), low, starts, ends)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of ``size`` words; a text of fewer words, but not none, has one run."""
    counts = np.diff(words.first)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(words.n_texts), per)
    began = np.cumsum(per) - per
    starts = np.arange(len(text)) - began[text] + words.first[:-1][text]
    ends = starts + np.minimum(size, counts)[text]
    return windows_hash(words.hash, starts, ends, STEP), text
