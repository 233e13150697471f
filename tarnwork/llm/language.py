"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions; at every position the two states give a
distribution over the languages, and a document's distribution is the mean over its positions. It is trained
here, in numpy, by backpropagation through time, on pieces of a bounded sample of labelled rows (``SAMPLE`` documents,
those with the smallest hash of id and text, ``PIECES`` stretches of each from anywhere in the text).

Whole texts are read. So that a long one is not one long chain of steps, its positions are dealt to windows of ``CORE`` bytes, and
each direction starts up to ``MARGIN`` bytes before the window, so every position's states have read at least
that much of the text before and after it, or all there is. Windows of about one length are read together.

Gates are piecewise linear (clip(x / 4 + 1/2, 0, 1)), which costs a fraction of a sigmoid and trains as well.

Null texts and texts without a letter get ``und`` and score 0. Of languages with equal probability the first by name is taken. Repeated
rows are judged one by one; in the sample a row repeated in full counts once. If no labelled row is left to learn from, everything
is ``und``. An empty table gives an empty result. Extra columns, whatever their names, stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import words as W
from .store import filter_texts

SAMPLE, PIECES = 4_000, 12  # documents to learn from, and stretches of each
HIDDEN, STEPS, BATCH, ROUNDS, RATE = 8, 64, 256, 120, 0.02  # STEPS: bytes of a training window
CORE, MARGIN = 256, 64
AT_ONCE = 2048  # windows in memory
BYTES = 1 << 20  # of text read together
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    #: for each direction: byte -> input of the three gates, state -> same, bias of the candidate's state part
    parts: dict[str, np.ndarray]


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1, out=x)


def _states(data: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool = False, real: np.ndarray | None = None, skip: int = 0):
    """States of one direction, data being (steps, windows), without the first ``skip``; a state that has read
    nothing but places that are not ``real`` is zero. With ``keep`` also what backpropagation needs."""
    steps, n = data.shape
    hidden = u.shape[0]
    h = np.zeros((n, hidden), np.float32)
    out = np.empty((steps - skip, n, hidden), np.float32)
    kept, every = [], None if real is None else real.all(axis=1)
    for t in range(steps):
        x = table[data[t]]
        g = h @ u
        a = x[:, : 2 * hidden] + g[:, : 2 * hidden]
        gates = _gate(a.copy() if keep else a)
        z, r = gates[:, :hidden], gates[:, hidden:]
        s = g[:, 2 * hidden :]
        c = np.tanh(x[:, 2 * hidden :] + r * s)
        if keep:
            kept.append((h, a, z, r, s, c))
        h = c + z * (h - c)
        if every is not None and not every[t]:
            h *= real[t][:, None]
        if t >= skip:
            out[t - skip] = h
    return (out, kept) if keep else out


def _back(data: np.ndarray, u: np.ndarray, kept: list, d_out: np.ndarray, table_grad: np.ndarray) -> np.ndarray:
    """Gradient of u; adds that of the byte table."""
    hidden = u.shape[0]
    du = np.zeros_like(u)
    dh = np.zeros_like(d_out[0])
    for t in range(len(kept) - 1, -1, -1):
        h, a, z, r, s, c = kept[t]
        dh = dh + d_out[t]
        dz = dh * (h - c)
        dc = dh * (1 - z) * (1 - c * c)
        inside = (np.abs(a) < 2) * np.float32(0.25)
        dx = np.concatenate([dz * inside[:, :hidden], dc * s * inside[:, hidden:], dc], axis=1)
        dg = np.concatenate([dx[:, : 2 * hidden], dc * r], axis=1)
        np.add.at(table_grad, data[t], dx)
        du += h.T @ dg
        dh = dh * z + dg @ u.T
    return du


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, rounds: int = ROUNDS, seed: int = 5) -> Model:
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    n_out = max(1, len(languages))
    size = 0.5 / np.sqrt(hidden)
    parts = {}
    for d in "fb":
        parts["e" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        parts["u" + d] = rng.normal(0, size, (hidden, 3 * hidden)).astype(np.float32)
    parts["w"] = rng.normal(0, 0.1, (2 * hidden, n_out)).astype(np.float32)
    parts["b"] = np.zeros(n_out, np.float32)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    by = [[i for i, x in enumerate(labels) if x == k and len(data[i])] for k in languages]
    by = [(k, rows) for k, rows in enumerate(by) if rows]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    for step in range(1, rounds + 1 if len(by) > 1 else 1):
        block, gold = np.full((STEPS, BATCH), 32, np.uint8), np.empty(BATCH, np.int64)
        for j in range(BATCH):
            k, rows = by[rng.integers(len(by))]  # languages in equal shares
            x = data[rows[rng.integers(len(rows))]]
            at = int(rng.integers(max(1, len(x) - STEPS + 1)))
            part = x[at : at + STEPS]
            block[: len(part), j] = part
            gold[j] = k
        fwd, kept_f = _states(block, parts["ef"], parts["uf"], keep=True)
        bwd, kept_b = _states(block[::-1], parts["eb"], parts["ub"], keep=True)
        both = np.concatenate([fwd, bwd[::-1]], axis=2)
        p = _softmax(both @ parts["w"] + parts["b"])
        p[:, np.arange(BATCH), gold] -= 1
        d = (p / (STEPS * BATCH)).astype(np.float32)
        grad = {"w": both.reshape(-1, 2 * hidden).T @ d.reshape(-1, n_out), "b": d.sum((0, 1)), "ef": np.zeros_like(parts["ef"]), "eb": np.zeros_like(parts["eb"])}
        d_both = d @ parts["w"].T
        grad["uf"] = _back(block, parts["uf"], kept_f, d_both[:, :, :hidden], grad["ef"])
        grad["ub"] = _back(block[::-1], parts["ub"], kept_b, d_both[::-1, :, hidden:], grad["eb"])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            parts[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, parts)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def positions(model: Model, before: np.ndarray, after: np.ndarray, real: tuple[np.ndarray, np.ndarray] | None = None, margin: int = 0) -> np.ndarray:
    """(steps, windows, languages): the distribution at every position of the windows.

    ``before`` holds the windows' bytes after those of the margin, ``after`` before those of the margin behind; both are (steps, windows).
    """
    p = model.parts
    hidden = p["uf"].shape[0]
    real_before, real_after = real or (None, None)
    logits = _states(before, p["ef"], p["uf"], real=real_before, skip=margin) @ p["w"][:hidden]
    logits += (_states(after[::-1], p["eb"], p["ub"], real=None if real_after is None else real_after[::-1], skip=margin) @ p["w"][hidden:])[::-1]
    logits += p["b"]
    return _softmax(logits)


def distributions(model: Model, data: np.ndarray, at: np.ndarray, core: int = CORE, margin: int = MARGIN) -> np.ndarray:
    """Mean distribution over all bytes of each text; zeros for empty texts."""
    lengths = np.diff(at)
    per = -(-lengths // core)
    text = np.repeat(np.arange(len(lengths)), per)
    starts = at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * core
    ends = np.minimum(starts + core, at[1:][text])
    order = np.argsort(starts - ends, kind="stable")  # windows of one length together, long ones first
    total = np.zeros((len(lengths), len(model.languages)))
    padded = np.concatenate([np.full(margin, 32, np.uint8), data, np.full(margin + core, 32, np.uint8)])
    for i in range(0, len(text), AT_ONCE):
        s, e, own = starts[order[i : i + AT_ONCE]], ends[order[i : i + AT_ONCE]], text[order[i : i + AT_ONCE]]
        low, high, steps = at[:-1][own], at[1:][own], int((e - s).max())
        before, after = s + np.arange(-margin, steps)[:, None], s + np.arange(steps + margin)[:, None]
        p = positions(model, padded[before + margin], padded[after + margin], ((before >= low) & (before < high), (after >= low) & (after < high)), margin)
        p = np.einsum("tnl,tn->nl", p, (after[:steps] < e).astype(np.float32))
        for k in range(p.shape[1]):
            total[:, k] += np.bincount(own, p[:, k], len(lengths))
    return total / np.maximum(lengths, 1)[:, None]


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(documents: DataFrame, sample: int = SAMPLE, pieces: int = PIECES) -> Model:
    """Learns from at most ``sample`` labelled documents, those with the smallest hash, none held out: ``pieces`` stretches of each."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(True)))
    text = F.col("text").cast("string")
    # The hashes' share that holds about ``sample`` rows is known from their number, so no task sends more than its part.
    h = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", text), 2)
    share = min(1.0, sample / max(1, rows.count()))
    room = F.greatest(F.length(text) - STEPS + 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda i: F.substring(text, (F.pmod(F.xxhash64(i, "doc_id"), room) + 1).cast("int"), F.lit(STEPS)))
    some = rows.select(h.alias("h"), F.col("lang").cast("string").alias("lang"), cut.alias("cut")).filter(F.col("h") <= F.lit(int(share * 2**62)))
    # Rows repeated in full have one hash and come once, so what is sent stays near ``sample`` rows whatever repeats.
    once = some.groupBy("h").agg(F.min_by("cut", "lang").alias("cut"), F.min("lang").alias("lang"))
    chosen = sorted(once.collect(), key=lambda r: r.h)[:sample]
    return train([x.encode() for r in chosen for x in r.cut], [r.lang for r in chosen for _ in r.cut])


def _verdicts(model: Model, texts: pa.Array, letters: pa.Array) -> tuple[list[str], np.ndarray]:
    data, at = W.raw(texts)
    some = np.array(letters.to_pylist(), bool) & bool(model.languages)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = distributions(model, data, at)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(p.argmax(axis=1).tolist(), some, strict=True)]
    return names, np.where(some, np.clip(p.max(axis=1), 0, 1), 0.0)


def _letters() -> Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, in one Arrow pass."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))  # a few thousand numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, most=BYTES):
                names, score = _verdicts(shared.value, part.column(0), part.column(1))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    source = documents.select(F.col("text").cast("string").alias("text"), _letters().alias("letters"), "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def readable(documents: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language can be told: neither ``und`` nor scored below ``least``, with all their columns.

    Each row is judged by its own text and goes on or not where it is, without a shuffle.
    """
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))  # a few thousand numbers, whatever the input

    def decide():
        def keep(part: pa.RecordBatch) -> np.ndarray:
            names, score = _verdicts(shared.value, part.column(0), part.column(1))
            return np.array([n != UNKNOWN for n in names], bool) & (score >= least)

        return keep

    return filter_texts(documents, [_letters()], decide, most=BYTES)
