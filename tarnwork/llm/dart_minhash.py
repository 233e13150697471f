"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Documents are weighted sets: five-word shingles (all words of a shorter text), weighted by how often they
occur. Similarity is the weighted Jaccard index, sum of minima over sum of maxima, and links need 0.8.

Signature: hashed darts fall into the region (weight, rank) of each element. A cell of unit weight gets
darts at the ranks of a unit Poisson process, all drawn from a hash of (element, cell), so documents that share
a cell share its darts; a cell filled in part keeps the darts within its weight. A document throws darts up to a
rank of about k (ln k + 3) over its total weight, each falls on one of k coordinates, and every coordinate
keeps its earliest dart (ranks are extended until none is empty). Two documents agree on a coordinate with
probability equal to their similarity. Work is linear in the elements plus k ln k.

Joining: 32 bands of 6 coordinates; a pair at 0.8 shares no band with probability 6e-5. Texts with equal words (by a BLAKE2b
digest of them) are one node first, so exact copies never meet in a band. In each band bucket all members are compared with its
smallest member (a star, so linear in the bucket); components of verified links follow. Then the pairs
of a bucket that are still in different components are compared, a bucket once however many bands hold the same members. All such pairs
are found either way; how they travel depends on the bucket: up to ``SMALL`` members as a list of pairs, more after another star and
then within the bucket, in blocks of at most ``BLOCK`` members and about ``BLOCK_SHINGLES`` shingles. Comparison is on whole
texts. No bucket is cut.

Texts without words and null texts have no shingles: each is a group of its own. A group's id is its smallest doc_id, null only if all
are null. Rows with equal doc_id may have different texts; each row gets its own text's group. Rows repeated in full are in one
group and all of them are kept or none. A very long text is hashed alone. An empty table gives an empty result. Extra columns,
whatever their names, stay out of the result.
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
from .store import drop, free_names, join_uneven, materialise

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
SMALL, BLOCK = 24, 1024  # members of a bucket whose open pairs are all listed; members of a block of a larger one
BLOCK_SHINGLES = 4_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def cells(element: np.ndarray, text: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and fill (0 to 1) of the unit cells of weighted elements.

    Without weights each occurrence of an element in a text is one unit of its weight.
    """
    if weight is None:
        order = np.argsort(W.mix(element ^ (text.astype(np.uint64) * GOLD)))
        e, t = element[order], text[order]
        n = len(e)
        if not n:
            return e, t, np.ones(0)
        new = np.ones(n, bool)
        new[1:] = (e[1:] != e[:-1]) | (t[1:] != t[:-1])
        number = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return W.mix(e + number.astype(np.uint64) * GOLD), t, np.ones(n)
    n = np.ceil(weight).astype(np.int64)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    fill = np.minimum(1.0, np.repeat(weight, n) - number)
    return W.mix(np.repeat(element, n) + number.astype(np.uint64) * GOLD), np.repeat(text, n), fill


def signatures(cell: np.ndarray, text: np.ndarray, fill: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """The rank of the earliest dart for each text and coordinate; infinite for texts without elements."""
    out = np.full(n_texts * k, np.inf)
    total = np.bincount(text, fill, n_texts)
    with np.errstate(divide="ignore"):
        reach = k * (np.log(k) + 3) / total
    open_ = total > 0
    floor = np.zeros(n_texts)  # ranks thrown so far
    while open_.any():
        alive = np.flatnonzero(open_[text])
        seed, doc, full = cell[alive], text[alive], fill[alive]
        rank = np.zeros(len(seed))
        step = 0
        while len(seed):
            step += 1
            h = W.mix(seed + np.uint64(step * W.BASE & W.MASK))
            rank = rank - np.log(_uniform(h))
            keep = rank <= reach[doc]
            seed, doc, full, rank, h = seed[keep], doc[keep], full[keep], rank[keep], h[keep]
            more = W.mix(h ^ GOLD)
            hit = rank > floor[doc]
            if (full < 1).any():
                hit &= _uniform(W.mix(more)) <= full
            place = doc[hit] * k + ((more[hit] >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(out, place, rank[hit])
        open_ &= np.isinf(out.reshape(n_texts, k)).any(axis=1)
        floor[open_] = reach[open_]
        reach[open_] *= 1.5
    return out.reshape(n_texts, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = W.mix(signature.view(np.uint64)).reshape(len(signature), bands, rows)
    up, _ = W.powers(W.BASE, rows + 1)
    keys = (parts * up[:rows]).sum(axis=2, dtype=np.uint64)
    return W.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * GOLD)


def sign(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, SHA-256 of the text, node (digest of the words; null without words), weight and band keys of each row."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                found = W.find_words(part.column(2))
                element, text = W.shingles(found, SHINGLE)
                keys = band_keys(signatures(*cells(element, text), part.num_rows, bands * rows), bands, rows)
                plain, at = found.plain()
                whole, none = memoryview(plain), found.first[1:] == found.first[:-1]
                ends = at[found.first].tolist()
                node = pa.array([None if no else hashlib.blake2b(whole[i:j], digest_size=16).digest() for no, i, j in zip(none, ends[:-1], ends[1:], strict=True)], pa.binary())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(none) * bands + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), node, pa.array(np.bincount(text, minlength=len(none)).astype(np.int64)), flat], ["doc_id", "text_hash", "node", "weight", "bands"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, text_hash binary, node binary, weight long, bands array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' weighted Jaccard index is at least ``least``."""

    def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        element, text = W.shingles(W.find_words(column), SHINGLE)
        return cells(element, text)[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text_a"):
                (ca, ta), (cb, tb) = (shingle_sets(part.column(i)) for i in (2, 3))
                n = part.num_rows
                both = np.concatenate([W.mix(ca ^ W.mix(ta.astype(np.uint64))), W.mix(cb ^ W.mix(tb.astype(np.uint64)))])
                text = np.concatenate([ta, tb])
                order = np.argsort(both, kind="stable")
                both, text = both[order], text[order]
                common = np.bincount(text[1:][both[1:] == both[:-1]], minlength=n) if len(both) else np.zeros(n)
                union = np.bincount(ta, minlength=n) + np.bincount(tb, minlength=n) - common
                keep = np.flatnonzero(common >= least * union - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep))], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, name: str) -> DataFrame:
    """node, root (smallest node of its component), for every node that has a link.

    Alternates large-star and small-star steps: each step links neighbours to their smallest one, so the number
    of rounds grows with the logarithm of a component's size and no node gathers all of its component.
    """

    def stars(e: DataFrame) -> bool:
        """Whether every node has one neighbour below it and that neighbour has none: nothing is left to join."""
        ends = e.select("u", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("m")))
        return ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("m").alias("m")).filter("n > 1 or (n > 0 and m > 0)").isEmpty()

    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, before = materialise(large, name), edges
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        drop(before), drop(large)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialise(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), name)


def _able(least: float):
    return F.least("weight", "other_weight") >= F.lit(least - 1e-9) * F.greatest("weight", "other_weight")


def _open(shared: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """The members, with root and size n, of buckets whose members are in different components."""
    state = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"_d{i}") for i in range(2)]
    keys = state.groupBy("key").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("shingles"), *members).filter("_r != _s")
    # Bands often hold the very same members, which need to be compared once only.
    once = keys.groupBy("n", "_d0", "_d1").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles"))
    return materialise(state.join(once.select("key", "n", "shingles"), "key"), name)


def bucket_links(table: pa.Table, least: float) -> pa.Table:
    """A spanning forest of the links between members of a block pair that are in different components.

    Members outside the commonest component are compared with all others by looking up their cells in an index of all cells.
    """
    nodes = np.array(table.column("node").to_pylist(), object)
    _, root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
    side = table.column("side").to_numpy()
    common = np.bincount(root).argmax()
    parts, base = [], 0
    for batch in table.select(["text"]).to_batches():
        for part in W.slices(batch):
            element, text = W.shingles(W.find_words(part.column(0)), SHINGLE)
            cell, owner, _ = cells(element, text)
            parts.append((cell, owner + base))
            base += part.num_rows
    cell, owner = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    weight = np.bincount(owner, minlength=len(nodes))
    by_cell = np.argsort(cell)
    index, holder = cell[by_cell], owner[by_cell]
    by_owner = np.argsort(owner, kind="stable")
    own_cells, first = cell[by_owner], np.concatenate([[0], np.cumsum(weight)])
    parent, links = np.arange(root.max() + 1), []
    # With one component at most of this block pair in common, every pair in two components has a member outside it.
    for i in np.flatnonzero(root != common).tolist():
        mine = own_cells[first[i] : first[i + 1]]
        low, high = np.searchsorted(index, mine, "left"), np.searchsorted(index, mine, "right")
        n = high - low
        others = holder[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(others, minlength=len(nodes))
        near = both >= least * (weight + weight[i] - both) - 1e-9
        near &= (side != side[i]) | (side == 2)
        for j in np.flatnonzero(near & (root != root[i])).tolist():
            x, y = root[i], root[j]
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((i, j))
    a, b = (np.array([x[k] for x in links], np.int64) for k in range(2))
    return pa.table({"a": pa.array(nodes[a].tolist(), pa.binary()), "b": pa.array(nodes[b].tolist(), pa.binary())})


def _large(rest: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """Links within large buckets: members go with their texts to pairs of blocks, and only forests of links come back."""
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = rest.select("key", "node", "root", blocks.alias("_n"), F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int").alias("_b"))
    dealt = dealt.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pairs = dealt.select(
        "key", F.least("_b", "_x").alias("i"), F.greatest("_b", "_x").alias("j"), F.when(F.col("_b") == F.col("_x"), 2).when(F.col("_b") < F.col("_x"), 0).otherwise(1).alias("side"), "node", "root"
    )
    with_text = pairs.join(texts, "node")
    return with_text.groupBy("key", "i", "j").applyInArrow(lambda t: bucket_links(t, least), "a binary, b binary")


def _finish(shared: DataFrame, roots: DataFrame, texts: DataFrame, least: float, small: int, block: int) -> DataFrame:
    """Compares what the first stars left open: members of a bucket that are still in different components.

    In small buckets all such pairs are compared. In large ones another star joins most of what is near; members still
    apart are then compared within the bucket, in blocks, which move each text once a block instead of once a pair.
    """
    ship(shared.sparkSession)
    rest = _open(shared, roots, "minhash-rest")
    other = rest.select("key", F.col("node").alias("other"), F.col("weight").alias("other_weight"), F.col("root").alias("other_root"))
    seat = F.min_by(F.struct("other", "other_weight", "other_root"), F.xxhash64(F.lit(1), "other", "key"))
    stars = other.join(rest.filter(F.col("n") > small).select("key").distinct(), "key", "left_semi").groupBy("key").agg(seat.alias("c")).select("key", "c.*")
    apart = (F.col("root") != F.col("other_root")) & _able(least)
    names = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    few = rest.filter(F.col("n") <= small)
    small_pairs = few.join(other.join(few.select("key").distinct(), "key", "left_semi"), "key").filter(apart & (F.col("node") < F.col("other"))).select(*names)
    star_pairs = rest.join(stars, "key").filter(apart).select(*names)
    links = materialise(_similar(small_pairs.unionByName(star_pairs).distinct(), texts, least), "minhash-more")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not links.isEmpty():
        roots = components(links.unionByName(known), "minhash-roots")
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    rest = _open(shared.join(rest.filter(F.col("n") > small).select("key").distinct(), "key", "left_semi"), roots, "minhash-rest")
    links = materialise(_large(rest, texts, least, block), "minhash-large")
    return roots if links.isEmpty() else components(links.unionByName(known), "minhash-roots")


def groups(documents: DataFrame, least: float = LEAST, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, group_id (smallest doc_id of its group), group_rows, kept, and text_hash.

    kept: the row has the group's smallest (doc_id, SHA-256 of the text), null ids last; rows repeated in full are all marked.
    """
    signed = materialise(sign(documents), "minhash-signed")
    least_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = materialise(
        signed.filter("node is not null").groupBy("node").agg(F.min(least_row).alias("row"), F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "minhash-nodes"
    )
    members = nodes.select("node", "weight", F.explode("bands").alias("key"))
    centers = members.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("_most")).filter("center != _most").select("key", "center")
    shared = materialise(members.join(centers, "key"), "minhash-shared")
    # One row per node brings its text: texts of equal words have equal shingles, whichever is taken.
    involved = shared.select("node").distinct().join(nodes, "node").select("node", F.col("row.doc_id").alias("_i"), F.col("row.text_hash").alias("text_hash"))
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = whole.join(involved, F.col("doc_id").eqNullSafe(F.col("_i")) & (whole["text_hash"] == involved["text_hash"]))
    texts = materialise(found.groupBy("node").agg(F.first("text").alias("text")), "minhash-texts")
    weights = nodes.select(F.col("node").alias("center"), F.col("weight").alias("center_weight"))
    stars = shared.filter("node != center").select("center", "node", "weight").distinct().join(weights, "center")
    able = F.least("weight", "center_weight") >= F.lit(least - 1e-9) * F.greatest("weight", "center_weight")
    links = materialise(_similar(stars.filter(able).select(F.col("center").alias("a"), F.col("node").alias("b")), texts, least), "minhash-links")
    roots = components(links, "minhash-roots")
    roots = _finish(shared, roots, texts, least, small, block)
    # From roots to nodes and from nodes to rows: a large group or a text with many copies is never one task.
    placed = materialise(nodes.select("node", "row", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-placed")
    smallest = placed.groupBy("root").agg(F.min("row").alias("_k"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_nodes"))
    by_node = materialise(join_uneven(placed, smallest, "root", "_nodes").select("node", "n", "_k", "_n"), "minhash-verdicts")
    out = join_uneven(signed.select("doc_id", "text_hash", "node"), by_node, "node", "n")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_k.doc_id")).alias("group_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_rows"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("_k.doc_id")) & (F.col("text_hash") == F.col("_k.text_hash")))).alias("kept"), "text_hash",
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents' columns, with one row of each group. Of rows repeated in full one stays."""
    found = materialise(groups(documents), "minhash-rows")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    (digest,) = free_names(documents.columns, 1)
    keyed = documents.withColumn(digest, F.unhex(F.sha2("text", 256)))
    kept = keyed.join(gone, keyed["doc_id"].cast("long").eqNullSafe(gone["_i"]) & (keyed[digest] == gone["_h"]), "left_anti").drop(digest)
    repeated = found.filter("kept and group_rows > 1").groupBy("doc_id", "text_hash").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
