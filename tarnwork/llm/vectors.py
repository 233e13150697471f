"""Near-duplicate vectors by an exact metric range join.

Vectors of a label are scaled to unit length, where cosine >= c means distance <= r = sqrt(2 - 2c). Pivots are the centres of a
label's dense areas, found in a sample of it. A vector's home is the ball of radius ``BALL`` around its nearest pivot, or the rest
if it is in no ball. The triangle inequality sets the replication: a vector visits a ball if its distance to the pivot is at most ``BALL`` + r,
and the rest unless it is within ``BALL`` - r of a pivot, so that all links of a home vector end in its cell. Cells then
join independently: every home vector meets all vectors of its cell, in blocks of bounded size, so a dense cell is many tasks.

Within a block, ``AXES`` more pivots span a subspace. The projection to it never lengthens a distance, so the cosine of a
pair is at most the product of the projections plus that of what the projections leave; only pairs that this bound lets pass are compared in
full. All links of a vector are counted in its home cell; only counts and a spanning forest leave a block, never pairs.

Pivots save work and never change the result: labels with at most ``CELL`` classes, or beyond the ``PIVOT_NUMBERS`` that are broadcast at most, are
one cell. Directions spread evenly over a sphere of many dimensions fill the rest, which no pivot parts; the README has figures.

Equal vectors of a label are one class first and are expanded by counting. A vector that is null, empty, zero or
holds null or non-finite components, or whose label is null, links with nothing. Vectors of different lengths do not
link. Repeated rows count as separate vectors. A component's id is its smallest vec_id, null only if all are null. Extra columns,
whatever their names, stay out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .dart_minhash import components
from .store import join_uneven, materialise

COSINE = 0.93
CELL, SAMPLE = 128, 512  # classes of the largest label without pivots, and classes that a label's pivots are chosen from
BALL, PIVOTS, PIVOT_NUMBERS = 0.6, 32, 4_000_000  # radius of a cell, pivots a label, and their components over all labels
AXES = 16  # pivots of the bound within a block
BLOCK, ROWS = 2048, 256  # vectors of a block, and rows compared at once
EPS = 1e-9


def unit(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def leaders(x: np.ndarray, reach: float, ball: float, most: int) -> np.ndarray:
    """The vectors with most others near them, one after another, none in the ball of an earlier one."""
    near = x @ x.T >= 1 - max(ball - reach, reach / 4) ** 2 / 2
    inside = x @ x.T >= 1 - ball**2 / 2
    left, out = np.ones(len(x), bool), []
    while len(out) < most and left.any():
        crowd = (near & left).sum(axis=1) * left
        best = int(crowd.argmax())
        if crowd[best] < 2:
            break
        out.append(best)
        left &= ~inside[best]
    return x[out]


def _pivots(classes: DataFrame, cell: int, reach: float, ball: float) -> dict[tuple, np.ndarray]:
    """Pivots of the largest labels; what they hold together is bounded by ``PIVOT_NUMBERS``."""
    large = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).orderBy(F.col("n").desc(), "label", "dim")
    kept, room = [], PIVOT_NUMBERS
    for r in large.limit(PIVOT_NUMBERS // PIVOTS // 16).toLocalIterator():
        room -= PIVOTS * r.dim
        if room < 0:
            break
        kept.append((r.label, r.dim, min(1.0, SAMPLE / r.n)))
    if not kept:
        return {}
    shares = classes.sparkSession.createDataFrame(kept, f"label {classes.schema['label'].dataType.simpleString()}, dim int, share double")
    some = classes.join(F.broadcast(shares), ["label", "dim"]).filter(F.shiftrightunsigned(F.xxhash64(F.lit(3), "cls"), 2) <= F.col("share") * F.lit(2.0**62))

    def choose(table: pa.Table) -> pa.Table:
        found = leaders(unit(table.column("embedding")), reach, ball, PIVOTS)
        return pa.table({"label": table.column("label")[: len(found)], "dim": table.column("dim")[: len(found)], "pivot": pa.array(found.tolist(), pa.list_(pa.float64()))})

    kinds = f"label {classes.schema['label'].dataType.simpleString()}, dim int, pivot array<double>"
    out: dict[tuple, list] = {}
    for r in some.select("label", "dim", "embedding").groupBy("label", "dim").applyInArrow(choose, kinds).collect():
        out.setdefault((r.label, r.dim), []).append(r.pivot)
    return {k: np.array(v) for k, v in out.items()}


def places(x: np.ndarray, pivots: np.ndarray, reach: float, ball: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell (-1: the rest) and whether it is the row's home, for each cell that a row is in."""
    d = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
    inside = d <= ball + reach + EPS
    nearest = d.argmin(axis=1)
    home = np.where(d[np.arange(len(d)), nearest] <= ball, nearest, -1)
    inside[np.flatnonzero(home >= 0), home[home >= 0]] = True
    outside = (home < 0) | ~(d <= ball - reach - EPS).any(axis=1)
    r, c = np.nonzero(inside)
    rest = np.flatnonzero(outside)
    r, c = np.concatenate([r, rest]), np.concatenate([c, np.full(len(rest), -1)])
    return r, c, home[r] == c


def _cells(classes: DataFrame, pivots: dict[tuple, np.ndarray], reach: float, ball: float) -> DataFrame:
    """cell and whether it is the vector's home; one row per cell that the vector is in."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOT_NUMBERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            rows, cells, home = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for key in sorted(set(keys), key=str):
                own = np.array([i for i, k in enumerate(keys) if k == key])
                if key in shared.value:
                    r, c, h = places(unit(batch.column(4).take(pa.array(own))), shared.value[key], reach, ball)
                else:
                    r, c, h = np.arange(len(own)), np.full(len(own), -1), np.ones(len(own), bool)
                rows.append(own[r]), cells.append(c), home.append(h)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(5)], pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(home))], ["cls", "label", "dim", "n", "embedding", "cell", "home"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("cls", "label", "dim", "n", "embedding"))
    return classes.select("cls", "label", "dim", "n", "embedding").mapInArrow(run, f"{schema}, cell int, home boolean")


def near_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, axes: int = AXES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pairs of left and right rows with cosine >= least, and how many pairs were compared in full."""
    basis, _ = np.linalg.qr(x[np.linspace(0, len(x) - 1, min(axes, len(x), x.shape[1])).astype(int)].T)
    part = x @ basis
    part = np.concatenate([part, np.sqrt(np.maximum(0, 1 - (part * part).sum(axis=1, keepdims=True)))], axis=1)
    for i in range(0, len(left), ROWS):
        own = left[i : i + ROWS]
        r, c = np.nonzero(part[own] @ part[right].T >= least - EPS)
        compared = len(r)
        if 4 * compared > len(own) * len(right):  # a dense block: one product is less work than the listed pairs
            r, c = np.nonzero(x[own] @ x[right].T >= least)
        else:
            a, b = own[r], right[c]
            good = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]]) >= least for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
            r, c = r[good], c[good]
        yield own[r], right[c], compared


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def join_block(table: pa.Table, least: float) -> pa.Table:
    """Links of the block's home vectors to its members: counts by class, and a spanning forest of the links."""
    home = table.column("home").to_numpy(zero_copy_only=False)
    member = table.column("member").to_numpy(zero_copy_only=False)
    names, index = np.unique(np.array(table.column("cls").to_pylist(), object), return_inverse=True)
    counts = table.column("n").to_numpy()
    x = unit(table.column("embedding"))
    h, m = np.flatnonzero(home), np.flatnonzero(member)
    links, parent = np.zeros(len(names), np.int64), np.arange(len(names))
    for one, two, _ in near_pairs(x, h, m, least):
        a, b = index[one], index[two]
        other = a != b
        a, b, two = a[other], b[other], two[other]
        links += np.bincount(a, counts[two], len(names)).astype(np.int64)
        while len(a):
            ra, rb = parent[a], parent[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            parent = _roots(parent)
    some = np.flatnonzero((links > 0) | (parent != np.arange(len(names))))
    return pa.table({"a": pa.array(names[some], pa.string()), "b": pa.array(names[parent[some]], pa.string()), "links": pa.array(links[some])})


def neighbours(vectors: DataFrame, least: float = COSINE, cell: int = CELL, block: int = BLOCK, ball: float = BALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    ship(vectors.sparkSession)
    sound = "label is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x != 0)"
    name = F.sha2(F.concat_ws(":", F.col("label").cast("string"), F.col("embedding").cast("string")), 256)
    source = vectors.selectExpr("vec_id", "label", "cast(embedding as array<double>) embedding", f"coalesce({sound}, false) sound")
    rows = materialise(source.select("vec_id", "label", F.when(F.col("sound"), F.col("embedding")).alias("embedding"), F.when(F.col("sound"), name).alias("cls")), "vectors-rows")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    classes = materialise(classes.withColumn("dim", F.size("embedding")), "vectors-classes")
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    placed = materialise(_cells(classes, _pivots(classes, cell, reach, ball), reach, ball), "vectors-cells")
    place = ["label", "dim", "cell"]
    sizes = placed.groupBy(*place).agg(F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("i_n"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("j_n"))
    sized = placed.join(sizes, place).withColumns({"_i": F.pmod(F.xxhash64("cls"), F.greatest("i_n", F.lit(1))).cast("int"), "_j": F.pmod(F.xxhash64("cls"), "j_n").cast("int")})
    # Home vectors go to all blocks of members, members to all blocks of home vectors.
    every = F.array_union(
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("j_n") - 1), lambda j: F.struct(F.col("_i").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
        F.transform(F.sequence(F.lit(0), F.greatest("i_n", F.lit(1)) - 1), lambda i: F.struct(i.alias("i"), F.col("_j").alias("j"))),
    )
    dealt = sized.withColumn("_b", F.explode(every)).select(
        *place, F.col("_b.i").alias("i"), F.col("_b.j").alias("j"), "cls", "n", "embedding", (F.col("home") & (F.col("_b.i") == F.col("_i"))).alias("home"), (F.col("_b.j") == F.col("_j")).alias("member")
    )
    found = materialise(dealt.groupBy(*place, "i", "j").applyInArrow(lambda t: join_block(t, least), "a string, b string, links long"), "vectors-found")
    roots = components(found.filter("a != b").select("a", "b"), "vectors-roots")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    by_class = classes.select(F.col("cls").alias("node"), "n", "least_id").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # From roots to classes and from classes to rows: a large component or a vector with many copies is never one task.
    by_class = materialise(by_class, "vectors-linked")
    smallest = materialise(by_class.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("_classes")), "vectors-components")
    verdict = materialise(join_uneven(by_class, smallest, "root", "_classes").select(F.col("node").alias("cls"), "n", "links", "component_id"), "vectors-verdicts")
    out = join_uneven(rows.select("vec_id", "cls"), verdict, "cls", "n")
    return out.select(
        "vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
