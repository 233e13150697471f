"""Idempotent ledgers, resumption, and folds over ordered events."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import ship


def replay(ledger: DataFrame, key: str, order: list[str], status: str, done: str) -> DataFrame:
    """The latest outcome of each request; a success is never replaced by a later failure."""
    rank = F.struct((F.col(status) == done).cast("int"), *order)
    rest = [c for c in ledger.columns if c != key]
    return ledger.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_r"), F.count(F.lit(1)).alias("attempts")).select(key, "_r.*", "attempts")


def remaining(work: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Work without an entry in the ledger."""
    return work.join(ledger.select(key).distinct(), key, "left_anti")


def follow(stream: DataFrame, key: str, path: str, checkpoint: str, time: str, delay: str = "1 hour") -> StreamingQuery:
    """Appends a stream's requests to a ledger once each: the checkpoint makes restarts continue, the watermark bounds the state."""
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def fold(events: DataFrame, key: str, order: list[str], step: Callable, start, out: str, schema: str) -> DataFrame:
    """Folds each key's events in order, one state a key; a key's events pass in sorted batches and are never all held."""

    ship(events.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, start, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                k = getattr(row, key)
                if k != now and now is not None:
                    done.append((now, state))
                    state = start
                now, state = k, step(state, row)
            if done:
                yield pd.DataFrame(done, columns=[key, out])
                done = []
        if now is not None:
            yield pd.DataFrame([(now, state)], columns=[key, out])

    return events.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _by_group(rows: DataFrame, group: list[str], order: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """Runs a fold over each group's rows in order: ``start()`` gives the fold of a new group, which takes a group's rows and gives result rows.

    Rows come in sorted batches. A group is one task's, as its picks depend on each other, so pass keys and not payloads.
    """
    ship(rows.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            for key, part in frame.groupby(group, sort=False, dropna=False):
                if key != now:
                    if held:
                        yield pd.DataFrame(list(start()(pd.concat(held))), columns=names)
                    now, held = key, []
                held.append(part)
        if held:
            yield pd.DataFrame(list(start()(pd.concat(held))), columns=names)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def smooth_order(streams: dict[str, list[tuple]], weights: dict[str, float]) -> Iterator[tuple[str, tuple]]:
    """Smooth weighted round robin over finite streams: each turn adds every live stream's weight to its credit, and the one with most credit (the
    first such) pays the sum of live weights and gives its next item whose keys are all new; a stream without one drops out. Items are (ident, keys)."""
    live = [[name, 0.0, iter(items)] for name, items in streams.items()]
    seen: set = set()
    while live:
        total = sum(weights[s[0]] for s in live)
        for s in live:
            s[1] += weights[s[0]]
        best = max(live, key=lambda s: s[1])
        best[1] -= total
        item = next((x for x in best[2] if seen.isdisjoint(x[1])), None)
        if item is None:
            live.remove(best)
            continue
        seen.update(item[1])
        yield best[0], item


def interleave(rows: DataFrame, group: list[str], stream: str, order: list[str], ident: str, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """group, stream, ident and place (from 0) of each group's rows in smooth weighted order; rows with a key seen before are left out.

    Streams take turns in the order of ``weights``; rows of a stream keep ``order``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*group, stream, ident)) + ", place long"

    def start():
        def fold(frame: pd.DataFrame):
            own = frame[group].iloc[0].tolist()
            by = dict(tuple(frame.groupby(stream, sort=False)))
            streams = {n: [(i, {k for k in ks if k is not None}) for i, *ks in by[n][[ident, *keys]].itertuples(index=False)] for n in weights if n in by}
            for place, (name, item) in enumerate(smooth_order(streams, weights)):
                yield (*own, name, item[0], place)

        return fold

    return _by_group(rows.select(*dict.fromkeys([*group, stream, ident, *keys, *order])), group, order, start, schema)


def uniform(*parts) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    return int.from_bytes(hashlib.sha256("/".join(map(str, parts)).encode()).digest()[:7], "big") / (1 << 56)


def shaped_pick(entities: list[tuple], frequency: dict, draw: float):
    """One of (entity, classes), with a weight of 1 / ((1 + how often its classes were observed) x entities of these classes)."""
    many = Counter(classes for _, classes in entities)
    weights = [1.0 / ((1 + sum(frequency.get(c, 0) for c in classes)) * many[classes]) for _, classes in entities]
    goal, so_far = draw * sum(weights), 0.0
    for entity, w in zip(entities, weights, strict=True):
        so_far += w
        if goal < so_far:
            return entity
    return entities[-1]


def adaptive_sample(rows: DataFrame, group: list[str], root: str, entity: str, label: str, per_root: int, seed: str) -> DataFrame:
    """group, root, entity, label: ``per_root`` entities of each root without repeats, by inverse frequency of the labels picked so far in the group.

    Roots go in order, and a root's picks are observed only when all of them are made. Draws come from SHA-256 of seed, group, root and turn.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*group, root, entity, label))

    def start():
        def fold(frame: pd.DataFrame):
            own, frequency = frame[group].iloc[0].tolist(), Counter()
            for r, part in frame.groupby(root, sort=True):
                left = [(e, (c,)) for e, c in part[[entity, label]].itertuples(index=False)]
                picked = []
                for turn in range(min(per_root, len(left))):
                    choice = shaped_pick(left, frequency, uniform(seed, *own, r, turn))
                    left.remove(choice)
                    picked.append(choice)
                frequency.update(c for _, classes in picked for c in classes)
                yield from ((*own, r, e, classes[0]) for e, classes in picked)

        return fold

    return _by_group(rows.select(*group, root, entity, label), group, [root, entity], start, schema)


def round_robin(pools: dict[tuple, list[dict]], turns: Callable[[tuple], int], budget: int, caps: dict[str, int]) -> Iterator[dict]:
    """Rows of sorted pools in turn, ``turns(pool)`` a round, until the budget is met or all pools are empty. A row is skipped for good if its ident came
    before, or if any of its values of a capped column (a list or one value) has been accepted as often as the cap allows."""
    queues = {k: iter(v) for k, v in sorted(pools.items())}
    schedule = [k for k in queues for _ in range(turns(k))]
    seen, used, n = set(), {c: Counter() for c in caps}, 0
    alive = True
    while alive and n < budget:
        alive = False
        for pool in schedule:
            for row in queues[pool]:
                alive = True
                if row["ident"] in seen:
                    continue
                seen.add(row["ident"])
                values = {c: set(row[c]) if isinstance(row[c], (list, tuple, np.ndarray)) else {row[c]} for c in caps}
                if any(used[c][v] >= caps[c] for c in caps for v in values[c]):
                    continue
                for c in caps:
                    used[c].update(values[c])
                n += 1
                yield row
                break
            if n == budget:
                return


def diverse(rows: DataFrame, group: list[str], pools: list[str], ident: str, caps: dict[str, int], budget: int, seed: str, heavier: tuple[str, object, int] | None = None) -> DataFrame:
    """group, ident, place: at most ``budget`` rows of each group, round robin over pools, within caps on single values or on each member of an array.

    A pool's order is that of SHA-256 of seed/ident. ``heavier`` = (pool column, least value, turns) gives such pools more turns a round.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*group, ident)) + ", place long"

    def turns(pool: tuple) -> int:
        return heavier[2] if heavier and pool[pools.index(heavier[0])] >= heavier[1] else 1

    def start():
        def fold(frame: pd.DataFrame):
            own, by = frame[group].iloc[0].tolist(), {}
            for row in frame.to_dict("records"):
                by.setdefault(tuple(row[p] for p in pools), []).append(row | {"ident": row[ident]})
            for place, row in enumerate(round_robin(by, turns, budget, caps)):
                yield (*own, row["ident"], place)

        return fold

    ordered = rows.select(*dict.fromkeys([*group, *pools, ident, *caps])).withColumn("_order", F.sha2(F.concat(F.lit(f"{seed}/"), F.col(ident).cast("string")), 256))
    return _by_group(ordered, group, ["_order"], start, schema)


def by_group_in_order(rows: DataFrame, group: str, order: list[str], step: Callable, start, value: str, out: str, kind: str) -> DataFrame:
    """Each row with a running state of its group (``step(state, value)`` after the row), in the rows' own order again by ``order``.

    Groups are spooled by the shuffle, sorted on disk, and pass in batches; no group is held whole.
    """
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), start
        for frame in frames:
            made = []
            for g, v in zip(frame[group], frame[value], strict=True):
                if g != now:
                    now, state = g, start
                state = step(state, v)
                made.append(state)
            yield frame.assign(**{out: made})

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(kind), True)])
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema).orderBy(*order)


def ordered_map(rows: DataFrame, ordinal: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of batches over all rows, in the input's order again. Spark bounds what is in flight; ``function`` keeps the ordinal."""
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    return rows.mapInPandas(run, schema).orderBy(ordinal)
