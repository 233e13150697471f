"""An index over JSON lines files: where each row's bytes are, and point lookups that read no others.

Files are indexed in byte ranges, so a large file is many tasks. A range begins with the first line that starts in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

CHUNK = 64 << 20
INDEX = "source string, offset long, length long, id string, stage string, split string, feature_key string"


def _open(path: str):
    from pyarrow import fs as arrow_fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    scheme, mark, rest = path.partition("://")
    fs, name = arrow_fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)
    return fs.open_input_file(name)


def _lines(stream, start: int, end: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes, line end included, of the lines that start in [start, end)."""
    at = start
    if start:
        stream.seek(start - 1)
        at -= 1
    else:
        stream.seek(0)
    rest, skip = b"", bool(start)
    while True:
        more = stream.read(step)
        rest += more
        cut = 0
        while (stop := rest.find(b"\n", cut)) >= 0 or (not more and cut < len(rest)):
            stop = stop + 1 if stop >= 0 else len(rest)
            if skip:
                skip = False
            elif at + cut >= end:
                return
            else:
                yield at + cut, rest[cut:stop]
            cut = stop
        at, rest = at + cut, rest[cut:]
        if not more or (not skip and at >= end):
            return


def build(spark: SparkSession, path: str, split: str, chunk: int = CHUNK) -> DataFrame:
    """One row per JSON line: source, offset, length, id, stage, split, feature_key. Blank lines are skipped. A line that is no JSON object, lacks an id or
    belongs to another split is an error, and so is an id that comes twice."""
    ship(spark)
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    parts = listed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk).cast("long"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, start in zip(frame["path"], frame["start"], strict=True):
                rows = []
                with _open(name) as stream:
                    for at, line in _lines(stream, int(start), int(start) + chunk):
                        if not line.strip():
                            continue
                        row = json.loads(line)
                        if not isinstance(row, dict) or not isinstance(row.get("id"), str) or row.get("split") != split:
                            raise ValueError(f"{name} at {at}: not a row of split {split}")
                        rows.append((name, at, len(line), row["id"], row.get("stage"), row["split"], row.get("feature_key")))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=INDEX.replace(" string", "").replace(" long", "").split(", "))
                            rows = []
                yield pd.DataFrame(rows, columns=INDEX.replace(" string", "").replace(" long", "").split(", "))

    dealt = parts.select("path", "start").repartition(max(1, min(parts.count(), 10_000)))
    from .records import scratch

    out = scratch(spark)
    dealt.mapInPandas(run, INDEX).write.parquet(out)
    index = spark.read.schema(INDEX).parquet(out)
    twice = index.groupBy("id").count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"id {twice.id} comes {twice['count']} times")
    return index


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and raw bytes of the wanted ids. Only their byte ranges are read, and each row must still have its id."""
    ship(index.sparkSession)
    places = index.join(wanted.select("id").distinct(), "id", "left_semi").select("source", "offset", "length", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, stream = None, None
        for frame in frames:
            rows = []
            for source, offset, length, ident in frame.itertuples(index=False):
                if source != name:
                    name, stream = source, _open(source)
                stream.seek(int(offset))
                raw = stream.read(int(length))
                if json.loads(raw).get("id") != ident:
                    raise ValueError(f"{source} at {offset} is not the row {ident} any more")
                rows.append((ident, raw))
            yield pd.DataFrame(rows, columns=["id", "raw"])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return places.repartitionByRange(n, "source", "offset").sortWithinPartitions("source", "offset").mapInPandas(run, "id string, raw binary")
