"""Files that vouch for others: JSON documents published whole, manifests, bound inputs, and digests taken once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTLED = 2  # seconds a file must have been left alone before its digest was taken


def _fs(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    own, fs = _fs(spark, path)
    return fs.exists(own)


def atomic_json(spark: SparkSession, path: str, value) -> None:
    """Writes indented UTF-8 JSON beside ``path`` and renames it there, so readers see the old document or the new one."""
    target, fs = _fs(spark, path)
    partial, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.partial")
    out = fs.create(partial, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(partial, target):
        fs.delete(partial, False)
        raise OSError(f"cannot publish {path}")


def read_json(spark: SparkSession, path: str):
    own, fs = _fs(spark, path)
    stream = fs.open(own)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified and content of every file that has bytes; without ``content`` in a later select nothing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def digests(found: DataFrame) -> DataFrame:
    return found.select("path", "bytes", "modified", F.sha2("content", 256).alias("sha256"))


def manifest(kind: str, config: dict, inputs: DataFrame, outputs: DataFrame, verification: dict) -> dict:
    """A complete manifest; ``inputs`` and ``outputs`` are digests. Meant for files, of which a job has few, not for rows."""
    own = lambda df: {r.path: {"sha256": r.sha256, "bytes": r.bytes} for r in df.select("path", "sha256", "bytes").toLocalIterator()}
    return {"schema_version": 1, "kind": kind, "status": "complete", "config": config, "inputs": own(inputs), "outputs": own(outputs), "verification": verification}


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose (bytes, modified) differ between two listings, with why: missing, new or changed."""
    a = before.select("path", F.struct("bytes", "modified").alias("_a"))
    b = after.select("path", F.struct("bytes", "modified").alias("_b"))
    why = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, "path", "full_outer").select("path", why.alias("why")).filter("why is not null")


class BoundInputs:
    """Inputs as they were when a job began; ``check`` fails if any of them is not so any more."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = files(spark, path).select("path", "bytes", "modified").collect()  # names of files
        self.before = spark.createDataFrame([tuple(r) for r in rows], "path string, bytes long, modified timestamp")

    def check(self) -> None:
        found = changed(self.before, files(self.spark, self.path)).orderBy("path").first()
        if found is not None:
            raise ValueError(f"input {found.path}: {found.why} since the job began")


def reuse_digests(found: DataFrame, receipts: DataFrame) -> DataFrame:
    """path, sha256, reused. A receipt (path, bytes, modified, sha256, taken) stands for a file with its size and time, if the file had been
    left alone for ``SETTLED`` seconds when the digest was taken; only the other files' contents are read."""
    settled = receipts.filter(F.col("taken") >= F.col("modified") + F.expr(f"interval {SETTLED} seconds"))
    own = settled.groupBy("path", "bytes", "modified").agg(F.max_by("sha256", "taken").alias("sha256"))
    key = ["path", "bytes", "modified"]
    known = found.select(*key).join(own, key).select("path", "sha256", F.lit(True).alias("reused"))
    rest = found.join(own, key, "left_anti").select("path", F.sha2("content", 256).alias("sha256"), F.lit(False).alias("reused"))
    return known.unionByName(rest)


def git_blobs(found: DataFrame, listed: DataFrame) -> DataFrame:
    """path, blob_id and whether it is the one that a tree lists; a listed path without a file has no blob_id."""
    own = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length("content").cast("string")), "utf-8"), F.unhex(F.lit("00")), F.col("content")))
    blobs = found.select("path", own.alias("blob_id"))
    return listed.select("path", F.col("blob_id").alias("_listed")).join(blobs, "path", "full_outer").select("path", "blob_id", F.col("blob_id").eqNullSafe(F.col("_listed")).alias("agrees"))
