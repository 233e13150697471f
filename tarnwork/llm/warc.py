"""WARC archives: written by tasks, read back, and assembled into one nested row per capture.

A capture is a transaction of three records: the request, the response (or a revisit record where an equal payload
is stored under another page), and metadata. Request and metadata name the response's record in WARC-Concurrent-To;
a revisit names the record it refers to in WARC-Refers-To. Files hold one gzip member a record and are closed at
``FILE_BYTES`` of payload, so a reader holds one record at a time. Each task writes under a name of its own attempt; only
files named in the manifest, which Spark commits with the tasks, are ever read.

Of records with equal payloads (by SHA-256) of at least ``least`` bytes, the smallest page_id is the response; rows that tie on
that id are all responses. Null html is an empty payload. A null page_id is never a response if another page has its payload. Repeated rows
each are a capture; their records are the same and are listed once. A very long page is one record, held whole by one task. An
empty table writes no file. Extra columns, whatever their names, stay out of the archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .store import join_uneven, materialise, new_path

FILE_BYTES, READ_BYTES = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "concurrent_to string, record_id string, kind string, target_uri string, refers_to string, page_id long, payload_bytes long, payload_digest string, payload binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{kind}')}>"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return zlib_member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def zlib_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def transaction(page_id: int | None, url: str | None, payload: bytes, response_page: int | None, is_revisit: bool) -> bytes:
    """The three records of a capture."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = urllib.parse.quote(url or "urn:none", safe="%/:=&?~#+!$,;'@()*[]")
    kind = "revisit" if is_revisit else "response"
    main = record_id(page_id, digest, kind)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    extra = {"WARC-Refers-To": record_id(response_page, digest, "response"), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if is_revisit else {}
    parts = urllib.parse.urlsplit(uri)
    ask = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    beside = {"WARC-Concurrent-To": main, "WARC-Target-URI": uri}
    return b"".join(
        [
            record("request", {"WARC-Record-ID": record_id(page_id, digest, "request"), **beside, "Content-Type": "application/http; msgtype=request"}, ask),
            record(kind, {"WARC-Record-ID": main, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", **extra, "Content-Type": "application/http; msgtype=response"}, head if is_revisit else head + payload),
            record("metadata", {"WARC-Record-ID": record_id(page_id, digest, "metadata"), **beside, "Content-Type": "application/warc-fields"}, f"page-id: {'' if page_id is None else page_id}\r\n".encode()),
        ]
    )


def _files(path: str):
    """The file system of a path and the path within it; Hadoop's names of object stores are known too."""
    from pyarrow import fs as arrow_fs

    scheme, mark, rest = path.partition("://")
    return arrow_fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest)


def write(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives under ``path``; returns the manifest (file, captures)."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("sha"))
    # Payloads of one row alone need no partner; of the others the first page is looked up, a very common one without a shuffle.
    shared = keyed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = join_uneven(keyed, materialise(shared, "warc-shared"), "sha", "n")
    first = F.when(F.col("n").isNull(), F.col("page_id")).otherwise(F.col("first"))
    roles = found.select(
        "page_id", "url", F.col("html").cast("binary").alias("html"), first.alias("first"), (~F.col("page_id").eqNullSafe(first) & (F.octet_length("html") >= least)).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(path)
        fs.create_dir(root, recursive=True)
        out, name, size, captures = None, None, 0, 0
        for batch in batches:
            for page_id, url, html, response, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, captures = f"captures-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                out.write(transaction(page_id, url, html, response, revisit))
                size, captures = size + len(html), captures + 1
                if size >= file_bytes:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([captures], pa.int64())], ["file", "captures"])
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([captures], pa.int64())], ["file", "captures"])

    return materialise(roles.mapInArrow(run, "file string, captures long"), "warc-manifest")


def members(stream, chunk: int = READ_BYTES) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    data, inflate, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        if inflate is None:
            inflate, parts = zlib.decompressobj(31), []
        parts.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate = None
    if inflate is not None:
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> dict | None:
    """One record, or None for a kind that belongs to no capture."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    kind = fields["warc-type"]
    if kind not in ("request", "response", "revisit", "metadata"):
        return None
    out = dict.fromkeys(NAMES) | {"record_id": fields["warc-record-id"], "kind": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    out["concurrent_to"] = fields.get("warc-concurrent-to") or out["record_id"]
    if kind in ("response", "revisit"):
        payload = block.partition(b"\r\n\r\n")[2]
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
                raise ValueError(f"payload of {out['record_id']} does not have its digest")
            out["payload"], out["payload_bytes"] = payload, len(payload)
        out["payload_digest"] = stated
    elif kind == "metadata":
        found = re.search(rb"^page-id:[ ]*(-?[0-9]+)", block, re.MULTILINE)
        out["page_id"] = int(found[1]) if found else None
    return out


def records(spark: SparkSession, path: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(path)
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                some, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in members(stream):
                        found = parse(member)
                        if found is None:
                            continue
                        if not payloads:
                            found["payload"] = None
                        some.append(found)
                        size += len(member)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    files = manifest.select("file").repartition(max(1, min(manifest.count(), 10_000)))
    return files.mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: page_id, response (or revisit), requests, metadata, and what a revisit refers to.

    Records meet by the identifier they are concurrent to. Rows repeated in full have equal identifiers: their records are counted before
    they meet, so no capture gathers more than its own few, and each row stays a capture.
    """
    part = F.struct("record_id", "kind", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")
    main = F.col("kind").isin("response", "revisit")
    counted = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("times"))
    captures = counted.groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.first(F.when(main, part), ignorenulls=True).alias("response"), F.max(F.when(main, F.col("times"))).alias("times"),
        F.collect_list(F.when(F.col("kind") == "request", F.struct("record_id", "target_uri"))).alias("requests"),
        F.collect_list(F.when(F.col("kind") == "metadata", F.struct("record_id", "page_id"))).alias("metadata"),
    ).filter("response is not null")
    captures = materialise(captures.withColumn("page_id", F.try_element_at("metadata", F.lit(1))["page_id"]).withColumn("refers", F.col("response.refers_to")), "warc-captures")
    cited = captures.filter("refers is not null").groupBy(F.col("refers").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    own = captures.filter("response.kind = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("_page"), F.col("response.payload_bytes").alias("_bytes"))
    origin = materialise(own.join(cited, own["refers"] == cited["_id"]).drop("_id"), "warc-origins")
    joined = join_uneven(captures, origin, "refers", "_n").withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return joined.select(
        "page_id", "capture_id", "response", "requests", "metadata", F.col("_page").alias("refers_to"), F.coalesce("response.payload_bytes", "_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type")
    )


def archive(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes the pages and returns the captures read back."""
    path = new_path(pages.sparkSession, "warc")
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    manifest = write(pages, path)
    # The archives are read, inflated and parsed once.
    return assemble(materialise(records(pages.sparkSession, path, manifest, payloads), "warc-records"))
