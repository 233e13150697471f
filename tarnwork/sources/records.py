"""JSON lines, raw lines with pointers, archives, and dataset fingerprints."""

from __future__ import annotations

import io
import tempfile
import unicodedata
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local one only where Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/tarnwork-records/{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str | None = None) -> str:
    """Writes JSON lines; the committer publishes them only when all tasks are done, and an existing path is an error."""
    path = path or scratch(df.sparkSession)
    df.write.mode("errorifexists").json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a malformed line fails the scan. Blank lines are skipped. The file's name travels as ``file``."""
    return spark.read.schema(schema).json(path, mode="FAILFAST").withColumn("file", F.col("_metadata.file_name"))


def pointers(lines: DataFrame, ordinal: str, line: str) -> DataFrame:
    """line_no, sha and byte_offset of each line in the order of ``ordinal``; one file is one ordered stream, worked on range by range."""
    from ..operators.ranges import ranges, running_total

    short = lines.select(ordinal, F.sha2(line, 256).alias("sha"), (F.octet_length(line) + 1).cast("long").alias("_bytes"))
    placed = running_total(running_total(ranges(short, [ordinal]), [ordinal], F.lit(1).cast("long"), "line_no"), [ordinal], F.col("_bytes"), "byte_offset")
    return placed.select("line_no", "sha", "byte_offset")


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a sum over their hashes that doesn't depend on their order."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 8), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("total"))


def parse_fenced(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``parsed``: the JSON object within an optional code fence, null if it is not valid."""
    bare = F.regexp_replace(F.trim(column), r"^```(?:json)?\s*|\s*```$", "")
    whole = f"{schema}, _corrupt string"
    found = F.from_json(bare, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("_p", found).withColumn("parsed", F.when(F.col("_p._corrupt").isNull() & F.col("_p").isNotNull(), F.col("_p"))).drop("_p")


def read_zip(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".txt", ".json", ".pgn"), most: int = 1 << 30) -> DataFrame:
    """(archive, member, ordinal, content) of the allowed members of the archives under a path."""
    return unzip(spark.read.format("binaryFile").load(path).select("path", "content"), suffixes, most)


def unzip(archives: DataFrame, suffixes: tuple[str, ...] = (".csv", ".txt", ".json", ".pgn"), most: int = 1 << 30) -> DataFrame:
    """The allowed members of archives (path, content) in archive order; too large an archive is an error."""
    ship(archives.sparkSession)

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = [i for i in z.infolist() if i.filename.endswith(suffixes)]
                    if sum(i.file_size for i in infos) > most:
                        raise ValueError(f"{name} holds more than {most} bytes")
                    rows += [(name, i.filename, k, z.read(i)) for k, i in enumerate(infos)]
            yield pd.DataFrame(rows, columns=["archive", "member", "ordinal", "content"])

    return archives.select("path", "content").mapInPandas(members, "archive string, member string, ordinal int, content binary")


def decode_text(content: bytes, charsets: tuple[str, ...] = ("utf-8-sig", "big5", "cp950")) -> str | None:
    """The text in the first charset that reads it, composed (NFKC)."""
    for charset in charsets:
        try:
            return unicodedata.normalize("NFKC", content.decode(charset))
        except UnicodeDecodeError:
            continue
    return None


def split_games(text: str, header: str = "[Game") -> list[str]:
    """Records that begin with ``header`` at the start of a line outside braces, brackets and line comments."""
    games, start, depth, comment = [], None, [], False
    for i, c in enumerate(text):
        if comment:
            comment = c != "\n"
            continue
        if not depth and (i == 0 or text[i - 1] == "\n") and text.startswith(header, i):
            if start is not None:
                games.append(text[start:i].strip())
            start = i
        if c == ";" and not depth:
            comment = True
        elif c in "{(":
            depth.append(c)
        elif c in "})" and depth and depth[-1] == {"}": "{", ")": "("}[c]:
            depth.pop()
    if start is not None:
        games.append(text[start:].strip())
    return games


def tags(text: str) -> dict[str, str]:
    """Header tags of a game; a repeated tag is an error."""
    import re

    found: dict[str, str] = {}
    for name, value in re.findall(r'^\[(\w+) "((?:[^"\\]|\\.)*)"\]', text, re.MULTILINE):
        if name in found:
            raise ValueError(f"repeated tag {name}")
        found[name] = re.sub(r"\\(.)", r"\1", value)
    return found


def main_line(text: str) -> list[str]:
    """Moves without headers, comments, variations, numbers, annotations and result."""
    import re

    kept, depth = [], 0
    body = re.sub(r"^\[[^\n]*\]$|;[^\n]*", " ", text, flags=re.MULTILINE)
    brace = False
    for c in body:
        if brace:
            brace = c != "}"
        elif c == "{":
            brace = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif not depth:
            kept.append(c)
            continue
        kept.append(" ")
    return [m for m in re.sub(r"[0-9]+\.+|\$[0-9]+", " ", "".join(kept)).split() if m not in ("1-0", "0-1", "1/2-1/2", "*")]


def parse_games(texts: DataFrame, column: str, carry: list[str]) -> DataFrame:
    """One row a game of each text: ordinal, headers and main line; a game with a repeated tag gets an error instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for *own, text in frame.itertuples(index=False):
                for k, game in enumerate(split_games(text or "")):
                    try:
                        rows.append((*own, k, tags(game), main_line(game), None))
                    except ValueError as e:
                        rows.append((*own, k, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[*carry, "ordinal", "headers", "moves", "error"])

    ship(texts.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    return texts.select(*carry, column).mapInPandas(run, "".join(f"{c} {kinds[c]}, " for c in carry) + "ordinal int, headers map<string,string>, moves array<string>, error string")


def grade_numeric(rows: DataFrame, answer: str, expected: str, allowed: str, within: int) -> DataFrame:
    """Adds ``errors``: json (no JSON object), fields (value or line missing), value (off by more than ``within``), line (its first move is not allowed)."""
    parsed = parse_fenced(rows, answer, "value int, line array<string>")
    p = F.col("parsed")
    fields = p["value"].isNull() | p["line"].isNull() | (F.size(p["line"]) == 0)
    code = F.when(p.isNull(), F.array(F.lit("json"))).when(fields, F.array(F.lit("fields"))).otherwise(
        F.array_compact(F.array(F.when(F.abs(p["value"] - F.col(expected)) > within, "value").otherwise(F.when(~F.array_contains(F.col(allowed), F.get(p["line"], 0)), "line"))))
    )
    return parsed.withColumn("errors", code).drop("parsed")
