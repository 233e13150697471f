"""Sources, ledgers and operators beyond the registered queries: edge cases and negative tests."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import keys as K
from tarnwork.operators import relations as R
from tarnwork.operators import select as S
from tarnwork.sources import records
from tarnwork.streaming import ledger as L


def test_bucket_is_the_whole_hash(spark):
    import hashlib

    got = spark.range(50).select("id", K.bucket("7", F.col("id")).alias("b")).collect()
    assert all(r.b == int(hashlib.sha256(f"7/{r.id}".encode()).hexdigest(), 16) % 100 for r in got)


def test_history_key_matches_json(spark):
    import hashlib
    import json

    items = ["user", "assistant", "a b"]
    got = spark.createDataFrame([(items,)], "h array<string>").select(K.history_key(F.col("h")).alias("k")).first().k
    assert got == hashlib.sha256(json.dumps(items).encode()).hexdigest()


def test_single_year(spark):
    rows = [("in 1999",), ("1999 and 2001",), ("119990",), (None,), ("1999, again 1999",)]
    assert [r.y for r in spark.createDataFrame(rows, "t string").select(K.single_year(F.col("t")).alias("y")).collect()] == [1999, None, None, None, 1999]


def test_jsonl_is_strict_and_never_overwrites(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    records.write_jsonl(spark.range(3), path)
    assert records.read_jsonl(spark, path, "id long").count() == 3
    with pytest.raises(Exception, match="exists"):
        records.write_jsonl(spark.range(3), path)
    (tmp_path / "bad.json").write_text('{"id": 1}\n\n{"id": oops}\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        records.read_jsonl(spark, f"file://{tmp_path}/bad.json", "id long").collect()


def test_zip_members_in_order_with_a_cap(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b.txt", "two"), z.writestr("a.csv", "one"), z.writestr("c.exe", "no")
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    got = records.read_zip(spark, f"file://{tmp_path}/x.zip").orderBy("ordinal").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("b.txt", b"two"), ("a.csv", b"one")]
    with pytest.raises(Exception, match="more than 3 bytes"):
        records.read_zip(spark, f"file://{tmp_path}/x.zip", most=3).collect()


def test_games():
    text = '[Game "1"]\n[Site "a \\"b\\""]\n\n1. e4 {c [Game} (1. d4 (x) y) e5 ; [Game z\n2. Nf3 $1 1-0\n[Game "2"]\n\n*\n'
    games = records.split_games(text)
    assert len(games) == 2 and records.tags(games[0])["Site"] == 'a "b"' and records.main_line(games[0]) == ["e4", "e5", "Nf3"] and records.main_line(games[1]) == []
    with pytest.raises(ValueError, match="repeated"):
        records.tags('[A "1"]\n[A "2"]')
    assert records.decode_text("棋".encode("big5")) == "棋" and records.decode_text("ａ".encode()) == "a"


def test_coverage_verdicts(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 2, 3], [1, 2, 4]))
    assert {r.k: r.verdict for r in R.coverage(a, b, "k").collect()} == {1: "covered", 2: "duplicate", 3: "missing", 4: "foreign"}


def test_isolation_drops_a_row_with_any_reserved_position(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    foot = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, p string")
    kept, dropped = R.isolate(rows, "id", foot, spark.createDataFrame([("b",)], "p string"), "p")
    assert sorted(r.id for r in kept.collect()) == [2, 3] and [r.id for r in dropped.collect()] == [1]


def test_conflicting_keys_vanish(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "x"), (5, "c", None)], "id int, k string, s string")
    assert sorted(r.id for r in S.conflict_dedup(d, ["k"], "s", [F.col("id")]).collect()) == [3, 5]


def test_derangement_changes_every_key(spark):
    d = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(10)], "id int, k string")
    got = R.derangement(d, "k", ["id"]).collect()
    assert len(got) == 10 and all(r.k != r.donor_k for r in got) and sorted(r.donor_id for r in got) == list(range(10))


def test_ledger_keeps_success(spark):
    d = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "failed"), ("b", 1, "failed"), ("b", 2, "failed")], "k string, n int, s string")
    assert {r.k: (r.n, r.s, r.attempts) for r in L.replay(d, "k", ["n"], "s", "ok").collect()} == {"a": (1, "ok", 2), "b": (2, "failed", 2)}


def test_fold_crosses_batches(spark):
    d = spark.createDataFrame([(i % 3, i, 1) for i in range(3000)], "k long, n long, v long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = L.fold(d, "k", ["n"], lambda s, r: s + r.v, 0, "total", "k long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(tuple(r) for r in got) == [(0, 1000), (1, 1000), (2, 1000)]


def test_stream_resumes_without_repeats(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    schema = "id long, ts timestamp"
    for part in (range(0, 5), range(3, 8)):
        spark.createDataFrame([(i,) for i in part], "id long").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").json(source)
        L.follow(spark.readStream.schema(schema).json(source), "id", out, mark, "ts").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_flagship(spark, sf):
    from tarnwork.plans import flagship

    got = flagship(spark, sf)
    assert got.columns == ["split", "lang", "source", "n"] and got.count() > 0


def test_command_line(spark, capsys, tmp_path):
    from tarnwork.__main__ import main

    assert main(["list"]) == 0 and "first_wins_dedup" in capsys.readouterr().out
    out = f"file://{tmp_path}/rows"
    assert main(["run", "hash_order_limit", "--data", "/root/testdata/sf0.001", "--out", out]) == 0
    assert spark.read.parquet(out).count() == 50
    with pytest.raises(SystemExit):
        main(["run", "no such query", "--data", "x"])


def test_stop_decisions(spark):
    rows = [("a", i, m) for i, m in enumerate([0.1, 0.5, 0.505, 0.4, 0.3])] + [("b", i, 0.1 * i) for i in range(5)]
    got = {r.run: (r.best_step, r.checks_since, r.stop) for r in S.decide(spark.createDataFrame(rows, "run string, step int, m double"), "run", "step", "m", 0.01, 3, 99).collect()}
    assert got == {"a": (1, 3, True), "b": (4, 0, False)}


def test_unset_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        records.scratch(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    conf.get = lambda key, default=None: "hdfs://x/y/"
    assert records.scratch(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))).startswith("hdfs://x/y/tarnwork")
