"""Positions, rules, games, exports and engine logs against plain Python and known numbers."""

import hashlib
import json
import math
import re
import time

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import board as B
from tarnwork.functions import keys as K
from tarnwork.sources import games as G


def perft(fen, depth):
    moves = B.legal_moves(fen)
    return len(moves) if depth == 1 else sum(perft(B.play(fen, m), depth - 1) for m in moves)


@pytest.mark.parametrize(
    ("fen", "counts"),
    [
        (B.START, (44, 1920, 79666)),
        ("r1ba1a3/4kn3/2n1b4/pNp1p1p1p/4c4/6P2/P1P2R2P/1CcC5/9/2BAKAB2 w - - 0 1", (38, 1128)),
        ("1cbak4/9/n2a5/2p1p3p/5cp2/2n2N3/6PCP/3AB4/2C6/3A1K1N1 w - - 0 1", (7, 281)),
    ],
)
def test_move_counts_are_the_published_ones(fen, counts):
    assert tuple(perft(fen, d + 1) for d in range(len(counts))) == counts


def test_ends_of_games():
    mated = "3k5/4R4/9/9/9/9/9/9/3R5/4K4 b - - 0 1"
    assert B.in_check(mated) and B.outcome([mated]) == (True, "red", "checkmate")
    stale = "4k4/9/9/9/9/9/9/9/4r4/3K5 w - - 0 1"
    assert not B.in_check(stale) and B.outcome([stale]) == (True, "black", "stalemate")
    still = ["a0a1", "a9a8", "a1a0", "a8a9"] * 2
    assert B.outcome(B.replay(B.START, still)) == (True, None, "repetition")
    hunt = "4k4/9/9/9/9/9/9/9/3R5/5K3 w - - 0 1"
    history = B.replay(hunt, ["d1e1", "e9d9", "e1d1", "d9e9"] * 2)
    assert B.outcome(history) == (True, "black", "perpetual_check")
    with pytest.raises(ValueError, match="illegal"):
        B.replay(B.START, ["a0a5"])
    facing = "4k4/9/9/9/4R4/9/9/9/9/4K4 w - - 0 1"
    assert all(m[2] == "e" for m in B.legal_moves(facing) if m.startswith("e5")) and "e0d0" in B.legal_moves(facing)


def test_evasions_name_their_means():
    fen = "4k4/9/9/9/9/9/4r4/9/3A5/3AK4 w - - 0 1"
    assert B.in_check(fen)
    how = dict(B.evasions(fen))
    assert how["d1e2"] == "line" or how.get("d0e1") == "line"
    assert set(how) == set(B.legal_moves(fen)) and set(how.values()) <= {"line", "general", "capture"}


def test_native_board_functions(spark):
    fens = [B.START, "4k4/9/9/9/9/9/9/9/9/4K4 b - - 0 1", "rheakaehr/9/9/9/9/9/9/9/9/RHEAKAEHR w - - 0 1", "9/9 w", "9x/9/9/9/9/9/9/9/9/9 w", None]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "i int, fen string")
    got = frame.select("i", B.piece_map(F.col("fen")).alias("m"), B.material(F.col("fen")).alias("n"), B.mirror_fen(B.mirror_fen(F.col("fen"))).alias("same"), B.mirror_fen(F.col("fen")).alias("turned")).orderBy("i").collect()
    for r, fen in zip(got[:3], fens, strict=False):
        board, _, _ = B.parse(fen)
        assert r.m == {B._name(p): c for p, c in enumerate(board) if c != "."} and r.n == sum(B.POINTS[c.lower()] for c in board if c != ".")
        assert r.same == fen
        assert len(B.legal_moves(r.turned)) == len(B.legal_moves(fen))
    assert [r.m for r in got[3:]] == [None] * 3
    moves = spark.createDataFrame([("a1i10",), ("b10c1",), ("a0b1",), ("j1a1",), (None,)], "m string").select(B.from_one_based(F.col("m")).alias("m")).collect()
    assert [r.m for r in moves] == ["a0i9", "b9c0", None, None, None]


def test_score_probability_by_hand(spark):
    def by_hand(points, score):
        m = max(17, min(110, points)) / 65
        a, b = (((c[0] * m + c[1]) * m + c[2]) * m + c[3] for c in (B.MIDDLE, B.WIDTH))
        won = lambda x: int(0.5 + 1000 / (1 + math.exp(max(-80, min(80, (a - x) / b)))))
        x = score * a / 100
        return (won(x) + (1000 - won(x) - won(-x)) / 2) / 1000

    rows = [(110, "cp", 35, None), (5, "cp", -900, None), (64, "mate", 3, None), (64, "mate", -1, None), (64, "cp", 0, [100, 500, 400]), (64, "cp", 0, [1, 2, 3]), (64, "odd", 0, None)]
    got = [r.p for r in spark.createDataFrame(rows, "n int, k string, s int, w array<int>").select(B.score_probability(F.col("n"), F.col("k"), F.col("s"), F.col("w")).alias("p")).collect()]
    assert got[:2] == pytest.approx([by_hand(110, 35), by_hand(5, -900)]) and got[2:] == [1.0, 0.0, 0.35, None, None]


def test_a_position_is_read_once(spark):
    """An argument used many times over made plans that compiled for minutes; each function holds it once."""
    fen = F.concat(F.col("board"), F.lit(" w - - 0 1"))
    points = B.material(fen)
    for made in (B.squares(fen), B.count(fen, "R"), points, B.score_probability(points, F.lit("cp"), F.lit(35))):
        assert str(made).count("board") == 1
    boards = ["rheakaehr/9/1c5c1/p1p1p1p1p/9/9/P1P1P1P1P/1C5C1/9/RNBAKABNR", "R8/9/9/9/4k4/9/4K4/9/9/8R", "9/9", "9x/9/9/9/9/9/9/9/9/9", "", None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(boards)], "i int, board string")
    score = B.score_probability(F.lit(0) + points, F.lit("cp"), F.lit(0))
    got = frame.select("i", B.count(fen, "R").alias("n"), points.alias("points"), score.alias("p")).orderBy("i").collect()
    assert [(r.n, r.points) for r in got] == [(2, 110), (2, 20), (None, None), (None, None), (None, None), (None, None)]
    assert [r.p for r in got[:2]] == [0.5, 0.5]


def test_material_takes_less_than_writing_a_board_out(spark):
    """It was counted in the board as written out, letter by letter, which took most of the query's time."""
    ranks = ["rnbakabnr", "1c5c1", "p1p1p1p1p", "RHEAKAEHR", "....4k", "9x", "8", "91", "5/4", "é8"]
    fens = [None, "", " ", *("/".join([r] + ["9"] * 9) + end for r in ranks for end in ("", " w - - 0 1", "\tw", "/9")), "9/" * 10, "9" * 10, "9/" * 10_000, "8/91/" + "9/" * 7 + "9"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "i int, fen string").select("i", B.material(F.col("fen")).alias("n")).orderBy("i").collect()
    points = dict(zip(ranks, (40, 10, 5, 40, 0), strict=False))
    found = {"/".join([r] + ["9"] * 9) + end: n for r, n in points.items() for end in ("", " w - - 0 1", "\tw")}
    assert [r.n for r in rows] == [found.get(f) for f in fens]
    many = spark.range(0, 100_000, 1, 1).select(F.concat(F.repeat(F.lit("rnbakabnr/"), 9), F.when(F.col("id") % 2 == 0, "1C5C1").otherwise("4K4"), F.lit(" w - - 0 1")).alias("fen"))

    def seconds(made):
        began = time.perf_counter()
        many.select(made.alias("x")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took = [min(seconds(made) for _ in range(3)) for made in (B.squares(F.col("fen")), B.material(F.col("fen")))]
    assert took[1] < took[0], took


def test_a_piece_map_reads_its_position_once(spark):
    """The board was decoded anew for each of its 90 places."""
    fen = F.concat(F.col("board"), F.lit(" w - - 0 1"))
    assert str(B.piece_map(fen)).count("board") == 1
    boards = ["r7R/9/9/h8/4k4/9/4K4/8E/9/P7p", "9/9/9/9/9/9/9/9/9/9", "9/9", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(boards)], "i int, board string").select("i", B.piece_map(fen).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [{"a9": "r", "i9": "R", "a6": "n", "e5": "k", "e3": "K", "i2": "B", "a0": "P", "i0": "p"}, {}, None, None]


def test_keys_are_json(spark):
    items = [["a", "b"], ['a", "b'], ["é", "棋", "😀"], ["\\", "\n\t\x01\x7f", ""], [], [None, "x"]]
    got = [r.k for r in spark.createDataFrame([(i,) for i in items], "h array<string>").select(K.history_key(F.col("h")).alias("k")).collect()]
    assert got == [hashlib.sha256(json.dumps(i).encode()).hexdigest() for i in items] and len(set(got)) == len(items)
    rows = [("a", None), (None, 'q"\\'), ("棋", "1"), ("a", "null")]
    got = [r.k for r in spark.createDataFrame(rows, "x string, y string").select(K.fingerprint(y=F.col("y"), x=F.col("x")).alias("k")).collect()]
    assert got == [hashlib.sha256(json.dumps({"x": x, "y": y}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for x, y in rows]
    got = spark.createDataFrame([("é 1", ["a0a1", "b0b1"])], "f string, m array<string>").select(K.context_key(F.col("f"), F.col("m")).alias("k")).first().k
    assert got == hashlib.sha256(json.dumps(["é 1", ["a0a1", "b0b1"]], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_normal_forms(spark):
    import unicodedata

    texts = ["ａｂｃ", "ﬁne  “x”. ", "砲二平五!?", None, "馬８進７+"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(K.normalize_text(F.col("t")).alias("n"), K.normalize_notation(F.col("t")).alias("m")).collect()
    assert [r.n for r in frame][:2] == ["abc", 'fine "x"'] and frame[2].m == "炮2平5" and frame[4].m == "马8进7" and frame[3].n is None
    assert all(unicodedata.is_normalized("NFKC", r.n) for r in frame if r.n)


def test_games_in_text():
    head = '[Game "Chinese Chess"]\n[Red "a \\"x\\""]\n[Black "b"]\n[Result "1-0"]\n\n'
    game = G.from_text((head + "1. 炮二平五 (1. C8=5 H2+3) 马8进7 {c} 2. h0-g2 ; x\n 1-0").encode("big5", "ignore") if False else (head + "1. 炮二平五 (1. C8=5 H2+3) 马8进7 {c} 2. h0-g2 ; x\n 1-0").encode())
    assert game["moves"] == ["h2e2", "h9g7", "h0g2"] and game["headers"]["Red"] == 'a "x"'
    assert game["game_id"] == "recorded-" + hashlib.sha256(json.dumps([B.START, game["moves"]], separators=(",", ":")).encode()).hexdigest()
    assert G.from_text((head + "1. 砲二平五 馬8進7 2. 馬二進三 1-0").encode("big5"))["moves"] == game["moves"]
    bad = {
        "1. a0a9 1-0": "illegal", "1. 马二进三": "end with the result", "1-0": "no moves", "1. 炮五平五 1-0": "0 legal moves",
    }
    for text, why in bad.items():
        with pytest.raises(ValueError, match=why):
            G.from_text((head + text).encode())
    with pytest.raises(ValueError, match="repeated"):
        G.from_text((head.replace("[Black", "[Red") + "1. h2e2 1-0").encode())
    with pytest.raises(ValueError, match="players"):
        G.from_text(b'[Result "1-0"]\n\n1. h2e2 1-0')
    mate = "3k5/4R4/9/9/9/9/9/9/4R4/4K4 w - - 0 1"
    with pytest.raises(ValueError, match="contradicts"):
        G.from_text(f'[Red "a"]\n[Black "b"]\n[Result "0-1"]\n[FEN "{mate}"]\n\n1. e1d1 0-1'.encode())
    with pytest.raises(ValueError, match="follows the end"):
        G.from_text(f'[Red "a"]\n[Black "b"]\n[Result "1-0"]\n[FEN "{mate}"]\n\n1. e1d1 d9d8 1-0'.encode())


def test_every_name_finds_its_move():
    history = B.replay(B.START, ["h2e2", "h9g7", "h0g2", "i9h9", "i0h0", "b9c7", "b0c2", "c6c5"])
    for fen in history:
        for move in B.legal_moves(fen):
            for name in B.notation(fen, move):
                assert G.resolve(fen, name) == move


def test_csv_games_and_streams(spark):
    columns = "archive string, member string, run long, game_id string, move_index string, move string, timestamp string, red_player string, black_player string, outcome string"

    def game(name, n, index=lambda i: i, red=lambda i: "r", time=lambda i: f"2024-01-0{i + 1}T00:00:00Z", run=lambda i: 0):
        return [("a", "m", run(i), name, str(index(i)), f"m{i}", time(i), red(i), "b", "1-0") for i in range(n)]

    rows = [
        *game("fine", 3), *game("gap", 3, index=lambda i: 2 * i), *game("text", 2, index=lambda i: i or "x"), *game("drift", 3, red=lambda i: "r" * (i // 2 + 1)), *game("back", 3, time=lambda i: f"2024-01-0{5 - i}T00:00:00+08:00"),
        *game("late", 2, time=lambda i: f"2025-01-0{i + 1}T00:00:00Z"), *game("naive", 2, time=lambda i: "2024-01-01 00:00:00"), *game("torn", 3, run=lambda i: i % 2), *game("one", 1),
    ]
    got = {r.game_id: r for r in G.validate(spark.createDataFrame(rows, columns), "2024-12-31T00:00:00Z", 2).collect()}
    assert {k: list(r.errors) for k, r in got.items()} == {"fine": [], "gap": ["index"], "text": ["index"], "drift": ["metadata"], "back": ["time_falls"], "late": ["too_late"], "naive": ["time_zone"], "torn": ["stretch"], "one": ["short"]}
    assert list(got["fine"].moves) == ["m0", "m1", "m2"]
    frame = spark.createDataFrame([(1, "a", []), (2, "a", []), (3, "b", ["x"]), (4, "b", []), (5, "c", [])], "n int, g string, e array<string>")
    earlier = spark.createDataFrame([("c",)], "g string")
    assert {r.n: r.stream for r in G.admit(frame, "g", [F.col("n")], "e", earlier).collect()} == {1: "admitted", 2: "duplicate", 3: "quarantined", 4: "admitted", 5: "previous"}


def test_csv_in_archives_is_strict(spark):
    import io
    import zipfile

    def archive(text):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("x.csv", text), z.writestr("y.txt", "no")
        return [("p", data.getvalue())]

    head = ",".join(G.COLUMNS)
    got = G.csv_rows(spark.createDataFrame(archive(head + '\ng,0,m,t,"a, ""b""",c,1-0\nh,0,m,t,a,c,1-0\ng,1,m,t,a,c,1-0\n'), "path string, content binary")).orderBy("at").collect()
    assert [(r.game_id, r.run) for r in got] == [("g", 0), ("h", 1), ("g", 2)] and got[0].red_player == 'a, "b"'
    for text, why in ((head + ",x\n", "other columns"), (head + "\ng,0\n", "2 fields")):
        with pytest.raises(Exception, match=why):
            G.csv_rows(spark.createDataFrame(archive(text), "path string, content binary")).collect()


def by_hand_log(lines):
    best, ranks, scored = lines[-1].split()[1], {}, {}
    for x in lines:
        if x.startswith("info ") and " pv " in x and re.search(r" score (cp|mate) -?\d+", x) and "bound" not in x:
            pv = x.split(" pv ")[1].split()
            rank = re.search(r"multipv (\d+)", x)
            ranks[int(rank[1]) if rank else 1] = pv[0]
            scored.pop(pv[0], None)
            scored[pv[0]] = int(re.search(r"score (?:cp|mate) (-?\d+)", x)[1])
    if best not in scored:
        return None
    return [(m, scored[m]) for m in dict.fromkeys([best, *[ranks[k] for k in sorted(ranks)], *reversed(scored)])][:3]


def test_engine_logs(spark):
    import random

    rng = random.Random(4)
    logs = []
    for n in range(60):
        lines = [f"info depth {d} multipv {rng.randint(1, 4)} score {rng.choice(['cp', 'mate'])} {rng.randint(-9, 9)}{rng.choice(['', '', ' upperbound'])} pv {rng.choice('abcdef')} z" for d in range(rng.randint(1, 9))]
        lines += rng.choice([[], ["info string pv", "info nodes 3"]])
        logs.append((n, [*lines, f"bestmove {rng.choice('abcdef')}"]))
    got = G.log_lines(spark.createDataFrame(logs, "n int, lines array<string>"), ["n"], "lines").collect()
    for r in got:
        want = by_hand_log(logs[r.n][1])
        assert (None if r.candidates is None else [(c.move, c.score) for c in r.candidates]) == want
