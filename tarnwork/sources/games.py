"""Recorded games: tagged text, field markup and CSV exports, parsed, replayed and given an identity.

Each parser gives the game or the reason why it is none, so a bad record is a row in quarantine and not a failed job.
"""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from ..functions import board as B
from .records import decode_text, main_line, tags

RESULTS = ("1-0", "0-1", "1/2-1/2")
GAME = "game_id string, initial_fen string, moves array<string>, history array<string>, headers map<string,string>, result string, ended boolean, winner string, reason string, error string"
FIELDS = [x.split(" ")[0] for x in GAME.split(", ")]
#: The markup's starting position, and its words for results.
MARKUP_START = "8979695949392919097717866646260600102030405060708012720323436383"
MARKUP_RESULTS = {"红胜": "1-0", "先胜": "1-0", "黑胜": "0-1", "先负": "0-1", "和棋": "1/2-1/2", "和": "1/2-1/2", "先和": "1/2-1/2"}
COLUMNS = ("game_id", "move_index", "move", "timestamp", "red_player", "black_player", "outcome")  # of a CSV export


def game_id(initial: str, moves: list[str]) -> str:
    return "recorded-" + hashlib.sha256(json.dumps([initial, moves], separators=(",", ":")).encode()).hexdigest()


def resolve(fen: str, name: str) -> str:
    """The legal move that a coordinate pair or a Western or Chinese name stands for; none or several are an error."""
    if re.fullmatch(r"[A-Ia-i][0-9]-?[A-Ia-i][0-9]", name):
        move = name.replace("-", "").lower()
        if move not in B.legal_moves(fen):
            raise ValueError(f"illegal move {name}")
        return move
    plain = lambda x: "".join(_SAME.get(c, c) for c in x).rstrip("!?+#")
    wanted = plain(name)
    found = [m for m in B.legal_moves(fen) if wanted in {plain(x) for x in B.notation(fen, m) if x}]
    if len(found) != 1:
        raise ValueError(f"{len(found)} legal moves are named {name}")
    return found[0]


def _same() -> dict[str, str]:
    from ..functions.keys import NOTATION

    return dict(zip(*NOTATION, strict=True))


_SAME = _same()


def replayed(headers: dict[str, str], names: list[str], players: bool = True) -> dict:
    """A game from headers and moves' names: every ply is legal, nothing follows the end, and the result fits it."""
    result = headers.get("Result")
    if result not in RESULTS or players and not (headers.get("Red") and headers.get("Black")):
        raise ValueError("players or result are missing")
    if not names:
        raise ValueError("no moves")
    initial = B.write(*B.parse(headers.get("FEN", B.START)))
    history, moves = [initial], []
    for ply, name in enumerate(names):
        if B.outcome(history)[0]:
            raise ValueError(f"a move follows the end at ply {ply}")
        moves.append(resolve(history[-1], name))
        history.append(B.play(history[-1], moves[-1]))
    ended, winner, reason = B.outcome(history)
    if ended and {"red": "1-0", "black": "0-1", None: "1/2-1/2"}[winner] != result:
        raise ValueError("the result contradicts the final position")
    return dict(zip(FIELDS, (game_id(initial, moves), initial, moves, history, headers, result, ended, winner, reason, None), strict=True))


def from_text(raw: bytes, players: bool = True) -> dict:
    """A game in tagged text; its movetext ends with the declared result."""
    text = decode_text(raw)
    if text is None:
        raise ValueError("no known charset")
    headers = tags(text)
    if headers.get("Game", "Chinese Chess") != "Chinese Chess":
        raise ValueError("another game")
    body = re.sub(r"^\[[^\n]*\]\s*$", "", text, flags=re.MULTILINE)
    if not re.search(re.escape(headers.get("Result", "?")) + r"\s*$", body):
        raise ValueError("the movetext does not end with the result")
    return replayed(headers, main_line(text), players)


def from_markup(raw: bytes) -> dict:
    """A game in field markup: whole games from the standard start only, moves as quadruples of digits."""
    text = html.unescape(raw.decode("utf-8-sig"))
    found = {}
    for block in re.findall(r"\[DhtmlXQ\](.*?)\[/DhtmlXQ\]", text, re.DOTALL) or [text]:
        fields = {k: v.strip() for k, v in re.findall(r"\[DhtmlXQ_([a-z]+)\](.*?)\[/DhtmlXQ_\1\]", block, re.DOTALL)}
        digits = re.sub(r"\s+", "", fields.get("movelist", ""))
        if not digits:
            continue
        if fields.get("binit") != MARKUP_START or fields.get("firstnum", "0") != "0" or fields.get("type", "全局") != "全局":
            raise ValueError("not a whole game from the standard start")
        if not re.fullmatch(r"(?:[0-8][0-9]){2,}", digits) or len(digits) % 4 or int(fields.get("length", len(digits) // 4)) != len(digits) // 4:
            raise ValueError("the move list is not whole")
        names = [f"{B.FILES[int(a)]}{9 - int(b)}{B.FILES[int(c)]}{9 - int(d)}" for a, b, c, d in (digits[i : i + 4] for i in range(0, len(digits), 4))]
        result = MARKUP_RESULTS.get(fields.get("result", ""))
        year = re.match(r"(20\d{2})年", fields.get("event", ""))
        if result is None or not (fields.get("date") or year):
            raise ValueError("no result or no date")
        headers = {"Event": fields.get("event", ""), "Date": fields.get("date") or f"{year[1]}-??-??", "Red": fields.get("red", fields.get("redname", "")), "Black": fields.get("black", fields.get("blackname", "")), "Result": result}
        game = replayed(headers, names)
        found[game["game_id"]] = game
    if len(found) != 1:
        raise ValueError(f"the page has {len(found)} games")
    return next(iter(found.values()))


def parse(rows: DataFrame, ident: str, content: str, reader=from_text) -> DataFrame:
    """ident and the game in each content (binary), or its error."""
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for own, raw in frame.itertuples(index=False):
                try:
                    out.append((own, *reader(bytes(raw)).values()))
                except (ValueError, TypeError, UnicodeDecodeError) as e:
                    out.append((own, *[None] * (len(FIELDS) - 1), str(e)))
            yield pd.DataFrame(out, columns=[ident, *FIELDS])

    return rows.select(ident, content).mapInPandas(run, f"{ident} {rows.schema[ident].dataType.simpleString()}, {GAME}")


def csv_rows(archives: DataFrame, columns: tuple[str, ...] = COLUMNS, suffix: str = ".csv", most: int = 1 << 30) -> DataFrame:
    """archive, member, at, run and the columns of every row of the archives' CSV members, in order; ``run`` numbers a member's stretches of one game.

    Members are read as streams. Other columns than the named ones, in this order, and archives over ``most`` bytes are errors.
    """
    ship(archives.sparkSession)
    schema = "archive string, member string, at long, run long, " + ", ".join(f"{c} string" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if sum(i.file_size for i in z.infolist()) > most:
                        raise ValueError(f"{name} holds more than {most} bytes")
                    for info in z.infolist():
                        if not info.filename.endswith(suffix):
                            continue
                        with z.open(info) as raw:
                            reader = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                            if tuple(next(reader, ())) != columns:
                                raise ValueError(f"{name}/{info.filename} has other columns")
                            rows, number, before = [], 0, None
                            for at, row in enumerate(reader):
                                if len(row) != len(columns):
                                    raise ValueError(f"{name}/{info.filename} row {at} has {len(row)} fields")
                                number += before is not None and row[0] != before
                                before = row[0]
                                rows.append((name, info.filename, at, number, *row))
                                if len(rows) == 20_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "at", "run", *columns])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["archive", "member", "at", "run", *columns])

    return archives.select("path", "content").mapInPandas(run, schema)


def validate(rows: DataFrame, cutoff: str, least_plies: int = 1) -> DataFrame:
    """One row a game: game_id, plies, moves and errors (sorted codes). Indices run from 0 without a gap, players and outcome never change, times have a zone,
    never fall and end by the cutoff, and a game stands in one stretch of one member."""
    time = F.when(F.col("timestamp").rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp("timestamp"))
    index = F.col("move_index").try_cast("long")
    seen = rows.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("plies"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("distinct"), F.count(index).alias("indexed"),
        F.count_distinct("red_player", "black_player", "outcome").alias("meta"), F.count(time).alias("timed"), F.max(time).alias("last"), F.count_distinct("archive", "member", "run").alias("stretches"),
        F.array_sort(F.collect_list(F.struct(index.alias("i"), time.alias("t"), F.col("move").alias("m")))).alias("steps"),
    )
    times = F.transform("steps", lambda x: x["t"])
    falls = F.exists(F.zip_with(F.slice(times, F.lit(1), F.size("steps") - 1), F.slice(times, F.lit(2), F.size("steps")), lambda a, b: b < a), lambda x: F.coalesce(x, F.lit(False)))
    code = lambda bad, name: F.when(bad, F.lit(name))
    errors = F.array(
        code((F.col("low") != 0) | (F.col("high") != F.col("plies") - 1) | (F.col("distinct") != F.col("plies")) | (F.col("indexed") != F.col("plies")), "index"), code(F.col("meta") != 1, "metadata"),
        code(F.col("plies") < least_plies, "short"), code(F.col("stretches") != 1, "stretch"), code((F.size("steps") > 1) & falls, "time_falls"), code(F.col("timed") != F.col("plies"), "time_zone"), code(F.col("last") > F.lit(cutoff).cast("timestamp"), "too_late"),
    )
    return seen.select("game_id", "plies", F.transform("steps", lambda x: x["m"]).alias("moves"), F.array_sort(F.array_compact(errors)).alias("errors"))


def admit(games: DataFrame, ident: str, order: list[Column], errors: str, previous: DataFrame | None = None) -> DataFrame:
    """Each game with its stream: quarantined (it has errors), previous (an earlier import has its ident), duplicate (not the first of its ident) or admitted."""
    sound = games.filter(F.size(errors) == 0)
    first = sound.groupBy(F.col(ident).alias("_ident")).agg(F.min(F.struct(*order)).alias("_first"))
    marked = games.join(first, F.col(ident) == F.col("_ident"), "left")
    if previous is None:
        known = F.lit(False)
    else:
        marked = marked.join(previous.select(F.col(ident).alias("_p")).distinct(), F.col(ident) == F.col("_p"), "left")
        known = F.col("_p").isNotNull()
    stream = F.when(F.size(errors) > 0, "quarantined").when(known, "previous").when(F.struct(*order) == F.col("_first"), "admitted").otherwise("duplicate")
    return marked.withColumn("stream", stream).drop("_ident", "_first", "_p")


def reuse(previous: DataFrame, ident: str, split: str, expected: Column, identity: Column) -> DataFrame:
    """An earlier import's rows, each with whether its ident and split are still what the rules give: those that differ must not be reused."""
    return previous.withColumn("holds", F.col(ident).eqNullSafe(identity) & F.col(split).eqNullSafe(expected))


def log_lines(rows: DataFrame, carry: list[str], lines: str) -> DataFrame:
    """carry, best, candidates of each engine log (array of lines). A score counts if it is exact; of a move the last such line stands; the best move comes
    first, then moves by their rank in the last lines, then others, last seen first; three at most."""
    line = F.col(lines)
    exact = F.filter(line, lambda x: x.startswith("info ") & x.contains(" pv ") & x.rlike(r" score (?:cp|mate) -?\d+") & ~x.contains("upperbound") & ~x.contains("lowerbound") & (F.trim(F.substring_index(x, " pv ", -1)) != ""))

    def read(x, i):
        number = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit("")).cast("int")
        pv = F.split(F.trim(F.substring_index(x, " pv ", -1)), r"\s+")
        return F.struct(
            i.alias("at"), F.element_at(pv, 1).alias("move"), F.slice(pv, 1, 12).alias("pv"), F.regexp_extract(x, r" score (cp|mate) ", 1).alias("score_type"), number(r" score (?:cp|mate) (-?\d+)").alias("score"),
            number(r" depth (\d+)").alias("depth"), F.coalesce(number(r" multipv (\d+)"), F.lit(1)).alias("rank"),
            F.when(x.rlike(r" wdl \d+ \d+ \d+"), F.array(*[F.regexp_extract(x, r" wdl (\d+) (\d+) (\d+)", k).cast("int") for k in (1, 2, 3)])).alias("wdl"),
        )

    base = rows.select(*carry, F.regexp_extract(F.element_at(line, -1), r"^bestmove (\S+)", 1).alias("best"), F.transform(exact, read).alias("_all"))
    later = lambda key: lambda x: ~F.exists(F.col("_all"), lambda y: (y[key] == x[key]) & (y["at"] > x["at"]))
    kept = base.withColumn("_moves", F.filter("_all", later("move"))).withColumn("_ranks", F.filter("_all", later("rank")))
    rank_of = lambda x: F.array_min(F.transform(F.filter(F.col("_ranks"), lambda r: r["move"] == x["move"]), lambda r: r["rank"]))
    placed = F.transform("_moves", lambda x: F.struct(F.when(x["move"] == F.col("best"), 0).when(rank_of(x).isNotNull(), 1).otherwise(2).alias("a"), F.coalesce(rank_of(x), -x["at"]).alias("b"), x.alias("x")))
    top = F.slice(F.transform(F.array_sort(placed), lambda p: p["x"]), 1, 3)
    scored = F.exists("_moves", lambda x: x["move"] == F.col("best"))
    return kept.select(*carry, "best", F.when(scored, F.transform(top, lambda x: x.dropFields("at", "rank"))).alias("candidates"))


