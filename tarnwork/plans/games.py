"""Queries over positions, games, exports and engine logs. Positions and games are made from the tables by rules that SQL can state too."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import board as B
from ..functions import keys as K
from ..sources import games as G
from .registry import Tables, query

#: Ranks that positions are put together from, by the first ten hexadecimal digits of an event's hash.
RANKS = ("9", "rnbakabnr", "1c5c1", "p1p1p1p1p", "P1P1P1P1P", "1C5C1", "RNBAKABNR", "4k4", "4K4", "r7r", "2b3b2", "3aka3", "3AKA3", "N7N", "c3p3C", "8P")
HEX = "0123456789abcdef"
#: Two openings that games are cut from.
OPENINGS = (("h2e2", "h9g7", "h0g2", "i9h9", "i0h0", "b9c7", "b0c2", "c6c5"), ("c3c4", "g9e7", "b0c2", "h9g7", "c2d4", "i9i8", "a0a2", "i8f8"))


def whole(rank: str) -> str:
    return "".join("." * int(c) if c.isdigit() else c for c in rank)


def positions(t: Tables):
    digit = lambda i: F.instr(F.lit(HEX), F.substring("h", i, 1))
    ranks = F.array(*[F.element_at(F.array(*map(F.lit, RANKS)), F.expr(f"instr('{HEX}', substring(h, {i}, 1))")) for i in range(1, 11)])
    hashed = t.events.select("event_id", "event_type", "value", F.sha2(F.col("event_id").cast("string"), 256).alias("h"))
    return hashed.select("event_id", "event_type", "value", F.concat(F.array_join(ranks, "/"), F.lit(" w - - 0 1")).alias("fen"))


def sql_positions() -> str:
    """event_id, event_type, value, b: the 90 places from a9 to i0."""
    names = "[" + ", ".join(f"'{whole(r)}'" for r in RANKS) + "]"
    parts = " || ".join(f"{names}[position(substr(h, {i}, 1) in '{HEX}')]" for i in range(1, 11))
    return f"p as (select event_id, event_type, value, {parts} as b from (select event_id, event_type, value, sha256(cast(event_id as varchar)) as h from events))"


@query(f"""with {sql_positions()}, s as (select event_id, substr('abcdefghi', i % 9 + 1, 1) || (9 - i // 9) || substr(b, i + 1, 1) as x from p, unnest(range(0, 90)) as u(i) where substr(b, i + 1, 1) <> '.')
    select p.event_id, count(x) as n_pieces, coalesce(string_agg(x, ' ' order by x), '') as pieces from p left join s on s.event_id = p.event_id group by p.event_id""")
def board_decode(t: Tables):
    entries = F.map_entries(B.piece_map(F.col("fen")))
    named = F.sort_array(F.transform(entries, lambda e: F.concat(e["key"], e["value"])))
    return positions(t).select("event_id", named.alias("named")).select("event_id", F.size("named").cast("long").alias("n_pieces"), F.array_join("named", " ").alias("pieces"))


@query(f"""with {sql_positions()}, r as (select event_id, string_agg(substr(b, 9 * k + 1, 9), '' order by k desc) as m from p, unnest(range(0, 10)) as u(k) group by event_id)
    select event_id, translate(m, 'rnbakcpRNBAKCP', 'RNBAKCPrnbakcp') as places, 'b' as side from r""")
def board_mirror(t: Tables):
    turned = positions(t).select("event_id", B.mirror_fen(F.col("fen")).alias("fen"))
    return turned.select("event_id", B.squares(F.col("fen")).alias("places"), F.split("fen", " ")[1].alias("side"))


@query("""select l_orderkey, l_linenumber, substr('abcdefghi', cast(l_partkey % 9 as int) + 1, 1) || (l_suppkey % 10) || substr('abcdefghi', cast(l_orderkey % 9 as int) + 1, 1) || (l_linenumber % 10) as move,
    substr('abcdefghi', cast(l_partkey % 9 as int) + 1, 1) || (l_suppkey % 10 + 1) || substr('abcdefghi', cast(l_orderkey % 9 as int) + 1, 1) || (l_linenumber % 10 + 1) as one_based,
    substr('abcdefghi', cast(l_partkey % 9 as int) + 1, 1) || (9 - l_suppkey % 10) || substr('abcdefghi', cast(l_orderkey % 9 as int) + 1, 1) || (9 - l_linenumber % 10) as mirrored from lineitem""")
def move_codec(t: Tables):
    letter = lambda c: F.substring(F.lit(B.FILES), (F.col(c) % 9 + 1).cast("int"), F.lit(1))
    rank = lambda c: (F.col(c) % 10 + 1).cast("string")
    moves = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(letter("l_partkey"), rank("l_suppkey"), letter("l_orderkey"), rank("l_linenumber")).alias("one_based"))
    coded = moves.withColumn("move", B.from_one_based(F.col("one_based")))
    return coded.select("l_orderkey", "l_linenumber", "move", B.to_one_based(F.col("move")).alias("one_based"), B.mirror_move(F.col("move")).alias("mirrored"))


COUNT = "len(b) - len(replace(b, '{p}', ''))"
MATERIAL = " + ".join(f"({COUNT.format(p=p)} + {COUNT.format(p=p.upper())}) * {n}" for p, n in B.POINTS.items() if n)


@query(f"""with {sql_positions()} select event_id, {COUNT.format(p="R")} as n_red_rooks, {COUNT.format(p="p")} as n_black_pawns, {MATERIAL} as material, len(replace(substr(b, 1, 9), '.', '')) as on_rank_9 from p""")
def board_counts(t: Tables):
    at_home = F.length(F.replace(F.substring(B.squares(F.col("fen")), 1, 9), F.lit("."), F.lit("")))
    return positions(t).select(
        "event_id", B.count(F.col("fen"), "R").cast("long").alias("n_red_rooks"), B.count(F.col("fen"), "p").cast("long").alias("n_black_pawns"), B.material(F.col("fen")).cast("long").alias("material"), at_home.cast("long").alias("on_rank_9")
    )


def _curve(c):
    return f"((({c[0]} * m + {c[1]}) * m + {c[2]}) * m + {c[3]})"


@query(f"""with {sql_positions()}, s as (select event_id, event_type, cast(floor(value) as int) * 10 - 500 as score, greatest(17, least(110, {MATERIAL})) / 65.0::double as m from p),
    c as (select *, {_curve(B.MIDDLE)} as a, {_curve(B.WIDTH)} as w from s), e as (select *, score * a / 100.0 as x from c),
    f as (select *, floor(0.5 + 1000 / (1 + exp(greatest(-80, least(80, (a - x) / w))))) as win, floor(0.5 + 1000 / (1 + exp(greatest(-80, least(80, (a + x) / w))))) as loss from e)
    select event_id, round(case event_type when 'error' then case when score > 0 then 1.0 else 0.0 end else (win + (1000 - win - loss) / 2) / 1000.0 end, 6) as p from f""")
def score_probability(t: Tables):
    score = F.floor("value").cast("int") * 10 - 500
    kind = F.when(F.col("event_type") == "error", "mate").otherwise("cp")
    return positions(t).select("event_id", F.round(B.score_probability(B.material(F.col("fen")), kind, score), 6).alias("p"))


def opening(t: Tables):
    """A game a user: an opening, cut after one to eight moves."""
    users = t.events.select("user_id").distinct()
    lines = F.when(F.col("user_id") % 2 == 0, F.array(*map(F.lit, OPENINGS[0]))).otherwise(F.array(*map(F.lit, OPENINGS[1])))
    return users.select("user_id", F.slice(lines, F.lit(1), (F.col("user_id") % 8 + 1).cast("int")).alias("moves"))


LINES = "[" + ", ".join("[" + ", ".join(f"'{m}'" for m in o) + "]" for o in OPENINGS) + "]"
SQL_OPENING = f"o as (select user_id, list_slice({LINES}[user_id % 2 + 1], 1, user_id % 8 + 1) as moves from (select distinct user_id from events))"
ID = f"""'recorded-' || sha256('["{B.START}",["' || array_to_string(moves, '","') || '"]]')"""


@query(f"""with {SQL_OPENING} select user_id, case when user_id % 9 = 4 then null else {ID} end as game_id, case when user_id % 9 = 4 then null else len(moves) end as plies,
    user_id % 9 <> 4 as sound from o""")
def game_parse(t: Tables):
    """Games as tagged text with comments and variations, in Western names or coordinates; a ninth of them has an illegal move."""
    text = F.concat(
        F.lit('[Game "Chinese Chess"]\n[Red "a"]\n[Black "b"]\n[Result "1/2-1/2"]\n\n'),
        F.array_join(F.transform("moves", lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(i % 2 == 0, F.upper(m)).otherwise(F.concat(F.substring(m, 1, 2), F.lit("-"), F.substring(m, 3, 2))), F.lit(" {h2e2 (x)} ; note\n"))), ""),
        F.when(F.col("user_id") % 9 == 4, "a0a9 ").otherwise("(1. a3a4) "), F.lit("1/2-1/2\n"),
    )
    found = G.parse(opening(t).select("user_id", F.encode(text, "utf-8").alias("raw")), "user_id", "raw")
    return found.select("user_id", "game_id", F.when(F.col("error").isNull(), F.size("moves").cast("long")).alias("plies"), F.col("error").isNull().alias("sound"))


@query(f"""with {SQL_OPENING} select user_id, case when user_id % 5 <> 3 then {ID} end as game_id from o""")
def markup_parse(t: Tables):
    """Games as field markup, moves as digits; a fifth of them declares a wrong length."""
    place = lambda m, i: F.concat((F.ascii(F.substring(m, i, 1)) - 97).cast("string"), (9 - F.substring(m, i + 1, 1).cast("int")).cast("string"))
    digits = F.array_join(F.transform("moves", lambda m: F.concat(place(m, 1), place(m, 3))), "\n")
    field = lambda k, v: F.concat(F.lit(f"[DhtmlXQ_{k}]"), v, F.lit(f"[/DhtmlXQ_{k}]"))
    length = (F.size("moves") + F.when(F.col("user_id") % 5 == 3, 1).otherwise(0)).cast("string")
    text = F.concat(F.lit("<p>[DhtmlXQ]"), field("binit", F.lit(G.MARKUP_START)), field("red", F.lit("a")), field("black", F.lit("b")), field("date", F.lit("2020-01-01")), field("result", F.lit("和")), field("length", length), field("movelist", digits), F.lit("[/DhtmlXQ]</p>"))
    return G.parse(opening(t).select("user_id", F.encode(text, "utf-8").alias("raw")), "user_id", "raw", G.from_markup).select("user_id", "game_id")


def _archives(rows, name: str):
    """CSV members in one ZIP archive a row of (path, member, text)."""

    def pack(frames):
        for f in frames:
            out = []
            for path, text in f.itertuples(index=False):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(name, text), z.writestr("readme.md", "not a table")
                out.append((path, data.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(pack, "path string, content binary")


@query("""select 'u' || user_id as game_id, count(*) as plies, string_agg(event_type, ' ' order by ts, event_id) as moves,
    array_to_string(list_filter([case when user_id % 7 = 1 and count(*) > 1 then 'index' end, case when user_id % 7 = 2 and count(*) > 1 then 'metadata' end, case when count(*) < 5 then 'short' end,
      case when user_id % 7 = 3 then 'time_zone' end, case when max(ts) > timestamp '2024-01-30 12:00:00' and user_id % 7 <> 3 then 'too_late' end], lambda x: x is not null), ',') as errors from events group by user_id""")
def csv_games(t: Tables):
    """A game a user as a CSV member of an archive; some have a gap in their index, a player who changes, or times without a zone."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = t.events.select("user_id", "event_type", "ts", "event_id", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    index = F.col("i") + F.when((F.col("user_id") % 7 == 1) & (F.col("i") > 0), 1).otherwise(0)
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("user_id") % 7 == 3, "").otherwise("Z"))
    black = F.when((F.col("user_id") % 7 == 2) & (F.col("i") == F.col("n") - 1), "other").otherwise("b,\"c\"")
    line = F.concat_ws(",", F.concat(F.lit("u"), "user_id"), index.cast("string"), "event_type", time, F.lit("a"), F.concat(F.lit('"'), F.replace(black, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("1-0"))
    games = numbered.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    text = F.concat(F.lit(",".join(G.COLUMNS) + "\n"), F.array_join("lines", "\n"), F.lit("\n"))
    rows = G.csv_rows(_archives(games.select(F.concat(F.lit("memory-"), "user_id").alias("path"), text.alias("text")), "games.csv"))
    found = G.validate(rows, "2024-01-30T12:00:00Z", least_plies=5)
    return found.select("game_id", "plies", F.array_join("moves", " ").alias("moves"), F.array_join("errors", ",").alias("errors"))


@query("""with e as (select user_id, event_type, cast(floor(value) as int) as score, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_id % 11 <> 0)
    select user_id, max(case when k = 1 then event_type end) as best, max(case when k = 1 then score end) as score, least(3, count(distinct event_type)) as n_candidates from e group by user_id""")
def engine_log_parse(t: Tables):
    """Engine logs made of events: bounds are no scores, the last exact line of a move stands, the best move comes first."""
    line = F.concat(
        F.lit("info depth "), (F.col("event_id") % 30).cast("string"), F.lit(" multipv "), (F.col("event_id") % 3 + 1).cast("string"), F.lit(" score cp "), F.floor("value").cast("int").cast("string"),
        F.when(F.col("event_id") % 11 == 0, " upperbound").otherwise(""), F.lit(" nodes 5 pv "), "event_type", F.lit(" x y"),
    )
    one = F.struct("ts", "event_id", line.alias("line"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("move"))
    logs = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    last = F.element_at(F.filter("l", lambda x: x["move"].isNotNull()), -1)["move"]
    logs = logs.filter(F.exists("l", lambda x: x["move"].isNotNull())).select("user_id", F.concat(F.transform("l", lambda x: x["line"]), F.array(F.concat(F.lit("bestmove "), last))).alias("lines"))
    found = G.log_lines(logs, ["user_id"], "lines")
    return found.select("user_id", "best", F.col("candidates")[0]["score"].alias("score"), F.size("candidates").cast("long").alias("n_candidates"))


@query()
def legal_move_tasks(t: Tables):
    """Positions along each user's opening: legal moves, captures, checks, mates, and how checks end."""
    lines = opening(t).select("user_id", F.explode(B.replay_of(F.lit(B.START), "moves")).alias("fen"))
    found = lines.select("user_id", "fen", B.legal_moves_of("fen").alias("moves"), B.tasks_of("fen").alias("t"))
    return found.select("user_id", "fen", F.size("moves").alias("n_moves"), F.size("t.captures").alias("n_captures"), F.size("t.checks").alias("n_checks"), F.size("t.mates").alias("n_mates"), F.size("t.evasions").alias("n_evasions"))


@query(f"""with {SQL_OPENING} select user_id, len(moves) + 1 as n_positions, 'w' as side_at_start, case when len(moves) % 2 = 0 then 'w' else 'b' end as side, false as ended from o""")
def game_replay(t: Tables):
    played = opening(t).withColumn("history", B.replay_of(F.lit(B.START), "moves"))
    stand = played.withColumn("s", B.state_of("history"))
    side = lambda c: F.split(c, " ")[1]
    return stand.select("user_id", F.size("history").cast("long").alias("n_positions"), side(F.col("history")[0]).alias("side_at_start"), side(F.element_at("history", -1)).alias("side"), F.col("s.ended").alias("ended"))


@query("""select event_id, event_type <> 'error' or event_id % 2 = 0 as holds from events""")
def mate_claims(t: Tables):
    """Mate in one claimed for a position where it is one, with a line that mates or one that does not."""
    fen = "3k5/4R4/9/9/9/9/9/9/4R4/4K4 w - - 0 1"
    kind = F.when(F.col("event_type") == "error", "mate").otherwise("cp")
    line = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("e1d1"))).otherwise(F.array(F.lit("e8e7")))
    return t.events.select("event_id", B.mate_claim_holds(F.lit(fen), kind, F.lit(1), line).alias("holds"))


@query("""with r as (select doc_id, lang, sha256(text) as h, array_to_string(list_filter([case when length(text) < 40 then 'short' end, case when text like '%###%' then 'junk' end], lambda x: x is not null), ',') as errors from documents),
    k as (select *, min(case when errors = '' then doc_id end) over (partition by h) as first from r), p as (select distinct h from r where lang = 'de' and errors = '')
    select doc_id, errors, case when errors <> '' then 'quarantined' when h in (select h from p) then 'previous' when doc_id = first then 'admitted' else 'duplicate' end as stream from k""")
def admit_quarantine_split(t: Tables):
    """Every document with its stream; German ones stand for an earlier import."""
    code = lambda bad, name: F.when(bad, F.lit(name))
    rows = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("h"), F.array_compact(F.array(code(F.length("text") < 40, "short"), code(F.col("text").contains("###"), "junk"))).alias("errors"))
    earlier = rows.filter((F.col("lang") == "de") & (F.size("errors") == 0))
    return G.admit(rows, "h", [F.col("doc_id")], "errors", earlier).select("doc_id", F.array_join("errors", ",").alias("errors"), "stream")


@query("""select doc_id, doc_id % 10 <> 3 and doc_id % 10 <> 7 as holds from documents where doc_id % 2 = 1""")
def previous_import_reuse(t: Tables):
    """An earlier import of the odd documents, in which some idents and some splits are not what the rules give any more."""
    split = K.assigned_split("7", F.col("doc_id"))
    ident = F.sha2("text", 256)
    earlier = t.documents.filter("doc_id % 2 = 1").select("doc_id", "text", F.when(F.col("doc_id") % 10 == 3, "stale").otherwise(ident).alias("ident"), F.when(F.col("doc_id") % 10 == 7, "other").otherwise(split).alias("split"))
    return G.reuse(earlier, "ident", "split", split, ident).select("doc_id", "holds")
