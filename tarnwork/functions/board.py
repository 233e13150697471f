"""Xiangqi positions: what a FEN says as Column functions, and a rules kernel for what only search can say.

Squares are a0 to i9, red's side first; FEN ranks run from 9 down to 0. The kernel holds a board as 90 places (rank * 9 + file) and
knows moves, checks, mates and repetitions. It runs in Arrow batches and remembers positions within a worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

START = "rnbakabnr/9/1c5c1/p1p1p1p1p/9/9/P1P1P1P1P/1C5C1/9/RNBAKABNR w - - 0 1"
#: Points of a piece for the score model, and other letters that stand for a piece.
POINTS = {"r": 10, "n": 5, "c": 5, "b": 3, "a": 2, "p": 1, "k": 0}
OTHER_LETTERS = {"h": "n", "e": "b"}
FILES = "abcdefghi"


# What a FEN says, in the JVM but for `material`. A column's expression is copied wherever it is used, so `squares` and what is built on it use their argument once.


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def squares(fen: Column) -> Column:
    """The board's 90 places from a9 to i0 as a string, '.' where empty; null if it does not have 10 ranks of 9 files."""
    board = F.element_at(F.split(fen, r"\s+"), 1)
    for n in range(1, 10):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    board = F.translate(board, "heHE", "nbNB")
    whole = F.regexp_extract_all(board, F.lit(r"^(?:[.racpnbkRACPNBK]{9}/){9}[.racpnbkRACPNBK]{9}$"), F.lit(0))
    return F.replace(F.get(whole, F.lit(0)), F.lit("/"), F.lit(""))


def piece_map(fen: Column) -> Column:
    """square -> piece; null for what is no board."""
    names = F.array(*[F.lit(f"{FILES[i % 9]}{9 - i // 9}") for i in range(90)])
    places = F.zip_with(names, F.split(squares(fen), ""), lambda k, v: F.when(v != ".", F.struct(k.alias("k"), v.alias("v"))))
    return F.map_from_entries(F.array_compact(places))


def count(fen: Column, piece: str) -> Column:
    return F.lit(90) - F.length(F.replace(squares(fen), F.lit(piece), F.lit("")))


#: By byte: points, files it takes up, whether it ends a field, and whether it stands in no board.
POINTS_OF, FILES_OF, SPACE, ODD = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, bool), np.ones(256, bool)
for _c in (*POINTS, *OTHER_LETTERS):
    for _x in (ord(_c), ord(_c.upper())):
        POINTS_OF[_x], FILES_OF[_x] = POINTS[OTHER_LETTERS.get(_c, _c)], 1
FILES_OF[ord(".")] = 1
FILES_OF[ord("1") : ord("9") + 1] = range(1, 10)
SPACE[list(b" \t\n\v\f\r")] = True
ODD[FILES_OF > 0] = ODD[ord("/")] = False
#: Characters of the longest board; any that is longer is none, as are its first BOARD + 1.
BOARD = 99


def _before(x: np.ndarray) -> np.ndarray:
    """Sums of all that stand before each place, and of all."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


@arrow_udf(T.IntegerType())
def points_of(fens: pa.Array) -> pa.Array:
    """`material` of a batch: sums over all bytes at once, whose differences are each board's own."""
    fens = fens.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(fens.buffers()[1], np.int64)[fens.offset :][: len(fens) + 1]
    starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    data = np.frombuffer(fens.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    spaces = np.append(np.flatnonzero(SPACE[data]), len(data))
    ends = np.minimum(ends, spaces[np.searchsorted(spaces, starts)])
    slash = data == ord("/")
    slashes, slashes_before, odd_before, points_before = np.flatnonzero(slash), _before(slash), _before(ODD[data]), _before(POINTS_OF[data])
    surplus = _before(FILES_OF[data] - 9 * slash)  # files less nine a slash: after each slash of a board as at its start
    sound = (slashes_before[ends] - slashes_before[starts] == 9) & (odd_before[ends] == odd_before[starts]) & (surplus[ends] - surplus[starts] == 9)
    some = np.flatnonzero(sound)
    ranks = slashes[slashes_before[starts[some], None] + np.arange(9)]
    sound[some] = (surplus[ranks + 1] == surplus[starts[some], None]).all(axis=1)
    return pa.array((points_before[ends] - points_before[starts]).astype(np.int32), mask=~sound)


def material(fen: Column) -> Column:
    """Points of both sides together; null for what is no board."""
    return points_of(F.substring(fen, 1, BOARD + 1))


def mirror_fen(fen: Column) -> Column:
    """The same position with the colours changed: ranks in reverse order, cases and the side to move swapped."""
    parts = F.split(fen, r"\s+")
    ranks = F.array_join(F.reverse(F.split(F.element_at(parts, 1), "/")), "/")
    low, up = "rhnaebkcp", "RHNAEBKCP"
    side = F.when(F.element_at(parts, 2) == "w", "b").otherwise("w")
    return F.array_join(F.concat(F.array(F.translate(ranks, low + up, up + low), side), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))), " ")


def mirror_move(move: Column) -> Column:
    return F.translate(move, "0123456789", "9876543210")


def from_one_based(move: Column) -> Column:
    """a1..i10 to a0..i9; null if it is no move."""
    p = r"^([a-i])(10|[1-9])([a-i])(10|[1-9])$"
    part = lambda i: F.regexp_extract(move, p, i)
    rank = lambda i: (part(i).try_cast("int") - 1).cast("string")
    return F.when(move.rlike(p), F.concat(part(1), rank(2), part(3), rank(4)))


def to_one_based(move: Column) -> Column:
    """a0..i9 to a1..i10; null if it is no move."""
    rank = lambda i: (F.substring(move, i, 1).try_cast("int") + 1).cast("string")
    return F.when(move.rlike("^(?:[a-i][0-9]){2}$"), F.concat(F.substring(move, 1, 1), rank(2), F.substring(move, 3, 1), rank(4)))


#: The score model's polynomials in material / 65, for the middle and the width of its curve.
MIDDLE = (220.59891365, -810.35730430, 928.68185198, 79.83955423)
WIDTH = (61.99287416, -233.72674182, 325.85508322, -68.72720854)


def score_probability(points: Column, kind: Column, score: Column, wdl: Column | None = None) -> Column:
    """The mover's expected result, 0 to 1: from win, draw and loss in permille if given; a mate score is 1 or 0; centipawns go through the curve."""

    def polynomial(c, m):
        return ((F.lit(c[0]) * m + c[1]) * m + c[2]) * m + c[3]

    def results(c):
        won = lambda x: F.floor(0.5 + 1000 / (1 + F.exp(F.greatest(F.lit(-80.0), F.least(F.lit(80.0), (c["a"] - x) / c["b"])))))
        return _let(score * c["a"] / 100.0, lambda x: F.struct(won(x).alias("win"), won(-x).alias("loss")))

    m = F.greatest(F.lit(17), F.least(F.lit(110), points)) / 65.0
    shape = _let(m, lambda m: F.struct(polynomial(MIDDLE, m).alias("a"), polynomial(WIDTH, m).alias("b")))
    curve = _let(_let(shape, results), lambda r: (r["win"] + (1000 - r["win"] - r["loss"]) / 2) / 1000.0)
    found = F.when(kind == "mate", F.when(score > 0, 1.0).otherwise(0.0)).when(kind == "cp", curve)
    if wdl is None:
        return found
    sound = (F.size(wdl) == 3) & F.forall(wdl, lambda x: x >= 0) & (F.aggregate(wdl, F.lit(0), lambda s, x: s + x.cast("int")) == 1000)
    return F.when(wdl.isNull(), found).when(sound, (F.get(wdl, 0) + F.get(wdl, 1) / 2) / 1000.0)


# The rules


def _place(square: str) -> int:
    return FILES.index(square[0]) + 9 * int(square[1])


def _name(place: int) -> str:
    return f"{FILES[place % 9]}{place // 9}"


def _steps(deltas, inside) -> list[list[int]]:
    out = []
    for p in range(90):
        x, y = p % 9, p // 9
        out.append([(y + dy) * 9 + x + dx for dx, dy in deltas if 0 <= x + dx < 9 and 0 <= y + dy < 10 and inside(x, y, x + dx, y + dy)])
    return out


CROSS, SLANT = ((1, 0), (-1, 0), (0, 1), (0, -1)), ((1, 1), (1, -1), (-1, 1), (-1, -1))
_palace = lambda x0, y0, x, y: 3 <= x <= 5 and (y <= 2 or y >= 7)
KING = _steps(CROSS, _palace)
ADVISOR = _steps(SLANT, _palace)
ELEPHANT = [[(to, (p + to) // 2) for to in row] for p, row in enumerate(_steps([(2 * a, 2 * b) for a, b in SLANT], lambda x0, y0, x, y: (y0 < 5) == (y < 5)))]
HORSE = [[] for _ in range(90)]  # (to, leg)
for _p in range(90):
    for _dx, _dy in ((1, 2), (2, 1), (-1, 2), (-2, 1), (1, -2), (2, -1), (-1, -2), (-2, -1)):
        _x, _y = _p % 9 + _dx, _p // 9 + _dy
        if 0 <= _x < 9 and 0 <= _y < 10:
            HORSE[_p].append((_y * 9 + _x, _p + (_dx // 2 if abs(_dx) == 2 else 0) + 9 * (_dy // 2 if abs(_dy) == 2 else 0)))
PAWN = {side: _steps(((0, 1 if side else -1), (1, 0), (-1, 0)), lambda x0, y0, x, y, side=side: y != y0 or (y0 >= 5 if side else y0 <= 4)) for side in (True, False)}
RAYS = [[[q for q in (p + k * (dx + 9 * dy) for k in range(1, 10)) if 0 <= q < 90 and (q // 9 == p // 9 if dx else True)] for dx, dy in CROSS] for p in range(90)]


def parse(fen: str) -> tuple[list[str], bool, list[str]]:
    """Board, whether red moves, and the other fields."""
    fields = fen.split()
    ranks = fields[0].split("/")
    if len(ranks) != 10:
        raise ValueError("a board has 10 ranks")
    board = ["."] * 90
    for r, text in enumerate(ranks):
        x = 0
        for c in text:
            if c.isdigit():
                x += int(c)
                continue
            piece = OTHER_LETTERS.get(c.lower(), c.lower())
            if piece not in POINTS or x > 8:
                raise ValueError(f"no board: {text}")
            board[(9 - r) * 9 + x] = piece.upper() if c.isupper() else piece
            x += 1
        if x != 9:
            raise ValueError(f"a rank has 9 files: {text}")
    if board.count("K") != 1 or board.count("k") != 1:
        raise ValueError("each side has one general")
    if len(fields) < 2 or fields[1] not in ("w", "b"):
        raise ValueError("no side to move")
    return board, fields[1] == "w", fields[2:] or ["-", "-", "0", "1"]


def write(board: list[str], red: bool, rest: list[str]) -> str:
    ranks = []
    for y in range(9, -1, -1):
        ranks.append(re.sub(r"\.+", lambda m: str(len(m[0])), "".join(board[9 * y : 9 * y + 9])))
    return " ".join(["/".join(ranks), "w" if red else "b", *rest])


def attackers(board: list[str], place: int, red: bool) -> list[int]:
    """Places of one side's pieces that could take on ``place``; the other general sees along an open file."""
    own = str.upper if red else str.lower
    out = []
    for ray in RAYS[place]:
        seen = [q for q in ray if board[q] != "."][:2]
        if seen and board[seen[0]] == own("r"):
            out.append(seen[0])
        if seen and board[seen[0]] == own("k") and seen[0] % 9 == place % 9 and board[place] in "kK":
            out.append(seen[0])
        if len(seen) == 2 and board[seen[1]] == own("c"):
            out.append(seen[1])
    for q, _ in HORSE[place]:
        if board[q] == own("n") and any(to == place and board[leg] == "." for to, leg in HORSE[q]):
            out.append(q)
    out += [q for q in range(max(0, place - 9), min(90, place + 10)) if board[q] == own("p") and place in PAWN[red][q]]
    return sorted(set(out))


def _targets(board: list[str], p: int) -> list[int]:
    kind, red = board[p].lower(), board[p].isupper()
    if kind == "k":
        found = KING[p]
    elif kind == "a":
        found = ADVISOR[p]
    elif kind == "b":
        found = [to for to, eye in ELEPHANT[p] if board[eye] == "."]
    elif kind == "n":
        found = [to for to, leg in HORSE[p] if board[leg] == "."]
    elif kind == "p":
        found = PAWN[red][p]
    else:
        found = []
        for ray in RAYS[p]:
            over = False
            for q in ray:
                if board[q] == ".":
                    if not over:
                        found.append(q)
                elif kind == "r" or over:
                    found.append(q)
                    break
                else:
                    over = True
    return [q for q in found if board[q] == "." or board[q].isupper() != red]


def _safe(board: list[str], p: int, q: int, red: bool) -> bool:
    own, taken = board[p], board[q]
    board[p], board[q] = ".", own
    ok = not attackers(board, board.index("K" if red else "k"), not red)
    board[p], board[q] = own, taken
    return ok


@lru_cache(maxsize=1 << 15)
def legal_moves(fen: str) -> tuple[str, ...]:
    """All legal moves, in order."""
    board, red, _ = parse(fen)
    return tuple(sorted(_name(p) + _name(q) for p in range(90) if board[p] != "." and board[p].isupper() == red for q in _targets(board, p) if _safe(board, p, q, red)))


def in_check(fen: str) -> bool:
    board, red, _ = parse(fen)
    return bool(attackers(board, board.index("K" if red else "k"), not red))


@lru_cache(maxsize=1 << 16)
def play(fen: str, move: str) -> str:
    if move not in legal_moves(fen):
        raise ValueError(f"illegal move {move}")
    board, red, rest = parse(fen)
    p, q = _place(move[:2]), _place(move[2:])
    quiet = board[q] == "."
    board[p], board[q] = ".", board[p]
    castles, ep, half, full = [*rest, "-", "-", "0", "1"][:4] if len(rest) < 4 else rest[:4]
    return write(board, not red, [castles, ep, str(int(half) + 1 if quiet else 0), str(int(full) + (not red))])


def replay(initial: str, moves: list[str]) -> list[str]:
    history = [initial]
    for move in moves:
        history.append(play(history[-1], move))
    return history


def outcome(history: list[str]) -> tuple[bool, str | None, str | None]:
    """ended, winner and reason of a game: a side without a legal move loses; a position that comes a third time is a draw, unless one side
    alone has given check with every move since, which then loses. Chases are not told from other repetitions."""
    last = history[-1]
    mover = last.split()[1]
    other = {"w": "black", "b": "red"}[mover]
    if not legal_moves(last):
        return True, other, "checkmate" if in_check(last) else "stalemate"
    keys = [" ".join(f.split()[:2]) for f in history]
    if keys.count(keys[-1]) >= 3:
        since = history[keys.index(keys[-1]) + 1 :]
        checked = {s: all(in_check(f) for f in since if f.split()[1] == s) for s in "wb"}  # the side that stands in check each time
        if checked["w"] != checked["b"]:
            return True, "red" if checked["w"] else "black", "perpetual_check"
        return True, None, "repetition"
    return False, None, None


def notation(fen: str, move: str) -> tuple[str, str | None]:
    """The move's Western and Chinese names; pawns of one file beyond two have no Chinese name here."""
    board, red, _ = parse(fen)
    p, q = _place(move[:2]), _place(move[2:])
    piece = board[p]
    file_of = lambda s: 9 - s % 9 if red else s % 9 + 1
    same = [s for s in range(90) if board[s] == piece and s % 9 == p % 9]
    ahead = sorted(same, key=lambda s: -s if red else s)
    letter = {"n": "H", "b": "E"}.get(piece.lower(), piece.upper())
    direction = "=" if p // 9 == q // 9 else "+" if (q > p) == red else "-"
    target = file_of(q) if direction == "=" or letter in "HEA" else abs(q // 9 - p // 9)
    if len(same) == 2 and letter not in "EA":
        front = "+" if ahead[0] == p else "-"
        western, where = f"{letter}{front}{direction}{target}", front
    elif len(same) == 1 or letter in "EA":
        western, where = f"{letter}{file_of(p)}{direction}{target}", str(file_of(p))
    else:
        return f"{letter}{'abcde'[ahead.index(p)]}{direction}{target}", None
    name = {"R": "车", "A": "仕" if red else "士", "C": "炮", "P": "兵" if red else "卒", "H": "马", "E": "相" if red else "象", "K": "帅" if red else "将"}[letter]
    number = (lambda n: "一二三四五六七八九"[int(n) - 1]) if red else str
    first = name + number(where) if where.isdigit() else {"+": "前", "-": "后"}[where] + name
    return western, first + {"+": "进", "-": "退", "=": "平"}[direction] + number(target)


def evasions(fen: str) -> list[tuple[str, str]]:
    """For a side in check each legal move and how it ends the check: captures, general moves, blocks a line or leg, or changes a cannon's screens."""
    board, red, _ = parse(fen)
    king = board.index("K" if red else "k")
    checkers = attackers(board, king, not red)
    out = []
    for move in legal_moves(fen) if checkers else ():
        p, q = _place(move[:2]), _place(move[2:])
        if p == king:
            how = "general"
        elif q in checkers:
            how = "capture"
        else:
            kinds = {board[c].lower() for c in checkers}
            between = {s for c in checkers for ray in RAYS[king] if c in ray for s in ray[: ray.index(c)]}
            how = "leg" if kinds == {"n"} else "screen_away" if "c" in kinds and p in between and q not in between else "screen_added" if kinds == {"c"} else "line"
        out.append((move, how))
    return out


# Kernels over batches

MOVES = T.ArrayType(T.StringType())


def _or_null(f):
    def safe(*args):
        try:
            return f(*args)
        except (ValueError, TypeError, AttributeError, IndexError):
            return None

    return safe


@pandas_udf(MOVES)
def legal_moves_of(fens: pd.Series) -> pd.Series:
    """Legal moves; null for what is no position."""
    return fens.map(_or_null(lambda f: list(legal_moves(f))))


@pandas_udf(MOVES)
def replay_of(fens: pd.Series, moves: pd.Series) -> pd.Series:
    """The history of positions; null if any move is illegal."""
    return pd.Series([_or_null(lambda f, m: replay(f, list(m)))(f, m) for f, m in zip(fens, moves, strict=True)])


@pandas_udf(T.StructType().add("ended", "boolean").add("winner", "string").add("reason", "string").add("check", "boolean").add("n_legal", "integer"))
def state_of(histories: pd.Series) -> pd.DataFrame:
    """How a history stands at its end."""
    rows = [_or_null(lambda h: (*outcome(list(h)), in_check(h[-1]), len(legal_moves(h[-1]))))(h) or (None,) * 5 for h in histories]
    return pd.DataFrame(rows, columns=["ended", "winner", "reason", "check", "n_legal"])


@pandas_udf(T.StructType().add("captures", MOVES).add("checks", MOVES).add("mates", MOVES).add("evasions", T.MapType(T.StringType(), T.StringType())))
def tasks_of(fens: pd.Series) -> pd.DataFrame:
    """Of a position's legal moves those that take, give check and mate, and how each one ends a check."""

    def one(fen):
        board, _, _ = parse(fen)
        moves = legal_moves(fen)
        after = {m: play(fen, m) for m in moves}
        checks = [m for m in moves if in_check(after[m])]
        return [m for m in moves if board[_place(m[2:])] != "."], checks, [m for m in checks if not legal_moves(after[m])], dict(evasions(fen))

    rows = [_or_null(one)(f) or (None,) * 4 for f in fens]
    return pd.DataFrame(rows, columns=["captures", "checks", "mates", "evasions"])


@pandas_udf(T.BooleanType())
def mate_claim_holds(fens: pd.Series, kinds: pd.Series, scores: pd.Series, lines: pd.Series) -> pd.Series:
    """Whether a claimed mate in one (score 1 or -1) is borne out by its line: the line is legal, and ends where the side to move has no move."""

    def one(fen, kind, score, line):
        if kind != "mate" or abs(score) != 1:
            return True
        plies = 1 if score > 0 else 2
        return len(line) >= plies and not legal_moves(replay(fen, list(line)[:plies])[-1])

    return pd.Series([_or_null(one)(*x) or False for x in zip(fens, kinds, scores, lines, strict=True)], dtype=bool)
