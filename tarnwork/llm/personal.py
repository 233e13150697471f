"""Personal data: generators propose candidate spans, boosted trees select redactions. DataFrame functions only.

Base generators (email, ip, card, phone) follow fixed patterns and their checks (octets, Luhn, digit counts); valid
base spans are always kept. High-recall generators propose more, overlapping ones: obfuscated addresses, telephone
numbers without a plus sign, IPv6 addresses, and base matches that failed their check. Boosted trees see each
candidate's format (digits, separators, letters, length) and context (words before it, what touches it) and a calibrated
threshold decides; a selected candidate that overlaps a base span of its kind adds nothing and is left out.

The trees are fitted here on labelled sentences made by a seeded rule (``SENTENCES``, fixed in number), passed
through the same generators, so training never depends on the input's size.

Patterns are written so that Java's matcher takes linear time: runs are possessive, and a match may begin inside a run only
where the previous match ended; sums run in blocks and overlaps are found by bisection, so a very long text takes time in proportion
to its length but for a logarithm. Null text is empty; each row is judged by itself, so repeated rows have repeated results; of spans that
begin at one place the order is that of the kinds. An empty table gives an empty result; extra columns, whatever their names, stay out of it.
"""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, SENTENCES, SEED = 0.9, 3_000, 11
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TWO_DIGITS = r"[0-9]{2}"
#: (kind, pattern, guard: literals; text without any of them has no match, or a pattern that each match contains)
BASE = ((0, EMAIL, ("@",)), (1, IP, (".",)), (2, CARD, r"[0-9][\x20-]?[0-9]"), (3, PHONE, ("+",)))
LOOSE = (
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++", ("at", "AT")),
    (1, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", (":",)),
    (3, r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])", TWO_DIGITS),
)
OCTETS = r"^" + r"\.".join([r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"] * 4) + r"$"
#: Context words that go before each kind's values; fixed values.
CUES = r"(?i)(?:mail|write|contact|phone|call|tel|fax|mobile|number|reach|card|visa|pay|host|server|address|ip)[^A-Za-z]*$"
FEATURES = ("kind", "digits", "letters", "length", "separators", "distinct", "at", "passes", "cue", "letter_before", "letter_after", "digit_touches", "parenthesis")
CANDIDATE = "array<struct<start:int,kind:int,end:int,m:string,base:boolean,before:string,after:string>>"
CONTEXT, BLOCK = 24, 128


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _matches(text: Column, kind: int, pattern: str, guard: str | tuple[str, ...], base: bool) -> Column:
    """The non-overlapping matches with their places and context: lengths of what lies between them give the places.

    Sums run in blocks, so work is linear in the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def piece(m, before, after):
        return F.struct(m.alias("m"), F.length(before).alias("g"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(1)).alias("after"))

    def step(so_far, x):
        start = so_far["at"] + x["g"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("m"), F.lit(base).alias("base"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(span)).alias("out"))

    none = F.array().cast(CANDIDATE)

    def in_blocks(p):
        def block(so_far, k):
            own = F.aggregate(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), F.struct(so_far["at"].alias("at"), none.alias("out")), step)
            return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(so_far["out"], F.array(o["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{CANDIDATE}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), start, block, lambda s: F.flatten(s["out"]))

    def paired(both):
        n = F.size(both["m"])
        triples = F.arrays_zip(both["m"].alias("m"), F.slice(both["g"], F.lit(1), n).alias("b"), F.slice(both["g"], F.lit(2), n).alias("a"))
        return F.transform(triples, lambda x: piece(x["m"], x["b"], x["a"]))

    pieces = _let(F.struct(found.alias("m"), gaps.alias("g")), paired)
    there = text.rlike(guard) if isinstance(guard, str) else reduce(or_, map(text.contains, guard))
    return F.when(there & text.rlike(pattern), _let(pieces, in_blocks)).otherwise(none)


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total, i):
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(x: Column) -> Column:
    """Whether a base match passes its kind's check."""
    digits = F.regexp_replace(x["m"], "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(x["kind"] == 0, F.lit(True))
        .when(x["kind"] == 1, x["m"].rlike(OCTETS))
        .when(x["kind"] == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(9, 15))
    )


def _overlaps(spans: Column, x: Column) -> Column:
    """Whether x overlaps one of the spans, which are apart and in order: the last one that begins before x ends is found by bisection."""

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        before = F.coalesce(F.get(spans, middle - 1)["start"] < x["end"], F.lit(False))
        return F.when(s["low"] >= s["high"], s).when(before, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    place = F.aggregate(turns, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda s: s["low"])
    return F.coalesce(F.get(spans, place - 1)["end"] > x["start"], F.lit(False))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, the text, valid base spans, and the other candidates that overlap none of their kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = documents.select("doc_id", text.alias("text"))
    found = source.withColumn("_b", F.concat(*[_matches(F.col("text"), *g, True) for g in BASE])).withColumn("_l", F.concat(*[_matches(F.col("text"), *g, False) for g in LOOSE]))
    checked = found.withColumn("_b", F.transform("_b", lambda x: x.withField("base", _valid(x))))
    base = F.filter("_b", lambda x: x["base"])
    split = checked.withColumn("base", F.array_sort(base)).withColumn("_f", F.filter("_b", lambda x: ~x["base"] & (F.length(x["m"]) >= 7)))
    split = split.withColumn("_k", F.array(*[F.filter("base", lambda b, k=k: b["kind"] == k) for k in range(len(KINDS))]))
    # One candidate a place: failed base matches and loose ones may overlap, and the trees see both.
    apart = F.when(F.size("base") == 0, F.concat("_f", "_l")).otherwise(F.filter(F.concat("_f", "_l"), lambda x: ~_overlaps(F.get("_k", x["kind"]), x)))
    return split.select("doc_id", "text", "base", F.array_sort(apart).alias("more"))


def _features(x: Column) -> list[Column]:
    m = x["m"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    before, after = x["before"], x["after"]
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        x["kind"].cast("double"), F.length(digits).cast("double"), F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"), F.length(m).cast("double"),
        F.length(F.regexp_replace(m, r"[^\x20.:-]", "")).cast("double"), F.size(F.array_distinct(F.split(digits, ""))).cast("double"), flag(m.rlike(r"(?i)[(\[](?:at|dot)[)\]]")),
        flag(_valid(x)), flag(before.rlike(CUES)), flag(before.rlike("[A-Za-z]$")), flag(after.rlike("[A-Za-z]")), flag(before.rlike("[0-9][.-]?$") | after.rlike("[0-9]")), flag(m.rlike(r"^\(")),
    ]


def _sentences() -> list[tuple[int, str, int]]:
    """Labelled sentences, each with one candidate that the base patterns don't settle; label 1: to be redacted."""
    r = random.Random(SEED)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def phone():
        style = r.randrange(3)
        return f"({digits(3)}) {digits(3)}-{digits(4)}" if style == 0 else f"{digits(3)}{'-. '[r.randrange(3)]}{digits(3)}{'-. '[r.randrange(3)]}{digits(4)}"

    def shape(kind):
        if kind == "mail":
            dot = r.choice([".", " (dot) ", "[dot]"])
            return r.choice(["write to ", "mail: ", "", "contact "]), f"{word()}{r.choice([' (at) ', '[at]', ' [AT] '])}{word()}{dot}{r.choice(['com', 'org', 'example'])}", 1
        if kind == "phone":
            return r.choice(["call ", "tel. ", "phone: ", "fax ", "mobile "]), phone(), 1
        if kind == "v6":
            return r.choice(["host ", "server ", ""]), ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8)), 1
        if kind == "figures":  # amounts, dates, parts of tables
            return r.choice(["", "about ", "page ", word() + " "]), r.choice([f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(2)}-{digits(3)}-{digits(3)}", f"{digits(4)}.{digits(3)}.{digits(3)}"]), 0
        if kind == "version":
            return r.choice(["version ", "v ", "section ", ""]), f"{r.randint(256, 999)}.{digits(2)}.{digits(1)}.{digits(3)}", 0
        return r.choice(["order ", "serial ", "", "id "]), digits(r.randint(12, 19)) if r.random() < 0.7 else f"+{digits(r.randint(16, 20))}", 0

    out = []
    for i in range(SENTENCES):
        cue, value, label = shape(r.choice(["mail", "phone", "v6", "figures", "figures", "version", "long"]))
        lead = " ".join(word() for _ in range(r.randint(2, 9)))
        tail = " ".join(word() for _ in range(r.randint(1, 6)))
        out.append((i, f"{lead} {cue}{value}{r.choice([' ', '. ', ', '])}{tail}", label))
    return out


_fitted: dict[str, boosting.Trees] = {}


def trees(spark: SparkSession) -> boosting.Trees:
    """Fitted once a process; the sentences are few and fixed."""
    if "trees" not in _fitted:
        rows = _sentences()
        made = candidates(spark.createDataFrame([x[:2] for x in rows], "doc_id int, text string").coalesce(1))
        one = made.select("doc_id", "text", F.explode("more").alias("x")).select("doc_id", *[c.alias(n) for n, c in zip(FEATURES, _features(F.col("x")), strict=True)])
        found = one.orderBy("doc_id", *FEATURES).collect()
        _fitted["trees"] = boosting.fit(np.array([list(r)[1:] for r in found], float), np.array([rows[r.doc_id][2] for r in found], float))
    return _fitted["trees"]


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text, base (valid base spans) and chosen (all spans to redact), both in order of start and kind."""
    model = trees(documents.sparkSession)
    found = candidates(documents)
    # Features are computed once a candidate, then the trees read them.
    described = F.transform("more", lambda x: F.struct(x.alias("x"), *[c.alias(f"f{i}") for i, c in enumerate(_features(x))]))
    decided = F.filter(described, lambda y: model.column([y[f"f{i}"] for i in range(len(FEATURES))]) >= F.lit(threshold))
    added = F.when(F.size("more") > 0, F.transform(decided, lambda y: y["x"])).otherwise(F.array().cast(CANDIDATE))
    chosen = F.array_sort(F.concat("base", added))
    return found.select("doc_id", "text", "base", chosen.alias("chosen"))


def spans(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and private: whether anything is to be redacted."""
    found = find(documents, threshold)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("chosen")).alias("spans"), (F.size("chosen") > 0).alias("private"))


def redact(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the text with each chosen span replaced by its kind; of overlapping spans the first one names the place."""
    found = find(documents, threshold)
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(so_far, x):
        add = F.concat(so_far["out"], F.substring(F.col("text"), so_far["at"] + 1, x["start"] - so_far["at"]), F.element_at(name, x["kind"] + 1))
        return F.when(x["start"] >= so_far["at"], F.struct(x["end"].alias("at"), add.alias("out"))).otherwise(F.struct(F.greatest(so_far["at"], x["end"]).alias("at"), so_far["out"].alias("out")))

    done = F.aggregate("chosen", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return found.select("doc_id", F.when(F.size("chosen") > 0, done).otherwise(F.col("text")).alias("text"))
