"""DataFrame forms of queries whose SQL, registered elsewhere, serves as the other opinion."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import metrics as M
from ..operators import relations as R
from ..operators import select as S
from .registry import ORACLES, QUERIES, Tables

c, lit, when = F.col, F.lit, F.when


def form(f):
    """Takes the place of the query of this name; its SQL stays what it is held against."""
    if f.__name__ not in ORACLES:
        raise KeyError(f.__name__)
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def n_rows() -> Column:
    return F.count(F.lit(1))


def sha(x: Column | str) -> Column:
    return F.sha2(x, 256)


def seeded(seed, key: str) -> Column:
    return sha(F.concat(lit(f"{seed}/"), c(key).cast("string")))


def labelled(t: Tables):
    return t.labels.join(t.documents, "doc_id")


# Metrics


@form
def grouped_accuracy(t: Tables):
    return labelled(t).rollup("lang", "source").agg(n_rows().alias("n"), F.round(M.share(c("quality") == 1), 9).alias("accuracy"))


@form
def conditional_metrics(t: Tables):
    toxic = c("toxic") == 1
    return labelled(t).groupBy("source").agg(n_rows().alias("n"), F.round(M.share(c("quality") == 1), 9).alias("rate"), F.round(F.avg(when(toxic, c("n_chars").cast("double"))), 6).alias("toxic_chars"), M.tally(toxic & (c("n_chars") > 1000)).alias("n_long"))


@form
def exploded_metrics(t: Tables):
    turns = t.conversations.groupBy("conv_id").agg(n_rows().alias("n_turns"))
    return t.conversations.join(turns, "conv_id").groupBy("role", "n_turns").agg(n_rows().alias("n"), F.max(F.length("text")).alias("longest"))


@form
def outcome_score(t: Tables):
    is_ = lambda s: c("o_orderstatus") == s
    return M.outcomes(t.orders, ["o_orderpriority"], is_("F"), is_("O"), is_("P")).withColumn("score", F.round("score", 9))


@form
def numeric_task_metrics(t: Tables):
    return t.events.groupBy("event_type").agg(n_rows().alias("n"), F.count("value").alias("n_scored"), F.round(F.avg(F.abs(c("value") - 50)), 6).alias("mean_error"))


@form
def micro_precision_recall(t: Tables):
    found = M.micro(labelled(t), ["lang"], c("quality") == 1, c("n_chars") > 300)
    return found.select("lang", *[F.round(x, 9).alias(x) for x in ("micro_precision", "micro_recall")])


@form
def bucket_groups(t: Tables):
    size = when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large")
    rows = t.part.select(c("p_brand").alias("kind"), size.alias("size_bucket"), "p_retailprice")
    return rows.groupingSets([["kind"], ["size_bucket"]], "kind", "size_bucket").agg(n_rows().alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@form
def grouping_sets_counts(t: Tables):
    rows = t.documents.select("lang", "source", (c("n_chars") % 3).alias("phase"))
    return rows.groupingSets([["lang"], ["lang", "source"], ["phase"], []], "lang", "source", "phase").agg(n_rows().alias("n"))


@form
def map_merge_sum(t: Tables):
    roles = t.conversations.groupBy("conv_id", "role").agg(n_rows().alias("n")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("counts"), F.sum("n").alias("total"))
    return M.merged_counts(roles.select(F.map_concat("counts", F.create_map(lit("total"), c("total"))).alias("counts")), "counts")


@form
def distinct_counts(t: Tables):
    return t.documents.groupBy("lang").agg(F.count_distinct(sha("text")).alias("texts"), F.count_distinct("source").alias("sources"), n_rows().alias("n"))


@form
def bitmask_or(t: Tables):
    bit = when(c("event_type") == "click", 1).when(c("event_type") == "view", 2).when(c("event_type") == "purchase", 4).when(c("event_type") == "signup", 8).otherwise(16)
    return t.events.groupBy("user_id").agg(F.bit_or(bit).alias("mask"))


@form
def weighted_mean(t: Tables):
    return labelled(t).groupBy("lang").agg(F.round(M.weighted_mean(c("toxic"), c("n_chars")), 9).alias("weighted"))


@form
def max_by_group(t: Tables):
    return t.documents.groupBy("lang").agg(F.max("n_chars").alias("longest"), F.max_by("doc_id", F.struct("n_chars", -c("doc_id"))).alias("doc_id"))


@form
def mixture_counts(t: Tables):
    return M.mixture_counts(t.documents, "lang", {"en": 0.5, "de": 0.25}, 0.125, "en")


@form
def gate_pass(t: Tables):
    tasks = labelled(t).groupBy("source").agg(n_rows().alias("n"), M.share(c("quality") == 1).alias("accuracy"))
    return M.gate(tasks, "n", "accuracy", 5, 0.6, 0.8).withColumn("worst", F.round("worst", 9))


@form
def functional_score(t: Tables):
    parts = 0.5 * M.share(c("quality") == 1) + 0.3 * (1 - M.share(c("toxic") == 1)) + 0.2 * M.share(c("n_chars") > 500)
    return labelled(t).agg(F.round(parts, 9).alias("score"))


@form
def accounting_identity(t: Tables):
    rows = t.documents.select("doc_id", sha("text").alias("h"), (F.length("text") < 40).alias("short"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"))
    stream = when(c("short"), "rejected").when(c("doc_id") == c("first"), "kept").otherwise("duplicates")
    return M.balance(rows.join(first, "h").select(stream.alias("stream")), "stream", "kept", ["rejected", "duplicates"])


@form
def throughput_ratio(t: Tables):
    found = M.throughput(t.events.filter("value > 0").select((c("user_id") % 4 + 1).alias("size"), "value"), "size", "value")
    return found.select("size", "n", F.round("rate", 9).alias("rate"), F.round("ratio", 9).alias("ratio"))


@form
def budget_plan(t: Tables):
    return M.schedule(t.documents.groupBy("lang").agg(n_rows().alias("n")), "n", 64, 1000.0, 3, 500)


@form
def class_bitmask(t: Tables):
    flags = {1: c("n_chars") < 200, 2: c("text").contains("###"), 4: c("text").contains("@")}
    names = F.concat(*[when(x, name).otherwise("") for name, x in zip("sjm", flags.values(), strict=True)])
    return t.documents.select("doc_id", M.mask(flags).alias("mask"), names.alias("classes"))


@form
def loss_vs_best(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(M.loss_to_best(t.lineitem, ["l_orderkey"], "l_extendedprice"), 6).alias("loss"))


@form
def response_contract(t: Tables):
    return t.events.select("event_id", (c("value") <= 90).alias("within_budget"), F.get_json_object("props", "$.k").isNotNull().alias("answered"), ((c("event_type") != "error") & c("value").isNotNull()).alias("ok"))


# Scalars and admission


@form
def label_canonicalize(t: Tables):
    named = c("s_name").startswith("Supplier#")
    team = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"), "left").filter(~named | c("n_name").isNotNull())
    return team.select("s_suppkey", when(named, c("n_name")).alias("team"), when(named, F.regexp_replace("s_name", "^Supplier#", "")).otherwise(c("s_name")).alias("label"))


@form
def derive_group(t: Tables):
    kind = when(c("url").startswith("https://"), "secure").when(c("url").startswith("http://"), "plain").otherwise("other")
    return t.pages.select("page_id", kind.alias("kind"), F.coalesce(F.nullif(F.regexp_extract("url", "^https?://([^/?#]+)", 1), lit("")), lit("none")).alias("host"))


@form
def score_order_key(t: Tables):
    whole = F.floor("value").cast("int")
    key = when(c("event_type") == "purchase", 100000 - whole).when(c("event_type") == "error", whole - 100000).otherwise(whole)
    return t.events.select("event_id", key.alias("order_key"), when(c("user_id") % 2 == 0, c("value")).otherwise(-c("value")).alias("seen_by_mover"))


@form
def exclusive_threshold(t: Tables):
    off = F.abs(c("value") - 50)
    return t.events.filter((off < 10) & (F.abs(off - 10) > 1e-12)).select("event_id")


@form
def decision_rules(t: Tables):
    rule = when(c("o_totalprice").isNull(), "unscored").when((c("o_orderstatus") == "F") & (c("o_totalprice") > 100000), "accept").when(c("o_orderstatus") == "P", "recurse").when(c("o_totalprice") < 5000, "too_small").otherwise("reject")
    return t.orders.select("o_orderkey", rule.alias("decision"))


@form
def coalesce_choice(t: Tables):
    best = t.events.groupBy("user_id").agg(F.max("value").alias("top"), F.min(when(c("event_type") == "purchase", c("event_id"))).alias("strict"))
    near = t.events.join(best, "user_id").filter(c("value") >= c("top") - 5)
    second = S.top_per_group(near, ["user_id"], [seeded(5, "event_id")], 2, "k").filter("k = 2").select("user_id", c("event_id").alias("near"))
    return best.join(second, "user_id", "left").select("user_id", F.coalesce("near", "strict", lit(-1)).alias("pick"))


@form
def schema_by_type(t: Tables):
    rule = when(c("event_type").isin("click", "view"), F.get_json_object("props", "$.k").isNotNull()).when(c("event_type") == "purchase", c("value") > 0).otherwise(lit(True))
    return t.events.select("event_id", rule.alias("ok"))


@form
def stage_filter(t: Tables):
    return t.documents.filter(c("lang").isin("de", "fr")).select("doc_id", "lang", "source")


@form
def split_file_agreement(t: Tables):
    split = K.assigned_split("7", c("source"))
    rows = t.documents.select(split.alias("split"), when(c("doc_id") % 50 == 0, "train").otherwise(split).alias("file"))
    return rows.groupBy("file").agg(n_rows().alias("n"), M.tally(c("split") != c("file")).alias("n_wrong"))


@form
def raw_line_filter(t: Tables):
    return t.events.filter(c("event_type") == "click").select("props")


@form
def metadata_then_payload(t: Tables):
    """Ids are chosen from narrow columns first; only their rows' texts are then read on."""
    chosen = t.labels.filter("quality = 1 and toxic = 1").select("doc_id").distinct()
    return t.documents.join(chosen, "doc_id", "left_semi").select("doc_id", "n_chars", c("text").alias("payload"))


@form
def unique_id_check(t: Tables):
    each = t.documents.groupBy("source", "doc_id").agg(n_rows().alias("k"))
    return each.groupBy("source").agg(F.sum("k").alias("n"), n_rows().alias("n_ids"), (F.sum("k") - n_rows()).alias("repeated"))


@form
def url_allowlist(t: Tables):
    part = lambda p: F.coalesce(F.expr(f"try_parse_url(url, '{p}')"), lit(""))
    allowed = c("url").rlike("^https?://[a-z.]+[.](com|org|net)(/|$)") & ~c("url").rlike("[?&](?:token|password)=")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return t.pages.select("page_id", F.coalesce(F.nullif(part("PROTOCOL"), lit("")), lit("")).alias("scheme"), host.alias("host"), allowed.alias("allowed"))


@form
def json_record_admission(t: Tables):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", when(k.isNull(), "no_key").when(k.cast("int") % 7 == 0, "enum").when(c("value") < 0, "negative").otherwise("ok").alias("reason"))


# Checks, rendering and sets


@form
def structural_validation(t: Tables):
    g = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("d"), n_rows().alias("n"), M.tally(~c("role").isin("system", "user", "assistant")).alias("odd"))
    return g.select("conv_id", c("low").isin(0, 1).alias("starts"), ((c("d") == c("n")) & (c("high") - c("low") + 1 == c("n"))).alias("gapless"), (c("odd") == 0).alias("roles_known"))


@form
def qualify_rows(t: Tables):
    first = F.max(when(c("l_linenumber") == 1, c("l_discount")))
    return t.lineitem.groupBy("l_orderkey").agg(((F.max("l_discount") < 0.10) & (first < 0.05)).alias("qualified"), M.tally(c("l_discount") >= 0.10).alias("n_over"))


@form
def grade_answers(t: Tables):
    grade = when(c("quality").isNull(), "unparsed").when((c("quality") == 1) & ~c("text").contains("###"), "correct").when(c("quality") == 1, "format").otherwise("wrong")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", grade.alias("grade"))


@form
def footprint_explode(t: Tables):
    words = F.array_distinct(F.split(F.replace("text", F.chr(lit(10)), lit(" ")), " "))
    return t.documents.select("doc_id", F.explode(F.array_remove(words, "")).alias("w"))


@form
def length_budget(t: Tables):
    n = F.size(F.split("text", " "))
    return t.documents.select("doc_id", n.alias("tokens"), (n <= 512).alias("fits"))


@form
def render_templates(t: Tables):
    text = c("doc_id").cast("string")
    question = when(c("doc_id") % 3 == 0, F.format_string("Which language is document %s?", text)).when(c("doc_id") % 3 == 1, F.format_string("Name the language of no. %s", text)).otherwise(F.format_string("%s: language?", text))
    return t.documents.select("doc_id", question.alias("question"), F.concat(lit("Answer: "), "lang").alias("answer"))


@form
def blinded_packet(t: Tables):
    """The packet's name binds all it carries: a change anywhere in the text is another packet."""
    return t.documents.select("doc_id", sha(F.concat_ws("|", "text", "lang")).alias("packet_id"), c("text").alias("excerpt"), "lang")


@form
def assemble_labels(t: Tables):
    return labelled(t).select("doc_id", c("lang").alias("stage"), c("source").alias("task_type"), c("quality").alias("answer"), when(c("toxic") == 1, "review").otherwise("train").alias("route"))


@form
def hidden_fields(t: Tables):
    return t.documents.drop("text", "source")


@form
def union_disjoint(t: Tables):
    even = t.documents.filter("doc_id % 2 = 0").select(c("doc_id").alias("id"), lit("a").alias("part"))
    rest = t.documents.filter("doc_id % 2 = 1 or doc_id % 100 = 0").select(c("doc_id").alias("id"), lit("b").alias("part"))
    return even.unionByName(rest).groupBy("id").agg(n_rows().alias("n"), F.count_distinct("part").alias("n_parts")).filter("n > 1")


@form
def qualified_merge(t: Tables):
    """Texts once each, from the English collection first; whether enough are left is one number for all rows."""
    rows = t.documents.select("doc_id", sha("text").alias("h"), when(c("lang") == "en", 1).otherwise(2).alias("k"))
    kept = rows.groupBy("h").agg(F.min(F.struct("k", "doc_id")).alias("r")).select("r.doc_id", "r.k")
    return kept.crossJoin(F.broadcast(kept.agg((n_rows() >= 32).alias("enough"))))  # one row


@form
def corpus_union(t: Tables):
    text = lambda x: c(x).cast("string")
    d = t.documents.select(F.concat(lit("d"), text("doc_id")).alias("id"), "text", lit("documents").alias("origin"))
    v = t.conversations.select(F.concat(lit("c"), text("conv_id"), lit("-"), text("turn")).alias("id"), "text", lit("conversations").alias("origin"))
    rank = F.struct(when(c("origin") == "documents", 0).otherwise(1).alias("o"), "id")
    return d.unionByName(v).groupBy(sha("text")).agg(F.min_by(F.struct("id", "origin"), rank).alias("r")).select("r.*")


@form
def set_equality(t: Tables):
    counts = R.coverage(t.labels.select("doc_id").distinct(), t.documents.select("doc_id").distinct(), "doc_id")
    found = counts.agg(M.tally(c("verdict") == "missing").alias("n_missing"), M.tally(c("verdict") == "foreign").alias("n_extra"))
    return found.withColumn("equal", c("n_missing") + c("n_extra") == 0)


@form
def set_intersection(t: Tables):
    one, two = t.documents.filter(c("lang") == "en"), t.documents.filter(c("source").isin("src1", "src2", "src3"))
    return one.select(sha("text").alias("h")).distinct().join(two.select(sha("text").alias("h")), "h", "left_semi")


@form
def augment_union(t: Tables):
    own = t.part.select(c("p_partkey").alias("id"), lit(None).cast("long").alias("parent"), c("p_name").alias("name"))
    turned = t.part.select((c("p_partkey") + 1000000).alias("id"), c("p_partkey").alias("parent"), F.reverse("p_name").alias("name"), "p_name").filter("name <> p_name").drop("p_name")
    return own.unionByName(turned)


@form
def view_fanout(t: Tables):
    numeric, move = F.struct(lit("numeric").alias("kind"), c("value").alias("score")), F.struct(lit("move").alias("kind"), lit(None).cast("double").alias("score"))
    views = F.array_compact(F.array(when(c("value").isNotNull(), numeric), when(c("event_type") != "view", move)))
    return t.events.select("event_id", F.explode(views).alias("v")).select("event_id", "v.*")


@form
def readback_diff(t: Tables):
    written = t.documents.select("doc_id", when(c("doc_id") % 97 == 0, "xx").otherwise(c("lang")).alias("lang"))
    both = written.select("*", lit("added").alias("side")).unionByName(t.documents.select("doc_id", "lang", lit("lost").alias("side")))
    return both.groupBy("doc_id", "lang").agg(F.count_distinct("side").alias("k"), F.min("side").alias("side")).filter("k = 1").drop("k")


@form
def table_diff(t: Tables):
    a = t.documents.select("doc_id", F.struct("n_chars").alias("a"))
    b = t.documents.filter("doc_id % 113 <> 5").select("doc_id", F.struct((c("n_chars") + when(c("doc_id") % 89 == 0, 1).otherwise(0)).alias("n_chars")).alias("b"))
    kind = when(c("b").isNull(), "missing").when(c("a").isNull(), "extra").when(~c("a").eqNullSafe(c("b")), "changed")
    return a.join(b, "doc_id", "full_outer").select("doc_id", kind.alias("kind")).filter("kind is not null")


@form
def catalog_build(t: Tables):
    rows = t.part.join(t.lineitem, c("l_partkey") == c("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count_distinct("p_partkey").alias("roots"), n_rows().alias("targets"), F.count_distinct("l_orderkey").alias("owners"))


# Selection


@form
def coalesce_identical(t: Tables):
    h = sha("p_name")
    return t.part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"), n_rows().alias("n"), F.min(h).eqNullSafe(F.max(h)).alias("identical"))


@form
def orbit_dedupe(t: Tables):
    return t.part.groupBy(F.least("p_name", F.reverse("p_name")).alias("orbit")).agg(F.min("p_partkey").alias("p_partkey"), n_rows().alias("n"))


@form
def sequence_integrity(t: Tables):
    i = c("l_linenumber")
    gapless = (F.min(i) == 1) & (F.max(i) == n_rows()) & (F.count_distinct(i) == n_rows())
    return t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("n"), gapless.alias("contiguous"), F.min("l_returnflag").eqNullSafe(F.max("l_returnflag")).alias("constant_flag"))


@form
def phase_tertile(t: Tables):
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    phase = F.least(lit(2), F.floor(3 * c("turn") / F.greatest(lit(1), c("last")))).cast("int")
    return t.conversations.join(last, "conv_id").select("conv_id", "turn", phase.alias("phase"))


@form
def variant_rotation(t: Tables):
    turn = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id")) - 1
    return t.documents.select("doc_id", (turn % 3).alias("variant"))


@form
def balanced_quota(t: Tables):
    each = S.top_per_group(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], [seeded(6, "event_id")], 2)
    return S.top_per_group(each, ["event_type"], [seeded(6, "event_id")], 40).select("event_type", "event_id")


@form
def quota_per_group(t: Tables):
    sized = t.conversations.select("conv_id", "turn").withColumn("n", n_rows().over(Window.partitionBy("conv_id")))
    return S.top_per_group(sized, ["conv_id"], [K.hash_order("8", c("conv_id"), c("turn"))], F.ceil(c("n") / 3)).select("conv_id", "turn")


@form
def stratified_sample(t: Tables):
    return S.top_per_group(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], [seeded(9, "doc_id")], 2)


@form
def even_spaced_pick(t: Tables):
    return S.evenly(t.documents.select("lang", "doc_id", "n_chars"), ["lang"], ["n_chars", "doc_id"], 10).select("lang", "doc_id")


@form
def cover_then_fill(t: Tables):
    return S.cover_then_fill(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], [c("n_chars").desc(), c("doc_id")], 30, "place").select("doc_id", "lang", "place")


@form
def budget_shortfall(t: Tables):
    pairs = t.documents.select("lang").distinct().crossJoin(t.documents.select("source").distinct())  # the plan's cells: every language with every source
    return S.shortfall(t.documents, ["lang", "source"], 12, pairs)


@form
def early_stopping(t: Tables):
    return S.patience(t.events.select(c("user_id").alias("run"), "ts", "event_id", "value"), "run", ["ts", "event_id"], "value")


# Joins


@form
def reject_anti_join(t: Tables):
    return t.documents.join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@form
def reservation_set(t: Tables):
    held = t.conversations.filter(K.bucket("7", c("conv_id")) >= 80).select(F.explode(F.array(c("role"), F.concat("role", lit("~")))).alias("position"))
    return held.unionByName(t.documents.filter(K.bucket("7", c("doc_id")) >= 90).select(c("lang").alias("position"))).distinct()


@form
def ownership_conflict(t: Tables):
    g = t.events.groupBy("user_id").agg(F.min("event_type").alias("first_owner"), F.max("event_type").alias("last_owner"))
    return g.withColumn("conflict", c("first_owner") != c("last_owner"))


@form
def paired_change(t: Tables):
    after = when(c("doc_id") % 3 == 0, 1 - c("quality")).otherwise(c("quality"))
    better, worse = M.tally((c("quality") == 0) & (after == 1)), M.tally((c("quality") == 1) & (after == 0))
    return labelled(t).groupBy("lang").agg(n_rows().alias("n"), better.alias("corrected"), worse.alias("newly_wrong"), (better - worse).alias("net"))


@form
def prediction_gold_join(t: Tables):
    predicted = when(c("n_chars") > 500, 1).otherwise(0)
    rows = t.documents.join(t.labels.select("doc_id", "quality", lit(1).alias("there")), "doc_id", "left")
    return rows.groupBy("source").agg(n_rows().alias("n"), F.count("there").alias("n_predicted"), M.tally(c("quality") != predicted).alias("n_mismatch"))


@form
def reuse_or_fresh(t: Tables):
    known = t.labels.filter("toxic = 0").select("doc_id", "quality", lit("cached").alias("origin"))
    return t.documents.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("origin", lit("fresh")).alias("origin"), F.coalesce("quality", lit(-1)).alias("quality"))


@form
def bitmask_join(t: Tables):
    roots = t.part.select("p_partkey", M.mask({1: c("p_size") < 10, 2: c("p_retailprice") > 1000}).alias("mask"))
    targets = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", when(c("l_returnflag") == "R", 1).otherwise(2).alias("bit"))
    return targets.join(roots, (c("l_partkey") == c("p_partkey")) & (c("mask").bitwiseAND(c("bit")) != 0)).select("l_orderkey", "l_linenumber", "p_partkey", "mask")


@form
def parent_child_join(t: Tables):
    parent = t.conversations.select("conv_id", (c("turn") + 1).alias("turn"), c("role").alias("parent_role"))
    return t.conversations.join(parent, ["conv_id", "turn"]).select("conv_id", "turn", "parent_role", (c("parent_role") == c("role")).alias("repeats"))


@form
def first_divergence(t: Tables):
    other = t.conversations.select((c("conv_id") - 1).alias("conv_id"), "turn", c("role").alias("other"))
    both = t.conversations.join(other, ["conv_id", "turn"])
    return both.groupBy("conv_id").agg(F.min(when(c("role") != c("other"), c("turn"))).alias("first_difference"), n_rows().alias("n_common"))


@form
def feature_join(t: Tables):
    return t.documents.select("doc_id").join(t.embeddings.select("vec_id", "label"), c("doc_id") == c("vec_id"))


@form
def review_binding(t: Tables):
    packets = t.documents.select("doc_id", sha("text").alias("packet"), c("source").alias("author"))
    reviews = packets.select("doc_id", when(c("doc_id") % 20 == 0, "stale").otherwise(c("packet")).alias("seen"), when(c("doc_id") % 9 == 0, c("author")).otherwise("reviewer").alias("reviewer"))
    return packets.join(reviews, "doc_id").select("doc_id", (c("seen") == c("packet")).alias("bound"), (c("reviewer") != c("author")).alias("independent"))
