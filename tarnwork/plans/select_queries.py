"""Windows, deduplication, quotas and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import select as S
from ..operators.ranges import number
from .registry import Duck, Tables, query, shared

ORDERED = "array_to_string(list(role order by turn), ' ')"


@query("select doc_id, h from (select doc_id, sha256(text) as h, row_number() over (partition by sha256(text) order by doc_id) as k from documents) where k = 1")
def first_wins_dedup(t: Tables):
    return S.first_wins(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), ["h"], [F.col("doc_id")])


@query("""select doc_id, kept_doc_id, source <> kept_source as other_source from (select doc_id, source, row_number() over w as k, first_value(doc_id) over w as kept_doc_id, first_value(source) over w as kept_source
    from documents window w as (partition by sha256(text) order by doc_id)) where k > 1""")
def duplicate_provenance(t: Tables):
    d = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    found = S.duplicate_provenance(d.withColumn("pair", F.struct("doc_id", "source")), ["h"], [F.col("doc_id")], "pair")
    return found.select("doc_id", F.col("kept_pair.doc_id").alias("kept_doc_id"), (F.col("source") != F.col("kept_pair.source")).alias("other_source"))


@query("""with s as (select doc_id, lang, source, sha256(text) as h from documents), g as (select h from s group by h having count(distinct lang) = 1)
    select min(doc_id) as doc_id, h from s where h in (select h from g) group by h""")
def conflict_dedup(t: Tables):
    return S.conflict_dedup(t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("h")), ["h"], "lang", [F.col("doc_id")]).select("doc_id", "h")


shared("coalesce_identical", lambda D: f"""
    select p_brand, p_type, min(p_partkey) as p_partkey, count(*) as n, count(distinct {D.sha('p_name')}) = 1 as identical from part group by p_brand, p_type""")  # fmt: skip


@query("select user_id, arg_max(event_id, (value, event_id)) as event_id, max(value) as value from events group by user_id")
def max_rank_dedup(t: Tables):
    return S.max_rank(t.events.select("user_id", "event_id", "value"), ["user_id"], [F.col("value"), F.col("event_id")])


shared("orbit_dedupe", lambda D: """
    select orbit, min(p_partkey) as p_partkey, count(*) as n from (select p_partkey, least(p_name, reverse(p_name)) as orbit from part) x group by orbit""")  # fmt: skip


@query("""with f as (select event_id, event_type, ts, case when event_type = lag(event_type) over (order by ts, event_id) then 0 else 1 end as c from events),
    i as (select *, sum(c) over (order by ts, event_id) as island from f) select cast(island as bigint) as island, min(event_type) as event_type, count(*) as n from i group by island""")
def contiguous_groups(t: Tables):
    found = S.islands(t.events.select("event_type", "ts", "event_id"), "event_type", ["ts", "event_id"])
    return found.groupBy(F.col("island").cast("long").alias("island")).agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


shared("sequence_integrity", lambda D: """
    select l_orderkey, count(*) as n, min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*) as contiguous, count(distinct l_returnflag) = 1 as constant_flag from lineitem group by l_orderkey""")  # fmt: skip


@query(f"""select conv_id, turn, array_to_string(list(role) over (partition by conv_id order by turn rows between unbounded preceding and current row), ' ') as prefix,
    array_to_string(list(role) over (partition by conv_id order by turn rows between 1 following and 8 following), ' ') as future from conversations where true or '{ORDERED[:0]}' = ''""")
def prefix_and_future_windows(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = F.array_join(F.collect_list("role").over(w.rowsBetween(1, 8)), " ")
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("role").over(w.rowsBetween(Window.unboundedPreceding, 0)), " ").alias("prefix"), F.when(after != "", after).alias("future"))


shared("phase_tertile", lambda D: """
    select conv_id, turn, cast(least(2, floor(3 * turn / greatest(1, max(turn) over (partition by conv_id)))) as int) as phase from conversations""")  # fmt: skip
shared("variant_rotation", lambda D: "select doc_id, (row_number() over (partition by lang, source order by doc_id) - 1) % 3 as variant from documents")
@query("select doc_id, (row_number() over (order by doc_id) - 1) % 8 as strided, cast(floor((row_number() over (order by doc_id) - 1) / 128) as bigint) as chunk from documents")
def shard_assignment(t: Tables):
    placed = number(t.documents.select("doc_id"), ["doc_id"], "i")
    return placed.select("doc_id", (F.col("i") % 8).alias("strided"), F.floor(F.col("i") / 128).cast("long").alias("chunk"))


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by sha256('3/' || lang || '/' || doc_id), doc_id) as k from documents) where k <= 20")
def hash_topk_per_group(t: Tables):
    return S.top_per_group(t.documents.select("doc_id", "lang"), ["lang"], [K.hash_order("3", F.col("lang"), F.col("doc_id")), F.col("doc_id")], 20)


@query("select doc_id from documents order by sha256('4/' || doc_id) limit 50")
def hash_order_limit(t: Tables):
    return S.hash_limit(t.documents.select("doc_id"), K.hash_order("4", F.col("doc_id")), 50)


def ranked(seed, key):
    return lambda D: D.sha(f"concat('{seed}/', {D.text(key)})")


shared("balanced_quota", lambda D: f"""
    with one as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by {ranked(6, 'event_id')(D)}) as g from events)
    select event_type, event_id from (select *, row_number() over (partition by event_type order by {ranked(6, 'event_id')(D)}) as k from one where g <= 2) x where k <= 40""")  # fmt: skip
shared("quota_per_group", lambda D: f"""
    select conv_id, turn from (select conv_id, turn, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by {D.sha(f"concat('8/', {D.text('conv_id')}, '/', {D.text('turn')})")}) as k from conversations) x where k <= ceil(n / 3.0)""")  # fmt: skip
shared("stratified_sample", lambda D: f"""
    select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by lang, source order by {ranked(9, 'doc_id')(D)}) as k from documents) x where k <= 2""")  # fmt: skip
shared("even_spaced_pick", lambda D: f"""
    with r as (select doc_id, lang, row_number() over (partition by lang order by n_chars, doc_id) - 1 as i, count(*) over (partition by lang) as n from documents),
    w as (select lang, n, k, cast({D.even('k * (n - 1) / 9.0')} as bigint) as i from (select distinct lang, n from r) a cross join (select p_partkey - 1 as k from part where p_partkey between 1 and 10) b)
    select distinct r.lang, r.doc_id from r join w on r.lang = w.lang and r.i = w.i""")  # fmt: skip
shared("cover_then_fill", lambda D: """
    with m as (select doc_id, lang, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as k from documents),
    o as (select doc_id, lang, row_number() over (order by case when k = 1 then 0 else 1 end, n_chars desc, doc_id) as place from m) select doc_id, lang, place from o where place <= 30""")  # fmt: skip
shared("budget_shortfall", lambda D: f"""
    with p as (select doc_id, lang, source, row_number() over (partition by lang, source order by {ranked(10, 'doc_id')(D)}) as k from documents),
    s as (select lang, source, count(*) as picked from p where k <= 12 group by lang, source), b as (select l.lang, s.source from (select distinct lang from documents) l cross join (select distinct source from documents) s)
    select b.lang, b.source, coalesce(s.picked, 0) as picked, 12 - coalesce(s.picked, 0) as shortfall from b left join s on b.lang = s.lang and b.source = s.source""")  # fmt: skip
shared("epoch_batches", lambda D: f"""
    with e as (select 0 as epoch union all select 1), p as (select epoch, doc_id, row_number() over (partition by epoch order by {D.sha(f"concat('12/', {D.text('epoch')}, '/', {D.text('doc_id')})")}) - 1 as i, count(*) over (partition by epoch) as n from e cross join documents),
    q as (select epoch, doc_id, i from p union all select epoch, doc_id, i + n as i from p where i < (64 - n % 64) % 64)
    select epoch, doc_id, cast(floor(i / 64) as bigint) as step, cast(floor((i % 64) / 16) as bigint) as worker, i % 16 as place from q""")  # fmt: skip
shared("weighted_pick", lambda D: f"""
    with w as (select lang, count(*) as n from documents group by lang), c as (select lang, sum(n) over (order by lang) - n as low, sum(n) over (order by lang) as high, sum(n) over () as total from w),
    u as (select p_partkey as draw, {D.hexint(f"substr({D.sha(f'''concat('13/', {D.text('p_partkey')})''')}, 1, 8)")} / 4294967296.0 as u from part)
    select u.draw, c.lang from u join c on u.u * c.total >= c.low and u.u * c.total < c.high""")  # fmt: skip
shared("early_stopping", lambda D: """
    with m as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as step, value from events),
    b as (select run, step, value, max(value) over (partition by run order by step rows between unbounded preceding and 1 preceding) as before from m)
    select run, max(case when before is null or value > before then step end) as best_step, max(step) - max(case when before is null or value > before then step end) as stale from b group by run""")  # fmt: skip
