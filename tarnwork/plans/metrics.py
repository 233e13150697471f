"""Aggregates, rates, gates and accounting; plain SQL, so partial aggregation runs before every shuffle."""

from __future__ import annotations

from .registry import shared

JOINED = "labels l join documents d on l.doc_id = d.doc_id"

shared("grouped_accuracy", lambda D: f"select lang, source, count(*) as n, round(avg(cast(quality as double)), 9) as accuracy from {JOINED} group by rollup(lang, source)")
shared("conditional_metrics", lambda D: f"""
    select source, count(*) as n, round(avg(cast(quality as double)), 9) as rate, round(avg(case when toxic = 1 then cast(n_chars as double) end), 6) as toxic_chars, count(case when toxic = 1 and n_chars > 1000 then 1 end) as n_long from {JOINED} group by source""")  # fmt: skip
shared("exploded_metrics", lambda D: """
    select role, n_turns, count(*) as n, max(length(text)) as longest from (select conv_id, role, text, count(*) over (partition by conv_id) as n_turns from conversations) x group by role, n_turns""")  # fmt: skip
shared("outcome_score", lambda D: """
    select o_orderpriority, count(case when o_orderstatus = 'F' then 1 end) as wins, count(case when o_orderstatus = 'O' then 1 end) as losses, count(case when o_orderstatus = 'P' then 1 end) as censored,
      round(count(case when o_orderstatus = 'F' then 1 end) / cast(nullif(count(case when o_orderstatus <> 'P' then 1 end), 0) as double), 9) as score from orders group by o_orderpriority""")  # fmt: skip
shared("numeric_task_metrics", lambda D: "select event_type, count(*) as n, count(value) as n_scored, round(avg(abs(value - 50)), 6) as mean_error from events group by event_type")
shared("micro_precision_recall", lambda D: f"""
    select lang, round(cast(sum(case when quality = 1 and n_chars > 300 then 1 else 0 end) as double) / nullif(sum(case when n_chars > 300 then 1 else 0 end), 0), 9) as micro_precision,
      round(cast(sum(case when quality = 1 and n_chars > 300 then 1 else 0 end) as double) / nullif(sum(case when quality = 1 then 1 else 0 end), 0), 9) as micro_recall from {JOINED} group by lang""")  # fmt: skip
shared("bucket_groups", lambda D: """
    select kind, size_bucket, count(*) as n, round(avg(p_retailprice), 4) as price from (select p_brand as kind, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size_bucket, p_retailprice from part) x group by grouping sets ((kind), (size_bucket))""")  # fmt: skip
shared("grouping_sets_counts", lambda D: "select lang, source, n_chars % 3 as phase, count(*) as n from documents group by grouping sets ((lang), (lang, source), (n_chars % 3), ())")
shared("map_merge_sum", lambda D: """
    select k, cast(sum(n) as bigint) as n from (select conv_id, role as k, count(*) as n from conversations group by conv_id, role union all select conv_id, 'total' as k, count(*) as n from conversations group by conv_id) x group by k""")  # fmt: skip
shared("positions_by_split", lambda D: f"select event_type, {D.strs('u')} as users from (select distinct event_type, {D.text('user_id')} as u from events) x group by event_type")
shared("distinct_counts", lambda D: f"select lang, count(distinct {D.sha('text')}) as texts, count(distinct source) as sources, count(*) as n from documents group by lang")
shared("bitmask_or", lambda D: "select user_id, bit_or(case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 4 when 'signup' then 8 else 16 end) as mask from events group by user_id")
shared("weighted_mean", lambda D: "select lang, round(sum(cast(toxic as double) * n_chars) / sum(n_chars), 9) as weighted from labels join documents using (doc_id) group by lang")


def max_by_sql(D):
    f = "max_by" if D.__name__ == "Spark" else "arg_max"
    row = "struct(n_chars, -doc_id)" if D.__name__ == "Spark" else "(n_chars, -doc_id)"
    return f"select lang, max(n_chars) as longest, {f}(doc_id, {row}) as doc_id from documents group by lang"


shared("max_by_group", max_by_sql)
shared("mixture_counts", lambda D: f"""
    with w as (select lang, count(*) as n from documents group by lang), r as (select lang, n, case lang when 'en' then 0.5 when 'de' then 0.25 else 0.125 end as weight from w), a as (select max(case when lang = 'en' then n end) as anchor from r)
    select lang, n, cast({D.even("anchor * weight / 0.5")} as bigint) as wanted from r cross join a""")  # fmt: skip
shared("gate_pass", lambda D: f"""
    with t as (select source, count(*) as n, avg(cast(quality as double)) as accuracy from {JOINED} group by source)
    select count(*) as n_tasks, min(n) >= 5 as enough, round(min(accuracy), 9) as worst, min(n) >= 5 and min(accuracy) >= 0.6 and avg(accuracy) >= 0.8 as pass from t""")  # fmt: skip
shared("functional_score", lambda D: f"""
    select round(cast(0.5 as double) * avg(cast(quality as double)) + cast(0.3 as double) * (1 - avg(cast(toxic as double))) + cast(0.2 as double) * avg(case when n_chars > 500 then cast(1 as double) else cast(0 as double) end), 9) as score from {JOINED}""")  # fmt: skip
shared("accounting_identity", lambda D: f"""
    with k as (select doc_id, length(text) < 40 as short, row_number() over (partition by {D.sha('text')} order by doc_id) as n from documents),
    c as (select count(*) as total, count(case when short then 1 end) as rejected, count(case when not short and n > 1 then 1 end) as duplicates, count(case when not short and n = 1 then 1 end) as kept from k) select *, total = kept + rejected + duplicates as balanced from c""")  # fmt: skip
shared("throughput_ratio", lambda D: """
    with s as (select size, count(*) as n, sum(value) as seconds from (select user_id % 4 + 1 as size, value from events where value > 0) x group by size), one as (select n / seconds as rate from s where size = 1)
    select size, n, round(n / seconds, 9) as rate, round((n / seconds) / one.rate, 9) as ratio from s cross join one""")  # fmt: skip
shared("budget_plan", lambda D: """
    select lang, count(*) as n, cast(ceil(count(*) / 64.0) as bigint) as updates_per_pass, least(3, cast(ceil(1000.0 / count(*)) as bigint)) as passes, least(500, cast(ceil(count(*) / 64.0) as bigint) * 3) as steps from documents group by lang""")  # fmt: skip
shared("class_bitmask", lambda D: """
    select doc_id, (case when n_chars < 200 then 1 else 0 end) + (case when text like '%###%' then 2 else 0 end) + (case when text like '%@%' then 4 else 0 end) as mask, concat(case when n_chars < 200 then 's' else '' end, case when text like '%###%' then 'j' else '' end, case when text like '%@%' then 'm' else '' end) as classes from documents""")  # fmt: skip
shared("loss_vs_best", lambda D: "select l_orderkey, l_linenumber, round(max(l_extendedprice) over (partition by l_orderkey) - l_extendedprice, 6) as loss from lineitem")
shared("response_contract", lambda D: f"""
    select event_id, value <= 90 as within_budget, {D.json('props', 'k')} is not null as answered, event_type <> 'error' and value is not null as ok from events""")  # fmt: skip
