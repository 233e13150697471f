"""Joins across sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import relations as R
from .registry import Duck, Tables, query, shared
from .scalars import bucket_sql, split_sql

VERDICT = "case when n_right = 0 then 'missing' when n_left = 0 then 'foreign' when n_left > 1 or n_right > 1 then 'duplicate' else 'covered' end"


@query(f"""with a as (select o_custkey as k, count(*) as n from orders group by 1), b as (select c_custkey as k, count(*) as n from customer where c_custkey % 10 <> 0 group by 1),
    j as (select coalesce(a.k, b.k) as key, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right from a full join b on a.k = b.k) select key, n_left, n_right, {VERDICT} as verdict from j""")
def coverage_join(t: Tables):
    return R.coverage(t.orders.select(F.col("o_custkey").alias("key")), t.customer.filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("key")), "key")


shared("reject_anti_join", lambda D: "select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)")

SHINGLES = "select distinct {i} as id, array_to_string(list_slice(w, i, i + 7), ' ') as p from (select {i}, regexp_split_to_array(text, '\\s+') as w from {t}) x, unnest(range(1, len(w) - 6)) as u(i)"


@query(f"""with d as ({SHINGLES.format(i="doc_id", t="documents")}), b as ({SHINGLES.format(i="item_id", t="benchmark")}), hit as (select distinct id from d where p in (select p from b))
    select doc_id, doc_id not in (select id from hit) as kept from documents""")
def reserved_isolation(t: Tables):
    d = t.documents
    return R.isolated(d.select("doc_id"), "doc_id", R.shingles(d, "doc_id", "text"), R.shingles(t.benchmark, "item_id", "text"), "position", "kept")


shared("reservation_set", lambda D: f"""
    select distinct position from (select role as position from conversations where {bucket_sql(D, 'conv_id')} >= 80 union all select concat(role, '~') as position from conversations where {bucket_sql(D, 'conv_id')} >= 80
      union all select lang as position from documents where {bucket_sql(D, 'doc_id')} >= 90) x""")  # fmt: skip


@query(f"""select h as position, count(distinct split) as n_splits, min(split) as first_split, max(split) as last_split from (select sha256(text) as h, {split_sql(Duck, 'doc_id')} as split from documents) x group by h having count(distinct split) > 1""")
def split_leakage(t: Tables):
    return R.leakage(t.documents.select(F.sha2("text", 256).alias("position"), K.assigned_split("7", F.col("doc_id")).alias("split")), "position", "split")


shared("ownership_conflict", lambda D: """
    select user_id, min(event_type) as first_owner, max(event_type) as last_owner, min(event_type) <> max(event_type) as conflict from events group by user_id""")  # fmt: skip


@query(f"""with s as (select doc_id, sha256(text) as h, case {split_sql(Duck, 'doc_id')} when 'test' then 0 when 'validation' then 1 else 2 end as k from documents)
    select doc_id from s where k = (select min(k) from s o where o.h = s.h)""")
def priority_isolation(t: Tables):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), K.assigned_split("7", F.col("doc_id")).alias("split"))
    return R.priority_isolation(d, "h", F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).otherwise(2)).select("doc_id")


shared("paired_change", lambda D: """
    with a as (select doc_id, lang, quality as before, case when doc_id % 3 = 0 then 1 - quality else quality end as after from labels join documents using (doc_id))
    select lang, count(*) as n, count(case when before = 0 and after = 1 then 1 end) as corrected, count(case when before = 1 and after = 0 then 1 end) as newly_wrong,
      count(case when before = 0 and after = 1 then 1 end) - count(case when before = 1 and after = 0 then 1 end) as net from a group by lang""")  # fmt: skip
shared("prediction_gold_join", lambda D: """
    select d.source, count(*) as n, count(l.doc_id) as n_predicted, count(case when l.quality <> (case when d.n_chars > 500 then 1 else 0 end) then 1 end) as n_mismatch
    from documents d left join labels l on d.doc_id = l.doc_id group by d.source""")  # fmt: skip
shared("reuse_or_fresh", lambda D: """
    select d.doc_id, case when l.doc_id is null then 'fresh' else 'cached' end as origin, coalesce(l.quality, -1) as quality from documents d left join labels l on d.doc_id = l.doc_id and l.toxic = 0""")  # fmt: skip
@query("""with r as (select conv_id, list(role order by turn) as roles from conversations group by conv_id), root as (select distinct list_slice(roles, 1, 2) as roles from r where len(roles) >= 2)
    select c.conv_id, array_to_string(root.roles, ' ') as root, len(c.roles) - 2 as extra from r c join root on list_slice(c.roles, 1, 2) = root.roles and len(c.roles) > 2""")
def prefix_join(t: Tables):
    """Every longer line with the two-step root that it begins with."""
    roles = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    roots = roles.filter(F.size("roles") >= 2).select(F.slice("roles", 1, 2).alias("root")).distinct()
    return R.family(roles, "roles", roots, "root").filter(F.size("roles") > F.size("root")).select("conv_id", F.array_join("root", " ").alias("root"), (F.size("roles") - F.size("root")).cast("long").alias("extra"))
shared("bitmask_join", lambda D: """
    with r as (select p_partkey, (case when p_size < 10 then 1 else 0 end) + (case when p_retailprice > 1000 then 2 else 0 end) as mask from part),
    t as (select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'R' then 1 else 2 end as bit from lineitem)
    select t.l_orderkey, t.l_linenumber, r.p_partkey, r.mask from t join r on t.l_partkey = r.p_partkey and (r.mask & t.bit) <> 0""")  # fmt: skip
shared("parent_child_join", lambda D: """
    select c.conv_id, c.turn, p.role as parent_role, p.role = c.role as repeats from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1""")  # fmt: skip


@query("""with recursive chain as (select doc_id, doc_id as link, 0 as depth from documents union all select doc_id, link // 2, depth + 1 from chain where link > 1)
    select doc_id, arg_max(link, depth) as original, max(depth) as depth from chain group by doc_id""")
def revision_chain(t: Tables):
    revisions = t.documents.select("doc_id", F.when(F.col("doc_id") > 1, F.expr("doc_id div 2")).alias("corrected_from"))
    return R.originals(revisions, "doc_id", "corrected_from").filter("not cyclic").select("doc_id", "original", "depth")


shared("first_divergence", lambda D: """
    with p as (select a.turn, a.conv_id, b.conv_id as other, a.role <> b.role as differs from conversations a join conversations b on b.conv_id = a.conv_id + 1 and b.turn = a.turn)
    select conv_id, min(case when differs then turn end) as first_difference, count(*) as n_common from p group by conv_id""")  # fmt: skip
shared("feature_join", lambda D: """
    select d.doc_id, e.vec_id, e.label from documents d join embeddings e on d.doc_id = e.vec_id""")  # fmt: skip
shared("review_binding", lambda D: f"""
    with p as (select doc_id, {D.sha('text')} as packet, source as author from documents), r as (select doc_id, case when doc_id % 20 = 0 then 'stale' else packet end as packet, case when doc_id % 9 = 0 then author else 'reviewer' end as reviewer from p)
    select p.doc_id, r.packet = p.packet as bound, r.reviewer <> p.author as independent from p join r on r.doc_id = p.doc_id""")  # fmt: skip


@query("""with s as (select doc_id, source, count(*) over (partition by source) as n from documents), p as (select *, row_number() over (order by n desc, source, doc_id) - 1 as i, max(n) over () as m, count(*) over () as total from s)
    select a.doc_id, a.source, b.doc_id as donor_doc_id, b.source as donor_source from p a join p b on (a.i + a.m) % a.total = b.i""")
def derangement_join(t: Tables):
    return R.derangement(t.documents.select("doc_id", "source"), "source", ["doc_id"])
