"""Keys, scalars, scans and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..sources import records
from .registry import Duck, Tables, query, shared


def bucket_sql(D, key: str, seed: str = "7", n: int = 100) -> str:
    """The modulus of the whole SHA-256 number, eight hexadecimal digits at a time."""
    h, total = D.sha(f"concat('{seed}/', {D.text(key)})"), "0"
    for i in range(8):
        total = f"(({total}) * {2**32 % n} + {D.hexint(f'substr({h}, {8 * i + 1}, 8)')}) % {n}"
    return total


def split_sql(D, key: str, seed: str = "7") -> str:
    b = bucket_sql(D, key, seed)
    return f"case when {b} < 80 then 'train' when {b} < 90 then 'validation' else 'test' end"


HISTORY = "select conv_id, sha256(concat('[\"', string_agg(role, '\", \"' order by turn), '\"]')) as history_key from conversations group by conv_id"


@query(HISTORY)
def history_key(t: Tables):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("h"))
    return g.select("conv_id", K.history_key(F.transform("h", lambda x: x["role"])).alias("history_key"))


@query(r"select doc_id, array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 2), ' ') as prefix from documents")
def prefix_key(t: Tables):
    return t.documents.select("doc_id", K.prefix_key(F.col("text")).alias("prefix"))


@query("""select doc_id, sha256('{"id":"' || doc_id || '","lang":"' || lang || '","source":"' || source || '"}') as fp from documents""")
def canonical_fingerprint(t: Tables):
    return t.documents.select("doc_id", K.fingerprint(source=F.col("source"), lang=F.col("lang"), id=F.col("doc_id")).alias("fp"))


@query(f"select doc_id, {split_sql(Duck, 'doc_id')} as split, {bucket_sql(Duck, 'doc_id')} as bucket from documents")
def assigned_split(t: Tables):
    return t.documents.select("doc_id", K.assigned_split("7", F.col("doc_id")).alias("split"), K.bucket("7", F.col("doc_id")).alias("bucket"))


@query("select doc_id, cast('0x' || substr(sha256('11/' || lang || '/' || doc_id), 1, 15) as bigint) as seed from documents")
def row_seed(t: Tables):
    return t.documents.select("doc_id", K.row_seed("11", F.col("lang"), F.col("doc_id")).alias("seed"))


@query("select o_orderkey, cast(regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '^[0-9]{4}') as integer) as y from orders")
def single_year(t: Tables):
    return t.orders.select("o_orderkey", K.single_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("y"))


@query(r"""select doc_id, sha256(regexp_replace(trim(regexp_replace(translate(text, '“”‘’', '""'''''), '\s+', ' ', 'g'), ' '), '[.!?;:, ]+$', '')) as norm from documents""")
def normalize_text(t: Tables):
    return t.documents.select("doc_id", F.sha2(K.normalize_text(F.col("text")), 256).alias("norm"))


shared("label_canonicalize", lambda D: """
    select s.s_suppkey, n.n_name as team, substr(s.s_name, length('Supplier#') + 1) as label
    from supplier s join nation n on s.s_nationkey = n.n_nationkey where s.s_name like 'Supplier#%'
    union all select s_suppkey, cast(null as varchar(1)) as team, s_name as label from supplier where s_name not like 'Supplier#%'""")  # fmt: skip
shared("derive_group", lambda D: f"""
    select page_id, case when url like 'https://%' then 'secure' when url like 'http://%' then 'plain' else 'other' end as kind,
      coalesce(nullif({D.extract('url', '^https?://([^/?#]+)', 1)}, ''), 'none') as host from pages""")  # fmt: skip
shared("score_order_key", lambda D: """
    select event_id, case when event_type = 'purchase' then 100000 - cast(floor(value) as int) when event_type = 'error' then -100000 + cast(floor(value) as int) else cast(floor(value) as int) end as order_key,
      case when user_id % 2 = 0 then value else -value end as seen_by_mover from events""")  # fmt: skip
shared("exclusive_threshold", lambda D: """
    select event_id from events where abs(value - 50) < 10 and abs(abs(value - 50) - 10) > 1e-12""")  # fmt: skip
shared("decision_rules", lambda D: """
    select o_orderkey, case when o_totalprice is null then 'unscored' when o_orderstatus = 'F' and o_totalprice > 100000 then 'accept'
      when o_orderstatus = 'P' then 'recurse' when o_totalprice < 5000 then 'too_small' else 'reject' end as decision from orders""")  # fmt: skip
shared("coalesce_choice", lambda D: f"""
    with best as (select user_id, max(value) as top from events group by user_id),
    near as (select e.user_id, e.event_id, row_number() over (partition by e.user_id order by {D.sha(f"concat('5/', {D.text('e.event_id')})")}) as k
      from events e join best b on e.user_id = b.user_id where e.value >= b.top - 5),
    strict as (select user_id, min(event_id) as event_id from events where event_type = 'purchase' group by user_id)
    select b.user_id, coalesce(n.event_id, s.event_id, -1) as pick from best b left join near n on n.user_id = b.user_id and n.k = 2 left join strict s on s.user_id = b.user_id""")  # fmt: skip
shared("schema_by_type", lambda D: f"""
    select event_id, case when event_type in ('click', 'view') then {D.json('props', 'k')} is not null when event_type = 'purchase' then value > 0 else true end as ok from events""")  # fmt: skip


@query(r"""select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[a-z]+|[0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]+$') then repeat('.', least(cast(substr(x, 1, 2) as int), 9)) else substr(x, 1, 1) end), '') as board from documents""")
def run_length_decode(t: Tables):
    """Digits stand for runs of empty squares; letters for pieces."""
    parts = F.regexp_extract_all("text", F.lit("[a-z]+|[0-9]+"), F.lit(0))
    square = lambda x: F.when(x.rlike("^[0-9]+$"), F.expr("repeat('.', 9)").substr(F.lit(1), F.least(F.substring(x, 1, 2).try_cast("int"), F.lit(9)))).otherwise(F.substring(x, 1, 1))
    return t.documents.select("doc_id", F.array_join(F.transform(parts, square), "").alias("board"))


@query("""select p_partkey, reverse(translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')) as mirrored from part""")
def mirror_transform(t: Tables):
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return t.part.select("p_partkey", F.reverse(F.translate("p_name", low + up, up + low)).alias("mirrored"))


# Scans


@query("select event_id, user_id, event_type, value from events")
def scan_jsonl_roundtrip(t: Tables):
    path = records.write_jsonl(t.events.select("event_id", "user_id", "event_type", "value"))
    return records.read_jsonl(t.spark, path, "event_id long, user_id long, event_type string, value double").select("event_id", "user_id", "event_type", "value")


@query("""with l as (select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as line from events)
    select event_id - 1 + 1 - (select min(event_id) from events) as line_no, sha256(line) as sha, cast(coalesce(sum(octet_length(encode(line)) + 1) over (order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset from l""")
def pointer_scan(t: Tables):
    lines = t.events.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))
    return records.pointers(lines, "event_id", "line")


shared("stage_filter", lambda D: "select doc_id, lang, source from documents where lang in ('de', 'fr')")
shared("split_file_agreement", lambda D: f"""
    with s as (select doc_id, {split_sql(D, 'source')} as split, case when doc_id % 50 = 0 then 'train' else {split_sql(D, 'source')} end as file from documents)
    select file, count(*) as n, count(case when split <> file then 1 end) as n_wrong from s group by file""")  # fmt: skip
shared("raw_line_filter", lambda D: "select props from events where event_type = 'click'")


@query("select count(*) as n, sum(hash_value) as total from (select cast('0x' || substr(sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}'), 1, 8) as bigint) as hash_value from documents)".replace("sum(hash_value)", "cast(sum(hash_value) as bigint)"))
def dataset_fingerprint(t: Tables):
    return records.fingerprint(t.documents.select("doc_id", "lang"))


shared("metadata_then_payload", lambda D: "select d.doc_id, d.n_chars, d.text as payload from documents d where d.doc_id in (select doc_id from labels where quality = 1 and toxic = 1)")
shared("unique_id_check", lambda D: "select source, count(*) as n, count(distinct doc_id) as n_ids, count(*) - count(distinct doc_id) as repeated from documents group by source")


@query(r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<li>')) as n_items, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang from pages""")
def tagged_text_extract(t: Tables):
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).alias("n_items"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")
    )


shared("url_allowlist", lambda D: f"""
    select page_id, {D.extract('url', '^([a-z]+)://', 1)} as scheme, {D.extract('url', '^[a-z]+://([^/?#]+)', 1)} as host,
      {D.matches('url', '^https?://[a-z.]+[.](com|org|net)(/|$)')} and not {D.matches('url', '[?&](?:token|password)=')} as allowed from pages""")  # fmt: skip
shared("json_record_admission", lambda D: f"""
    select event_id, case when {D.json('props', 'k')} is null then 'no_key' when cast({D.json('props', 'k')} as int) % 7 = 0 then 'enum' when value < 0 then 'negative' else 'ok' end as reason from events""")  # fmt: skip


@query(r"""select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k, event_id % 3 <> 0 as valid from events""")
def fenced_json_parse(t: Tables):
    fenced = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n{oops "), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props")).alias("answer"), "props")
    parsed = records.parse_fenced(fenced, "answer", "k int")
    return parsed.select("event_id", F.when(F.col("parsed").isNull(), F.get_json_object("props", "$.k").try_cast("int")).otherwise(F.col("parsed.k")).alias("k"), F.col("parsed").isNotNull().alias("valid"))


