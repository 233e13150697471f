"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart_minhash, decontaminate, language, mixture, personal, shards, tokens, toxicity, vectors, warc

try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
except ImportError:  # another place can be given to tokens.write
    TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.spans(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, group_id (smallest doc_id of its near duplicates), group_rows, kept."""
    return dart_minhash.groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op5_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_and_read(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``capture``: the nested row's requests and metadata as JSON."""
    nested = F.to_json(F.struct(F.transform("requests", lambda r: r["target_uri"]).alias("requests"), F.transform("metadata", lambda m: m["page_id"]).alias("metadata")))
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", nested.alias("capture"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours(table(spark, sf_dir, "embeddings"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.weigh(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_toxicity, op3_dart_minhash, op4_kd_shards, op5_repair_tokens, op6_warc, op7_decontaminate, op8_range_join, op9_mixture, op10_language)
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
REACH = "reach as (select {i} as a, {i} as b from {t} union select r.a, l.b from reach r join both_ways l on l.a = r.b)"

OP3_SQL = f"""
with recursive d as materialized (select doc_id, {WORDS} as w from documents),
e as (select doc_id, w, unnest(range(1, case when len(w) >= 5 then len(w) - 3 else least(len(w), 1) + 1 end)) as i from d),
s as materialized (select doc_id, h, row_number() over (partition by doc_id, h) as k from (select doc_id, hash(array_to_string(w[i:i + 4], ' ')) as h from e)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.h = b.h and a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
link as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where c >= 0.8 * (a.n + b.n - c) - 1e-9),
both_ways as materialized (select x as a, y as b from link union select y, x from link),
{REACH.format(i="doc_id", t="d")},
g as (select a as doc_id, min(b) as group_id from reach group by a)
select doc_id, group_id, count(*) over (partition by group_id) as group_rows, doc_id = group_id as kept from g"""

OP6_SQL = r"""
with p as (select page_id, coalesce(nullif(url, ''), 'urn:none') as url, coalesce(html, '') as html from pages), h as (select page_id, url, html, sha1(html) as h, min(page_id) over (partition by html) as first from p)
select page_id, '{"requests":["' || array_to_string(list_transform(string_split(url, ''), lambda c: case when regexp_full_match(c, '[A-Za-z0-9_.~%/:=&?#+!$,;''@()*\[\]-]') then c else url_encode(c) end), '') || '"],"metadata":[' || cast(page_id as varchar) || ']}' as capture, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast(('0x' || substr(h, cast(i // 4 * 5 + 1 as int), 5)) as bigint) >> cast(15 - i % 4 * 5 as int)) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from h"""

OP7_SQL = f"""
with b as (select item_id, {WORDS} as w from benchmark), bw as (select item_id, w, unnest(range(1, case when len(w) >= 10 then len(w) - 8 else least(len(w), 1) + 1 end)) as i from b),
win as (select distinct item_id, array_to_string(w[i:i + 9], ' ') as t, least(len(w), 10) as n from bw), sizes as (select distinct n from win),
d as materialized (select doc_id, {WORDS} as w from documents),
dw as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join sizes where len(w) >= n),
hit as (select doc_id, i, win.n, item_id from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as t from dw) x join win on win.t = x.t and win.n = x.n),
spot as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(i, i + n)) as q from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join spot on spot.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

OP8_SQL = f"""
with recursive v as materialized (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null),
link as materialized (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
both_ways as materialized (select x as a, y as b from link union all select y, x from link),
{REACH.format(i="vec_id", t="embeddings")},
g as (select a as vec_id, min(b) as component_id from reach group by a), n as (select a, count(*) as n from both_ways group by a)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from g left join n on n.a = vec_id"""

#: The others have no SQL: a trained model (1, 2, 10), a tokenizer (5), splits that depend on each other (4), a seeded hash (9).
ORACLES: dict[str, str] = {"op3_dart_minhash": OP3_SQL, "op6_warc": OP6_SQL, "op7_decontaminate": OP7_SQL, "op8_range_join": OP8_SQL}
