"""Queries over stores, indexes and evidence: what is written is read back and held against the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators.ranges import number
from ..sources import evidence, features, records, row_index
from ..streaming import ledger as L
from .registry import Tables, query

LINE = """'{"id":"' || event_id || '","stage":"' || event_type || '","split":"train","feature_key":"u' || user_id || '","value":"' || cast(floor(value) as int) || '"}'"""


@query(f"""select cast(event_id as varchar) as id, sha256({LINE} || chr(10)) as raw_sha256, length({LINE}) + 1 as length from events where event_type = 'purchase'""")
def row_index_lookup(t: Tables):
    """JSON lines of all events are indexed in small byte ranges; the purchases' lines are then read by their places."""
    path = records.scratch(t.spark)
    text = lambda c: F.col(c).cast("string")
    lines = t.events.select(text("event_id").alias("id"), F.col("event_type").alias("stage"), F.lit("train").alias("split"), F.concat(F.lit("u"), text("user_id")).alias("feature_key"), F.floor("value").cast("int").cast("string").alias("value"))
    records.write_jsonl(lines, path)
    index = row_index.build(t.spark, f"{path}/*.json", "train", chunk=100_000)
    found = row_index.lookup(index, index.filter("stage = 'purchase'").select("id"))
    return found.select("id", F.sha2("raw", 256).alias("raw_sha256"), F.octet_length("raw").cast("long").alias("length"))


@query("""select event_type as stage, count(*) as n, count(distinct user_id) as n_features, cast(sum(length) as bigint) as bytes from (select event_type, user_id, length('{"id":"' || event_id || '","stage":"' || event_type || '","split":"train","feature_key":"u' || user_id || '"}') + 1 as length from events) group by event_type""")
def row_index_build(t: Tables):
    path = records.scratch(t.spark)
    records.write_jsonl(t.events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("stage"), F.lit("train").alias("split"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("feature_key")), path)
    index = row_index.build(t.spark, f"{path}/*.json", "train")
    return index.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_key").alias("n_features"), F.sum("length").cast("long").alias("bytes"))


#: Half precision holds whole numbers up to 2,048 and no text has 2,048**3 letters, so a count is stored as three digits, lowest first.
BASE, DIGITS = 2048, 3


def _counts(texts):
    return [[n // BASE**k % BASE for n in (len(x), x.count("e"), x.count(" ")) for k in range(DIGITS)] for x in texts]


@query("""with r as (select sha256(text) as h, text, doc_id % 4 = 0 as base from documents), d as (select h, min(text) as text, bool_or(base) as base from r group by h)
    select h, case when base then 0 else 1 end as block, length(text) as n, length(text) - length(replace(text, 'e', '')) as n_e, length(text) - length(replace(text, ' ', '')) as n_space from d""")
def feature_extraction(t: Tables):
    """A base block, then the features of all other texts, each text once. Null texts are one text, with no features; its key is empty."""
    store = features.create(t.spark, records.scratch(t.spark), 3 * DIGITS)
    texts = t.documents.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    features.extract(store, texts.filter("doc_id % 4 = 0"), "h", "text", _counts)
    features.extract(store, texts, "h", "text", _counts)
    part = lambda i: F.when(F.col("key") != "", sum(F.col("feature")[DIGITS * i + k].cast("long") * BASE**k for k in range(DIGITS)))
    return store.read().select(F.nullif("key", F.lit("")).alias("h"), "block", part(0).alias("n"), part(1).alias("n_e"), part(2).alias("n_space"))


@query("""select vec_id, cast(case when vec_id % 3 = 0 then 0 when vec_id % 3 = 1 then 1 else 2 end as int) as block, round(cast(embedding[1] as double), 5) as first from embeddings""")
def cache_extension(t: Tables):
    """Three stores with a third of the vectors each; the first is extended by the others, in order."""
    width = t.embeddings.select(F.size("embedding")).first()[0]
    stores = [features.create(t.spark, records.scratch(t.spark), width) for _ in range(3)]
    for k, store in enumerate(stores):
        store.append(t.embeddings.filter(F.col("vec_id") % 3 == k).select(F.col("vec_id").cast("string").alias("key"), "embedding"))
    stores[0].extend(stores[1:])
    return stores[0].read().select(F.col("key").cast("long").alias("vec_id"), "block", F.round(F.col("feature")[0].cast("double"), 5).alias("first"))


@query(r"""select doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\x00'::blob || encode(text)) as blob_id, doc_id % 50 <> 0 as agrees from documents""")
def git_blob_scan(t: Tables):
    """Texts as files of a tree that lists a wrong identifier for every fiftieth."""
    found = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    own = evidence.git_blobs(found, found.select("path", F.lit("").alias("blob_id")))
    listed = own.select("path", F.when(F.col("path").cast("long") % 50 == 0, "0").otherwise(F.col("blob_id")).alias("blob_id"))
    return evidence.git_blobs(found, listed).select(F.col("path").cast("long").alias("doc_id"), "blob_id", "agrees")


@query("""select doc_id, sha256(text) as sha256, doc_id % 3 = 0 and doc_id % 5 <> 0 as reused from documents""")
def verified_digests(t: Tables):
    """Texts as files. Receipts exist for a third; those of every fifth file were taken too soon after it changed."""
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    found = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("bytes"), when.alias("modified"), F.encode("text", "utf-8").alias("content"), "doc_id")
    taken = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(60))
    receipts = found.filter("doc_id % 3 = 0").select("path", "bytes", "modified", F.sha2("content", 256).alias("sha256"), taken.alias("taken"))
    return evidence.reuse_digests(found.drop("doc_id"), receipts).select(F.col("path").cast("long").alias("doc_id"), "sha256", "reused")


@query("""select doc_id, case when doc_id % 40 = 1 then 'missing' when doc_id % 40 = 2 then 'changed' end as why from documents where doc_id % 40 in (1, 2)""")
def bound_inputs(t: Tables):
    """Listings of files before and after a job: some are gone, some have another size."""
    listing = t.documents.select(F.col("doc_id").cast("string").alias("path"), "n_chars", F.lit("2024-01-01").cast("timestamp").alias("modified"), "doc_id")
    before = listing.select("path", F.col("n_chars").alias("bytes"), "modified")
    after = listing.filter("doc_id % 40 <> 1").select("path", (F.col("n_chars") + F.when(F.col("doc_id") % 40 == 2, 1).otherwise(0)).alias("bytes"), "modified")
    return evidence.changed(before, after).select(F.col("path").cast("long").alias("doc_id"), "why")


@query("select lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by lang")
def atomic_json_roundtrip(t: Tables):
    """A summary published as one JSON document, twice under one name, and read back."""
    path = f"{records.scratch(t.spark)}/summary.json"
    rows = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).collect()  # one row a language
    evidence.atomic_json(t.spark, path, {"status": "building"})
    evidence.atomic_json(t.spark, path, {"status": "complete", "langs": [r.asDict() for r in rows]})
    found = evidence.read_json(t.spark, path)
    return t.spark.createDataFrame([(x["lang"], x["n"], x["chars"]) for x in found["langs"] if found["status"] == "complete"], "lang string, n long, chars long")


@query("""select sha256(string_agg(line, '' order by k)) as sha256, cast(sum(length(line)) as bigint) as bytes, 1 as n_outputs, 'complete' as status
    from (select regionkey as k, '{"r_regionkey":' || regionkey || ',"r_name":"' || name || '"}' || chr(10) as line from (select r_regionkey as regionkey, r_name as name from region))""")
def manifest_lineage(t: Tables):
    """A written file's manifest: its digest and size are those of its lines."""
    path = records.scratch(t.spark)
    records.write_jsonl(t.region.coalesce(1).sortWithinPartitions("r_regionkey"), path)
    outputs = evidence.digests(evidence.files(t.spark, f"{path}/*.json"))
    made = evidence.manifest("regions", {"order": "r_regionkey"}, outputs.limit(0), outputs, {"rows": t.region.count()})
    evidence.atomic_json(t.spark, f"{path}/manifest.json", made)
    back = evidence.read_json(t.spark, f"{path}/manifest.json")
    (one,) = back["outputs"].values()
    return t.spark.createDataFrame([(one["sha256"], one["bytes"], len(back["outputs"]), back["status"])], "sha256 string, bytes long, n_outputs int, status string")


@query("select doc_id, lang from (select doc_id, lang, row_number() over (order by sha256('21/' || doc_id)) as k from documents where lang in ('de', 'fr')) where k <= 25")
def validation_sample(t: Tables):
    """25 documents of two stages, by the hash of seed and id."""
    return t.documents.filter(F.col("lang").isin("de", "fr")).select("doc_id", "lang").orderBy(K.hash_order("21", F.col("doc_id"))).limit(25)


@query("select doc_id, row_number() over (order by lang, source, doc_id) - 1 as place from documents")
def canonical_order(t: Tables):
    """Every row's place in the order of output, without a task that sorts them all."""
    return number(t.documents.select("doc_id", "lang", "source"), ["lang", "source", "doc_id"], "place").select("doc_id", "place")


def _digest(frame):
    return frame.assign(digest=[hashlib.sha256(x.encode()).hexdigest() for x in frame["text"]])[["place", "doc_id", "digest"]]


@query("select row_number() over (order by doc_id) - 1 as place, doc_id, sha256(text) as digest from documents")
def ordered_parallel_map(t: Tables):
    """A Python function over batches in parallel, results in the input's order."""
    return L.ordered_map(number(t.documents.select("doc_id", "text"), ["doc_id"], "place"), "place", _digest, "place long, doc_id long, digest string")


@query("""select lang, count(*) as n, avg(case when quality = 1 then 1.0 else 0.0 end) as contract_rate, avg(case when toxic = 1 then 1.0 else 0.0 end) as flagged_rate, avg(case when loss < 0.10 then 1.0 when loss is not null then 0.0 end) as small_loss,
    count(loss) as n_scored from (select d.lang, l.quality, l.toxic, case when d.n_chars > 300 then (d.doc_id % 37) / 100.0 end as loss from documents d join labels l on l.doc_id = d.doc_id) group by lang""")
def explanation_metrics(t: Tables):
    """Rates of contracts met and of losses under a tenth, over scored rows alone, with how many there are."""
    rows = t.documents.join(t.labels, "doc_id").withColumn("loss", F.when(F.col("n_chars") > 300, (F.col("doc_id") % 37) / 100.0))
    rate = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rate(F.col("quality") == 1).alias("contract_rate"), rate(F.col("toxic") == 1).alias("flagged_rate"), rate(F.col("loss") < 0.10).alias("small_loss"), F.count("loss").alias("n_scored"))


@query("""select event_id, case when event_id % 6 = 0 then 'json' when event_id % 6 = 1 then 'fields' when abs(floor(value) - 50) > 45 then 'value' when event_id % 6 = 3 then 'line' else '' end as errors from events""")
def numeric_answer_grade(t: Tables):
    """JSON answers graded by schema, value and line: broken JSON, a missing field, a value out of reach, a line that begins elsewhere."""
    value = F.floor("value").cast("int")
    good = F.to_json(F.struct(value.alias("value"), F.array(F.when(F.col("event_id") % 6 == 3, "x").otherwise(F.col("event_type")), F.lit("y")).alias("line")))
    answer = F.when(F.col("event_id") % 6 == 0, F.lit("{oops")).when(F.col("event_id") % 6 == 1, F.to_json(F.struct(value.alias("value")))).otherwise(good)
    rows = t.events.select("event_id", answer.alias("answer"), F.lit(50).alias("expected"), F.array("event_type").alias("allowed"))
    graded = records.grade_numeric(rows, "answer", "expected", "allowed", within=45)
    return graded.select("event_id", F.array_join("errors", ",").alias("errors"))
