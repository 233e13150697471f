"""Validators, grading, rendering, sets and stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relations as R
from ..sources import features, records
from ..sources.records import scratch
from .registry import Tables, query, shared

shared("structural_validation", lambda D: """
    select conv_id, min(turn) in (0, 1) as starts, count(distinct turn) = count(*) and max(turn) - min(turn) + 1 = count(*) as gapless, count(case when role not in ('system', 'user', 'assistant') then 1 end) = 0 as roles_known from conversations group by conv_id""")  # fmt: skip


@query("""select doc_id, array_to_string(list_filter([case when n_chars < 100 then 'short' end, case when text like '%###%' then 'junk' end, case when regexp_matches(text, '[0-9]{12}') then 'digits' end, case when n_chars <> length(text) then 'length' end], lambda x: x is not null), ',') as errors from documents""")
def error_code_array(t: Tables):
    code = lambda c, name: F.when(c, F.lit(name))
    found = F.array_compact(F.array(code(F.col("n_chars") < 100, "short"), code(F.col("text").contains("###"), "junk"), code(F.col("text").rlike("[0-9]{12}"), "digits"), code(F.col("n_chars") != F.length("text"), "length")))
    return t.documents.select("doc_id", F.array_join(found, ",").alias("errors"))


@query("""with m as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) as w from conversations), p as (select conv_id, turn, w, lag(w) over (partition by conv_id order by turn) as before from m)
    select conv_id, turn, len(list_filter(w, lambda x: not list_contains(coalesce(before, []), x))) as n_new from p""")
def mentions_subset(t: Tables):
    words = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    before = F.coalesce(F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    return words.withColumn("_b", before).select("conv_id", "turn", F.size(F.array_except("w", "_b")).cast("long").alias("n_new"))


shared("qualify_rows", lambda D: """
    select l_orderkey, max(l_discount) < 0.10 and max(case when l_linenumber = 1 then l_discount end) < 0.05 as qualified, count(case when l_discount >= 0.10 then 1 end) as n_over from lineitem group by l_orderkey""")  # fmt: skip
shared("grade_answers", lambda D: """
    select d.doc_id, d.lang, case when l.quality is null then 'unparsed' when l.quality = 1 and d.text not like '%###%' then 'correct' when l.quality = 1 then 'format' else 'wrong' end as grade from documents d left join labels l on d.doc_id = l.doc_id""")  # fmt: skip
shared("footprint_explode", lambda D: f"""
    select distinct doc_id, w from (select doc_id, {D.split("replace(text, chr(10), chr(32))", ' ')} as ws from documents) x, {D.unnest('ws')} as u(w) where w <> ''""")  # fmt: skip
shared("length_budget", lambda D: f"""
    select doc_id, {D.size(D.split('text', ' '))} as tokens, {D.size(D.split('text', ' '))} <= 512 as fits from documents""")  # fmt: skip
shared("render_templates", lambda D: f"""
    select doc_id, case doc_id % 3 when 0 then concat('Which language is document ', {D.text('doc_id')}, '?') when 1 then concat('Name the language of no. ', {D.text('doc_id')}) else concat({D.text('doc_id')}, ': language?') end as question, concat('Answer: ', lang) as answer from documents""")  # fmt: skip
shared("blinded_packet", lambda D: f"""
    select doc_id, {D.sha("concat(text, '|', lang)")} as packet_id, text as excerpt, lang from documents""")  # fmt: skip
shared("assemble_labels", lambda D: """
    select d.doc_id, d.lang as stage, d.source as task_type, l.quality as answer, case when l.toxic = 1 then 'review' else 'train' end as route from documents d join labels l on d.doc_id = l.doc_id""")  # fmt: skip
shared("hidden_fields", lambda D: "select doc_id, lang, n_chars from documents")

# Sets and stores
shared("union_disjoint", lambda D: """
    select id, count(*) as n, count(distinct part) as n_parts from (select doc_id as id, 'a' as part from documents where doc_id % 2 = 0 union all select doc_id as id, 'b' as part from documents where doc_id % 2 = 1 or doc_id % 100 = 0) x group by id having count(*) > 1""")  # fmt: skip
shared("qualified_merge", lambda D: f"""
    with u as (select doc_id, {D.sha('text')} as h, 1 as k from documents where lang = 'en' union all select doc_id, {D.sha('text')} as h, 2 as k from documents where lang <> 'en'),
    f as (select doc_id, h, k, row_number() over (partition by h order by k, doc_id) as n from u) select doc_id, k, count(*) over () >= 32 as enough from f where n = 1""")  # fmt: skip
shared("corpus_union", lambda D: f"""
    with u as (select concat('d', {D.text('doc_id')}) as id, text, 'documents' as origin from documents union all select concat('c', {D.text('conv_id')}, '-', {D.text('turn')}) as id, text, 'conversations' as origin from conversations),
    k as (select id, origin, row_number() over (partition by {D.sha('text')} order by origin desc, id) as n from u) select id, origin from k where n = 1""")  # fmt: skip
shared("set_equality", lambda D: """
    with a as (select doc_id from labels except select doc_id from documents), b as (select doc_id from documents except select doc_id from labels)
    select (select count(*) from a) as n_missing, (select count(*) from b) as n_extra, (select count(*) from a) + (select count(*) from b) = 0 as equal""")  # fmt: skip


@query("""with a as (select conv_id, list(distinct role) as r from conversations group by conv_id) select conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda x: not list_contains(r, x))), ',') as missing from a""")
def set_diff_arrays(t: Tables):
    g = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return g.select("conv_id", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, ("assistant", "system", "user"))), "r")), ",").alias("missing"))


shared("set_intersection", lambda D: f"select {D.sha('text')} as h from documents where lang = 'en' intersect select {D.sha('text')} as h from documents where source in ('src1', 'src2', 'src3')")
shared("augment_union", lambda D: """
    select p_partkey as id, cast(null as bigint) as parent, p_name as name from part union all select p_partkey + 1000000 as id, p_partkey as parent, reverse(p_name) as name from part where p_name <> reverse(p_name)""")  # fmt: skip
shared("view_fanout", lambda D: """
    select event_id, 'numeric' as kind, value as score from events where value is not null union all select event_id, 'move' as kind, cast(null as double) as score from events where event_type <> 'view'""")  # fmt: skip
@query("""with r as (select c.conv_id, string_agg(c.role, ' ' order by c.turn) as prefix from conversations c join conversations p on p.conv_id = c.conv_id and c.turn <= p.turn group by c.conv_id, p.turn)
    select prefix, min(conv_id) as conv_id, count(*) as n from r group by prefix""")
def prefix_expand(t: Tables):
    """Each prefix of each conversation's roles, once, with its first owner."""
    roles = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return R.prefixes(roles, "roles").groupBy(F.array_join("prefix", " ").alias("prefix")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
shared("readback_diff", lambda D: """
    with w as (select doc_id, case when doc_id % 97 = 0 then 'xx' else lang end as lang from documents) select doc_id, lang, 'added' as side from (select doc_id, lang from w except select doc_id, lang from documents) x union all select doc_id, lang, 'lost' as side from (select doc_id, lang from documents except select doc_id, lang from w) y""")  # fmt: skip
shared("table_diff", lambda D: """
    with b as (select doc_id, case when doc_id % 89 = 0 then n_chars + 1 else n_chars end as n_chars from documents where doc_id % 113 <> 5)
    select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'missing' when a.doc_id is null then 'extra' else 'changed' end as kind from documents a full join b on a.doc_id = b.doc_id where a.n_chars is distinct from b.n_chars""")  # fmt: skip
shared("catalog_build", lambda D: """
    select p.p_brand, count(distinct p.p_partkey) as roots, count(*) as targets, count(distinct l.l_orderkey) as owners from part p join lineitem l on l.l_partkey = p.p_partkey group by p.p_brand""")  # fmt: skip


@query("""select vec_id, block, ordinal, width from (select vec_id, 0 as block, row_number() over (order by vec_id) - 1 as ordinal, len(embedding) as width from embeddings where vec_id % 2 = 0
    union all select vec_id, 1, row_number() over (order by vec_id) - 1, len(embedding) from embeddings where vec_id % 3 = 0 and vec_id % 2 = 1)""")
def feature_append_disjoint(t: Tables):
    """A store of the even vectors, then those divisible by three appended: what the store has is not written again."""
    store = features.create(t.spark, scratch(t.spark), width=t.embeddings.select(F.size("embedding")).first()[0])
    named = t.embeddings.select(F.col("vec_id").cast("string").alias("key"), "embedding")
    store.append(named.filter("key % 2 = 0"))
    store.append(named.filter("key % 3 = 0"), known="skip")
    rows = store.read().withColumn("vec_id", F.col("key").cast("long"))
    order = F.row_number().over(Window.partitionBy("block").orderBy("vec_id")) - 1
    return rows.select("vec_id", F.col("block"), order.cast("long").alias("ordinal"), F.size("feature").cast("long").alias("width"))


@query("""with n as (select count(*) as n from embeddings) select d.doc_id, p.pos, e.vec_id, e.label from documents d cross join n cross join (select unnest([0, 1, 2, 3]) as pos) p join embeddings e on e.vec_id = case when p.pos = 3 then d.doc_id * 7 % n.n else (d.doc_id * 7 + p.pos * 3) % n.n end""")
def feature_gather(t: Tables):
    """Four keys of each document, the last one a repeat of the first, looked up in order in the whole store."""
    store = features.create(t.spark, scratch(t.spark), width=t.embeddings.select(F.size("embedding")).first()[0])
    store.append(t.embeddings.select(F.col("vec_id").cast("string").alias("key"), "embedding"))
    n = t.embeddings.count()
    keys = t.documents.select("doc_id", F.array(*[((F.col("doc_id") * 7 + 3 * i) % n).cast("string") for i in (0, 1, 2, 0)]).alias("keys"))
    found = store.gather(keys, ["doc_id"], "keys")
    return found.select("doc_id", "pos", F.col("key").cast("long").alias("vec_id")).join(t.embeddings.select("vec_id", "label"), "vec_id")


@query("""select doc_id, k, text from (select doc_id, 1 as k, text from documents union all select doc_id, 2, lang from documents)""")
def archive_import(t: Tables):
    """The whole text and the language of every document as members of a ZIP archive a document, read back in order."""
    import io
    import zipfile

    rows = t.documents.select("doc_id", "text", "lang")

    def pack(frames):
        import pandas as pd

        for f in frames:
            out = []
            for d, a, b in f.itertuples(index=False):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(f"{d}-1.txt", a), z.writestr(f"{d}-2.txt", b), z.writestr("skip.bin", "x")
                out.append(data.getvalue())
            yield pd.DataFrame({"content": out})

    packed = rows.mapInPandas(pack, "content binary").withColumn("path", F.lit("memory"))
    member = F.split(F.regexp_replace("member", "[.]txt$", ""), "-")
    return records.unzip(packed).select(member[0].cast("long").alias("doc_id"), member[1].cast("int").alias("k"), F.decode("content", "utf-8").alias("text"))


@query("select page_id, 3 as n_games, 'a b c' as moves, url as site from pages")
def game_text_import(t: Tables):
    game = F.concat(F.lit('[Game "1"]\n[Site "'), "url", F.lit('"]\n\n1. a {no [Game here} (2. x (y) z) b ; [Game c\n2. c 1-0\n\n'))
    second = F.lit('[Game "2"]\n[Game "3"]\n\n1. q *\n')
    texts = t.pages.select("page_id", F.concat(game, second).alias("text"))
    found = records.parse_games(texts, "text", ["page_id"])
    return found.groupBy("page_id").agg((F.max("ordinal") + 1).alias("n_games"), F.max(F.when(F.col("ordinal") == 0, F.array_join("moves", " "))).alias("moves"), F.max(F.when(F.col("ordinal") == 0, F.col("headers")["Site"])).alias("site"))
