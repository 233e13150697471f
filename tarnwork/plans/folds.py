"""Stateful queries, each with the closed form that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranges import number
from ..streaming import ledger as L
from .registry import Tables, query


@query("""select user_id, event_id, event_type, attempts from (select user_id, event_id, event_type, count(*) over (partition by user_id) as attempts, row_number() over (partition by user_id order by case when event_type = 'purchase' then 1 else 0 end desc, ts desc, event_id desc) as k from events) where k = 1""")
def ledger_replay(t: Tables):
    return L.replay(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_type", "purchase").select("user_id", "event_id", "event_type", "attempts")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def resume_remaining(t: Tables):
    return L.remaining(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


def _step(state: str, row) -> str:
    if state in ("completed", "forfeit"):
        return state
    if row.event_type == "purchase":
        return "completed"
    return "forfeit" if row.event_type == "error" else "playing"


@query("""select user_id, case when bool_or(event_type = 'purchase') and (not bool_or(event_type = 'error') or min(case when event_type = 'purchase' then (ts, event_id) end) < min(case when event_type = 'error' then (ts, event_id) end)) then 'completed'
    when bool_or(event_type = 'error') then 'forfeit' else 'playing' end as state from events group by user_id""")
def state_fold(t: Tables):
    events = t.events.select("user_id", "event_type", "ts", "event_id")
    return L.fold(events, "user_id", ["ts", "event_id"], _step, "planned", "state", "user_id long, state string")


WEIGHTS = {"click": 4.0, "view": 2.0, "purchase": 1.0}


@query()
def weighted_interleave(t: Tables):
    """Each user's events of three kinds in smooth weighted order; of events with one user, hour and kind only the first is taken."""
    rows = t.events.filter(F.col("event_type").isin(*WEIGHTS)).select("user_id", "event_type", "event_id", F.concat_ws("/", "event_type", F.date_format("ts", "yyyyMMddHH")).alias("hour"))
    return L.interleave(rows, ["user_id"], "event_type", ["event_id"], "event_id", ["hour"], WEIGHTS)


@query()
def adaptive_sampler(t: Tables):
    """Two documents of each source, by inverse frequency of their length classes so far, in each language."""
    rows = t.documents.select("lang", "source", "doc_id", F.floor(F.log10(F.col("n_chars") + 1)).cast("int").alias("length_class"))
    return L.adaptive_sample(rows, ["lang"], "source", "doc_id", "length_class", 2, "31")


@query()
def diverse_selection(t: Tables):
    """At most 60 documents a language, in turn over length classes, at most 4 of a source and 30 that share a first or last word."""
    words = F.array_distinct(F.array(F.substring_index("text", " ", 1), F.substring_index("text", " ", -1)))
    rows = t.documents.select("lang", "doc_id", "source", F.floor(F.log10(F.col("n_chars") + 1)).cast("int").alias("length_class"), words.alias("ends"))
    return L.diverse(rows, ["lang"], ["length_class"], "doc_id", {"source": 4, "ends": 30}, 60, "32", heavier=("length_class", 3, 2))


@query("""select event_id, user_id, round(sum(value) over (partition by user_id order by ts, event_id), 4) as running, row_number() over (order by ts, event_id) - 1 as place from events""")
def group_process_restore_order(t: Tables):
    """A running total within each user's events, which then stand in the order of time again."""
    done = L.by_group_in_order(t.events.select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], lambda s, v: s + v, 0.0, "value", "running", "double")
    return number(done.select("event_id", "user_id", "ts", "running"), ["ts", "event_id"], "place").select("event_id", "user_id", F.round("running", 4).alias("running"), "place")
