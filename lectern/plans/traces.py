"""Queries on trace events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.session import load
from lectern.streaming import agents as S
from lectern.streaming import trace as Z

#: Events of the test data: a user is a request, an event type a sub-agent.
ROWS = "e as (select user_id::varchar as request_id, event_type as subagent_id, event_id as seq, list_extract(['started', 'step', 'thinking', 'final'], (event_id % 4)::int + 1) as type, case when event_id % 4 = 1 then event_id % 7 end as step, case when event_id % 3 = 0 then 't' || event_id end as text from events)"


def events(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in ("started", "step", "thinking", "final")]), (F.col("event_id") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_type").alias("subagent_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.when(F.col("event_id") % 4 == 1, F.col("event_id") % 7).alias("step"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("text"))


@query("trc_fold_subagents", f"with {ROWS} select request_id, subagent_id, arg_max(type, seq) as status, max(seq) as last_seq, count(distinct step) as steps, arg_max(text, seq) filter (text is not null) as last_text from e group by 1, 2")
def trc_fold_subagents(spark, sf_dir):
    return Z.folded(events(spark, sf_dir))


@query("trc_parse_ndjson", f"with {ROWS} select request_id, subagent_id, seq, type, step, text from e where seq % 10 <> 9")
def trc_parse_ndjson(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.when(F.col("seq") % 10 == 9, F.lit('{"request_id": "abgebrochen')).otherwise(F.to_json(F.struct(*e.columns)))
    return Z.parsed(e.select(line.alias("value"))).select("request_id", "subagent_id", "seq", "type", "step", "text")


@query("trc_tag_filter", f"with {ROWS} select request_id, 'sub_' || subagent_id as subagent_id, seq, type from e where type not in ('started', 'final')")
def trc_tag_filter(spark, sf_dir):
    return Z.tagged(events(spark, sf_dir), F.concat(F.lit("sub_"), "subagent_id")).select("request_id", "subagent_id", "seq", "type")


@query("trc_last_final", f"with {ROWS} select request_id, max(seq) as seq, arg_max(subagent_id, seq) as subagent_id from e where type = 'final' group by 1")
def trc_last_final(spark, sf_dir):
    return events(spark, sf_dir).where("type = 'final'").groupBy("request_id").agg(F.max("seq").alias("seq"), F.max_by("subagent_id", "seq").alias("subagent_id"))


@query("trc_durations", "select user_id, min(ts) as started, max(ts) as finished, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as duration_ms, count(*) as events from events group by 1")
def trc_durations(spark, sf_dir):
    return Z.durations(load(spark, sf_dir, "events"), "user_id", "ts")


#: Events as those of sub-agents: a user's are a request, whose kinds follow from the event's id, with two specialists.
AGENT_ROWS = """a as (select user_id::varchar as request_id, event_id as seq, list_extract(['subagent_started', 'subagent_step', 'subagent_step', 'subagent_step', 'subagent_done', 'final'], (event_id * 7 % 6)::int + 1) as type,
    case when event_id % 2 = 0 then 'sub-1-facts' else 'sub-2-context' end as subagent_id, case when event_id % 2 = 0 then 'facts' else 'context' end as subagent_role, event_type || event_id as sub_query, event_id % 4 as step,
    case when event_id % 3 = 0 then 'action' else 'step' end as inner_type, upper(event_type) as action, 'o' || event_id as observation, 'a' || event_id as answer_preview, event_id % 5 > 1 as sufficient, case when event_id % 11 = 0 then 'e' || event_id end as error from events)"""


def agent_events(spark, sf_dir):
    i = F.col("event_id")
    kinds = F.array(*[F.lit(t) for t in ("subagent_started", "subagent_step", "subagent_step", "subagent_step", "subagent_done", "final")])
    facts = i % 2 == 0
    none = {c.split(" ")[0]: c.split(" ", 1)[1] for c in ("role_label string", "focus string", "thought string", "args string", "subtasks array<struct<role:string,sub_query:string,focus:string>>")}
    return load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), i.alias("seq"), F.element_at(kinds, (i * 7 % 6 + 1).cast("int")).alias("type"),
        F.when(facts, "sub-1-facts").otherwise("sub-2-context").alias("subagent_id"), F.when(facts, "facts").otherwise("context").alias("subagent_role"), F.concat("event_type", i.cast("string")).alias("sub_query"), (i % 4).alias("step"),
        F.when(i % 3 == 0, "action").otherwise("step").alias("inner_type"), F.upper("event_type").alias("action"), F.concat(F.lit("o"), i.cast("string")).alias("observation"), F.concat(F.lit("a"), i.cast("string")).alias("answer_preview"), (i % 5 > 1).alias("sufficient"),
        F.when(i % 11 == 0, F.concat(F.lit("e"), i.cast("string"))).alias("error"), *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()],
    )


@query(
    "trc_subagent_steps",
    f"""with {AGENT_ROWS}, k as (select request_id, subagent_id, min(seq) as known, arg_max(case type when 'subagent_started' then 'running' else case when error is null then 'done' else 'error' end end, seq) as status from a where type in ('subagent_started', 'subagent_done') group by 1, 2),
    p as (select request_id, subagent_id, arg_max(sub_query, seq) as sub_query from a where type = 'subagent_started' group by 1, 2), n as (select request_id, subagent_id, arg_max(answer_preview, seq) as answer, arg_max(sufficient, seq) as sufficient, arg_max({{'e': error}}, seq)['e'] as error from a where type = 'subagent_done' group by 1, 2),
    s as (select a.* from a join k using (request_id, subagent_id) where type = 'subagent_step' and seq > known),
    f as (select request_id, subagent_id, step, min(seq) as first, arg_max(action, seq) filter (inner_type = 'step') as full_action, arg_max(observation, seq) filter (inner_type = 'step') as full_seen, arg_min(action, seq) as begun from s group by 1, 2, 3),
    r as (select request_id, subagent_id, first as seq, step, coalesce(full_action, begun) as action, coalesce(full_seen, '') as observation from f union all select request_id, subagent_id, s.seq, step, s.action, '' from s join f using (request_id, subagent_id, step) where s.inner_type = 'action' and s.seq > f.first),
    l as (select request_id, subagent_id, count(*) as n_steps, string_agg(step || ':' || action || ':' || observation, ',' order by seq) as steps from r group by 1, 2)
    select request_id, subagent_id, coalesce(sub_query, '') as sub_query, coalesce(answer, '') as answer, sufficient, error, status, coalesce(n_steps, 0)::int as n_steps, coalesce(steps, '') as steps from k left join p using (request_id, subagent_id) left join n using (request_id, subagent_id) left join l using (request_id, subagent_id)""",
)
def trc_subagent_steps(spark, sf_dir):
    """Traces of sub-agents with the records of their steps."""
    made = S.folded(agent_events(spark, sf_dir))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["step"].cast("string"), s["action"], s["observation"])), ",")
    return made.select("request_id", "subagent_id", "sub_query", "answer", "sufficient", "error", "status", F.size("steps").alias("n_steps"), steps.alias("steps"))
