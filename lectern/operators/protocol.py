"""The exported protocol of conversations: nested records without what is null or empty, each thing once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cleaned(c: Column, kind: T.DataType) -> Column:
    """A value without nulls, empty lists and empty records, at every depth of its type; null if nothing is left.

    Entries of lists stay in their places, an empty text is a value. to_json then leaves
    out the fields that are null.
    """
    if isinstance(kind, T.StructType):
        parts = {f.name: cleaned(c.getField(f.name), f.dataType) for f in kind.fields}
        some = F.lit(False)
        for p in parts.values():
            some = some | p.isNotNull()
        return F.when(c.isNotNull() & some, F.struct(*[p.alias(n) for n, p in parts.items()]))
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(c) > 0, F.transform(c, lambda x: entry(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        made = F.map_filter(F.transform_values(c, lambda _, v: cleaned(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(made) > 0, made)
    return c


def entry(c: Column, kind: T.DataType) -> Column:
    """An entry of a list: cleaned inside, but it stays even if nothing is left of it."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[cleaned(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: entry(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_filter(F.transform_values(c, lambda _, v: cleaned(v, kind.valueType)), lambda _, v: v.isNotNull())
    return c


STEP = ("step", "thought", "action", "args", "observation", "chunks")
STEP_ALONE = (*STEP, "subagent_id", "subagent_role")
SUB_AGENT = ("subagent_id", "role", "role_label", "sub_query", "focus", "status", "sufficient", "searched_collections", "error", "answer")
#: What a message may carry besides, in the order in which it is written.
MORE = ("citations", "manager_plan", "compliance", "synthesizer", "searched_collections", "system_prompt", "request_id", "sufficient")


def _fields(kind: T.DataType, names: tuple[str, ...]) -> list[str]:
    """Of these names those that an array's records have."""
    have = {f.name for f in kind.elementType.fields}
    return [n for n in names if n in have]


def protocol(messages: DataFrame, key: str, header: dict[str, Column] | None = None) -> DataFrame:
    """key, message_count, document: one JSON text for each conversation.

    ``messages``: key, index, role, text, and any of created_at, duration_ms, audit,
    enriched_query, agent_steps, sub_agents, error and MORE. Steps of sub-agents are kept
    where they were made, without the raw response and without their sub-agent's name; a
    message's flat steps are left out if it has sub-agents; a query that was not enriched,
    and a duration that is no assistant's, are left out; ``error`` is true or absent. A
    conversation's messages are brought together in one row.
    """
    kinds = {f.name: f.dataType for f in messages.schema}
    has = lambda c: c in kinds
    steps = lambda arr, kind, names: F.transform(arr, lambda s: F.struct(*[s[n].alias(n) for n in _fields(kind, names)]))
    subs = F.size("sub_agents") > 0 if has("sub_agents") else F.lit(False)
    parts = [F.col("index"), F.col("role")]
    if has("created_at"):
        parts.append(F.col("created_at"))
    parts.append(F.col("text"))
    if has("duration_ms"):
        parts.append(F.when(F.col("role") == "assistant", F.col("duration_ms")).alias("duration_ms"))
    if has("audit"):
        parts.append(F.col("audit"))
    if has("enriched_query"):
        parts.append(F.when((F.col("enriched_query") != "") & (F.col("enriched_query") != F.col("text")), F.col("enriched_query")).alias("enriched_query"))
    parts += [F.col(c) for c in MORE[:2] if has(c)]
    if has("sub_agents"):
        inner = kinds["sub_agents"].elementType["agent_steps"].dataType
        one = lambda s: F.struct(*[s[n].alias(n) for n in _fields(kinds["sub_agents"], SUB_AGENT)], steps(s["agent_steps"], inner, STEP).alias("agent_steps"))
        parts.append(F.when(subs, F.transform("sub_agents", one)).alias("sub_agents"))
    if has("agent_steps"):
        parts.append(F.when(~F.coalesce(subs, F.lit(False)), steps(F.col("agent_steps"), kinds["agent_steps"], STEP_ALONE)).alias("agent_steps"))
    parts += [F.col(c) for c in MORE[2:] if has(c)]
    if has("error"):
        parts.append(F.when(F.coalesce(F.col("error").cast("string"), F.lit("")).isin("", "false"), None).otherwise(True).alias("error"))
    rows = messages.select(key, F.struct(*parts).alias("m"))
    kind = rows.schema["m"].dataType
    rows = rows.select(key, F.col("m.index").alias("_i"), entry(F.col("m"), kind).alias("m"))
    whole = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.to_json("m").alias("j")))), lambda x: x["j"]).alias("_all"))
    # every message is JSON text by itself; the header's fields stand before them
    head = F.to_json(F.struct(*[c.alias(n) for n, c in (header or {}).items()], F.size("_all").alias("message_count")))
    body = F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"messages":['), F.array_join("_all", ","), F.lit("]}"))
    return whole.withColumn("_h", head).select(key, F.size("_all").cast("long").alias("message_count"), body.alias("document"))
