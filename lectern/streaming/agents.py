"""Traces of sub-agents with their steps: patches of fields and step records, in batch and as a stream whose state expires.

An event sets the fields of its type and leaves the others: a plan seeds its sub-agents, a
start names one, its end brings the answer. A step's first event makes its record, an
``action`` behind another one makes one more, and a ``step`` replaces the first record of
its number. Steps before their sub-agent is known, or before a plan that seeds it anew, are
not shown. Events are told apart by ``seq``, in which they apply, whatever order they come
in; a repeated one changes nothing.

Rows: a step without a number is a record of its own and is shown without one; events
without a request, a sub-agent or a seq are left out; an empty table gives no rows; of
events with the same seq the greater type holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.agents import DEFAULT_ROLE, ROLE_LABELS
from lectern.operators.manager import Managed

EVENT = (
    "request_id string, ts timestamp, seq long, type string, subagent_id string, subagent_role string, role_label string, sub_query string, focus string, inner_type string, "
    "step long, action string, thought string, args string, observation string, answer_preview string, sufficient boolean, error string, subtasks array<struct<role:string,sub_query:string,focus:string>>"
)
RECORD = "struct<step:long,action:string,thought:string,args:string,observation:string>"
TRACE = f"request_id string, subagent_id string, role string, role_label string, sub_query string, focus string, answer string, sufficient boolean, error string, status string, steps array<{RECORD}>"
FIELDS = ("role", "role_label", "sub_query", "focus", "answer", "sufficient", "error", "status")
#: The fields that an event of a type sets.
SETS = {"seeded": FIELDS, "subagent_started": ("role", "role_label", "sub_query", "focus", "status"), "subagent_done": ("answer", "sufficient", "error", "status")}
UNKNOWN_LABEL = "Spezialist"


def label_of(role: Column, otherwise: Column) -> Column:
    out = otherwise
    for name, label in ROLE_LABELS.items():
        out = F.when(role == name, label).otherwise(out)
    return out


def patches(events: DataFrame) -> DataFrame:
    """request_id, ts, seq, subagent_id, type, the fields and the step's columns: a plan is one event for each sub-agent that it seeds."""
    known = events.where(F.col("request_id").isNotNull() & F.col("seq").isNotNull())
    plan = known.where("type = 'manager_plan'").select("request_id", "ts", "seq", F.posexplode("subtasks").alias("_n", "_t"))
    none = lambda kind: F.lit(None).cast(kind)
    seeded = plan.select(
        "request_id", "ts", "seq", F.concat(F.lit("sub-"), (F.col("_n") + 1).cast("string"), F.lit("-"), "_t.role").alias("subagent_id"), F.lit("seeded").alias("type"),
        F.col("_t.role").alias("role"), label_of(F.col("_t.role"), F.col("_t.role")).alias("role_label"), F.col("_t.sub_query").alias("sub_query"), F.col("_t.focus").alias("focus"),
        F.lit("").alias("answer"), none("boolean").alias("sufficient"), none("string").alias("error"), F.lit("pending").alias("status"), none("string").alias("inner"), none(RECORD).alias("record"),
    )
    done = F.col("type") == "subagent_done"
    status = F.when(done & (F.coalesce("error", F.lit("")) != ""), "error").when(done, "done").when(F.col("type") == "subagent_started", "running")
    label = F.coalesce("role_label", label_of(F.col("subagent_role"), F.lit(UNKNOWN_LABEL)))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    of_step = F.col("inner_type").isin("action", "step")
    record = F.struct("step", text("action"), text("thought"), F.coalesce("args", F.lit("{}")).alias("args"), F.when(F.col("inner_type") == "step", F.coalesce("observation", F.lit(""))).otherwise("").alias("observation"))
    others = known.where(F.col("subagent_id").isNotNull() & (F.col("type").isin("subagent_started", "subagent_done") | ((F.col("type") == "subagent_step") & of_step)))
    rest = others.select(
        "request_id", "ts", "seq", "subagent_id", "type", F.col("subagent_role").alias("role"), label.alias("role_label"), "sub_query", "focus", F.coalesce("answer_preview", F.lit("")).alias("answer"),
        "sufficient", "error", status.alias("status"), F.when(F.col("type") == "subagent_step", F.col("inner_type")).alias("inner"), F.when(F.col("type") == "subagent_step", record).alias("record"),
    )
    return seeded.unionByName(rest)


def _finished(rows: DataFrame) -> DataFrame:
    """Fields that no event set get what a new sub-agent has."""
    role = F.coalesce("role", F.lit(DEFAULT_ROLE))
    return rows.select(
        "request_id", "subagent_id", role.alias("role"), F.coalesce("role_label", label_of(role, F.lit(UNKNOWN_LABEL))).alias("role_label"), F.coalesce("sub_query", F.lit("")).alias("sub_query"), "focus",
        F.coalesce("answer", F.lit("")).alias("answer"), "sufficient", "error", F.coalesce("status", F.lit("running")).alias("status"), F.coalesce("steps", F.expr(f"cast(array() as array<{RECORD}>)")).alias("steps"),
    )


def folded(events: DataFrame) -> DataFrame:
    """The sub-agents of all requests (``TRACE``) from their events (``EVENT``), by aggregations alone.

    Field by field the last event that sets it holds. Steps are reduced to records by their
    number before a sub-agent's records are brought together.
    """
    p = patches(events)
    key = ["request_id", "subagent_id"]
    at = F.struct("seq", "type")
    fields = []
    for f in FIELDS:
        sets = F.col("type").isin(*[t for t, names in SETS.items() if f in names])
        fields.append(F.max_by(F.struct(f), F.when(sets, at))[f].alias(f))
    upserts = F.col("type") != "subagent_step"
    merged = p.groupBy(*key).agg(*fields, F.min(F.when(upserts, F.col("seq"))).alias("_known"), F.max(F.when(F.col("type") == "seeded", F.col("seq"))).alias("_seeded"), F.bool_or(upserts).alias("_any")).where("_any")
    own = F.coalesce(F.greatest("_known", "_seeded"), F.lit(-1))
    steps = p.where("type = 'subagent_step'").select(*key, "seq", "inner", "record").join(merged.select(*key, own.alias("_from")), key).where("seq > _from")
    steps = steps.dropDuplicates([*key, "seq"])
    # a step without a number is told from others by its place
    steps = steps.withColumns({"_step": F.col("record.step"), "_own": F.when(F.col("record.step").isNull(), F.col("seq"))})
    action = F.col("inner") == "action"
    first = steps.groupBy(*key, "_step", "_own").agg(F.min("seq").alias("_first"), F.max_by("record", F.when(~action, F.col("seq"))).alias("_full"), F.min_by("record", "seq").alias("_begun"), F.array_sort(F.collect_list(F.when(action, F.struct("seq", "record")))).alias("_actions"))
    more = F.filter("_actions", lambda a: a["seq"] > F.col("_first"))
    records = first.select(*key, F.inline(F.concat(F.array(F.struct(F.col("_first").alias("seq"), F.coalesce("_full", "_begun").alias("record"))), more)))
    lists = records.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "record"))), lambda x: x["record"]).alias("steps"))
    return _finished(merged.drop("_known", "_seeded", "_any").join(lists, key, "left"))


def events_of(made: Managed, started: Column | None = None) -> DataFrame:
    """The events (``EVENT``) that a run of the manager sends: a request for each question, seq counting from 1.

    In the order of a request: its plan, each specialist's start, for each of its steps the
    action and then the whole step, its end, and last ``final``. Specialists follow one
    another; rows of a request are numbered by a window over its own events.
    """
    at = started if started is not None else F.current_timestamp()
    request = F.col("question_id").cast("string").alias("request_id")
    place = lambda a, b, c: F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("int") for x in (a, b, c)]).alias("_at")
    kinds = dict(x.split(" ", 1) for x in EVENT.split(", "))

    def rows(df: DataFrame, kind: str, where: Column, **given: Column) -> DataFrame:
        return df.select(request, where, F.lit(kind).alias("type"), *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items() if n not in ("request_id", "ts", "seq", "type")])

    sub, n = F.col("subagent_id"), F.col("n")
    out = rows(made.plans, "manager_plan", place(0, 0, 0), subtasks=F.col("plan.subtasks"))
    out = out.unionByName(rows(made.subagents, "subagent_started", place(1, n, 0), subagent_id=sub, subagent_role=F.col("role"), role_label=label_of(F.col("role"), F.lit(UNKNOWN_LABEL)), sub_query=F.col("sub_query"), focus=F.col("focus")))
    who = made.subagents.select("question_id", "n", "subagent_id", "role")
    steps = made.steps.join(who, ["question_id", "n"])
    same = {"subagent_id": sub, "subagent_role": F.col("role"), "step": F.col("step"), "action": F.col("action"), "thought": F.col("thought"), "args": F.col("args")}
    out = out.unionByName(rows(steps, "subagent_step", place(1, n, F.col("step") * 2 - 1), inner_type=F.lit("action"), **same))
    out = out.unionByName(rows(steps, "subagent_step", place(1, n, F.col("step") * 2), inner_type=F.lit("step"), observation=F.col("observation"), **same))
    out = out.unionByName(rows(made.subagents, "subagent_done", place(1, n, 1 << 20), subagent_id=sub, subagent_role=F.col("role"), answer_preview=F.left("answer", F.lit(200)), sufficient=F.col("sufficient"), error=F.col("error")))
    out = out.unionByName(rows(made.answers, "final", place(2, 0, 0), answer_preview=F.col("answer"), sufficient=F.col("sufficient")))
    seq = F.row_number().over(W.partitionBy("request_id").orderBy("_at")).cast("long")
    return out.select("request_id", at.alias("ts"), seq.alias("seq"), *[c for c in out.columns if c not in ("request_id", "_at")])


def ndjson(events: DataFrame) -> DataFrame:
    """value: a line of JSON for each event, without what is null."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


class SubAgents(StatefulProcessor):
    """State of one sub-agent: where each field was set last, and a record for each step.

    The record map is keyed by the event that made the record, so a replaced step replaces
    its record. Nothing is read but the rows of the events' own steps, until the trace is
    put together. The state goes when event time has passed the last event by ``idle_ms``.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "name string", "seq long, type string, text string, flag boolean")
        self.events = handle.getMapState("events", "step long, seq long", f"inner string, record {RECORD}")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self.last.get()[0] if self.last.exists() else 0
        for f in rows:
            for e in f.to_dict("records"):
                latest = max(latest, int(pd.Timestamp(e["ts"]).timestamp() * 1000))
                if e["type"] == "subagent_step":
                    r = {k: _plain(v) for k, v in e["record"].items()}
                    # a frame's numbers are floats where some are missing
                    step = None if r["step"] is None else int(r["step"])
                    self.events.updateValue((-1 if step is None else step, int(e["seq"])), (e["inner"], (step, *(r[k] for k in ("action", "thought", "args", "observation")))))
                    continue
                for name in (*SETS[e["type"]], "_known", "_seeded" if e["type"] == "seeded" else "_known"):
                    self._set(name, int(e["seq"]), e["type"], _plain(e.get(name)))
        self.last.update((latest,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(latest + self.idle_ms)
        if self.fields.containsKey(("_known",)):
            yield self._trace(key)

    def _set(self, name: str, seq: int, kind: str, value) -> None:
        old = self.fields.getValue((name,)) if self.fields.containsKey((name,)) else None
        # the first event that makes a sub-agent known, the last one of anything else
        if old is None or (seq < old[0] if name == "_known" else (seq, kind) > (old[0], old[1])):
            self.fields.updateValue((name,), (seq, kind, None if isinstance(value, bool) else value, value if isinstance(value, bool) else None))

    def _trace(self, key) -> pd.DataFrame:
        fields = {k[0]: v for k, v in self.fields.iterator()}
        start = max(fields["_known"][0], fields["_seeded"][0] if "_seeded" in fields else -1)
        by: dict[object, list] = {}
        for (step, seq), (inner, record) in self.events.iterator():
            if seq > start:
                by.setdefault(step if step >= 0 else ("own", seq), []).append((seq, inner, tuple(record)))
        records = []
        for some in by.values():
            some.sort(key=lambda x: x[0])
            full = [r for _, inner, r in some if inner == "step"]
            records.append((some[0][0], full[-1] if full else some[0][2]))
            records += [(seq, r) for seq, inner, r in some[1:] if inner == "action"]
        value = lambda f: None if f not in fields else fields[f][3] if fields[f][3] is not None else fields[f][2]
        role = value("role") or DEFAULT_ROLE
        names = ("step", "action", "thought", "args", "observation")
        row = {
            "request_id": key[0], "subagent_id": key[1], "role": role, "role_label": value("role_label") or ROLE_LABELS.get(role, UNKNOWN_LABEL), "sub_query": value("sub_query") or "", "focus": value("focus"),
            "answer": value("answer") or "", "sufficient": value("sufficient"), "error": value("error"), "status": value("status") or "running",
            "steps": [dict(zip(names, r, strict=True)) for _, r in sorted(records, key=lambda x: x[0])],
        }
        return pd.DataFrame([row])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.fields, self.events, self.last):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _plain(v):
    """A cell of a frame as a plain value: no number is None, and numpy's values are Python's."""
    if v is None or (isinstance(v, float) and v != v):
        return None
    return v.item() if hasattr(v, "item") else v


#: What RocksDB keeps of a query's state is needed for timers and maps.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded_stream(events: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The same fold over a stream, in update mode: each change gives a sub-agent's trace, whose state is dropped ``idle_ms`` after its last event.

    Two steps of different numbers are merged without reading each other; a sub-agent's
    state is bounded by its own events, and event time (with ``late`` allowed) ends it.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    p = patches(events).withWatermark("ts", late)
    return p.groupBy("request_id", "subagent_id").transformWithStateInPandas(SubAgents(idle_ms), TRACE, "Update", "EventTime")
