"""Traces of sub-agents: batch and stream against a plain fold, and state that expires."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators.agents import ROLE_LABELS
from lectern.streaming import agents as S


def fold_by_hand(events):
    """The service's own way: a list of sub-agents, patched event by event."""
    out = {}
    for e in sorted(events, key=lambda e: (e["seq"], e["type"])):
        subs = out.setdefault(e["request_id"], {})
        if e["type"] == "manager_plan":
            for i, t in enumerate(e["subtasks"], 1):
                subs[f"sub-{i}-{t['role']}"] = {"role": t["role"], "role_label": ROLE_LABELS.get(t["role"], t["role"]), "sub_query": t["sub_query"], "focus": t.get("focus"), "answer": "", "status": "pending", "steps": []}
        new = {"role": "facts", "role_label": "Fakten", "sub_query": "", "focus": None, "answer": "", "status": "running", "steps": []}
        if e["type"] == "subagent_started":
            patch = {"role": e["subagent_role"], "role_label": e.get("role_label") or ROLE_LABELS.get(e["subagent_role"], "Spezialist"), "sub_query": e.get("sub_query") or "", "focus": e.get("focus"), "status": "running"}
            subs[e["subagent_id"]] = {**subs.get(e["subagent_id"], new), **patch}
        if e["type"] == "subagent_done":
            patch = {"answer": e.get("answer_preview") or "", "sufficient": e.get("sufficient"), "error": e.get("error"), "status": "error" if e.get("error") else "done"}
            subs[e["subagent_id"]] = {**subs.get(e["subagent_id"], new), **patch}
        if e["type"] == "subagent_step" and e["subagent_id"] in subs and e["inner_type"] in ("action", "step"):
            steps = subs[e["subagent_id"]]["steps"]
            full = (e.get("step"), e.get("action") or "", e.get("thought") or "", e.get("args") or "{}", (e.get("observation") or "") if e["inner_type"] == "step" else "")
            at = next((i for i, s in enumerate(steps) if s[0] == full[0] and full[0] is not None), None)
            if e["inner_type"] == "step" and at is not None:
                steps[at] = full
            else:
                steps.append(full)
    return {(r, s): (v["role"], v["role_label"], v["sub_query"], v["focus"], v["answer"], v.get("sufficient"), v.get("error"), v["status"], v["steps"]) for r, subs in out.items() for s, v in subs.items()}


def events_of(n, seed=1, minutes=0):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1) + timedelta(minutes=minutes)
    out = []
    for i in range(n):
        r = f"r{rng.randrange(3)}-{minutes}"
        sub, role = rng.choice([("sub-1-facts", "facts"), ("sub-2-context", "context"), ("sub-9-x", "x")])
        kind = rng.choice(["subagent_started", "subagent_step", "subagent_step", "subagent_step", "subagent_step", "subagent_done", "final", "compliance"] + ["manager_plan"] * (i % 40 == 0))
        e = {"request_id": r, "ts": (start + timedelta(seconds=i)).isoformat(), "seq": i, "type": kind}
        if kind == "manager_plan":
            e["subtasks"] = [{"role": "facts", "sub_query": f"q{i}"}, {"role": "context", "sub_query": "z", "focus": f"f{i}"}]
        else:
            e["subagent_id"] = sub
        if kind == "subagent_started":
            e |= {"subagent_role": role, "sub_query": f"s{i}"} | ({"focus": "f"} if i % 2 else {}) | ({"role_label": "Eigen"} if i % 3 == 0 else {})
        if kind == "subagent_step":
            e |= {"inner_type": rng.choice(["action", "step", "step", "thinking"]), "action": f"A{i}", "thought": "t" * (i % 3)} | ({"step": rng.randrange(4)} if i % 9 else {}) | ({"observation": f"o{i}"} if i % 2 else {}) | ({"args": '{"a": 1}'} if i % 4 == 0 else {})
        if kind == "subagent_done":
            e |= {"answer_preview": f"antwort {i}", "sufficient": bool(i % 2)} | ({"error": "kaputt"} if i % 5 == 0 else {})
        out.append(e)
    return out


def rows(df_rows):
    return {(r.request_id, r.subagent_id): (r.role, r.role_label, r.sub_query, r.focus, r.answer, r.sufficient, r.error, r.status, [tuple(s) for s in r.steps]) for r in df_rows}


def parsed(lines):
    return lines.select(F.from_json("value", S.EVENT).alias("e")).select("e.*")


def test_batch_is_the_plain_fold(spark):
    events = events_of(400)
    lines = [json.dumps(e) for e in events + events[50:80]]
    random.Random(2).shuffle(lines)
    df = parsed(spark.createDataFrame([(x,) for x in lines] + [("kein json",), ("{}",)], "value string").repartition(4))
    assert rows(S.folded(df).collect()) == fold_by_hand(events)
    assert S.folded(df.where("false")).count() == 0


def test_stream_is_the_batch_and_its_state_expires(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = events_of(150)
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(json.dumps(e) for e in events[n::3]))
    out = []

    def start():
        stream = parsed(spark.readStream.option("maxFilesPerTrigger", 1).text(f"file://{source}"))
        q = S.folded_stream(stream, "5 minutes", 60_000).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    start()
    want = fold_by_hand(events)
    assert rows(out) == want
    # hours later only the new requests have state
    later = events_of(60, 3, 600)
    (source / "3.json").write_text("\n".join(json.dumps(e) for e in later))
    (source / "4.json").write_text(json.dumps(later[-1]))
    kept = start()
    assert rows(out) == want | fold_by_hand(later)
    assert kept[-1] < kept[0]


def test_a_run_is_told_and_read_back(spark, tmp_path):
    """The events of a manager's run, written as lines and folded, give its specialists and their steps."""
    from lectern.operators.manager import run_manager

    hit = "query_id string, rank int, doc_id int, collection string, file_name string, page int, text string, score double, bm25 double, rrf double, rerank_score double, label string, observation string"
    search = lambda q: q.sparkSession.createDataFrame([(r.query_id, 1, 1, "c", "f", 1, r.query, 1.0, 1.0, 1.0, 1.0, "", f"[1] (f, S. 1) {r.query}") for r in q.collect()], hit)
    plan = json.dumps({"subtasks": [{"role": "facts", "sub_query": "eins"}, {"role": "context", "sub_query": "zwei", "focus": "F"}]})
    n = lambda m: F.size(F.filter(m, lambda x: x["role"] == "assistant"))
    chat = lambda m: F.when(n(m) == 0, 'THOUGHT: t\nACTION: SEARCH({"query": "x"})').otherwise("Fertig [1].")
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, query string")
    made = run_manager(q, lambda c: F.lit(plan), chat, search, "uc")
    S.ndjson(S.events_of(made)).write.text(f"file://{tmp_path}/lines")
    events = parsed(spark.read.text(f"file://{tmp_path}/lines"))
    assert [r.type for r in events.where("request_id = '1'").orderBy("seq").collect()] == ["manager_plan", *(["subagent_started"] + ["subagent_step"] * 4 + ["subagent_done"]) * 2, "final"]
    got = rows(S.folded(events).collect())
    subs = {(str(r.question_id), r.subagent_id): r for r in made.subagents.collect()}
    assert set(got) == set(subs) == {(r, s) for r in ("1", "2") for s in ("sub-1-facts", "sub-2-context")}
    for k, v in got.items():
        assert v[:5] == (subs[k].role, ROLE_LABELS[subs[k].role], subs[k].sub_query, subs[k].focus, subs[k].answer) and v[7] == "done"
        assert [(s[0], s[1]) for s in v[8]] == [(1, "SEARCH"), (2, "FINAL_ANSWER")] and v[8][0][4].startswith("[1] (f, S. 1) x")
