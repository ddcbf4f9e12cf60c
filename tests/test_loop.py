"""The loop of actions and the manager against a plain loop, with a scripted model and a search by dictionary."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern.operators import agents as A
from lectern.operators.loop import run_loop, sources_text
from lectern.operators.manager import concatenated, fan_out, run_manager, subtasks
from lectern.providers import attempted

# workers do not find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NO_INFO = re.compile(A.NO_INFO.removeprefix("(?i)"), re.I)
TEXTS = {w: [(i, f"{w} Text {i}\nzweite Zeile", i % 3) for i in range(1, 1 + len(w) % 4)] for w in ("pumpe", "ventil", "druck", "motor", "öl", "kette")}


def hits_of(query):
    """(rank, doc_id, file_name, page, text) of a made-up search: the chunks of the words that are known."""
    out = []
    for w in dict.fromkeys(re.findall(r"\w+", query.lower())):
        out += [(f"{w}.pdf", page, text) for _, text, page in TEXTS.get(w, [])]
    return [(n, n, *x) for n, x in enumerate(out[:7], 1)]


HIT = "query_id {}, rank int, doc_id int, collection string, file_name string, page int, text string, score double, bm25 double, rrf double, rerank_score double, label string, observation string"


def search(queries):
    """The same over a table; the questions are few."""
    rows = []
    for q in queries.collect():
        for n, d, f, page, text in hits_of(q["query"]):
            line = f"[{n}] ({f}{f', S. {page}' if page else ''}) {text[:300]}"
            rows.append((q.query_id, n, d, "wl_x", f, page, text, 1.0, 1.0, 1.0, 1.0, "", line))
    return queries.sparkSession.createDataFrame(rows, HIT.format(queries.schema["query_id"].dataType.simpleString()))


def respond(messages):
    """The model: what it says depends on the question and the number of its answers."""
    question = next(m["content"] for m in messages if m["role"] == "user")
    n = sum(m["role"] == "assistant" for m in messages)
    if "kaputt" in question:
        raise RuntimeError("Modell nicht erreichbar")
    say = lambda action, **args: f"THOUGHT: {action.lower()} {n}\nACTION: {action}({json.dumps(args, ensure_ascii=False)})"
    script = {
        "hastig": [say("FINAL_ANSWER", answer="Sofort [1] und [9] (siehe [8]).")] * 5,
        "klärt": [say("CLARIFY", question="Welche?"), say("CLARIFY", question="Welche Pumpe?")],
        "ratlos": [say("SEARCH", query="ventil"), say("FINAL_ANSWER", answer="Es wurden keine Stellen gefunden."), say("FINAL_ANSWER", answer="Druck laut [3].")],
        "leer": [say("SEARCH", query="nichts"), say("FINAL_ANSWER", answer=""), say("FINAL_ANSWER", answer="  ")],
        "sucht": [say("SEARCH"), say("REFINE_QUERY", query=" öl kette ", reason=" genauer "), say("REFINE_QUERY", query=""), say("REFINE_QUERY", query="motor"), say("SEARCH_CNC", ruest_id="1"), say("LOOKUP_SOURCES")],
        "merkt": [say("RECALL_MEMORY"), say("TANZEN"), "ACTION: SEARCH({kaputtes json)", "Frei gesagt [2]."],
        "stumm": ["", "", ""],
    }
    for key, said in script.items():
        if key in question:
            return said[min(n, len(said) - 1)]
    return say("SEARCH", query="druck motor")


def plain_loop(query, memory, budget, said=()):
    """The loop for one question, step by step."""
    no_info = lambda t: not t.strip() or bool(NO_INFO.search(t.strip()))
    if said and len(query.split()) <= 8:
        query = A.CONTEXT_HEAD + "\n".join(f"- {p}" for p in [*said, query]) + A.CONTEXT_TAIL
    messages = [{"role": "system", "content": ""}, {"role": "user", "content": query}]
    steps, chunks, searched, retried, last, answer, sufficient = [], [], False, False, query, "", False
    for n in range(1, budget + 1):
        try:
            response = respond(messages)
        except RuntimeError as e:
            return [], "", False, 0, str(e)
        thought = re.search(r"THOUGHT:\s*(.*?)(?=ACTION:|$)", response, re.S)
        thought = thought[1].strip() if thought else ""
        if m := re.search(r"ACTION:\s*(\w+)\(", response):
            action, args = m[1], {}
            at = response.find("{", m.end())
            if at >= 0:
                try:
                    args = json.JSONDecoder().raw_decode(response[at:])[0]
                except ValueError:
                    args = {}
        else:
            thought, action, args = thought or response, "FINAL_ANSWER", {"answer": response}
        note = lambda t: (thought + "\n" if thought else "") + t
        if not searched and action in ("FINAL_ANSWER", "CLARIFY"):
            thought, action, args = note(A.CORRECTED_SEARCH), "SEARCH", {"query": query}
        elif action == "FINAL_ANSWER" and not retried and no_info(args.get("answer", "")):
            words, seen = [], set()
            for w in f"{query} {last}".split():
                if (k := w.lower().strip(A.PUNCTUATION)) and k not in seen:
                    seen.add(k)
                    words.append(w)
            retried = True
            thought, action, args = note(A.CORRECTED_REFINE), "REFINE_QUERY", {"query": " ".join(words), "reason": A.BROADER}
        asked = None
        if action == "SEARCH":
            asked = args.get("query", query)
        if action == "REFINE_QUERY":
            asked = (args.get("query") or "").strip() or None
        if action in ("SEARCH", "REFINE_QUERY"):
            searched, last = True, args.get("query") or last
        found = hits_of(asked) if asked is not None else []
        seen_text = "\n".join(f"[{i}] ({f}{f', S. {p}' if p else ''}) {t[:300]}" for i, _, f, p, t in found) or A.NO_RESULTS
        chunks += found
        if action == "SEARCH":
            seen_by = seen_text
        elif action == "REFINE_QUERY":
            reason = args.get("reason", "").strip()
            seen_by = A.NO_REFINED_QUERY if asked is None else (f"[Verfeinerte Suche: {reason}]\n" if reason else "[Verfeinerte Suche]\n") + seen_text
        elif action == "SEARCH_CNC":
            seen_by = "SEARCH_CNC ist für Use Case 'wiener_linien' nicht verfügbar."
        elif action == "CLARIFY":
            seen_by = "CLARIFICATION_NEEDED: " + args.get("question", A.ASK_AGAIN)
        elif action == "RECALL_MEMORY":
            seen_by = f"Gespeicherter Kontext:\n{memory}" if memory else A.NO_MEMORY
        elif action == "LOOKUP_SOURCES":
            seen_by = "Quellen"
        elif action == "FINAL_ANSWER":
            seen_by = args.get("answer", "")
        else:
            seen_by = f"Unbekannte Action: {action}"
        steps.append((n, action, thought, asked, seen_by))
        if action == "FINAL_ANSWER":
            answer, sufficient = args.get("answer", ""), not no_info(args.get("answer", ""))
            break
        if action == "CLARIFY":
            answer = args.get("question", A.ASK_AGAIN)
            break
        messages += [{"role": "assistant", "content": response}, {"role": "user", "content": f"OBSERVATION: {seen_by}"}]
    if not answer:
        if chunks:
            answer, sufficient = A.FOUND_HEAD + "\n".join(f"[{i}] ({f}{f', S. {p}' if p else ''}) {t[:200]}" for i, (_, _, f, p, t) in enumerate(chunks[:5], 1)), True
        else:
            answer, sufficient = A.NOTHING_FOUND, False
    for bad in {int(x) for x in re.findall(r"\[(\d+)]", answer)} - set(range(1, len(chunks) + 1)):
        answer = answer.replace(f"[{bad}]", "\0")
    if "\0" in answer:
        answer = re.sub(r"\(\s*(?:Quelle|Quellen|siehe|vgl\.?)?\s*\)", "", answer.replace("\0", ""))
        answer = re.sub(r"[ \t]{2,}", " ", re.sub(r"\s+([,.;:!?])", r"\1", answer)).strip()
    return steps, answer.strip('" \n') or "Die Anfrage konnte nicht vollständig beantwortet werden. Bitte präzisieren Sie Ihre Frage.", sufficient, len(chunks), None


QUESTIONS = [
    (1, "hastig druck pumpe", None, 5), (2, "klärt motor", None, 5), (3, "ratlos druck, kette", None, 5), (4, "leer motor", "alt", 5), (5, "sucht pumpe", None, 5), (6, "merkt öl", "Q: a\nA: b", 4),
    (7, "stumm ventil", None, 3), (8, "immer weiter", None, 2), (9, "kaputt druck", None, 3), (10, "nichts bekannt", "", 1), (11, "leer xyz", None, 3), (12, "hastig", None, 1), (13, "sucht motor und kette", None, 1),
]


def told(messages):
    return [respond([{"role": m["role"], "content": m["content"]} for m in x]) for x in messages]


def test_loop(spark):
    q = spark.createDataFrame(QUESTIONS, "question_id long, query string, memory string, budget int")
    run = run_loop(q, attempted(told, "string"), search, "wiener_linien", "Quellen")
    steps = {}
    for r in run.steps.orderBy("step").collect():
        steps.setdefault(r.question_id, []).append((r.step, r.action, r.thought, r.search_query, r.observation))
    answers = {r.question_id: r for r in run.answers.collect()}
    for i, query, memory, budget in QUESTIONS:
        want, answer, sufficient, n, error = plain_loop(query, memory, budget)
        assert steps.get(i, []) == want, (i, query)
        got = answers[i]
        assert (got.answer, got.sufficient, got.n_chunks, got.error) == (answer, sufficient, n, error), (i, query)
    cited = {(r.question_id, r.ref) for r in run.citations.collect()}
    assert (1, "[1]") in cited and (1, "[9]") not in cited
    assert all(set(a.searched_collections) <= {"wl_x"} for a in answers.values())


def test_history_and_columns(spark):
    q = spark.createDataFrame([(1, "und öl", ["sucht pumpe"]), (2, "x " * 9 + "druck", ["sucht"])], "question_id long, query string, said array<string>")
    run = run_loop(q, attempted(told, "string"), search, "wiener_linien", max_steps=2, collections=["b", "a"])
    got = {(r.question_id, r.step): r.search_query for r in run.steps.collect()}
    want = {(i, s[0]): s[3] for i, query, said in [(1, "und öl", ["sucht pumpe"]), (2, "x " * 9 + "druck", ["sucht"])] for s in plain_loop(query, None, 2, said)[0]}
    assert got == want and {tuple(r.searched_collections) for r in run.answers.collect()} == {("a", "b")}
    none = run_loop(q.where("false"), lambda m: F.lit("x"), search, "wiener_linien")
    assert none.steps.count() == 0 and none.answers.count() == 0


def test_one_specialist_fails(spark):
    plan = json.dumps({"rationale": "w", "merge_strategy": "comparative", "subtasks": [{"role": "facts", "sub_query": "hastig druck"}, {"role": "procedure", "sub_query": "kaputt"}, {"role": "context", "sub_query": "hastig motor"}]})
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, query string").withColumn("plan", F.lit(plan)).select("question_id", "query", A.normalise_plan(F.col("plan"), F.col("query")).alias("plan"))
    subs, _ = fan_out(subtasks(q), attempted(told, "string"), search, "wiener_linien")
    got = {(r.question_id, r.n): (r.answer, r.sufficient, r.n_chunks, r.error) for r in subs.collect()}
    assert len(got) == 6
    for i in (1, 2):
        assert got[i, 1] == ("", False, 0, "Modell nicht erreichbar")
        assert got[i, 0][1:] == (True, len(hits_of("druck")), None) and got[i, 2][1:] == (True, len(hits_of("motor")), None)


@pytest.mark.parametrize(("judge", "want", "ok"), [("kein json", "fassung [1]", True), ('{"verdict": "REFUSE"}', A.REFUSED, False), ('{"verdict": "REWRITE", "guidance": "kurz"}', "fassung neu [1]", True)])
def test_manager(spark, judge, want, ok):
    plan = json.dumps({"subtasks": [{"role": "facts", "sub_query": "hastig druck"}, {"role": "facts", "sub_query": "hastig druck motor"}, {"role": "context", "sub_query": "kaputt"}]})
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, query string")
    put = lambda query, fragments, pool: F.concat(F.lit("```\nANTWORT: fassung"), F.when(fragments.contains("kurz"), " neu").otherwise(""), F.lit(" [1] [77]\n```"))
    made = run_manager(q, lambda c: F.lit(plan), attempted(told, "string"), search, "wiener_linien", put, lambda pool, answer: F.lit(judge))
    rows = made.answers.collect()
    size = len({t[:200] for t in [x[4] for x in hits_of("druck motor")]})
    assert [(r.answer, r.sufficient, r.n_pool) for r in rows] == [(want, ok, size)] * 2
    assert made.subagents.where("error is not null").count() == 2


def test_fallbacks(spark):
    q = spark.createDataFrame([(1, "hastig xyz")], "question_id long, query string")
    none = run_manager(q, lambda c: F.lit("kein json"), attempted(told, "string"), search, "wiener_linien").answers.first()
    assert none.n_pool == 0 and not none.sufficient and none.answer.startswith("Sofort")
    some = run_manager(q.withColumn("query", F.lit("hastig druck")), lambda c: F.lit("kein json"), attempted(told, "string"), search, "wiener_linien", lambda *a: F.lit(None).cast("string")).answers.first()
    assert some.answer.startswith("**Fakten:** Sofort [1]")
    empty = spark.range(1).select(concatenated(F.expr("cast(array() as array<struct<label:string,answer:string>>)")).alias("x")).first().x
    assert empty == A.NOTHING_SUPPORTED


def test_attempted(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(items):
        calls.add(1)
        if "b" in items:
            raise ValueError("nicht b")
        return [x.upper() for x in items]

    df = spark.createDataFrame([(i, None if i == 3 else "b" if i == 7 else f"x{i}") for i in range(120)], "i int, x string").coalesce(1)
    got = {r.i: (r.y.value, r.y.error) for r in df.select("i", attempted(call, "string")(F.col("x")).alias("y")).collect()}
    assert got[7] == (None, "nicht b") and got[3] == (None, None) and got[8] == ("X8", None) and sum(v is not None for v, _ in got.values()) == 118
    assert calls.value == 3 + 50


def test_sources(spark):
    p = spark.createDataFrame([("wl_b", [1.0, 2.0]), ("wl_a", [1.0, 2.0]), ("wl_a", [1.0, 2.0]), ("gw_x", [1.0])], "collection string, vector array<double>")
    assert sources_text(p, "wiener_linien") == "Verfügbare Quellen für wiener_linien:\n- wl_a (2 Chunks, 2D)\n- wl_b (1 Chunks, 2D)"
    assert sources_text(p, "neumann") == A.NO_SOURCES
