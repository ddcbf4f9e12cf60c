"""Queries on agent text, plans and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators import agents as A
from lectern.operators.loop import run_loop, sources_text
from lectern.operators.manager import fan_out, run_manager, subtasks
from lectern.operators.search import found_chunks, search
from lectern.plans.ranking import search_points, search_sql
from lectern.plans.registry import query
from lectern.providers import attempted
from lectern.session import load, written

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _text():
    return F.col("text")


def messages(spark, sf_dir):
    return load(spark, sf_dir, "conversations")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "agt_enrich_query",
    f"""with u as (select conv_id, string_agg('- ' || text, chr(10) order by turn) as lines from conversations where role = 'user' group by 1), c as (select distinct conv_id from conversations)
    select conv_id, case when conv_id % 3 = 0 or lines is null then 'und bei Modell ' || conv_id || case when conv_id % 3 = 0 then ' und den anderen sieben neueren Modellen dieser Reihe' else '' end else {sql_text(A.CONTEXT_HEAD)} || lines || chr(10) || '- und bei Modell ' || conv_id || {sql_text(A.CONTEXT_TAIL)} end as query from c left join u using (conv_id)""",
)
def agt_enrich_query(spark, sf_dir):
    m = messages(spark, sf_dir)
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"])
    q = F.concat(F.lit("und bei Modell "), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 3 == 0, " und den anderen sieben neueren Modellen dieser Reihe").otherwise(""))
    return m.groupBy("conv_id").agg(said.alias("said")).select("conv_id", A.enrich_query(q, F.col("said")).alias("query"))


@query("agt_history_window", "with r as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as n from conversations) select conv_id, turn, role from r where n <= 6")
def agt_history_window(spark, sf_dir):
    return A.history_window(messages(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "role")


@query("agt_prior_user", "with r as (select conv_id, text, turn, row_number() over (partition by conv_id order by turn desc) as n from conversations where role = 'user') select conv_id, string_agg('- ' || text, chr(10) order by turn) as prior from r where n <= 2 group by 1")
def agt_prior_user(spark, sf_dir):
    last = A.history_window(messages(spark, sf_dir).where("role = 'user'"), "conv_id", "turn", 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return last.groupBy("conv_id").agg(joined.alias("prior"))


def response():
    return F.when(F.col("turn") % 3 == 0, F.concat(F.lit("THOUGHT: denke "), F.col("turn").cast("string"), F.lit('\nACTION: SEARCH({"query": "a } b", "f": {"x": '), F.col("conv_id").cast("string"), F.lit("}}) rest"))).when(F.col("turn") % 3 == 1, F.lit("ACTION: CLARIFY()")).otherwise(F.concat(F.lit("Antwort "), F.col("conv_id").cast("string")))


@query(
    "agt_parse_action",
    """select conv_id, turn, case turn % 3 when 0 then 'denke ' || turn when 1 then '' else 'Antwort ' || conv_id end as thought, case turn % 3 when 0 then 'SEARCH' when 1 then 'CLARIFY' else 'FINAL_ANSWER' end as action,
    case turn % 3 when 0 then '{"query": "a } b", "f": {"x": ' || conv_id || '}}' when 1 then '{}' else '{"answer":"Antwort ' || conv_id || '"}' end as args from conversations""",
)
def agt_parse_action(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", "turn", A.parse_action(response()).alias("p")).select("conv_id", "turn", "p.thought", "p.action", "p.args")


@query("agt_extract_json", """select conv_id, turn, '{"a": "' || turn || ' \\" {", "b": [{}]}' as found from conversations""")
def agt_extract_json(spark, sf_dir):
    text = F.concat(F.lit('vor {"a": "'), F.col("turn").cast("string"), F.lit(' \\" {", "b": [{}]} nach }'))
    return messages(spark, sf_dir).select("conv_id", "turn", A.balanced_json(text, F.lit(1)).alias("found"))


@query(
    "agt_normalise_plan",
    f"""select conv_id, turn, case when turn % 3 < 2 then 'weil' else {sql_text(A.FALLBACK_RATIONALE)} end as rationale, case turn % 3 when 0 then 'comparative' when 1 then 'complementary' else 'fallback' end as merge_strategy,
    case turn % 3 when 0 then 2 when 1 then 1 else 1 end as n, case turn % 3 when 0 then 'procedure' else 'facts' end as first_role, case turn % 3 when 2 then 'frage ' || conv_id else 'q1' end as first_query from conversations""",
)
def agt_normalise_plan(spark, sf_dir):
    plan = F.when(F.col("turn") % 3 == 0, F.lit('{"rationale": " weil ", "merge_strategy": "comparative", "subtasks": [{"role": "procedure", "sub_query": " q1"}, {"role": "x", "sub_query": ""}, {"role": "context", "sub_query": "q3"}, {"role": "facts", "sub_query": "q4"}]}'))
    plan = plan.when(F.col("turn") % 3 == 1, F.lit('{"rationale": "weil", "merge_strategy": "?", "subtasks": [{"role": "x", "sub_query": "q1"}]}')).otherwise("kein json")
    p = A.normalise_plan(plan, F.concat(F.lit("frage "), F.col("conv_id").cast("string")))
    made = messages(spark, sf_dir).select("conv_id", "turn", p.alias("p"))
    return made.select("conv_id", "turn", "p.rationale", "p.merge_strategy", F.size("p.subtasks").alias("n"), F.col("p.subtasks")[0]["role"].alias("first_role"), F.col("p.subtasks")[0]["sub_query"].alias("first_query"))


@query("agt_no_info", f"select conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') = '' or regexp_matches(text, {sql_text(A.NO_INFO)}) as no_info from conversations")
def agt_no_info(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", "turn", A.no_info(F.col("text")).alias("no_info"))


@query("agt_broaden_query", "select conv_id, turn, 'Druck im Ventil ' || turn || ' (hoch) neu' as query from conversations")
def agt_broaden_query(spark, sf_dir):
    q = F.concat(F.lit("Druck im Ventil "), F.col("turn").cast("string"))
    return messages(spark, sf_dir).select("conv_id", "turn", A.broaden(q, F.lit('druck, "ventil" (hoch) !! HOCH neu')).alias("query"))


@query(
    "agt_guard_decision",
    """with c as (select conv_id, turn, list_extract(['SEARCH', 'FINAL_ANSWER', 'CLARIFY', 'FINAL_ANSWER'], turn % 4 + 1) as a, turn % 4 = 3 as empty, turn > 1 as searched, conv_id % 2 = 0 as retried from conversations)
    select conv_id, turn, case when not searched and a in ('FINAL_ANSWER', 'CLARIFY') then 'SEARCH' when a = 'FINAL_ANSWER' and not retried and empty then 'REFINE_QUERY' else a end as action from c""",
)
def agt_guard_decision(spark, sf_dir):
    a = F.element_at(F.array(*[F.lit(x) for x in ("SEARCH", "FINAL_ANSWER", "CLARIFY", "FINAL_ANSWER")]), (F.col("turn") % 4 + 1).cast("int"))
    answer = F.when(F.col("turn") % 4 == 3, "").otherwise("Ja.")
    return messages(spark, sf_dir).select("conv_id", "turn", A.guard(a, answer, F.col("turn") > 1, F.col("conv_id") % 2 == 0).alias("action"))


#: Users are of a use case; what it enables, less one action that differs from user to user.
ENABLED = "u(use_case, actions) as (values " + ", ".join(f"('{k}', {list(v['actions'])!r})" for k, v in A.USE_CASES.items()) + f"), e as (select distinct user_id, use_case, list_filter(actions, lambda a: a <> list_extract({list(A.ACTIONS)!r}, (user_id % 7)::int + 1)) as actions from events join u on use_case = list_extract(['neumann', 'gw_stpoelten', 'wiener_linien', 'ustp'], (user_id % 4)::int + 1))"


def enabled_actions(spark, sf_dir):
    """user_id, use_case and the actions that are enabled."""
    from lectern.plans.admin import log

    every = spark.createDataFrame([(k, list(v["actions"])) for k, v in A.USE_CASES.items()], "use_case string, actions array<string>")
    off = F.element_at(F.array(*[F.lit(a) for a in A.ACTIONS]), (F.col("user_id") % 7 + 1).cast("int"))
    return log(spark, sf_dir).select("user_id", "use_case").distinct().join(every, "use_case").select("user_id", "use_case", F.array_except("actions", F.array(off)).alias("actions"))


@query("agt_filter_actions", f"with {ENABLED} select user_id, array_to_string(list_filter(['SEARCH', 'REFINE_QUERY', 'FINAL_ANSWER'], lambda a: a = 'FINAL_ANSWER' or list_contains(actions, a)), ',') as actions from e")
def agt_filter_actions(spark, sf_dir):
    return enabled_actions(spark, sf_dir).select("user_id", F.array_join(A.filter_actions(F.col("actions")), ",").alias("actions"))


@query("cat_actions_enabled", f"with {ENABLED} select user_id, use_case, unnest(actions) as action from e")
def cat_actions_enabled(spark, sf_dir):
    return enabled_actions(spark, sf_dir).select("user_id", "use_case", F.explode("actions").alias("action"))


SIGNED = "case a " + " ".join(f"when '{k}' then {sql_text(v)}" for k, v in A.SIGNATURES.items()) + " end"


@query(
    "agt_system_prompt",
    f"""with {ENABLED}, s as (select user_id, string_agg('## ' || event_type || ' — ' || event_id || chr(10) || event_type || chr(10) || chr(10), '' order by event_id) as skills from events where event_id % 10 = 0 group by 1)
    select user_id, 'Prompt ' || use_case || chr(10) || chr(10) || 'Verfügbare Actions (immer als JSON-Argument):' || chr(10) || array_to_string(list_transform(actions, lambda a: '- ' || {SIGNED}), chr(10)) || chr(10) || chr(10)
        || coalesce({sql_text(A.RULES_HEAD)} || rtrim(skills, chr(10)) || chr(10) || chr(10), '') || 'ENDE' as prompt from e left join s using (user_id)""",
)
def agt_system_prompt(spark, sf_dir):
    """A prompt for each user: the use case's, the signatures of its actions, its enabled skills, the suffix."""
    skill = F.struct("event_id", F.struct(F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("overview"), F.concat(F.lit("  "), "event_type", F.lit("\n")).alias("task")).alias("s"))
    skills = load(spark, sf_dir, "events").where("event_id % 10 = 0").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(skill)), lambda x: x["s"]).alias("skills"))
    made = A.system_prompt(F.concat(F.lit("Prompt "), "use_case"), F.col("actions"), F.col("skills"), F.lit("ENDE"))
    return enabled_actions(spark, sf_dir).join(skills, "user_id", "left").select("user_id", made.alias("prompt"))


@query(
    "agt_fallback_answer",
    "with r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'assistant'), a as (select conv_id, 'Basierend auf den gefundenen Dokumenten:' || chr(10) || chr(10) || string_agg('[' || i || '] (conv, S. ' || (turn + 1) || ') ' || left(text, 200), chr(10) order by i) as answer, true as sufficient from r where i <= 5 group by 1) select * from a union all select distinct conv_id, " + sql_text(A.NOTHING_FOUND) + ", false from conversations where conv_id not in (select conv_id from a)",
)
def agt_fallback_answer(spark, sf_dir):
    from lectern.operators.ranking import observation

    m = messages(spark, sf_dir)
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    lines = m.where("role = 'assistant'").withColumn("i", i).where("i <= 5").select("conv_id", "i", observation(F.col("i"), F.lit("conv"), F.col("turn") + 1, _text(), 200).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    made = lines.groupBy("conv_id").agg(F.concat(F.lit("Basierend auf den gefundenen Dokumenten:\n\n"), text).alias("answer"))
    return m.select("conv_id").distinct().join(made, "conv_id", "left").select("conv_id", F.coalesce("answer", F.lit(A.NOTHING_FOUND)).alias("answer"), F.col("answer").isNotNull().alias("sufficient"))


@query("agt_concat_fragments", "with f as (select conv_id, string_agg('**' || case turn % 3 when 0 then 'Fakten' when 1 then 'Prozedur' else 'Kontext' end || ':** ' || text, chr(10) || chr(10) order by turn) as answer from conversations where text <> '' group by 1) select * from f")
def agt_concat_fragments(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(x) for x in A.ROLE_LABELS.values()]), (F.col("turn") % 3 + 1).cast("int"))
    part = F.concat(F.lit("**"), label, F.lit(":** "), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n")
    return messages(spark, sf_dir).where("text <> ''").groupBy("conv_id").agg(joined.alias("answer"))


@query("agt_compliance", "select conv_id, turn, list_extract(['OK', 'REFUSE', 'OK', 'REWRITE'], turn % 4 + 1) as verdict, case turn % 4 when 1 then false else true end as sufficient from conversations")
def agt_compliance(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("kein json"), F.lit('{"verdict": "REFUSE", "issues": []}'), F.lit('{"verdict": "??"}'), F.lit('{"verdict": "REWRITE"}')), (F.col("turn") % 4 + 1).cast("int"))
    v = A.verdict(raw)
    return messages(spark, sf_dir).select("conv_id", "turn", v.alias("verdict"), (v != "REFUSE").alias("sufficient"))


@query("agt_final_flags", "select conv_id, bool_or(role = 'assistant') as sufficient, string_agg(distinct role, ',' order by role) as searched from conversations group by 1")
def agt_final_flags(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("conv_id").agg(F.bool_or(F.col("role") == "assistant").alias("sufficient"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("searched"))


@query(
    "agt_flatten_steps",
    "with c as (select conv_id, count(*) as n from conversations group by 1) select conv_id, 0 as step, 'MANAGER_PLAN' as action from c union all select conv_id, row_number() over (partition by conv_id order by turn), upper(role) from conversations union all select conv_id, n + 1, 'SYNTHESIZE' from c",
)
def agt_flatten_steps(spark, sf_dir):
    from pyspark.sql import Window as W

    m = messages(spark, sf_dir)
    size = m.groupBy("conv_id").agg(F.count("*").alias("n"))
    steps = m.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("step"), F.upper("role").alias("action"))
    return size.select("conv_id", F.lit(0).cast("long").alias("step"), F.lit("MANAGER_PLAN").alias("action")).unionByName(steps).unionByName(size.select("conv_id", (F.col("n") + 1).alias("step"), F.lit("SYNTHESIZE").alias("action")))


PARTS = "select item_id * 3 + n as item_id, case n when 2 then substr(text, 1 + 2 * (length(text) // 3)) else substr(text, 1 + n * (length(text) // 3), length(text) // 3) end as text from benchmark, unnest([0, 1, 2]) t(n)"
LANGUAGES = "select 'wl_' || lang as collection, doc_id, source as file_name, doc_id % 5 as page, text from documents"


def thirds(spark, sf_dir):
    """Items cut into three parts, as subtasks of a plan."""
    size = "length(text) div 3"
    part = lambda n: F.expr(f"substring(text, 1 + {n} * ({size}), {size})" if n < 2 else f"substring(text, 1 + 2 * ({size}))")
    tasks = F.array(*[F.struct(F.lit(r).alias("role"), part(i).alias("sub_query"), F.lit("").alias("focus")) for i, r in enumerate(A.ROLE_LABELS)])
    return load(spark, sf_dir, "benchmark").select("item_id", "text", tasks.alias("subtasks"))


@query("agt_fanout", f"select item_id // 3 as item_id, item_id % 3 as subtask, rank, doc_id, score from (select query_id as item_id, * exclude (query_id) from ({search_sql(LANGUAGES, queries=PARTS)}))")
def agt_fanout(spark, sf_dir):
    """Subtasks of all questions searched together: a row for each hit of each (question, subtask)."""
    each = thirds(spark, sf_dir).select("item_id", F.posexplode("subtasks").alias("n", "t"))
    hits = search(search_points(spark, sf_dir), each.select((F.col("item_id") * 3 + F.col("n")).alias("query_id"), F.col("t.sub_query").alias("query")))
    return hits.select(F.expr("query_id div 3").alias("item_id"), (F.col("query_id") % 3).alias("subtask"), "rank", "doc_id", "score")


def scripted(messages):
    """A model that knows five manners, chosen by the length of the question, and says what its step asks for."""
    n = F.size(F.filter(messages, lambda m: m["role"] == "assistant"))
    question = F.element_at(F.filter(messages, lambda m: m["role"] == "user"), 1)["content"]
    words = F.array_join(F.slice(F.split(F.regexp_replace(question, r'["\\\\]', " "), r"\s+"), 1, 3), " ")
    say = lambda action, args: F.concat(F.lit(f"THOUGHT: Schritt\nACTION: {action}("), args, F.lit(")"))
    search_for = say("SEARCH", F.concat(F.lit('{"query": "'), words, F.lit('"}')))
    final = lambda text: say("FINAL_ANSWER", F.lit(f'{{"answer": "{text}", "extras": {{}}}}'))
    manner = F.length(question) % 5
    hasty = final("Das steht in [1] und (siehe [99]).")
    unsure = F.when(n == 0, search_for).when(n == 1, final("Dazu liegen keine Angaben vor.")).otherwise(final("Es ist so [2], siehe [30] ."))
    curious = F.when(n == 0, say("RECALL_MEMORY", F.lit("{}"))).when(n == 1, say("LOOKUP_SOURCES", F.lit("{}"))).otherwise(search_for)
    asking = F.when(n == 0, search_for).otherwise(say("CLARIFY", F.lit('{"question": "Welches Modell?"}')))
    return F.when(manner == 0, hasty).when(manner == 1, unsure).when(manner == 2, curious).when(manner == 3, asking).otherwise(F.lit("Ohne Form gesagt [1]."))


def looked_up(points, vectors):
    """A search of the loop, over the collections of a use case."""
    return lambda q: found_chunks(points, q, "wiener_linien", "wl_fehlt", vectors=vectors)


def written_vectors(spark, sf_dir):
    """The points, and what all searches of a run read of them, written once; texts stay in the documents."""
    points = search_points(spark, sf_dir)
    return points, written(points.drop("text"), "points")[0]


@query("agt_loop")
def agt_loop(spark, sf_dir):
    """Every item as a question to the loop of actions, with three steps: a row for each step."""
    points, vectors = written_vectors(spark, sf_dir)
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Q: "), "text")).alias("memory"))
    run = run_loop(questions, scripted, looked_up(points, vectors), "wiener_linien", sources_text(vectors, "wiener_linien"), max_steps=3)
    return run.steps.select("question_id", "step", "action", "thought", "search_query", "observation")


def faulty(texts):
    """A model of a service that fails on some texts."""
    out = []
    for m in texts:
        question = [x["content"] for x in m if x["role"] == "user"][0]
        if len(question) % 7 == 3:
            raise RuntimeError(f"Modell nicht erreichbar ({len(question)})")
        out.append(f'THOUGHT: t\nACTION: FINAL_ANSWER({{"answer": "Teil {len(question)} [1]"}})')
    return out


def thirds_plan(query):
    """A plan as JSON: a subtask for each third of the question."""
    size = F.floor(F.length(query) / 3).cast("int")
    part = lambda n: F.substring(query, 1 + n * size, size) if n < 2 else F.substring(query, 1 + 2 * size, F.length(query))
    tasks = F.array(*[F.struct(F.lit(r).alias("role"), part(i).alias("sub_query"), F.lit("").alias("focus")) for i, r in enumerate(A.ROLE_LABELS)])
    return F.to_json(F.struct(F.lit("weil").alias("rationale"), F.lit("comparative").alias("merge_strategy"), tasks.alias("subtasks")))


PART_SQL = f"p as (select item_id // 3 as question_id, item_id % 3 as n, {STRIP.format('text')} as q from ({PARTS}))"


@query(
    "agt_isolated_errors",
    f"with {PART_SQL} select question_id, n, case when length(q) % 7 = 3 then '' else 'Teil ' || length(q) || ' [1]' end as answer, length(q) % 7 <> 3 as sufficient, case when length(q) % 7 = 3 then 0 else 7 end as n_chunks, case when length(q) % 7 = 3 then 'Modell nicht erreichbar (' || length(q) || ')' end as error from p where q <> ''",
)
def agt_isolated_errors(spark, sf_dir):
    """Specialists of all questions with a model that fails on some: those are empty results with their error, the others stay."""
    plans = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), A.normalise_plan(thirds_plan(F.col("text")), F.col("text")).alias("plan"))
    subs, _ = fan_out(subtasks(plans), attempted(faulty, "string"), looked_up(*written_vectors(spark, sf_dir)), "wiener_linien")
    return subs.select("question_id", "n", "answer", "sufficient", F.least("n_chunks", F.lit(7)).cast("int").alias("n_chunks"), "error")


@query("agt_manager")
def agt_manager(spark, sf_dir):
    """Every item planned, answered by three specialists, put together and judged."""
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    comply = lambda pool, answer: F.when(F.length(answer) % 3 == 0, '{"verdict": "REFUSE"}').when(F.length(answer) % 3 == 1, '{"verdict": "REWRITE", "guidance": "kürzer"}').otherwise("kein json")
    put = lambda q, fragments, pool: F.concat(F.lit("ANTWORT: "), F.left(fragments, F.lit(60)), F.when(fragments.contains("KORREKTUR"), " (neu)").otherwise(""), F.lit(" [1] [500]"))
    made = run_manager(questions, thirds_plan, scripted, looked_up(*written_vectors(spark, sf_dir)), "wiener_linien", put, comply)
    return made.answers.select("question_id", "answer", "sufficient", "verdict", "n_pool", "merge_strategy")


MEMORY = "with e as (select conv_id, turn, role as q, 'Q: ' || role || chr(10) || 'A: ' || left(text, 500) as e from conversations) "


@query("mem_append_truncate", MEMORY + "select conv_id, left(string_agg(e, chr(10) || '---' || chr(10) order by turn), 4000) as memory, count(*) as version from e group by 1")
def mem_append_truncate(spark, sf_dir):
    return A.memory(messages(spark, sf_dir), "conv_id", "turn", F.col("role"), _text())


@query("agt_recall_memory", MEMORY + "select c.conv_id, case when m.memory is null then 'Kein gespeicherter Kontext für diese Session.' else 'Gespeicherter Kontext:' || chr(10) || m.memory end as observation from (select distinct conv_id from conversations) c left join (select conv_id, left(string_agg(e, chr(10) || '---' || chr(10) order by turn), 4000) as memory from e where q = 'user' group by 1) m using (conv_id)")
def agt_recall_memory(spark, sf_dir):
    m = messages(spark, sf_dir)
    known = A.memory(m.where("role = 'user'"), "conv_id", "turn", F.col("role"), _text())
    out = F.coalesce(F.concat(F.lit("Gespeicherter Kontext:\n"), "memory"), F.lit("Kein gespeicherter Kontext für diese Session."))
    return m.select("conv_id").distinct().join(known, "conv_id", "left").select("conv_id", out.alias("observation"))
