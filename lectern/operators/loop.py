"""The loop of actions over a table of questions: every step is one job for all that are still open.

A question's state is a row: its messages, whether a search has been made, whether one was
broadened, and the last search. A step asks the model (a column of the messages), parses
its response, applies the guards, carries out the action and appends the observation; all
searches of a step are one search. Each step's rows are written to the shared folder, so the
model is asked once and a lost executor repeats one step at most. Questions that end drop
out; the number of steps is a budget of the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import clean_answer, strip
from lectern.operators import agents as A
from lectern.operators import ranking as R
from lectern.operators import vectors as V
from lectern.session import written

MESSAGES = "array<struct<role:string,content:string>>"

#: A search for many queries: (query_id, query) to the columns of ``search.found_chunks``.
Search = Callable[[DataFrame], DataFrame]


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def sources_text(points: DataFrame, use_case: str) -> str:
    """The collections of a use case with their sizes, as the model sees them; one row for each collection goes to the driver."""
    own = V.collections(points.where(V.own_collection(F.col("collection"), use_case)), "vector", "collection").orderBy("collection").collect()
    lines = [f"- {r.collection} ({r['count']} Chunks, {r.dimension}D)" for r in own]
    return "\n".join([f"Verfügbare Quellen für {use_case}:", *lines]) if lines else A.NO_SOURCES


@dataclass
class Run:
    """What a loop gives: ``steps``, the ``chunks`` of its searches, ``answers`` and their ``citations``."""

    steps: DataFrame
    chunks: DataFrame
    answers: DataFrame
    citations: DataFrame


def guarded(active: DataFrame) -> DataFrame:
    """With the action that is carried out: a search comes before any answer, and an answer without information is tried once more with a broader query."""
    arg = lambda name: F.get_json_object("args", f"$.{name}")
    said = arg("answer")
    first = ~F.col("searched") & F.col("action").isin("FINAL_ANSWER", "CLARIFY")
    again = ~first & (F.col("action") == "FINAL_ANSWER") & ~F.col("retried") & A.no_info(said)
    note = lambda text: F.concat(F.when(F.col("thought") != "", F.concat("thought", F.lit("\n"))).otherwise(""), F.lit(text))
    asked = F.when(first, F.col("enriched")).when(again, A.broaden(F.col("enriched"), F.col("last_query"))).when(F.col("action") == "SEARCH", F.coalesce(arg("query"), "enriched")).when(F.col("action") == "REFINE_QUERY", arg("query"))
    made = active.select(
        "*", first.alias("_first"), again.alias("_again"), asked.alias("asked"), F.coalesce(said, F.lit("")).alias("said"),
        F.when(again, A.BROADER).when(F.col("action") == "REFINE_QUERY", F.coalesce(strip(arg("reason")), F.lit(""))).otherwise("").alias("reason"),
        F.coalesce(arg("question"), F.lit(A.ASK_AGAIN)).alias("question"),
    )
    acts = F.when(F.col("_first"), "SEARCH").when(F.col("_again"), "REFINE_QUERY").otherwise(F.col("action"))
    made = made.withColumns({"thought": F.when(F.col("_first"), note(A.CORRECTED_SEARCH)).when(F.col("_again"), note(A.CORRECTED_REFINE)).otherwise(F.col("thought")), "action": acts, "retried": F.col("retried") | F.col("_again")})
    looks = F.col("action").isin("SEARCH", "REFINE_QUERY")
    refined = F.when(F.col("action") == "REFINE_QUERY", strip(F.coalesce("asked", F.lit("")))).otherwise(F.col("asked"))
    kept = F.when(looks & (F.coalesce("asked", F.lit("")) != ""), F.col("asked")).otherwise(F.col("last_query"))
    blank = (F.col("action") == "REFINE_QUERY") & (refined == "")
    return made.withColumns({"search_query": F.when(looks & ~blank, refined), "last_query": kept, "searched": F.col("searched") | looks}).drop("_first", "_again", "asked")


def observed(acted: DataFrame, hits: DataFrame, sources: str, use_case: str, cnc: DataFrame | None) -> DataFrame:
    """With the observation of each row's action."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "observation"))), lambda x: x["observation"]), "\n")
    found = hits.groupBy(F.col("query_id").alias("question_id")).agg(lines.alias("_found"))
    both = acted.join(found, "question_id", "left")
    both = both.join(cnc.select(F.col("query_id").alias("question_id"), F.col("observation").alias("_cnc")), "question_id", "left") if cnc is not None else both.withColumn("_cnc", F.lit(f"SEARCH_CNC ist für Use Case '{use_case}' nicht verfügbar."))
    result = F.coalesce("_found", F.lit(A.NO_RESULTS))
    prefix = F.when(F.col("reason") != "", F.concat(F.lit("[Verfeinerte Suche: "), "reason", F.lit("]\n"))).otherwise("[Verfeinerte Suche]\n")
    action = F.col("action")
    seen = (
        F.when(action == "SEARCH", result)
        .when(action == "REFINE_QUERY", F.when(F.col("search_query").isNull(), A.NO_REFINED_QUERY).otherwise(F.concat(prefix, result)))
        .when(action == "SEARCH_CNC", F.coalesce("_cnc", F.lit("Keine CNC-Schritte gefunden.")))
        .when(action == "CLARIFY", F.concat(F.lit("CLARIFICATION_NEEDED: "), "question"))
        .when(action == "RECALL_MEMORY", F.coalesce(F.concat(F.lit("Gespeicherter Kontext:\n"), F.nullif("memory", F.lit(""))), F.lit(A.NO_MEMORY)))
        .when(action == "LOOKUP_SOURCES", sources)
        .when(action == "FINAL_ANSWER", F.col("said"))
        .otherwise(F.concat(F.lit("Unbekannte Action: "), action))
    )
    return both.withColumn("observation", seen).drop("_found", "_cnc")


STEP = ["question_id", "step", "thought", "action", "args", "search_query", "observation", "response", "error"]


def run_loop(
    questions: DataFrame,
    chat: Callable[[Column], Column],
    search: Search,
    use_case: str,
    sources: str = A.NO_SOURCES,
    max_steps: int = A.MAX_STEPS,
    cnc: Callable[[DataFrame], DataFrame] | None = None,
    collections: list[str] | None = None,
) -> Run:
    """Answers to all ``questions`` (question_id, query; said: earlier user messages, history: messages, system, memory, budget if they are there).

    ``chat`` makes the model's response of the messages, as a string or as struct(value,
    error); a question whose call fails ends there with an empty answer, without steps or
    chunks, and its error, and the others go on. ``cnc`` answers SEARCH_CNC for a table
    (query_id, args). ``collections`` are what the search reads, for a question's
    searched_collections; without them those count that gave it chunks. ``budget`` limits the steps of a row, ``max_steps`` those of all.
    """
    have = set(questions.columns)
    of = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    enriched = A.enrich_query(F.col("query"), F.coalesce(of("said", "array<string>"), F.expr("cast(array() as array<string>)")))
    before = F.coalesce(of("history", MESSAGES), F.expr(f"cast(array() as {MESSAGES})"))
    state = questions.select(
        "question_id", enriched.alias("enriched"), F.coalesce(of("system", "string"), F.lit("")).alias("system"), F.slice(before, F.greatest(F.size(before) - A.HISTORY + 1, F.lit(1)), A.HISTORY).alias("history"),
        of("memory", "string").alias("memory"), F.least(F.coalesce(of("budget", "int"), F.lit(max_steps)), F.lit(max_steps)).alias("budget"),
    )
    first = F.concat(F.array(message("system", F.col("system"))), F.col("history").cast(MESSAGES), F.array(message("user", F.col("enriched"))))
    state = state.select("question_id", "enriched", "memory", "budget", first.cast(MESSAGES).alias("messages"), F.lit(False).alias("searched"), F.lit(False).alias("retried"), F.col("enriched").alias("last_query"))
    stepped, chunks = [], []
    for n in range(1, max_steps + 1):
        active = state.where(F.col("budget") >= n)
        asked = active.withColumn("_r", chat(F.col("messages")))
        plain = asked.schema["_r"].dataType.simpleString() == "string"
        asked = asked.withColumns({"response": F.col("_r") if plain else F.col("_r.value"), "error": F.lit(None).cast("string") if plain else F.col("_r.error")}).drop("_r")
        parsed = asked.withColumn("_p", A.parse_action(F.coalesce("response", F.lit("")))).select("*", "_p.*").drop("_p")
        acted, _ = written(guarded(parsed.withColumn("step", F.lit(n))), "acted")
        good = acted.where("error is null")
        asks = good.where("search_query is not null").select(F.col("question_id").alias("query_id"), F.col("search_query").alias("query"))
        # a step that asks for nothing does not read the points
        hits = chunks[0].where("false") if chunks and asks.isEmpty() else written(search(asks).withColumn("step", F.lit(n)), "hits")[0]
        steps_cnc = cnc(good.where("action = 'SEARCH_CNC'").select(F.col("question_id").alias("query_id"), "args")) if cnc else None
        seen = observed(acted, hits, sources, use_case, steps_cnc).withColumn("ends", F.col("error").isNotNull() | F.col("action").isin("FINAL_ANSWER", "CLARIFY"))
        after = F.concat("messages", F.array(message("assistant", F.col("response")), message("user", F.concat(F.lit("OBSERVATION: "), "observation"))))
        done, _ = written(seen.withColumn("messages", F.when(F.col("ends"), F.col("messages")).otherwise(after)), "step")
        stepped.append(done)
        chunks.append(hits)
        state = done.where("not ends").select(*state.columns)
        if state.isEmpty():
            break
    every = reduce(DataFrame.unionByName, stepped)
    failed = every.where("error is not null").select("question_id")
    steps = every.join(failed, "question_id", "left_anti").select(*[c for c in STEP if c != "error"])
    last = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("step")))
    ends = every.withColumn("_last", last).where("_last = 1").select("question_id", F.col("step").alias("steps"), "ends", "error", "action", "said", "question")
    pool = reduce(DataFrame.unionByName, chunks).where("rank is not null").withColumnRenamed("query_id", "question_id").join(failed, "question_id", "left_anti")
    # numbers count over all searches of a question in order
    pool = pool.withColumn("n", F.row_number().over(W.partitionBy("question_id").orderBy("step", "rank")))
    line = R.observation(F.col("n"), F.col("file_name"), F.col("page"), F.col("text"), 200)
    best = pool.where(F.col("n") <= A.FALLBACK_CHUNKS).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    looked = every.where("search_query is not null").join(failed, "question_id", "left_anti").select("question_id").distinct().withColumn("_looked", F.lit(True))
    found = pool.groupBy("question_id").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_set("collection")).alias("collections"))
    told = F.when(F.col("ends") & (F.col("action") == "FINAL_ANSWER"), F.col("said")).when(F.col("ends") & (F.col("action") == "CLARIFY"), F.col("question")).otherwise("")
    whole = questions.select("question_id").join(ends, "question_id", "left").join(best, "question_id", "left").join(found, "question_id", "left").join(looked, "question_id", "left").withColumn("_told", F.coalesce(told, F.lit("")))
    answer = F.when(F.col("_told") != "", F.col("_told")).when(F.col("_lines").isNotNull(), F.concat(F.lit(A.FOUND_HEAD), "_lines")).otherwise(A.NOTHING_FOUND)
    sufficient = F.when(F.col("_told") != "", (F.col("action") == "FINAL_ANSWER") & ~A.no_info(F.col("_told"))).otherwise(F.col("_lines").isNotNull())
    broken = F.col("error").isNotNull()
    valid = F.transform(F.sequence(F.lit(1), F.greatest(F.coalesce("n_chunks", F.lit(0)), F.lit(1))), lambda i: i.cast("long"))
    valid = F.when(F.coalesce("n_chunks", F.lit(0)) > 0, valid).otherwise(F.expr("cast(array() as array<long>)"))
    answers = whole.select(
        "question_id", F.when(broken, "").otherwise(R.strip_unresolved(clean_answer(answer), valid)).alias("answer"), F.when(broken, False).otherwise(sufficient).alias("sufficient"),
        F.coalesce("collections" if collections is None else F.when(F.col("_looked"), F.array(*[F.lit(c) for c in sorted(collections)]).cast("array<string>")), F.expr("cast(array() as array<string>)")).alias("searched_collections"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.when(broken, 0).otherwise(F.col("steps")).alias("steps"), "error",
    )
    answers, _ = written(answers, "answers")
    numbered = pool.select("question_id", F.col("n").cast("long").alias("n"), "doc_id", "file_name", "page", F.left("text", F.lit(200)).alias("excerpt"), F.col("rerank_score").alias("score"))
    return Run(steps, pool, answers, R.citations(answers, numbered, "question_id", rank="n"))
