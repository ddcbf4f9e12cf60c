"""Plan, fan out, synthesize, check: a table of questions, each answered by up to three specialists.

All subtasks of all questions are one table and go through the loop of actions together. A
specialist that fails is an empty result with its error; the others of its question stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean_synthesized, strip
from lectern.operators import agents as A
from lectern.operators import ranking as R
from lectern.operators.loop import Run, Search, run_loop
from lectern.session import written


@dataclass
class Managed:
    """``plans``, ``subagents`` (a row for each subtask), ``steps`` of all, the ``pool`` of chunks and the final ``answers``."""

    plans: DataFrame
    subagents: DataFrame
    steps: DataFrame
    pool: DataFrame
    answers: DataFrame
    citations: DataFrame


def subtasks(plans: DataFrame) -> DataFrame:
    """question_id, n (from 0), subagent_id, role, sub_query, focus: a row for each subtask of the plans."""
    each = plans.select("question_id", F.posexplode("plan.subtasks").alias("n", "t"))
    return each.select("question_id", "n", F.concat(F.lit("sub-"), (F.col("n") + 1).cast("string"), F.lit("-"), "t.role").alias("subagent_id"), "t.role", "t.sub_query", "t.focus")


def role_label(role: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in A.ROLE_LABELS.items():
        out = F.when(role == name, label).otherwise(out)
    return out


def fan_out(tasks: DataFrame, chat: Callable[[Column], Column], search: Search, use_case: str, prompt: Column | None = None, collections: list[str] | None = None) -> tuple[DataFrame, Run]:
    """The subtasks with answer, sufficient, searched_collections, n_chunks, error; and the run of their loop by ``task`` ("question:n")."""
    keyed = tasks.withColumn("task", F.concat_ws(":", F.col("question_id").cast("string"), F.col("n").cast("string")))
    system = F.concat(F.coalesce(prompt if prompt is not None else F.lit(""), F.lit("")), F.lit("\n\n"), role_label(F.col("role")), F.lit("\n"), F.coalesce("focus", F.lit("")))
    run = run_loop(keyed.select(F.col("task").alias("question_id"), F.col("sub_query").alias("query"), system.alias("system")), chat, search, use_case, max_steps=A.ROLE_STEPS, collections=collections)
    got = run.answers.select(F.col("question_id").alias("task"), "answer", "sufficient", "searched_collections", "n_chunks", "error")
    return keyed.join(got, "task"), run


def concatenated(fragments: Column) -> Column:
    """Answers of specialists (label, answer) one after the other, empty ones left out."""
    some = F.filter(fragments, lambda f: f["answer"] != "")
    return F.when(F.size(some) > 0, F.array_join(F.transform(some, lambda f: F.concat(F.lit("**"), f["label"], F.lit(":** "), f["answer"])), "\n\n")).otherwise(A.NOTHING_SUPPORTED)


def rendered(fragments: Column) -> Column:
    """Fragments (label, sub_query, answer, error) as the synthesizer sees them."""
    body = lambda f: F.when(f["error"].isNotNull(), F.concat(F.lit("(Fehler: "), f["error"], F.lit(")"))).otherwise(strip(F.coalesce(F.nullif(f["answer"], F.lit("")), F.lit("(leer)"))))
    return F.array_join(F.transform(fragments, lambda f: F.concat(F.lit("--- "), f["label"], F.lit(" (Sub-Query: "), f["sub_query"], F.lit(") ---\n"), body(f))), "\n\n")


def run_manager(
    questions: DataFrame,
    plan: Callable[[Column], Column],
    chat: Callable[[Column], Column],
    search: Search,
    use_case: str,
    synthesize: Callable[[Column, Column, Column], Column] | None = None,
    comply: Callable[[Column, Column], Column] | None = None,
    collections: list[str] | None = None,
) -> Managed:
    """Final answers to ``questions`` (question_id, query).

    ``plan`` makes a plan's JSON of the query, ``synthesize`` an answer of (query, fragments,
    pool) or null where it fails, and then the fragments stand one after the other;
    ``comply`` judges (pool, answer) as JSON. An answer to rewrite is synthesized once more
    with the guidance behind the fragments, a refused one is replaced.
    """
    plans, _ = written(questions.select("question_id", "query", A.normalise_plan(plan(F.col("query")), F.col("query")).alias("plan")), "plans")
    subs, run = fan_out(subtasks(plans), chat, search, use_case, collections=collections)
    subs, _ = written(subs, "subagents")
    of = subs.select(F.col("task"), F.col("question_id").alias("whole"), F.col("n").alias("sub"))
    # three subtasks at most, each with some dozens of chunks
    chunks = run.chunks.withColumnRenamed("question_id", "task").join(of, "task").select(F.col("whole").alias("question_id"), (F.col("sub") * 1000 + F.col("n")).alias("pos"), "doc_id", "file_name", "page", "text", F.col("rerank_score").alias("score"))
    pool, _ = written(R.merged_pool(chunks, "question_id"), "pool")
    line = R.observation(F.col("rank"), F.col("file_name"), F.col("page"), F.col("text"), 400)
    lines = lambda at, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, what.alias("x")))), lambda x: x["x"]), "\n")
    pooled = pool.groupBy("question_id").agg(lines("rank", line).alias("pool"), F.count("*").alias("n_pool"))
    fragment = F.struct(role_label(F.col("role")).alias("label"), "sub_query", "answer", "error")
    merged = subs.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", fragment.alias("f")))), lambda x: x["f"]).alias("fragments"),
        F.bool_or("sufficient").alias("any_sufficient"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("searched_collections")))).alias("searched_collections"),
    )
    whole = plans.join(merged, "question_id", "left").join(pooled, "question_id", "left").withColumn("n_pool", F.coalesce("n_pool", F.lit(0)))
    fallback = F.coalesce(F.get(F.filter(F.transform("fragments", lambda f: f["answer"]), lambda a: a != ""), F.lit(0)), F.lit(A.NO_DOCUMENTS))

    def made(shown: Column) -> Column:
        text = concatenated(F.col("fragments")) if synthesize is None else F.coalesce(synthesize(F.col("query"), shown, F.col("pool")), concatenated(F.col("fragments")))
        return F.when(F.col("n_pool") == 0, fallback).otherwise(clean_synthesized(text))

    first, _ = written(whole.withColumn("answer", made(rendered(F.col("fragments")))), "synthesized")
    judged = F.lit(None).cast("string") if comply is None else comply(F.col("pool"), F.col("answer"))
    checked, _ = written(first.withColumn("_j", F.when(strip(F.col("answer")) != "", judged)).withColumns({"verdict": A.verdict(F.col("_j")), "guidance": F.coalesce(F.nullif(F.get_json_object("_j", "$.guidance"), F.lit("")), F.lit(""))}).drop("_j"), "checked")
    hint = F.concat(rendered(F.col("fragments")), F.when(F.col("guidance") != "", F.concat(F.lit("\nKORREKTUR-HINWEIS DES COMPLIANCE-AGENTEN:\n"), "guidance", F.lit("\nBerücksichtige diesen Hinweis beim Umformulieren.\n"))).otherwise(""))
    again = F.when((F.col("verdict") == "REWRITE") & (F.col("n_pool") > 0), made(hint)).when(F.col("verdict") == "REFUSE", A.REFUSED).otherwise(F.col("answer"))
    valid = F.when(F.col("n_pool") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("n_pool", F.lit(1)).cast("long")), lambda i: i)).otherwise(F.expr("cast(array() as array<long>)"))
    final = checked.withColumn("answer", again).select(
        "question_id", R.strip_unresolved(F.col("answer"), valid).alias("answer"), ((F.col("n_pool") > 0) & F.coalesce("any_sufficient", F.lit(False)) & (F.col("verdict") != "REFUSE")).alias("sufficient"),
        "verdict", F.col("n_pool").cast("long").alias("n_pool"), F.coalesce("searched_collections", F.expr("cast(array() as array<string>)")).alias("searched_collections"), F.col("plan.merge_strategy").alias("merge_strategy"),
    )
    answers, _ = written(final, "answers")
    steps = run.steps.withColumnRenamed("question_id", "task").join(of, "task").select(F.col("whole").alias("question_id"), F.col("sub").alias("n"), *[c for c in run.steps.columns if c != "question_id"])
    cited = R.citations(answers, pool.select("question_id", F.col("rank").cast("long").alias("rank"), "doc_id", "file_name", "page", F.left("text", F.lit(200)).alias("excerpt"), "score"), "question_id")
    return Managed(plans, subs, steps, pool, answers, cited)
