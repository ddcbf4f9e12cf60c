"""Operators on agent text, plans, actions and histories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import strip, words

# Use cases with their roles, actions and default collections.
ACTIONS = ("SEARCH", "SEARCH_CNC", "REFINE_QUERY", "CLARIFY", "RECALL_MEMORY", "LOOKUP_SOURCES", "FINAL_ANSWER")
USE_CASES = {
    "gw_stpoelten": {"roles": ("default",), "actions": ACTIONS, "default_collection": "gw_cnc_steps"},
    "neumann": {"roles": ("default",), "actions": tuple(a for a in ACTIONS if a != "SEARCH_CNC"), "default_collection": "neumann_machines"},
    "ustp": {"roles": ("default",), "actions": tuple(a for a in ACTIONS if a != "SEARCH_CNC"), "default_collection": "ustp_default"},
    "wiener_linien": {"roles": ("default", "trainee"), "actions": tuple(a for a in ACTIONS if a != "SEARCH_CNC"), "default_collection": "wl_default"},
}
# How a model is told to call each action, and the head of a use case's rules.
SIGNATURES = {
    "SEARCH": 'SEARCH({"query": "...", "collection": "...", "filters": {}})',
    "SEARCH_CNC": 'SEARCH_CNC({"ruest_id": "...", "missing_tool": "..."})',
    "REFINE_QUERY": 'REFINE_QUERY({"query": "umformulierte Suchanfrage", "reason": "warum die vorherige Suche nicht reichte"})',
    "CLARIFY": 'CLARIFY({"question": "..."})',
    "RECALL_MEMORY": "RECALL_MEMORY({})",
    "LOOKUP_SOURCES": "LOOKUP_SOURCES({})",
    "FINAL_ANSWER": 'FINAL_ANSWER({"answer": "...", "extras": {}})',
}
RULES_HEAD = (
    "# Zusätzliche Regeln\n\nBeachte die folgenden Regeln bei jeder Anfrage. Wenn eine Regel greift, passe deinen Workflow entsprechend an "
    "(erweitere Schritte, brich ab, oder ändere die Antwort).\n\n"
)
ROLE_LABELS = {"facts": "Fakten", "procedure": "Prozedur", "context": "Kontext"}
ROLE_ACTIONS = ("SEARCH", "REFINE_QUERY", "FINAL_ANSWER")
DEFAULT_ROLE, SUBTASKS, SHORT_QUERY, HISTORY = "facts", 3, 8, 6
# What an answer says if the documents do not have it.
NO_INFO = (
    r"(?i)(keine\s+(?:passenden\s+|spezifischen\s+|konkreten\s+)?(?:information|informationen|angabe|angaben|hinweise|dokumente)"
    r"|nicht\s+(?:in\s+den\s+|enthalten|dokumentiert|genannt|beschrieben)"
    r"|enthalten\s+die\s+dokumente\s+keine"
    r"|liegen\s+keine\s+.*vor"
    r"|keine\s+\S+(?:\s+\S+){0,4}?\s+vorliegen"
    r"|(?:handlungsempfehlung|empfehlung|aussage|antwort)\s+nicht\s+möglich"
    r"|wurden\s+keine\s+.*gefunden)"
)
# Where a response has its thought and its action.
THOUGHT, ACTION = r"(?s)THOUGHT:\s*(.*?)(?=ACTION:|$)", r"ACTION:\s*(\w+)\("
PUNCTUATION = ".,;:!?\"'()[]„"
CONTEXT_HEAD = "Kontext aus dem Gespräch – der Benutzer hat folgende Nachrichten gesendet:\n"
CONTEXT_TAIL = "\n\nBeantworte die Frage basierend auf dem gesamten Kontext."
CORRECTED_SEARCH = "[Auto-Korrektur: SEARCH erzwungen, bevor eine Antwort gegeben wird.]"
CORRECTED_REFINE = "[Auto-Korrektur: breitere Suche erzwungen, bevor 'keine Information' zurückgegeben wird.]"
BROADER = "Erste Suche ohne belastbaren Treffer – breitere Formulierung"
NO_REFINED_QUERY = "REFINE_QUERY benötigt eine neue Query im 'query'-Feld."
NO_RESULTS = "Keine Ergebnisse in der Datenbank gefunden."
ASK_AGAIN = "Können Sie Ihre Frage präzisieren?"
NO_MEMORY = "Kein gespeicherter Kontext für diese Session."
NO_SOURCES = "Keine Collections für diesen Use Case gefunden."
FOUND_HEAD = "Basierend auf den gefundenen Dokumenten:\n\n"
NOTHING_SUPPORTED = "Es konnten keine belastbaren Informationen gefunden werden."
NO_DOCUMENTS = "Zu dieser Anfrage wurden keine passenden Dokumente gefunden."
REFUSED = "Die Antwort konnte nicht belegbar formuliert werden. Bitte präzisieren Sie Ihre Frage oder laden Sie zusätzliche Dokumente hoch."
MAX_STEPS, ROLE_STEPS, FALLBACK_CHUNKS = 5, 3, 5
NOTHING_FOUND = "Zu dieser Anfrage wurden keine passenden Dokumente gefunden. Versuchen Sie eine andere Formulierung oder laden Sie relevante Dokumente hoch."
FALLBACK_FOCUS = "Direkte Beantwortung der Originalfrage."
FALLBACK_RATIONALE = "Fallback: Manager-LLM lieferte keinen verwertbaren Plan."
MEMORY_CHARS = 4000


def no_info(answer: Column) -> Column:
    """Whether an answer says that the documents have nothing; blank ones do."""
    t = strip(F.coalesce(answer, F.lit("")))
    return (t == "") | t.rlike(NO_INFO)


def broaden(query: Column, narrowed: Column) -> Column:
    """Words of both queries, each once regardless of case and punctuation, in order."""
    every = words(F.concat(query, F.lit(" "), narrowed))
    edge = "[" + re.escape(PUNCTUATION) + "]+"
    key = lambda w: F.regexp_replace(F.lower(w), f"^{edge}|{edge}$", "")
    keys = F.transform(every, key)
    first = F.filter(F.transform(every, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (key(x["w"]) != "") & (F.array_position(keys, key(x["w"])) == x["i"] + 1))
    joined = F.array_join(F.transform(first, lambda x: x["w"]), " ")
    return F.when(joined != "", joined).otherwise(query)


def enrich_query(query: Column, user_messages: Column) -> Column:
    """A short follow-up with all user messages before it; a long one stays."""
    lines = F.concat(user_messages, F.array(query))
    made = F.concat(F.lit(CONTEXT_HEAD), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(CONTEXT_TAIL))
    return F.when((F.size(user_messages) == 0) | (F.size(words(query)) > SHORT_QUERY), query).otherwise(made)


def balanced_json(text: Column, after: Column) -> Column:
    """The first balanced {...} at or after a place (from 1), aware of strings and escapes; null if there is none."""
    begin = F.position(F.lit("{"), text, after)
    rest = F.substring(text, begin, F.length(text))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        inside = F.when(s["escaped"], s["inside"]).when(c == '"', ~s["inside"]).otherwise(s["inside"])
        plain = ~s["inside"] & ~s["escaped"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        end = F.when((s["end"] == 0) & plain & (c == "}") & (depth == 0), s["n"] + 1).otherwise(s["end"])
        return F.struct((s["n"] + 1).alias("n"), depth.alias("depth"), inside.alias("inside"), (s["inside"] & ~s["escaped"] & (c == "\\")).alias("escaped"), end.alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["end"])
    return F.when((begin > 0) & (end > 0), F.substring(rest, F.lit(1), end))


def parse_action(response: Column) -> Column:
    """struct(thought, action, args) of a model's response; without an action all of it is the final answer."""
    thought = strip(F.regexp_extract(response, THOUGHT, 1))
    name = F.regexp_extract(response, ACTION, 1)
    at = F.regexp_instr(response, F.lit(ACTION))
    args = balanced_json(response, F.greatest(at, F.lit(1)))
    return F.when(name != "", F.struct(thought.alias("thought"), name.alias("action"), F.coalesce(args, F.lit("{}")).alias("args"))).otherwise(
        F.struct(F.when(thought != "", thought).otherwise(response).alias("thought"), F.lit("FINAL_ANSWER").alias("action"), F.to_json(F.struct(response.alias("answer"))).alias("args"))
    )


def guard(action: Column, answer: Column, searched: Column, retried: Column) -> Column:
    """The action that is carried out: a search comes first; an empty answer is tried once more with a broader query."""
    return F.when(~searched & action.isin("FINAL_ANSWER", "CLARIFY"), "SEARCH").when((action == "FINAL_ANSWER") & ~retried & no_info(answer), "REFINE_QUERY").otherwise(action)


PLAN = "struct<rationale:string,merge_strategy:string,subtasks:array<struct<role:string,sub_query:string,focus:string>>>"


def normalise_plan(raw: Column, query: Column) -> Column:
    """A usable plan from a model's JSON: at most three subtasks, known roles, no blank queries; else one fact search."""
    p = F.from_json(raw, PLAN)
    blank = lambda c: F.coalesce(strip(c), F.lit(""))
    cut = F.slice(p["subtasks"], 1, SUBTASKS)
    clean = F.filter(F.transform(cut, lambda s: F.struct(F.when(s["role"].isin(*ROLE_LABELS), s["role"]).otherwise(DEFAULT_ROLE).alias("role"), blank(s["sub_query"]).alias("sub_query"), blank(s["focus"]).alias("focus"))), lambda s: s["sub_query"] != "")
    merge = F.when(p["merge_strategy"].isin("complementary", "comparative", "fallback"), p["merge_strategy"]).otherwise("complementary")
    one = F.array(F.struct(F.lit(DEFAULT_ROLE).alias("role"), query.alias("sub_query"), F.lit(FALLBACK_FOCUS).alias("focus")))
    fallback = F.struct(F.lit(FALLBACK_RATIONALE).alias("rationale"), F.lit("fallback").alias("merge_strategy"), one.alias("subtasks"))
    return F.when(F.coalesce(F.size(clean), F.lit(0)) > 0, F.struct(F.left(blank(p["rationale"]), F.lit(500)).alias("rationale"), merge.alias("merge_strategy"), clean.alias("subtasks"))).otherwise(fallback)


def filter_actions(enabled: Column) -> Column:
    kept = F.array_intersect(F.array(*[F.lit(a) for a in ROLE_ACTIONS]), enabled)
    return F.array_union(kept, F.array(F.lit("FINAL_ANSWER")))


def system_prompt(prompt: Column, actions: Column, skills: Column, suffix: Column) -> Column:
    """A use case's prompt, the signatures of its actions, its rules if there are any (array of struct(name, overview, task)), and the suffix."""
    signature = F.create_map(*[F.lit(x) for kv in SIGNATURES.items() for x in kv])
    lines = F.array_join(F.transform(F.filter(actions, lambda a: a.isin(*SIGNATURES)), lambda a: F.concat(F.lit("- "), F.element_at(signature, a))), "\n")
    rules = F.array_join(F.transform(skills, lambda s: F.concat(F.lit("## "), s["name"], F.lit(" — "), s["overview"], F.lit("\n"), strip(s["task"]), F.lit("\n\n"))), "")
    block = F.when(F.coalesce(F.size(skills), F.lit(0)) > 0, F.concat(F.lit(RULES_HEAD), F.regexp_replace(rules, r"\s+$", ""), F.lit("\n\n"))).otherwise("")
    return F.concat(prompt, F.lit("\n\nVerfügbare Actions (immer als JSON-Argument):\n"), lines, F.lit("\n\n"), block, suffix)


def verdict(raw: Column) -> Column:
    """OK, REWRITE or REFUSE from a checker's JSON; anything else passes."""
    v = F.get_json_object(raw, "$.verdict")
    return F.when(v.isin("OK", "REWRITE", "REFUSE"), v).otherwise("OK")


def history_window(messages: DataFrame, key: str, turn: str, n: int = HISTORY) -> DataFrame:
    """The last n messages of each conversation."""
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(turn)))
    return messages.withColumn("_n", last).where(F.col("_n") <= n).drop("_n")


def memory(entries: DataFrame, key: str, order: str, question: Column, answer: Column, limit: int = MEMORY_CHARS) -> DataFrame:
    """key, memory, version: entries joined in order and cut to the limit from the front, one version for each entry.

    What is full takes nothing more, so entries that begin beyond the limit are counted but not collected.
    """
    entry = F.concat(F.lit("Q: "), question, F.lit("\nA: "), F.left(answer, F.lit(500)))
    joint = "\n---\n"
    before = F.sum(F.length("_e") + len(joint)).over(W.partitionBy(key).orderBy(order, "_e").rowsBetween(W.unboundedPreceding, -1))
    placed = entries.select(key, order, entry.alias("_e")).withColumn("_at", F.coalesce(before, F.lit(0)))
    head = F.array_sort(F.collect_list(F.when(F.col("_at") < limit, F.struct(order, "_e"))))
    made = placed.groupBy(key).agg(head.alias("_all"), F.count("*").alias("version"))
    return made.select(key, F.left(F.array_join(F.transform("_all", lambda x: x["_e"]), joint), F.lit(limit)).alias("memory"), "version")
