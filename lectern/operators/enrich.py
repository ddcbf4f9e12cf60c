"""Rule-based metadata of chunks, as plugins made of column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip, words

# Key words by label; the first label with a hit counts.
AREAS = {
    "hydraulik": ("druck", "öl", "pumpe", "ventil", "hydraulik"),
    "elektrik": ("spannung", "strom", "motor", "frequenz"),
    "mechanik": ("lager", "welle", "getriebe", "riemen"),
}
TOPICS = {
    "stoerung": ("fehler", "störung", "alarm", "warnung"),
    "wartung": ("wartung", "inspektion", "prüfung", "intervall"),
    "sicherheit": ("sicherheit", "gefahr", "schutz", "vorsicht"),
}
TECHNICAL = ("frequenz", "impedanz", "nennspannung")
# Patterns of machine code and laws, and names of operations.
CNC = r"(?i)[NGT]\d+|[GXYZFS]\s*-?[\d.]+"
SPEED = r"(?i)S\s*(\d+)"
OPERATION = r"(?i)G\s*0?([1-3]|81|83)\b"
OPERATIONS = {"1": "Linearfraesen", "2": "Kreisinterpolation", "3": "Kreisinterpolation", "81": "Bohren", "83": "Bohren"}
LAW = r"§\s*\d+\s*(Abs\.\s*\d+)?\s*[\p{L}\p{N}_]+"


def first_label(text: Column, labels: dict[str, tuple[str, ...]], default: str = "allgemein") -> Column:
    low = F.lower(text)
    return reduce(lambda out, kv: out.when(low.rlike("|".join(kv[1])), kv[0]), labels.items(), F.when(F.lit(False), "")).otherwise(default)


def area(text: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), first_label(text, AREAS))


def machine_collection(machine: Column) -> Column:
    return F.concat(F.lit("neumann_"), F.translate(F.lower(F.coalesce(machine, F.lit("unknown"))), "-", "_"))


def is_cnc(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CNC)) >= 3


def operation(text: Column) -> Column:
    code = F.regexp_extract(text, OPERATION, 1)
    return reduce(lambda out, kv: out.when(code == kv[0], kv[1]), OPERATIONS.items(), F.when(F.lit(False), "")).otherwise("unbekannt")


def cutting_speed(text: Column) -> Column:
    return F.regexp_extract(text, SPEED, 1).try_cast("long")


def cnc_collection(text: Column) -> Column:
    return F.when(is_cnc(text), "gw_cnc_steps").when(F.lower(text).contains("material"), "gw_material_info").otherwise("gw_ruest_data")


def law_ref(text: Column) -> Column:
    return strip(F.regexp_extract(text, LAW, 0))


def difficulty(text: Column) -> Column:
    n, low = F.size(words(text)), F.lower(text)
    points = [n > 200, n > 400, law_ref(text) != "", low.rlike("|".join(TECHNICAL))]
    return F.least(F.lit(1) + sum((p.cast("int") for p in points), F.lit(0)), F.lit(5))


@dataclass(frozen=True)
class Plugin:
    """The extension surface: typed columns, target collection, collections, actions."""

    name: str
    collections: tuple[str, ...]
    columns: Callable[[Column, Callable[[str], Column]], dict[str, Column]]
    collection: Callable[[Column, Callable[[str], Column]], Column]
    actions: tuple[str, ...] = ("SEARCH", "RECALL_MEMORY", "LOOKUP_SOURCES", "FINAL_ANSWER")


PLUGINS: dict[str, Plugin] = {}


def register(plugin: Plugin) -> None:
    PLUGINS[plugin.name] = plugin


def plugin(name: str) -> Plugin:
    try:
        return PLUGINS[name]
    except KeyError:
        raise ValueError(f"unknown use case {name!r}; known: {', '.join(sorted(PLUGINS))}") from None


register(Plugin("neumann", ("neumann_machines",), lambda t, raw: {"machine_id": F.coalesce(raw("machine_id"), F.lit("unknown")), "area": area(t, raw("area")), "topic": first_label(t, TOPICS)}, lambda t, raw: machine_collection(raw("machine_id"))))
register(Plugin("gw_stpoelten", ("gw_cnc_steps", "gw_ruest_data", "gw_material_info"), lambda t, raw: {"is_cnc_block": is_cnc(t), "operation_type": F.when(is_cnc(t), operation(t)), "cutting_speed": F.when(is_cnc(t), cutting_speed(t))}, lambda t, raw: cnc_collection(t), ("SEARCH", "SEARCH_CNC", "RECALL_MEMORY", "LOOKUP_SOURCES", "FINAL_ANSWER")))
register(Plugin("wiener_linien", ("wl_default",), lambda t, raw: {"audience": F.coalesce(raw("audience"), F.lit("both")), "difficulty": difficulty(t), "law_ref": law_ref(t), "criticality": F.when(law_ref(t) != "", "high").otherwise("medium")}, lambda t, raw: F.lit("wl_default"), ("SEARCH", "CLARIFY", "RECALL_MEMORY", "LOOKUP_SOURCES", "FINAL_ANSWER")))
register(Plugin("beispiel", ("beispiel_docs",), lambda t, raw: {"kategorie": F.coalesce(raw("kategorie"), F.lit("unbekannt")), "ist_wichtig": t.contains("ACHTUNG") | t.contains("WARNUNG")}, lambda t, raw: F.lit("beispiel_docs")))
register(Plugin("ustp", ("ustp_default",), lambda t, raw: {}, lambda t, raw: F.lit("ustp_default")))


def enriched(chunks: DataFrame, name: str, text: str = "text", raw: str | None = None) -> DataFrame:
    """Chunks with a plugin's columns and collection; ``raw`` names a map column with what the request brings."""
    p = plugin(name)
    take = (lambda k: F.col(raw)[k]) if raw else (lambda k: F.lit(None).cast("string"))
    return chunks.withColumns({**p.columns(F.col(text), take), "collection": p.collection(F.col(text), take)})


def merged(base: Column, raw: Column) -> Column:
    """Both maps; keys of ``raw`` win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(raw, k)), raw)
