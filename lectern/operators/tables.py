"""Imported tables: cells, personal data, placeholders, rewriting, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import PII
from lectern.operators.places import placed

# Types of personal data by a model's labels.
LABELS = {"private_person": "NAME", "private_email": "EMAIL", "private_phone": "PHONE", "private_address": "ADDRESS", "private_url": "URL", "private_date": "DATE", "account_number": "ACCOUNT", "secret": "SECRET"}
GENERIC = {"PER": "NAME", "PERSON": "NAME", "ORG": "ORG", "LOC": "LOC", "GPE": "LOC", "MISC": "MISC"}


def label_type(label: Column) -> Column:
    """Type of a model's label, with or without a place prefix; null if it means nothing here."""
    raw = F.regexp_replace(label, r"(?i)^[BILES]-", "")
    out = reduce(lambda o, kv: o.when(F.lower(raw) == kv[0], kv[1]), LABELS.items(), F.when(F.lit(False), ""))
    out = reduce(lambda o, kv: o.when(F.upper(raw) == kv[0], kv[1]), GENERIC.items(), out)
    return out.when(F.upper(raw).contains("ORGANIZATION"), "ORG").when(F.upper(raw).contains("LOCATION"), "LOC")


def cell_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def cells(table: DataFrame, columns: list[str], row: str) -> DataFrame:
    """(row_idx, col_idx, col_name, text) of every cell."""
    every = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col_name"), cell_text(F.col(c)).alias("text")) for i, c in enumerate(columns)])
    return table.select(F.col(row).alias("row_idx"), F.explode(every).alias("c")).select("row_idx", "c.col_idx", "c.col_name", "c.text")


def spans(text: Column) -> Column:
    """array(struct(start, end, type, text)) of personal data, by the fixed patterns; the default provider."""

    def found(label: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
        none = F.expr("cast(array() as array<struct<start:int,end:int,type:string,text:string>>)")
        start = F.struct(F.lit(0).alias("at"), none.alias("all"))

        def step(acc: Column, hit: Column) -> Column:
            begin = F.position(hit, text, acc["at"] + 1) - 1
            end = begin + F.length(hit)
            return F.struct(end.alias("at"), F.array_append(acc["all"], F.struct(begin.alias("start"), end.alias("end"), F.lit(label).alias("type"), hit.alias("text"))).alias("all"))

        return F.aggregate(hits, start, step, lambda acc: acc["all"])

    return F.concat(*[found(label, pattern) for label, pattern in PII])


def detections(found: DataFrame) -> DataFrame:
    """(row_idx, col_idx, start, end, type, text) of all cells; of overlapping spans the first."""
    rows = found.where("text <> ''").select("row_idx", "col_idx", F.explode(spans(F.col("text"))).alias("d")).select("row_idx", "col_idx", "d.*")
    before = F.max("end").over(W.partitionBy("row_idx", "col_idx").orderBy("start", F.desc("end"), "type").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_b", before).where(F.coalesce(F.col("_b"), F.lit(0)) <= F.col("start")).drop("_b")


def detection_key() -> Column:
    return F.concat_ws(":", "row_idx", "col_idx", "start", "end", "type")


def offsets(text: Column, found: Column) -> Column:
    """array(struct(start, end)) of words found by a model that gives none, each searched from the end of the last."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc: Column, w: Column) -> Column:
        at = F.position(w, text, acc["at"] + 1)
        hit = F.struct((at - 1).alias("start"), (at - 1 + F.length(w)).alias("end"))
        return F.when(at > 0, F.struct(hit["end"].alias("at"), F.array_append(acc["all"], hit).alias("all"))).otherwise(F.struct(acc["at"].alias("at"), acc["all"].alias("all")))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda acc: acc["all"])


def placeholders(approved: DataFrame) -> DataFrame:
    """(type, key, placeholder): numbers by type in the order in which cells are rewritten.

    That order is rows, columns, and spans from right to left in a cell.  Values are
    reduced to one row each before they are numbered, by a range sort over all partitions.
    """
    place = F.struct("row_idx", "col_idx", (-F.col("start")).alias("back"))
    first = approved.groupBy("type", F.lower("text").alias("key")).agg(F.min(place).alias("_p")).select("type", "key", "_p.*")
    return placed(first, ["type"], ["row_idx", "col_idx", "back", "key"], "n").select("type", "key", F.concat(F.lit("["), "type", F.lit("_"), (F.col("n") + 1).cast("string"), F.lit("]")).alias("placeholder"))


def rewritten(found: DataFrame, approved: DataFrame) -> DataFrame:
    """(row_idx, col_idx, text): cells with approved spans replaced, from right to left."""
    named = approved.withColumn("key", F.lower("text")).join(placeholders(approved), ["type", "key"])
    by_cell = named.groupBy("row_idx", "col_idx").agg(F.sort_array(F.collect_list(F.struct("start", "end", "placeholder")), asc=False).alias("_all"))
    put = F.aggregate("_all", F.col("text"), lambda s, d: F.overlay(s, d["placeholder"], d["start"] + 1, d["end"] - d["start"]))
    return found.join(by_cell, ["row_idx", "col_idx"], "left").select("row_idx", "col_idx", F.when(F.col("_all").isNull(), F.col("text")).otherwise(put).alias("text"))
