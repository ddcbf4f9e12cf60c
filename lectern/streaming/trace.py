"""The trace stream: events of a request folded into its sub-agents' states, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "request_id string, subagent_id string, seq long, type string, step long, text string"
STATE = "request_id string, subagent_id string, status string, last_seq long, steps long, last_text string"
# Event types that begin and end a run inside a sub-agent; the manager sends its own.
INNER = ("started", "final")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from lines of JSON; lines that are no JSON object with a request are left out."""
    return lines.select(F.from_json(column, EVENT).alias("e")).select("e.*").where(F.col("request_id").isNotNull())


def checked(events: DataFrame) -> DataFrame:
    """The same events; one of the type ``error`` ends the query with its text."""
    failed = F.when(F.col("type") == "error", F.raise_error(F.coalesce("text", F.lit("stream error"))).cast("boolean")).otherwise(F.lit(True))
    return events.where(failed)


def tagged(events: DataFrame, subagent: Column) -> DataFrame:
    """Events of sub-agents with their id; their inner begins and ends are left out."""
    return events.where(~F.col("type").isin(*INNER)).withColumn("subagent_id", subagent)


def folded(events: DataFrame) -> DataFrame:
    """State of each sub-agent: its last type, place and text that is set, and how many different steps it has."""
    return events.groupBy("request_id", "subagent_id").agg(
        F.max_by("type", "seq").alias("status"),
        F.max("seq").alias("last_seq"),
        F.countDistinct("step").alias("steps"),
        F.max_by("text", F.when(F.col("text").isNotNull(), F.col("seq"))).alias("last_text"),
    )


def durations(events: DataFrame, key: str, time: str) -> DataFrame:
    """Begin, end and milliseconds of each request."""
    return events.groupBy(key).agg(F.min(time).alias("started"), F.max(time).alias("finished"), F.floor((F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / 1000).alias("duration_ms"), F.count("*").alias("events"))


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status, last, steps, text, text_seq = state.get if state.exists else (None, -1, [], None, -1)
    seen = set(steps)
    for f in frames:
        for e in f.itertuples():
            if e.seq > last:
                status, last = e.type, int(e.seq)
            if e.text is not None and e.text == e.text and e.seq > text_seq:
                text, text_seq = e.text, int(e.seq)
            if e.step is not None and e.step == e.step:
                seen.add(int(e.step))
    state.update((status, last, sorted(seen), text, text_seq))
    yield pd.DataFrame([(*key, status, last, len(seen), text)], columns=[c.split()[0] for c in STATE.split(", ")])


def folded_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream, in update mode: each change gives a sub-agent's new state."""
    state = "status string, last long, steps array<long>, text string, text_seq long"
    return events.groupBy("request_id", "subagent_id").applyInPandasWithState(_fold, STATE, state, "update", "NoTimeout")


def read_trace(spark: SparkSession, path: str, files_at_a_time: int = 1) -> DataFrame:
    """Events from a growing directory of JSON lines."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files_at_a_time).text(path))
