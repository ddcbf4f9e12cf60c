"""Records of the service around the queries: log lines, audit blocks, numbers from the environment, import gates."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip

# Messages and the default prompt of the image description.
NOT_RELEASED = "Import blockiert: Snapshot wurde nicht freigegeben."
NO_ROWS = "Import abgebrochen: keine Zeilen im Snapshot."
NO_QUERY = "REFINE_QUERY benötigt eine neue Query im 'query'-Feld."
VISION_PROMPT = "Beschreibe dieses Bild präzise und sachlich in 1-3 Sätzen auf Deutsch. Konzentriere dich auf technisch relevante Inhalte: Diagramme, Schaltpläne, Maschinenteile, Tabellen, Beschriftungen. Gib NUR die Beschreibung zurück, keinen Rahmentext."
CONTEXT_CHARS = 300
# Kinds of tables that are read, and the tables of the service.
TABLE_KINDS = ("csv", "xlsx", "xls")
SCHEMAS = {
    "queries": "id string, use_case string, session_id string, role string, query_text string, answer_text string, chunks_used string, agent_steps string, scores string, sufficient boolean, created_at timestamp",
    "feedback": "id string, query_id string, rating string, comment string, created_at timestamp",
    "ingestion_log": "id string, file_name string, file_hash string, stored_path string, collection string, use_case string, chunk_count int, status string, error_detail string, created_at timestamp",
    "agent_memory": "id string, use_case string, memory_text string, version int, updated_at timestamp",
    "evaluation_runs": "id string, query_id string, reranked_chunks string, threshold_passed boolean, refined_queries string, created_at timestamp",
    "usecase_config": "use_case string, chat_provider string, embedding_provider string, vision_provider string, ollama_base_url string, ollama_api_key_encrypted string, openai_base_url string, openai_api_key_encrypted string, llm_model string, embedding_model string, vision_model string, embedding_dimension int, temperature float, max_tokens int, embed_batch_size int, agent_max_steps int, memory_max_chars int, updated_at timestamp",
    "usecase_prompts": "use_case string, prompt_key string, content string, updated_at timestamp",
    "usecase_skills": "id string, use_case string, name string, overview string, detailed_task string, enabled boolean, position int, created_at timestamp, updated_at timestamp",
}


def log_line(timestamp: Column, level: Column, service: Column, request_id: Column, message: Column, extra: Column) -> Column:
    """A log record as one line of JSON; an empty request id is null."""
    row = F.struct(timestamp.alias("timestamp"), level.alias("level"), service.alias("service"), F.nullif(request_id, F.lit("")).alias("request_id"), message.alias("message"), extra.alias("extra"))
    return F.to_json(row, {"ignoreNullFields": "false"})


def error_line(timestamp: Column, file_name: Column, error: Column, detail: Column) -> Column:
    """A file that could not be read, as one line of JSON."""
    return F.to_json(F.struct(timestamp.alias("timestamp"), file_name.alias("file_name"), error.alias("error"), detail.alias("detail")), {"ignoreNullFields": "false"})


def append_lines(lines: DataFrame, path: str) -> None:
    """Add lines (one text column) to a log; the folder grows by a file for each task."""
    lines.write.mode("append").text(path)


def append_rows(rows: DataFrame, table: str, path: str) -> None:
    """Add rows to a table of the service; columns that are missing are null, others are an error."""
    names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
    if unknown := set(rows.columns) - set(names):
        raise ValueError(f"{table} has no column {', '.join(sorted(unknown))}")
    kinds = dict(c.split() for c in SCHEMAS[table].split(", "))
    rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names]).write.mode("append").parquet(path)


def whole_number(raw: Column, default: int | None = None) -> Column:
    """An integer setting; what is not set or no integer is the default."""
    ok = raw.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$")
    return F.coalesce(F.when(ok, F.replace(F.trim(raw), F.lit("_"), F.lit("")).try_cast("bigint")), F.lit(default).cast("bigint"))


def real_number(raw: Column, default: float | None = None) -> Column:
    ok = raw.rlike(r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$")
    return F.coalesce(F.when(ok, F.replace(F.trim(raw), F.lit("_"), F.lit("")).try_cast("double")), F.lit(default).cast("double"))


def table_kind(file_name: Column) -> Column:
    """struct(kind, error): how a table's file is read."""
    ext = F.lower(F.regexp_extract(file_name, r"\.([^.]*)$", 1))
    known = ext.isin(*TABLE_KINDS)
    return F.struct(F.when(known, ext).alias("kind"), F.when(~known, F.when(ext == "", "?").otherwise(ext)).alias("error"))


def import_gate(released_at: Column, n_rows: Column, strategy: Column) -> Column:
    """struct(target, error): tables go row by row or as one file, and only if released and not empty."""
    error = F.when(released_at.isNull(), NOT_RELEASED).when(n_rows == 0, NO_ROWS)
    return F.struct(F.when(error.isNull(), F.when(strategy == "per-row", "rows").otherwise("file")).alias("target"), error.alias("error"))


def audit(model: Column, provider: Column, temperature: Column, max_tokens: Column, started: Column, finished: Column) -> Column:
    """What an answer was made with, and how long it took."""
    took = F.round((F.unix_micros(finished) - F.unix_micros(started)) / 1000).cast("bigint")
    return F.struct(model.alias("model"), provider.alias("llm_provider"), temperature.alias("temperature"), max_tokens.alias("max_tokens"), finished.alias("generated_at"), took.alias("processing_ms"))


def vision_prompt(context: Column, base: Column | None = None) -> Column:
    first = F.lit(VISION_PROMPT) if base is None else F.coalesce(F.nullif(base, F.lit("")), F.lit(VISION_PROMPT))
    return F.when(F.coalesce(context, F.lit("")) == "", first).otherwise(F.concat(first, F.lit("\n\nKontext aus dem Dokument: "), F.left(context, F.lit(CONTEXT_CHARS))))


def model_list(answer: Column) -> Column:
    """array(struct(name, id)) from a provider's JSON answer; a model without a name is called by its id."""
    data = F.from_json(answer, "struct<data:array<struct<name:string,id:string>>>")["data"]
    return F.transform(F.coalesce(data, F.array()), lambda m: F.struct(F.coalesce(m["name"], m["id"]).alias("name"), m["id"].alias("id")))


def searchable_text(metadata_text: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(metadata_text, F.lit("")), text, F.lit(""))


def candidate_id(chunk_id: Column, metadata_chunk_id: Column, row_id: Column) -> Column:
    """What a candidate is known by when rankings are fused."""
    return F.coalesce(F.nullif(chunk_id, F.lit("")), F.nullif(metadata_chunk_id, F.lit("")), row_id)


def refined(query: Column, reason: Column, observation: Column) -> Column:
    """The observation of a search with a rewritten query, under a line that says so; a blank query is refused."""
    why = strip(F.coalesce(reason, F.lit("")))
    head = F.when(why != "", F.concat(F.lit("[Verfeinerte Suche: "), why, F.lit("]\n"))).otherwise("[Verfeinerte Suche]\n")
    return F.when(strip(F.coalesce(query, F.lit(""))) == "", NO_QUERY).otherwise(F.concat(head, F.coalesce(observation, F.lit(""))))


class Kept:
    """A value that is read again once it is older than ``seconds``."""

    def __init__(self, read: Callable[[], object], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.read, self.seconds, self.clock = read, seconds, clock
        self.value, self.until = None, float("-inf")

    def get(self) -> object:
        if self.clock() >= self.until:
            self.value, self.until = self.read(), self.clock() + self.seconds
        return self.value

    def forget(self) -> None:
        self.until = float("-inf")
