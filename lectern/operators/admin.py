"""Logs, configuration, prompts and skills as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Columns of a use case's configuration that override the environment.
MERGED = ("chat_provider", "embedding_provider", "vision_provider", "chat_url", "embedding_url", "chat_key", "embedding_key")
RATINGS = ("positive", "negative")


def set_(c: Column | str) -> Column:
    """Null for an empty text: both mean that nothing is set."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def resolved(base: DataFrame, rows: DataFrame, key: str = "use_case") -> DataFrame:
    """Configuration of every use case: what its row sets, over the base (one row)."""
    env = base.select(*[F.col(c).alias(f"_{c}") for c in base.columns])
    both = rows.crossJoin(F.broadcast(env.limit(1)))  # the base is one row
    return both.select(key, *[F.coalesce(set_(c), F.col(f"_{c}")).alias(c) if c in rows.columns else F.col(f"_{c}").alias(c) for c in base.columns])


def patched(rows: DataFrame, patch: DataFrame, key: str, secrets: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a patch by key: null leaves a column, '' in a secret clears it; new keys are added."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in patch.columns if c != key])
    out = [key]
    for c in rows.columns:
        if c == key:
            continue
        if c not in patch.columns:
            out.append(c)
        elif c in secrets:
            out.append(F.when(F.col(f"_{c}") == "", F.lit(None)).otherwise(F.coalesce(f"_{c}", c)).alias(c))
        else:
            out.append(F.coalesce(f"_{c}", c).alias(c))
    return rows.join(p, key, "full_outer").select(*out)


def prompt(rows: DataFrame, use_case: str, defaults: DataFrame) -> DataFrame:
    """prompt_key, content, is_override: a use case's own prompt before the one for all, before the default."""
    best = F.row_number().over(W.partitionBy("prompt_key").orderBy(F.col("use_case") == "*"))
    own = rows.where(F.col("use_case").isin(use_case, "*") & (F.col("content") != "")).withColumn("_n", best).where("_n = 1").select("prompt_key", F.col("content").alias("_own"))
    return defaults.join(own, "prompt_key", "left").select("prompt_key", F.coalesce("_own", "content").alias("content"), F.col("_own").isNotNull().alias("is_override"))


def role_prompts(asked: DataFrame, prompts: DataFrame, key: str, default: str = "default") -> DataFrame:
    """key, role, prompt for every (key, role) asked for: the role's own prompt (key, role, prompt), else that of the default role."""
    first = prompts.where(F.col("role") == default).select(key, F.col("prompt").alias("_default"))
    return asked.join(prompts, [key, "role"], "left").join(first, key, "left").select(key, "role", F.coalesce("prompt", "_default").alias("prompt"))


def last_prompts(changes: DataFrame) -> DataFrame:
    """What is left of changes in order: the last content of each key; an empty one deletes."""
    return changes.groupBy("use_case", "prompt_key").agg(F.max_by("content", "seq").alias("content")).where("content <> ''")


def skills(rows: DataFrame) -> DataFrame:
    return rows.where("enabled").orderBy("use_case", "position", "name")


def ingestion_log(entries: DataFrame) -> DataFrame:
    """One row for each file: name, use case and time of its first entry, chunks and path of its last."""
    return entries.groupBy("file_hash").agg(F.min_by("file_name", "seq").alias("file_name"), F.min_by("use_case", "seq").alias("use_case"), F.min("created_at").alias("created_at"), F.max_by("chunk_count", "seq").alias("chunk_count"), F.max_by("stored_path", "seq").alias("stored_path"))


def page_of(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)
