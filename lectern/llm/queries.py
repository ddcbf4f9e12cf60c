"""One query for each corpus operator, applied to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, jaccard, media, merkle, personal, quality, rolling, secrets, sql, suffixes, tokenfiles, toxicity
from .common import documents, fresh_path, table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    tokenfiles.write_token_files(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), path, end=0)
    return tokenfiles.read_token_files(spark, path)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    media.write_archives(documents(spark, sf_dir), path)
    return media.read_features(spark, path)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir), k=3, num=90, den=100)


def op10_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recovered_turns(table(spark, sf_dir, "conversations"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(documents(spark, sf_dir))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(documents(spark, sf_dir))


def op13_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_features(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_media": op7_media,
    "op8_secret_scan": op8_secret_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_turns": op10_chat_turns,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_personal_data": op12_personal_data,
    "op13_rolling_features": op13_rolling_features,
}

ORACLES: dict[str, str] = {"op11_merkle_manifest": sql.OP11, "op13_rolling_features": sql.OP13}
