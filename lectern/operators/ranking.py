"""Ranking: BM25, reciprocal rank fusion, reranking, deduplication, observations, sufficiency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import strip

# Parameters of BM25 and of rank fusion, and sizes of the candidate cascade.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
SEARCH_K, RERANK_IN, RERANK_OUT, SHOWN = 40, 25, 15, 7


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def word_hashes(text: Column) -> Column:
    """The words of a text in order, as 64-bit hashes."""
    return F.transform(tokens(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def bm25(pool: DataFrame, queries: DataFrame, pool_key: str = "query_id", occurrence: str = "doc_id", text: str = "text", query_text: str = "query", texts: DataFrame | None = None, text_key: list[str] | None = None) -> DataFrame:
    """pool_key, occurrence, bm25: scores of each pool's candidates for its query.

    Statistics are per pool (a pool is the candidates of one query), and each of its rows
    counts as a text of its own; negative idf values become EPSILON times the mean idf of
    the pool; query words count as often as they occur. ``occurrence`` tells the rows of a
    pool apart. ``texts`` (text_key, text) has each text once where pools share them;
    without it a pool's rows have their texts themselves. Only document frequencies need a
    row for each word; words of a text are counted for the query in the text's own row.
    """
    own = [pool_key, occurrence]
    if texts is None:
        cut = pool.select(*own, word_hashes(F.col(text)).alias("_w"))
    else:
        some = pool.select(*own, *text_key)
        cut = some.join(texts.join(some.select(*text_key).distinct(), text_key, "left_semi").select(*text_key, word_hashes(F.col(text)).alias("_w")), text_key).select(*own, "_w")
    stats = cut.groupBy(pool_key).agg(F.count("*").alias("_n"), F.avg(F.size("_w")).alias("_avgdl"))
    df = cut.select(pool_key, F.explode(F.array_distinct("_w")).alias("_word")).groupBy(pool_key, "_word").agg(F.count("*").alias("_df"))
    raw = df.join(stats, pool_key).withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    floor = raw.groupBy(pool_key).agg((F.avg("_idf") * EPSILON).alias("_floor"))
    asked = queries.select(pool_key, word_hashes(F.col(query_text)).alias("_q"))
    words = asked.select(pool_key, F.explode(F.array_distinct("_q")).alias("_word"))
    of = raw.join(words, [pool_key, "_word"]).groupBy(pool_key, "_avgdl").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_idf"))).alias("_idfs"))
    known = of.join(floor, pool_key).join(asked, pool_key)
    hits = F.filter("_w", lambda w: F.array_contains("_q", w))
    norm = K1 * (1 - B + B * F.size("_w") / F.col("_avgdl"))

    def part(w: Column) -> Column:
        tf = F.size(F.filter("_hits", lambda x: x == w))
        idf = F.element_at("_idfs", w)
        return F.when(tf > 0, F.when(idf < 0, F.col("_floor")).otherwise(idf) * tf * (K1 + 1) / (tf + F.col("_norm"))).otherwise(0.0)

    scored = cut.join(known, pool_key, "left").select(*own, "_q", "_idfs", "_floor", hits.alias("_hits"), norm.alias("_norm"))
    score = F.aggregate("_q", F.lit(0.0), lambda s, w: s + part(w))
    return scored.select(*own, F.round(F.coalesce(score, F.lit(0.0)), 6).alias("bm25"))


def rrf(rankings: DataFrame, key: str = "query_id", id_column: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Sum of 1 / (60 + rank) over the rankings that an id is in; ranks count from 1."""
    return rankings.groupBy(key, id_column).agg(F.round(F.sum(1.0 / (RRF_K + F.col(rank))), 9).alias("rrf"))


def hybrid_fuse(pool: DataFrame, queries: DataFrame, key: str = "query_id", id_column: str = "doc_id", text: str = "text", query_text: str = "query", score: str = "score", pos: str = "pos", texts: DataFrame | None = None, text_key: list[str] | None = None) -> DataFrame:
    """One row for each id of a pool, with bm25, dense_rank, sparse_rank, rrf and fused_rank.

    Rows are ranked by score and by bm25, ties in the pool's order (``pos`` tells its rows
    apart). An id that stands in several rows, such as a chunk that lies in two collections,
    adds up what all its places give in both rankings; its columns are those of its last
    row, its ranks its best. Ties of the sum keep the dense order.
    """
    # ranks are made of narrow rows; what else a pool's row has is joined to the rows that are left
    scored = pool.select(key, id_column, pos, score).join(bm25(pool, queries, key, pos, text, query_text, texts, text_key), [key, pos])
    own = W.partitionBy(key)
    ranked = scored.withColumn("dense_rank", F.row_number().over(own.orderBy(F.desc(score), pos))).withColumn("sparse_rank", F.row_number().over(own.orderBy(F.desc("bm25"), pos)))
    both = 1.0 / (RRF_K + F.col("dense_rank")) + 1.0 / (RRF_K + F.col("sparse_rank"))
    last = [F.max(pos).alias(pos), *[F.max_by(c, pos).alias(c) for c in (score, "bm25")]]
    found = ranked.groupBy(key, id_column).agg(*last, F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"), F.round(F.sum(both), 9).alias("rrf"))
    placed = found.withColumn("fused_rank", F.row_number().over(own.orderBy(F.desc("rrf"), "dense_rank")))
    rest = [c for c in pool.columns if c not in (key, id_column, pos, score)]
    return placed.join(pool.select(key, pos, *rest), [key, pos]) if rest else placed


def relevance(score: Column) -> Column:
    return F.when(score >= 3, "highly_relevant").when(score >= 0, "relevant").when(score >= -3, "marginally_relevant").otherwise("not_relevant")


def rerank(ranked: DataFrame, scorer: Callable[[DataFrame], Column] | None, key: str = "query_id", rank: str = "fused_rank", top_in: int = RERANK_IN, top_out: int = RERANK_OUT, score: str = "score") -> DataFrame:
    """The first ``top_out`` of ``top_in`` by a scorer, which sees no others; without one the order stays."""
    pool = ranked.where(F.col(rank) <= top_in)
    if scorer is None:
        return pool.where(F.col(rank) <= top_out).withColumn("rerank_score", F.col(score)).withColumn("relevance_label", F.lit("unranked")).withColumn("rerank_rank", F.col(rank))
    scored = pool.withColumn("rerank_score", scorer(pool))
    placed = scored.withColumn("rerank_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("rerank_score"), rank)))
    return placed.where(F.col("rerank_rank") <= top_out).withColumn("relevance_label", relevance(F.col("rerank_score")))


def dedup_prefix(ranked: DataFrame, text: str = "text", rank: str = "rerank_rank", key: str = "query_id", prefix: int = 150) -> DataFrame:
    """Of texts with the same first characters the best-ranked; empty ones all stay."""
    k = strip(F.left(text, F.lit(prefix)))
    first = F.row_number().over(W.partitionBy(key, k).orderBy(rank))
    return ranked.withColumn("_first", (first == 1) | (k == "")).where("_first").drop("_first")


def observation(i: Column, file_name: Column, page: Column, text: Column, cut: int = 300) -> Column:
    source = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(file_name, F.lit(", S. "), page.cast("string"))).otherwise(file_name)
    return F.concat(F.lit("["), i.cast("string"), F.lit("] ("), source, F.lit(") "), F.left(F.coalesce(text, F.lit("")), F.lit(cut)))


def merged_pool(chunks: DataFrame, key: str, text: str = "text", score: str = "score", pos: str = "pos", prefix: int = 200) -> DataFrame:
    """Chunks of several searches as one pool: place of the first, content of the best copy of each text prefix."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    rest = [c for c in chunks.columns if c not in (key, pos)]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(score, F.lit(0.0)), -F.col(pos)))
    found = chunks.where(t != "").groupBy(key, F.left(t, F.lit(prefix)).alias("_k")).agg(F.min(pos).alias(pos), best.alias("_b"))
    return found.select(key, pos, *[F.col("_b")[c].alias(c) for c in rest]).withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(pos)))


def sufficiency(hits: DataFrame, key: str, score: str = "score", least: int = 2, threshold: float = 0.5) -> DataFrame:
    """Whether enough hits score well, with the reason and what to do."""
    n = F.count_if(F.col(score) >= threshold)
    short = F.concat(F.lit("Nur "), n.cast("string"), F.when(n == 1, " Chunk").otherwise(" Chunks"), F.lit(f" über Threshold {threshold}, mindestens {least} benötigt"))
    return hits.groupBy(key).agg(
        (n >= least).alias("sufficient"),
        F.when(n >= least, F.concat(n.cast("string"), F.lit(f" Chunks über Threshold {threshold}"))).otherwise(short).alias("reason"),
        F.when(n >= least, "proceed").otherwise("refine_query").alias("recommended_action"),
    )


def refine_hint(query: Column, values: Column) -> Column:
    """The first five words of a query, then values that are not among what is there yet, in order."""
    head = F.slice(F.filter(F.split(query, r"\s+"), lambda x: x != ""), 1, 5)
    return F.array_join(F.aggregate(F.filter(values, lambda v: v.isNotNull()), head, lambda a, v: F.when(F.array_contains(a, v), a).otherwise(F.array_append(a, v))), " ")


# citations


def citation_refs(answer: Column) -> Column:
    """Numbers in square brackets, each once, in order; [01] is [1]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)]"), 1), lambda r: r.cast("long")))


def citations(answers: DataFrame, pool: DataFrame, key: str, answer: str = "answer", rank: str = "rank") -> DataFrame:
    """key, order, ref and the pool's columns for every number that is in the pool."""
    refs = answers.select(key, F.posexplode(citation_refs(F.col(answer))).alias("order", "_ref"))
    return refs.join(pool.withColumnRenamed(rank, "_ref"), [key, "_ref"]).withColumn("ref", F.format_string("[%d]", "_ref")).drop("_ref")


# What a removed number leaves open, and how it is closed up.
EMPTY_PAREN, BEFORE_PUNCTUATION, BLANKS = r"\(\s*(?:Quelle|Quellen|siehe|vgl\.?)?\s*\)", r"\s+([,.;:!?])", r"[ \t]{2,}"


def strip_unresolved(answer: Column, valid: Column) -> Column:
    """Without the numbers in brackets that are not in ``valid`` (array<long>); what that leaves open is closed up."""
    bad = F.filter(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(\[\d+])"), 1)), lambda r: ~F.array_contains(valid, F.regexp_extract(r, r"\d+", 0).cast("long")))
    cut = F.aggregate(bad, answer, lambda s, r: F.replace(s, r, F.lit("")))
    tidy = F.regexp_replace(cut, EMPTY_PAREN, "")
    tidy = F.regexp_replace(F.regexp_replace(tidy, BEFORE_PUNCTUATION, "$1"), BLANKS, " ")
    return F.when(F.size(bad) > 0, strip(tidy)).otherwise(answer)
