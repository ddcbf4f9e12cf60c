"""The whole search: embed, resolve, top k of each collection, fuse, rerank, deduplicate, show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import providers
from lectern.operators import ranking as R
from lectern.operators import vectors as V
from lectern.session import written


def resolved(points: DataFrame, wanted: str, use_case: str) -> tuple[list[str], str]:
    """The collections that a use case's search for one may read, and the message if there are none."""
    catalogue = points.select("collection").distinct()
    row = points.sparkSession.range(1).select(V.resolve_collections(catalogue, F.lit(wanted), use_case).alias("r")).first().r
    return list(row.names), row.message


#: Places of points that are sent to all tasks, some 20 MB; of more, texts are joined to them by a shuffle.
SENT_PLACES = 200_000


def those(points: DataFrame, places: DataFrame, place: list[str]) -> DataFrame:
    """The points at some places: where they are few, all points are passed by once and only these are moved."""
    places, _ = written(places, "places")
    return points.join(F.broadcast(places) if places.count() <= SENT_PLACES else places, place, "left_semi")


def found_chunks(
    points: DataFrame,
    queries: DataFrame,
    use_case: str | None = None,
    wanted: str = "",
    filters: dict | None = None,
    scorer: Callable[[DataFrame], Column] | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, doc_id, collection, file_name, page, text, score, bm25, rrf, rerank_score, label, observation, best first.

    ``points``: collection, doc_id, file_name, page, text, vector, each (collection, doc_id)
    once, as an upsert leaves them; ``queries``: query_id, query. A doc_id that lies in
    several collections is one candidate whose ranks add up. With a use case only its own
    collections are read, the wanted one or, where that is missing, all of them; a search
    that may read none gives one row for each query with the message. ``scorer`` reranks the
    best by a column of (query, text, score, bm25). ``vectors`` are the points without their
    texts, where these are written for several searches: ``points`` are then read for texts alone.

    All queries are searched in one job; each step works on fewer rows than the one
    before: 40 of each collection, 25 to the reranker, 15 out of it, 7 shown.  What is
    found goes as ids and word counts; its texts are taken out of the points once, and joined
    to the rows that are reranked.
    """
    stored = points if vectors is None else vectors
    own = stored.where(V.matching(filters or {}))
    if use_case is not None:
        names, message = resolved(stored, wanted, use_case)
        if message:
            none = F.lit(None)
            of = lambda c: none.cast(points.schema[c].dataType).alias(c)
            return queries.select("query_id", none.cast("int").alias("rank"), *[of(c) for c in ("doc_id", "collection", "file_name", "page", "text")], *[none.cast("double").alias(c) for c in ("score", "bm25", "rrf", "rerank_score")], none.cast("string").alias("label"), F.lit(message).alias("observation"))
        own = own.where(F.col("collection").isin(*names))
    place = ["collection", "doc_id"]
    asked = queries.select("query_id", providers.embed(F.col("query")).alias("qv"))
    found = V.top_k_batch(own.select("collection", "doc_id", "vector"), asked, R.SEARCH_K, "query_id", "qv", "doc_id", "vector", per=["collection"])
    # narrow rows, written since the ranking reads them several times and all points are searched for them
    pool, _ = written(found.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("collection"), F.col("rank")))).drop("rank"), "found")
    texts, _ = written(those(points.select(*place, "file_name", "page", "text"), pool.select(*place).distinct(), place), "texts")
    # each text is cut into words once, however many queries find it
    fused = R.hybrid_fuse(pool, queries, texts=texts.select(*place, "text"), text_key=place)
    few = fused.where(F.col("fused_rank") <= R.RERANK_IN).join(texts, place).join(queries.select("query_id", "query"), "query_id")
    kept = R.dedup_prefix(R.rerank(few, scorer))
    shown = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rerank_rank"))).where(F.col("rank") <= R.SHOWN)
    line = R.observation(F.col("rank"), F.col("file_name"), F.col("page"), F.col("text"))
    return shown.select("query_id", "rank", "doc_id", "collection", "file_name", "page", "text", "score", "bm25", "rrf", F.col("rerank_score").cast("double").alias("rerank_score"), F.col("relevance_label").alias("label"), line.alias("observation"))


def search(points: DataFrame, queries: DataFrame, use_case: str | None = None, wanted: str = "", filters: dict | None = None, scorer: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """query_id, rank, doc_id, collection, score, bm25, rrf, label, observation of ``found_chunks``."""
    return found_chunks(points, queries, use_case, wanted, filters, scorer).select("query_id", "rank", "doc_id", "collection", "score", "bm25", "rrf", "label", "observation")
