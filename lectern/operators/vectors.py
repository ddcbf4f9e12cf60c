"""A table of points as a vector store: ids, upserts, exact search, linked and multi-collection search.

Points: collection, point_id, chunk_id, vector array<double>, payload map or columns,
embed_model.  Search is exact.  Scores are rounded to six digits before ranking, ties
go by id, so that results are the same on any plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import written

# Fixed value: the DNS name space of version-5 identifiers.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Query rows that are sent to all tasks at a time; their vectors are some 10 MB at a thousand dimensions.
QUERY_BLOCK = 1000

#: Values of ``per`` whose best scores a task remembers; what it forgets costs rows of the shuffle, no results.
GROUPS = 100
#: Bytes of candidates that a task holds back; of more, those that are among the best so far are sent on.
HELD_BYTES = 32 << 20

# Prefixes of the collections of each use case.
PREFIXES = {"neumann": ("neumann_",), "gw_stpoelten": ("gw_",), "wiener_linien": ("wl_",), "ustp": ("ustp_",)}


def uuid5(name: Column) -> Column:
    """Version-5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(chunk_id: Column) -> Column:
    return F.when(chunk_id.rlike(UUID), F.lower(chunk_id)).otherwise(uuid5(chunk_id))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """A vector of length 1: done once at writing, a score is then a dot product."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def matching(filters: dict[str, object]) -> Column:
    """Conjunction of equalities on columns; applied before search, so k results remain."""
    return reduce(lambda a, kv: a & (F.col(kv[0]) == F.lit(kv[1])), filters.items(), F.lit(True))


def top_k(points: DataFrame, query: list[float], k: int = 5, id_column: str = "vec_id", vector: str = "embedding", filters: dict | None = None) -> DataFrame:
    """The k most similar points to one vector, best first."""
    found = points.where(matching(filters or {})).withColumn("score", F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6))
    return found.orderBy(F.desc("score"), id_column).limit(k)


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; straight from Arrow's values where none are null."""
    flat = vectors.flatten()
    if len(vectors) and not vectors.null_count and not flat.null_count and len(flat) % len(vectors) == 0:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.array(vectors.to_pylist(), np.float64)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[list[tuple]]:
    """Query rows in blocks of QUERY_BLOCK; the driver holds one block at a time."""
    held: list[tuple] = []
    for row in queries.select(*columns).toLocalIterator():
        held.append(tuple(row))
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held


def by_block(queries: DataFrame, columns: list[str], search: Callable[[list[tuple]], tuple[DataFrame, Broadcast]], empty: Callable[[], DataFrame]) -> DataFrame:
    """One table of what a search gives for each block of queries.

    One block is left to run with the caller's plan. Of more, each is written to the shared
    folder before the next is read, and its broadcast is given up.
    """
    done: list[DataFrame] = []
    blocks = query_blocks(queries, columns)
    now = next(blocks, None)
    while now is not None:
        found, sent = search(now)
        now = next(blocks, None)
        if now is None and not done:
            return found
        done.append(written(found, "searched")[0])
        sent.destroy()
    return reduce(DataFrame.unionByName, done) if done else empty()


def among_best(best: dict[tuple, np.ndarray], group: tuple, scores: np.ndarray, k: int) -> np.ndarray:
    """Which scores (points by queries) are among the k best of their query in what the group has had so far, ties included; ``best`` keeps those k."""
    if len(best) == GROUPS and group not in best:
        best.clear()
    top = np.concatenate([best[group], scores]) if group in best else scores
    best[group] = top = np.partition(top, -k, axis=0)[-k:] if len(top) > k else top
    return (scores >= (top.min(axis=0) if len(top) == k else -np.inf)) & (scores > -np.inf)


def best_rows(parts: list[pa.RecordBatch], k: int, id_column: str) -> pa.Table:
    """The k best rows of each ``_at`` (a group and a query) by score, ties by id."""
    rows = pa.Table.from_batches(parts)
    rows = rows.take(pc.sort_indices(rows, [("_at", "ascending"), ("score", "descending"), (id_column, "ascending")], null_placement="at_start"))
    at = rows["_at"].to_numpy()
    return rows.filter(pa.array(np.arange(len(at)) - np.searchsorted(at, at) < k))


def top_k_batch(
    points: DataFrame, queries: DataFrame, k: int, query_id: str, query_vector: str, id_column: str = "vec_id", vector: str = "embedding", per: list[str] | None = None, keep: list[str] | None = None, match: tuple[str, str] | None = None
) -> DataFrame:
    """query_id, id, score, rank (and the ``per`` and ``keep`` columns) of the k most similar points for each query and each value of ``per``.

    Queries are sent to all points in blocks of QUERY_BLOCK rows.  A batch of points is
    scored by one matrix product, and what is among the best k for a query of all that its
    task has seen is held back until the task ends (HELD_BYTES): k rows for each query and
    group go on to the shuffle, however many points tie.  Vectors without length score 0.
    ``match`` names a column of the points and one of the queries that must be equal; a
    query without a value takes all points.
    """
    group, more = per or [], keep or []
    types = {f.name: f.dataType.simpleString() for f in points.schema} | {query_id: queries.schema[query_id].dataType.simpleString()}
    names = [query_id, id_column, *group, *more]
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", score double"
    kind = pa.int64() if types[query_id] in ("int", "bigint") else pa.string()
    schema = schema.replace(f"{query_id} int,", f"{query_id} bigint,")
    compared = [match[0]] if match else []

    def searched(block: list[tuple]) -> tuple[DataFrame, Broadcast]:
        wanted = unit_rows(np.array([r[1] for r in block], np.float64))
        shared = points.sparkSession.sparkContext.broadcast(([r[0] for r in block], wanted, [r[2] for r in block] if match else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, matrix, values = shared.value
            best: dict[tuple, np.ndarray] = {}
            codes: dict[tuple, int] = {}
            held: list[pa.RecordBatch] = []
            size = 0

            def sent(rows: pa.Table) -> Iterator[pa.RecordBatch]:
                asked = pa.array(of, kind).take(pa.array(rows["_at"].to_numpy() % len(of)))
                yield from pa.table([asked, *rows.columns[1:]], names=[*names, "score"]).to_batches(max_chunksize=10_000)

            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    score = np.round(unit_rows(matrix_of(part.column(part.num_columns - 1))) @ matrix.T, 6)
                    if values is not None:
                        own = np.array(part.column(part.num_columns - 2).to_pylist(), object)
                        apart = own[:, None] != np.array(values, object)[None, :]
                        score[apart & np.array([v is not None for v in values])[None, :]] = -np.inf
                    columns = [part.column(1 + i).to_pylist() for i in range(len(group))]
                    members: dict[tuple, list[int]] = {}
                    for i, g in enumerate(zip(*columns, strict=True) if group else [()] * part.num_rows):
                        members.setdefault(g, []).append(i)
                    for g, at in members.items():
                        s = score[at]
                        r, q = np.nonzero(among_best(best, g, s, k))
                        if not len(r):
                            continue
                        take = pa.array(np.array(at)[r])
                        place = codes.setdefault(g, len(codes)) * len(of) + q
                        held.append(pa.RecordBatch.from_arrays([pa.array(place), *(part.column(i).take(take) for i in range(1 + len(group) + len(more))), pa.array(s[r, q])], names=["_at", *names[1:], "score"]))
                        size += held[-1].nbytes
                        if size > HELD_BYTES:
                            rows = best_rows(held, k, id_column)
                            held, size = rows.to_batches(), rows.nbytes
                            if size > HELD_BYTES // 2:
                                yield from sent(rows)
                                held, size = [], 0
            if held:
                yield from sent(best_rows(held, k, id_column))

        found = points.select(id_column, *group, *more, *compared, vector).mapInArrow(run, schema)
        rank = F.row_number().over(W.partitionBy(query_id, *group).orderBy(F.desc("score"), id_column))
        return found.withColumn("rank", rank).where(F.col("rank") <= k), shared

    columns = [query_id, query_vector] + ([match[1]] if match else [])
    return by_block(queries, columns, searched, lambda: points.sparkSession.createDataFrame([], schema + ", rank int"))


def upsert(batches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return batches.withColumn("_n", last).where("_n = 1").drop("_n")


def upserted(points: DataFrame | None, batch: DataFrame, collection: str, embed_model: str | None = None) -> DataFrame:
    """collection, point_id, chunk_id, vector, payload, seq: a store with a batch (chunk_id, vector, metadata, seq) written to it.

    A missing collection is made by its first points, an empty batch changes nothing, and the last row of an id
    stays. In a payload the model's stamp goes over the metadata, and the chunk id over both.
    """
    stamp = F.create_map(F.lit("_embed_model"), F.lit(embed_model)) if embed_model else F.create_map().cast("map<string,string>")
    over = ["chunk_id"] + ["_embed_model"] * bool(embed_model)
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*over))
    made = batch.select(F.lit(collection).alias("collection"), point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "vector", F.map_concat(own, stamp, F.create_map(F.lit("chunk_id"), F.col("chunk_id"))).alias("payload"), "seq")
    if points is None:
        return upsert(made, ["collection", "point_id"], ["seq"])
    # what is written now is later than anything that is there
    both = points.withColumn("_late", F.lit(0)).unionByName(made.withColumn("_late", F.lit(1)))
    return upsert(both, ["collection", "point_id"], ["_late", "seq"]).drop("_late")


def without_collection(points: DataFrame, name: str) -> DataFrame:
    """The store without a collection; a missing one is an error."""
    if points.where(F.col("collection") == name).limit(1).count() == 0:
        raise ValueError(f"Collection '{name}' not found")
    return points.where(F.col("collection") != name)


def collections(points: DataFrame, vector: str = "embedding", model: str = "embed_model") -> DataFrame:
    """collection, count, dimension and a model of each collection."""
    return points.groupBy("collection").agg(F.count("*").alias("count"), F.max(F.size(vector)).alias("dimension"), F.min(model).alias("model"))


def prefixes(use_case: str) -> tuple[str, ...]:
    return PREFIXES.get(use_case, (use_case + "_",))


def own_collection(name: Column, use_case: str) -> Column:
    return reduce(lambda a, p: a | name.startswith(p), prefixes(use_case), F.lit(False))


def resolve_collections(catalogue: DataFrame, wanted: Column, use_case: str) -> Column:
    """struct(names, message): what a search for the wanted collection may read.

    A collection that exists and is the use case's own is taken; a missing one stands
    for all own ones; another's is refused. The catalogue has a row for each collection.
    """
    names = [r[0] for r in catalogue.select("collection").distinct().orderBy("collection").collect()]
    every = F.array(*[F.lit(n) for n in names]) if names else F.expr("cast(array() as array<string>)")
    own = F.filter(every, lambda n: own_collection(n, use_case))
    none = F.slice(every, 1, 0)
    quoted = F.concat(F.lit("'"), wanted, F.lit("'"))
    return (
        F.when(F.coalesce(wanted, F.lit("")) == "", F.struct(none.alias("names"), F.lit("Keine Collections verfügbar.").alias("message")))
        .when(~F.array_contains(every, wanted) & (F.size(own) == 0), F.struct(none.alias("names"), F.lit(f"Keine Collections für Use Case '{use_case}' gefunden.").alias("message")))
        .when(~F.array_contains(every, wanted), F.struct(own.alias("names"), F.lit("").alias("message")))
        .when(~own_collection(wanted, use_case), F.struct(none.alias("names"), F.concat(F.lit("Collection "), quoted, F.lit(f" gehört nicht zu Use Case '{use_case}'.")).alias("message")))
        .otherwise(F.struct(F.array(wanted).alias("names"), F.lit("").alias("message")))
    )


def cross_search(points: DataFrame, primary: str, linked: list[str], query: list[float], link_key: str, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", filters: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """The top k of a collection (those that the filters leave), each with the best point of the same link key in every
    linked collection, its score and the ``keep`` columns of its payload; null where there is no key, match or collection.

    A left lateral top-1 join: linked points are scored once and reduced by key before the join.
    """
    more = keep or []
    hits = top_k(points.where(F.col("collection") == primary), query, k, id_column, vector, filters).select(F.col(id_column).alias("primary_id"), F.col("score").alias("primary_score"), F.col(link_key).alias("_key"))
    scored = points.where(F.col("collection").isin(*linked) & F.col(link_key).isNotNull()).withColumn("score", F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6))
    best = scored.groupBy("collection", F.col(link_key).alias("_key")).agg(F.max_by(F.struct(F.col(id_column).alias("id"), "score", *more), F.struct("score", -F.col(id_column))).alias("hit"))
    wide = best.groupBy("_key").pivot("collection", linked).agg(F.first("hit"))
    return hits.join(wide, "_key", "left").select("primary_id", "primary_score", *[F.col(c)[x].alias(f"{c}_{x}") for c in linked for x in ("id", "score", *more)])


def cross_search_batch(
    points: DataFrame, queries: DataFrame, primary: str, linked: list[str], link_key: str, k: int = 5, query_id: str = "query_id", query_vector: str = "qv",
    id_column: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, match: tuple[str, str] | None = None,
) -> DataFrame:
    """``cross_search`` for a table of queries: query_id, rank, primary_id, primary_score, and for each linked collection the best point of the same link key.

    A batched lateral top-1 join. A block of queries is first searched in the primary
    collection (with ``match``, see ``top_k_batch``); its hits, k for each query, are sent to
    the linked points, of which a batch is scored key by key for those queries alone that
    hit the key; one row for each (query, collection, key) and batch goes on to the shuffle.
    """
    spark, more = points.sparkSession, keep or []
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    kind = queries.schema[query_id].dataType.simpleString().replace("int", "bigint").replace("bigbigint", "bigint")
    id_kind = pa.int64() if kind == "bigint" else pa.string()
    first = points.where(F.col("collection") == primary)
    others = points.where(F.col("collection").isin(*linked) & F.col(link_key).isNotNull())
    schema = f"{query_id} {kind}, collection string, {link_key} {types[link_key]}, {id_column} {types[id_column]}, " + "".join(f"{c} {types[c]}, " for c in more) + "score double"

    def searched(block: list[tuple]) -> tuple[DataFrame, Broadcast]:
        asked = spark.createDataFrame(block, queries.select(*columns).schema)
        hits, _ = written(top_k_batch(first, asked, k, query_id, query_vector, id_column, vector, keep=[link_key], match=match), "primary")
        by_key: dict = {}
        for r in hits.select(query_id, link_key).where(F.col(link_key).isNotNull()).distinct().collect():  # k rows for each query of the block
            by_key.setdefault(r[1], []).append(r[0])
        place = {r[0]: i for i, r in enumerate(block)}
        shared = spark.sparkContext.broadcast(({key: [place[q] for q in qs] for key, qs in by_key.items()}, [r[0] for r in block], unit_rows(np.array([r[1] for r in block], np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, of, matrix = shared.value
            for batch in batches:
                members: dict[tuple, list[int]] = {}
                for i, (c, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    if key in keys:
                        members.setdefault((c, key), []).append(i)
                if not members:
                    continue
                rows = unit_rows(matrix_of(batch.column(batch.num_columns - 1)))
                at, who, scores = [], [], []
                for (_, key), some in members.items():
                    asked_by = keys[key]
                    score = np.round(rows[some] @ matrix[asked_by].T, 6)
                    # all that tie for the best go on; ids decide behind the shuffle
                    r, q = np.nonzero(score >= score.max(axis=0))
                    at += [some[i] for i in r]
                    who += [of[asked_by[i]] for i in q]
                    scores += score[r, q].tolist()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(who, id_kind), *(batch.column(i).take(take) for i in range(batch.num_columns - 1)), pa.array(scores, pa.float64())], names=[query_id, *batch.schema.names[:-1], "score"])

        found = others.select("collection", link_key, id_column, *more, vector).mapInArrow(run, schema)
        best = found.groupBy(query_id, link_key, "collection").agg(F.max_by(F.struct(F.col(id_column).alias("id"), "score", *more), F.struct("score", -F.col(id_column))).alias("hit"))
        wide = best.groupBy(query_id, link_key).pivot("collection", linked).agg(F.first("hit"))
        joined = hits.join(wide, [query_id, link_key], "left")
        return joined.select(query_id, "rank", F.col(id_column).alias("primary_id"), F.col("score").alias("primary_score"), *[F.col(c)[x].alias(f"{c}_{x}") for c in linked for x in ("id", "score", *more)]), shared

    columns = [query_id, query_vector] + ([match[1]] if match else [])
    named = ", ".join(f"{c}_{x} {'double' if x == 'score' else types[id_column if x == 'id' else x]}" for c in linked for x in ("id", "score", *more))
    return by_block(queries, columns, searched, lambda: spark.createDataFrame([], f"{query_id} {kind}, rank int, primary_id {types[id_column]}, primary_score double, {named}"))


# The collections of a search for machining steps, the key that links them, and how many are shown.
CNC_STEPS, CNC_LINKED, CNC_KEY, CNC_SHOWN = "gw_cnc_steps", ("gw_ruest_data", "gw_material_info"), "cnc_step_id", 5
CNC_NONE = "Keine CNC-Schritte gefunden."


def cnc_observations(points: DataFrame, asked: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """query_id and observation of machining-step searches (query_id, ruest_id, missing_tool), all in one job.

    ``points``: collection, point_id, vector, cnc_step_id, ruest_map_id, operation_type,
    cutting_speed, text. A question that names a set-up map takes only its steps; one
    without hits says so.
    """
    text = F.concat(F.lit("CNC Rüstung "), F.coalesce("ruest_id", F.lit("")), F.lit(" "), F.coalesce("missing_tool", F.lit("")))
    queries = asked.select("query_id", embed(text).alias("qv"), F.nullif("ruest_id", F.lit("")).alias("ruest"))
    found = cross_search_batch(points, queries, CNC_STEPS, list(CNC_LINKED), CNC_KEY, CNC_SHOWN, id_column="point_id", vector="vector", keep=["text"], match=("ruest_map_id", "ruest"))
    about = points.where(F.col("collection") == CNC_STEPS).select(F.col("point_id").alias("primary_id"), "operation_type", "cutting_speed")
    known = found.join(about, "primary_id")
    part = lambda label, c: F.coalesce(F.concat(F.lit(f" | {label}: "), F.left(F.when(F.col(f"{c}_id").isNotNull(), F.coalesce(f"{c}_text", F.lit(""))), F.lit(80))), F.lit(""))
    line = F.concat(F.format_string("[%d] Op: %s, Speed: %s", "rank", F.coalesce("operation_type", F.lit("?")), F.coalesce(F.col("cutting_speed").cast("string"), F.lit("?"))), part("Rüst", CNC_LINKED[0]), part("Material", CNC_LINKED[1]))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    shown = known.groupBy("query_id").agg(F.array_join(F.concat(F.array(F.format_string("Gefunden: %d ähnliche CNC-Schritte", F.count("*"))), lines), "\n").alias("observation"))
    return asked.select("query_id").join(shown, "query_id", "left").select("query_id", F.coalesce("observation", F.lit(CNC_NONE)).alias("observation"))


def orphans(catalogue: DataFrame, prefix_table: DataFrame) -> DataFrame:
    """Collections that belong to no use case."""
    return catalogue.join(F.broadcast(prefix_table), F.expr("startswith(collection, prefix)"), "left_anti")
