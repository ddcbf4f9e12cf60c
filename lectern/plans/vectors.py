"""Queries on embeddings and the vector store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import vectors as V
from lectern.plans.registry import query
from lectern.providers import batch_report, embedded_batch
from lectern.session import load

# Labels of the test embeddings stand for collections.
NAMES = ("neumann_a", "neumann_b", "gw_cnc_steps", "gw_ruest_data", "gw_material_info", "wl_default", "ustp_default", "other_x")
POINTS = f"p as (select vec_id, embedding, label, list_extract([{', '.join(repr(n) for n in NAMES)}], label % 8 + 1) as collection, case when label % 8 = 7 then 'm2' else 'm1' end as embed_model, vec_id % 50 as link from embeddings)"
Q0 = "q as (select embedding as qv from embeddings where vec_id = 0)"
SCORE = "round(list_cosine_similarity(embedding::double[], qv::double[]), 6)"


def points(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in NAMES])
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", F.element_at(names, F.col("label") % 8 + 1).alias("collection"), F.when(F.col("label") % 8 == 7, "m2").otherwise("m1").alias("embed_model"), (F.col("vec_id") % 50).alias("link"))


def first_vector(spark, sf_dir):
    """The query vector: one row."""
    return load(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@query("vec_topk", f"with {POINTS}, {Q0} select vec_id, {SCORE} as score from p, q order by score desc, vec_id limit 5")
def vec_topk(spark, sf_dir):
    return V.top_k(points(spark, sf_dir), first_vector(spark, sf_dir)).select("vec_id", "score")


@query("vec_topk_filtered", f"with {POINTS}, {Q0} select vec_id, {SCORE} as score from p, q where label = 3 order by score desc, vec_id limit 5")
def vec_topk_filtered(spark, sf_dir):
    return V.top_k(points(spark, sf_dir), first_vector(spark, sf_dir), filters={"label": 3}).select("vec_id", "score")


@query(
    "vec_topk_batch",
    f"with {POINTS}, q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 20 = 0), s as (select query_id, vec_id, {SCORE} as score from p, q), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, vec_id, score, rank from r where rank <= 5",
)
def vec_topk_batch(spark, sf_dir):
    p = points(spark, sf_dir)
    queries = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return V.top_k_batch(p.select("vec_id", "embedding"), queries, 5, "query_id", "qv").select("query_id", "vec_id", "score", "rank")


@query("vec_multi_collection", f"with {POINTS}, {Q0}, s as (select collection, vec_id, {SCORE} as score from p, q where starts_with(collection, 'gw_')), r as (select *, row_number() over (partition by collection order by score desc, vec_id) as rank from s) select collection, vec_id, score, rank from r where rank <= 40")
def vec_multi_collection(spark, sf_dir):
    p = points(spark, sf_dir)
    own = p.where(V.own_collection(F.col("collection"), "gw_stpoelten")).select("collection", "vec_id", "embedding")
    q = p.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("qv"))
    return V.top_k_batch(own, q, 40, "query_id", "qv", per=["collection"]).select("collection", "vec_id", "score", "rank")


@query(
    "vec_uuid5",
    f"""with h as (select doc_id, sha1(unhex('{V.DNS}') || encode('chunk_' || doc_id)) as h from documents)
    select doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || list_extract(['8', '9', 'a', 'b'], (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1) || h[18:20] || '-' || h[21:32] as point_id from h""",
)
def vec_uuid5(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", V.point_id(F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("vec_list_collections", f'with {POINTS} select collection, count(*) as "count", max(len(embedding))::int as dimension, min(embed_model) as model from p group by 1')
def vec_list_collections(spark, sf_dir):
    return V.collections(points(spark, sf_dir))


@query("vec_tenant_collections", f"with {POINTS} select distinct collection from p where starts_with(collection, 'neumann_')")
def vec_tenant_collections(spark, sf_dir):
    return points(spark, sf_dir).where(V.own_collection(F.col("collection"), "neumann")).select("collection").distinct()


@query(
    "vec_resolve_collections",
    f"""with {POINTS}, c as (select distinct collection from p), own as (select string_agg(collection, ',' order by collection) as names from c where starts_with(collection, 'gw_')),
    w(wanted) as (values ('gw_cnc_steps'), ('gw_fehlt'), ('wl_default'), ('')) select wanted,
    case when wanted = '' then '' when wanted not in (select collection from c) then (select names from own) when not starts_with(wanted, 'gw_') then '' else wanted end as names,
    case when wanted = '' then 'Keine Collections verfügbar.' when wanted in (select collection from c) and not starts_with(wanted, 'gw_') then 'Collection ''' || wanted || ''' gehört nicht zu Use Case ''gw_stpoelten''.' else '' end as message from w""",
)
def vec_resolve_collections(spark, sf_dir):
    wanted = spark.createDataFrame([("gw_cnc_steps",), ("gw_fehlt",), ("wl_default",), ("",)], "wanted string")
    r = V.resolve_collections(V.collections(points(spark, sf_dir)), F.col("wanted"), "gw_stpoelten")
    return wanted.select("wanted", F.array_join(r["names"], ",").alias("names"), r["message"].alias("message"))


@query("vec_missing_collection", f"with {POINTS}, w(name) as (values ('gw_cnc_steps'), ('fehlt')) select name, case when name in (select collection from p) then 'ok' else 'not_found' end as status from w")
def vec_missing_collection(spark, sf_dir):
    wanted = spark.createDataFrame([("gw_cnc_steps",), ("fehlt",)], "name string")
    known = V.collections(points(spark, sf_dir)).select(F.col("collection").alias("name"), F.lit(True).alias("known"))
    return wanted.join(known, "name", "left").select("name", F.when(F.col("known"), "ok").otherwise("not_found").alias("status"))


@query("vec_model_guard", f"with {POINTS}, {Q0}, h as (select collection, embed_model, row_number() over (partition by collection order by {SCORE} desc, vec_id) as rank from p, q) select collection, embed_model as index_model, embed_model <> 'm1' as mismatch from h where rank = 1")
def vec_model_guard(spark, sf_dir):
    p = points(spark, sf_dir)
    q = p.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("qv"))
    best = V.top_k_batch(p.select("collection", "vec_id", "embedding", "embed_model"), q, 1, "query_id", "qv", per=["collection"], keep=["embed_model"])
    return best.select("collection", F.col("embed_model").alias("index_model"), (F.col("embed_model") != "m1").alias("mismatch"))


CROSS = f"""{POINTS}, {Q0}, h as (select vec_id, link, {SCORE} as score from p, q where collection = 'gw_cnc_steps' order by score desc, vec_id limit 5),
    l as (select collection, link, vec_id, {SCORE} as score, row_number() over (partition by collection, link order by {SCORE} desc, vec_id) as rank from p, q where collection in ('gw_ruest_data', 'gw_material_info'))"""


@query("vec_cross_search", f"with {CROSS} select h.vec_id as primary_id, h.score as primary_score, a.vec_id as gw_ruest_data_id, a.score as gw_ruest_data_score, b.vec_id as gw_material_info_id, b.score as gw_material_info_score from h left join l a on a.link = h.link and a.rank = 1 and a.collection = 'gw_ruest_data' left join l b on b.link = h.link and b.rank = 1 and b.collection = 'gw_material_info'")
def vec_cross_search(spark, sf_dir):
    return V.cross_search(points(spark, sf_dir), "gw_cnc_steps", ["gw_ruest_data", "gw_material_info"], first_vector(spark, sf_dir), "link")


@query("vec_cross_filtered", f"with {CROSS.replace("where collection = 'gw_cnc_steps'", "where collection = 'gw_cnc_steps' and label = 10")} select h.vec_id as primary_id, h.score as primary_score, a.vec_id as gw_ruest_data_id, a.score as gw_ruest_data_score, a.embed_model as gw_ruest_data_embed_model from h left join (select l.*, p.embed_model from l join p using (vec_id)) a on a.link = h.link and a.rank = 1 and a.collection = 'gw_ruest_data'")
def vec_cross_filtered(spark, sf_dir):
    return V.cross_search(points(spark, sf_dir), "gw_cnc_steps", ["gw_ruest_data"], first_vector(spark, sf_dir), "link", filters={"label": 10}, keep=["embed_model"])


BATCH = f"""{POINTS}, q as (select vec_id as query_id, embedding as qv, case when vec_id % 40 = 0 then 10 end as wanted from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as primary_id, link, {SCORE} as primary_score from p, q where collection = 'gw_cnc_steps' and (wanted is null or label = wanted)),
    h as (select *, row_number() over (partition by query_id order by primary_score desc, primary_id) as rank from s),
    t as (select h.query_id, h.link, collection, vec_id, embed_model, {SCORE} as score from (select distinct query_id, link from h where rank <= 5) h join q using (query_id) join p using (link) where collection in ('gw_ruest_data', 'gw_material_info')),
    l as (select *, row_number() over (partition by query_id, link, collection order by score desc, vec_id) as best from t)"""


@query(
    "vec_cross_batch",
    f"with {BATCH} select h.query_id, h.rank::int as rank, h.primary_id, h.primary_score, a.vec_id as gw_ruest_data_id, a.score as gw_ruest_data_score, a.embed_model as gw_ruest_data_embed_model, b.vec_id as gw_material_info_id, b.score as gw_material_info_score, b.embed_model as gw_material_info_embed_model from h left join l a on a.query_id = h.query_id and a.link = h.link and a.best = 1 and a.collection = 'gw_ruest_data' left join l b on b.query_id = h.query_id and b.link = h.link and b.best = 1 and b.collection = 'gw_material_info' where h.rank <= 5",
)
def vec_cross_batch(spark, sf_dir):
    """Every twentieth vector as a query to linked collections, half of them with a filter of their own."""
    p = points(spark, sf_dir)
    q = p.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.when(F.col("vec_id") % 40 == 0, F.lit(10)).cast(p.schema["label"].dataType).alias("wanted"))
    return V.cross_search_batch(p, q, "gw_cnc_steps", ["gw_ruest_data", "gw_material_info"], "link", keep=["embed_model"], match=("label", "wanted"))


@query("vec_cnc_search", f"with {CROSS}, n as (select h.*, row_number() over (order by h.score desc, h.vec_id) as i from h) select '[' || i || '] Op: op' || n.vec_id % 3 || coalesce(' | Rüst: text ' || a.vec_id, '') as line from n left join l a on a.link = n.link and a.rank = 1 and a.collection = 'gw_ruest_data'")
def vec_cnc_search(spark, sf_dir):
    from pyspark.sql import Window as W

    hits = vec_cross_search(spark, sf_dir).withColumn("i", F.row_number().over(W.orderBy(F.desc("primary_score"), "primary_id")))  # five rows
    text = F.left(F.concat(F.lit("text "), F.col("gw_ruest_data_id").cast("string")), F.lit(80))
    return hits.select(F.concat(F.format_string("[%d] Op: op%d", "i", F.col("primary_id") % 3), F.coalesce(F.concat(F.lit(" | Rüst: "), text), F.lit(""))).alias("line"))


@query("vec_lookup_sources", f"with {POINTS} select '- ' || collection || ' (' || count(*) || ' Chunks, ' || max(len(embedding)) || 'D)' as line from p where starts_with(collection, 'neumann_') group by collection")
def vec_lookup_sources(spark, sf_dir):
    c = V.collections(points(spark, sf_dir)).where(V.own_collection(F.col("collection"), "neumann"))
    return c.select(F.format_string("- %s (%d Chunks, %dD)", "collection", "count", "dimension").alias("line"))


PREFIX_ROWS = [(u, p) for u, ps in V.PREFIXES.items() for p in ps]
PREFIX_SQL = "x(use_case, prefix) as (values " + ", ".join(f"('{u}', '{p}')" for u, p in PREFIX_ROWS) + ")"


@query("vec_orphans", f"with {POINTS}, {PREFIX_SQL} select collection, count(*) as \"count\" from p where not exists (select 1 from x where starts_with(p.collection, x.prefix)) group by 1")
def vec_orphans(spark, sf_dir):
    return V.orphans(V.collections(points(spark, sf_dir)), spark.createDataFrame(PREFIX_ROWS, "use_case string, prefix string")).select("collection", "count")


@query("vec_overview", f"with {POINTS}, {PREFIX_SQL} select use_case, count(distinct collection) as collections, count(*) as chunks from p join x on starts_with(collection, prefix) group by 1")
def vec_overview(spark, sf_dir):
    c = V.collections(points(spark, sf_dir))
    x = F.broadcast(spark.createDataFrame(PREFIX_ROWS, "use_case string, prefix string"))  # a fixed table
    return c.join(x, F.expr("startswith(collection, prefix)")).groupBy("use_case").agg(F.count("*").alias("collections"), F.sum("count").alias("chunks"))


@query("vec_upsert_lww", "with b as (select vec_id % 100 as chunk_id, vec_id as seq, label from embeddings) select chunk_id, max(seq) as seq, arg_max(label, seq) as label from b group by 1")
def vec_upsert_lww(spark, sf_dir):
    b = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("chunk_id"), F.col("vec_id").alias("seq"), "label")
    return V.upsert(b, ["chunk_id"], ["seq"])


@query("vec_delete_collection", f"with {POINTS} select collection, count(*) as \"count\" from p where collection <> 'other_x' group by 1")
def vec_delete_collection(spark, sf_dir):
    return V.without_collection(points(spark, sf_dir), "other_x").groupBy("collection").agg(F.count("*").alias("count"))


@query("emb_dimension", "select vec_id, len(embedding)::int as dimension from embeddings")
def emb_dimension(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dimension"))


def sized(texts):
    """A provider of vectors that fails on some texts, and with them on the whole of what it was given."""
    if any(len(t) % 11 == 3 for t in texts):
        raise ValueError("zu schwer")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


BATCHED = "b as (select doc_id, text, row_number() over (order by doc_id) - 1 as i from documents)"


@query(
    "emb_batch_assign",
    f"with {BATCHED} select doc_id, i // 50 as batch_id, 'chunk_' || i as chunk_id, case when length(text) % 11 <> 3 then length(text) end as first, case when length(text) % 11 = 3 then 'Missing vector for chunk chunk_' || i || ': zu schwer' end as error from b",
)
def emb_batch_assign(spark, sf_dir):
    made = embedded_batch(load(spark, sf_dir, "documents").select("doc_id", "text"), sized, ["doc_id"])
    return made.select("doc_id", "batch_id", "chunk_id", F.col("vector")[0].cast("long").alias("first"), "error")


@query("emb_batch_report", f"with {BATCHED} select i // 50 as batch_id, count(*) as total, count(*) filter (length(text) % 11 <> 3) as success, count(*) filter (length(text) % 11 = 3) as failed, coalesce(string_agg('Missing vector for chunk chunk_' || i || ': zu schwer', ';' order by i) filter (length(text) % 11 = 3), '') as errors from b group by 1")
def emb_batch_report(spark, sf_dir):
    made = embedded_batch(load(spark, sf_dir, "documents").select("doc_id", "text"), sized, ["doc_id"])
    return batch_report(made).select("batch_id", "total", "success", "failed", F.array_join("errors", ";").alias("errors"))


@query("emb_cosine_pairs", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.vec_id + 1 = b.vec_id")
def emb_cosine_pairs(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    score = V.dot(F.col("x"), F.col("y")) / (V.norm(F.col("x")) * V.norm(F.col("y")) + 1e-12)
    return a.join(b, "b").select("a", "b", F.round(score, 6).alias("similarity"))
