"""Queries on ranking, retrieval and citations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import providers
from lectern.operators import ranking as R
from lectern.operators.search import search
from lectern.plans.registry import query
from lectern.session import load

WORDS = "regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]+)', 1)"
#: Pools of the test data: documents are dealt out to the items of the benchmark, whose ids count from 0.
POOL = "d as (select doc_id % (select count(*) from benchmark) as query_id, doc_id, text, doc_id // (select count(*) from benchmark) as pos, 1.0 / (1 + doc_id % 7) as score from documents), q as (select item_id as query_id, text as query from benchmark), p as (select d.* from d join q using (query_id))"


def pool(spark, sf_dir):
    n = load(spark, sf_dir, "benchmark").count()
    d = load(spark, sf_dir, "documents").select(F.expr(f"doc_id % {max(n, 1)}").alias("query_id"), "doc_id", "text", F.expr(f"doc_id div {max(n, 1)}").alias("pos"), (F.lit(1.0) / (1 + F.col("doc_id") % 7)).alias("score"))
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return d.join(q.select("query_id"), "query_id", "left_semi"), q


BM25 = f"""{POOL}, t as (select query_id, doc_id, {WORDS.format('text')} as t from p), l as (select query_id, doc_id, len(t) as dl from t),
    st as (select query_id, count(*) as n, avg(dl) as avgdl from l group by 1),
    tf as (select query_id, doc_id, word, count(*) as tf from (select query_id, doc_id, unnest(t) as word from t) group by all),
    df as (select query_id, word, count(*) as df from tf group by all),
    i as (select query_id, word, avgdl, ln(n - df + 0.5) - ln(df + 0.5) as idf from df join st using (query_id)),
    fl as (select query_id, avg(idf) * 0.25 as fl from i group by 1),
    w as (select query_id, word, count(*) as times from (select query_id, unnest({WORDS.format('query')}) as word from q) group by all),
    s as (select tf.query_id, tf.doc_id, sum(times * case when idf < 0 then fl else idf end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as b from tf join i using (query_id, word) join fl using (query_id) join w using (query_id, word) join l using (query_id, doc_id) group by all),
    b as (select l.query_id, l.doc_id, round(coalesce(s.b, 0), 6) as bm25 from l left join s using (query_id, doc_id))"""
FUSED = f"""{BM25}, r as (select p.*, bm25, row_number() over (partition by query_id order by score desc, pos) as dense_rank, row_number() over (partition by query_id order by bm25 desc, pos) as sparse_rank from p join b using (query_id, doc_id)),
    f as (select *, round(1.0 / (60 + dense_rank) + 1.0 / (60 + sparse_rank), 9) as rrf from r), h as (select *, row_number() over (partition by query_id order by rrf desc, dense_rank) as fused_rank from f)"""


@query("rnk_tokenize", f"select doc_id, len({WORDS.format('text')})::int as n_tokens, md5(array_to_string({WORDS.format('text')}, ' ')) as digest from documents")
def rnk_tokenize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.size(R.tokens(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(R.tokens(F.col("text")), " ").cast("binary")).alias("digest"))


@query("rnk_bm25", f"with {BM25} select query_id, doc_id, round(bm25, 4) as bm25 from b")
def rnk_bm25(spark, sf_dir):
    p, q = pool(spark, sf_dir)
    return R.bm25(p, q).withColumn("bm25", F.round("bm25", 4))


@query("rnk_rrf", f"with {POOL}, r as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, pos) as rank from p union all select query_id, doc_id, row_number() over (partition by query_id order by length(text) desc, pos) from p) select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as rrf from r group by all")
def rnk_rrf(spark, sf_dir):
    p, _ = pool(spark, sf_dir)
    rank = lambda *o: p.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy(*o, "pos")).alias("rank"))
    return R.rrf(rank(F.desc("score")).unionByName(rank(F.desc(F.length("text")))))


@query("rnk_hybrid_fuse", f"with {FUSED} select query_id, doc_id, dense_rank, sparse_rank, rrf, fused_rank from h")
def rnk_hybrid_fuse(spark, sf_dir):
    return R.hybrid_fuse(*pool(spark, sf_dir)).select("query_id", "doc_id", "dense_rank", "sparse_rank", "rrf", "fused_rank")


@query("rnk_rerank_fallback", f"with {FUSED} select query_id, doc_id, fused_rank as rank, score as rerank_score, 'unranked' as relevance_label from h where fused_rank <= 15")
def rnk_rerank_fallback(spark, sf_dir):
    r = R.rerank(R.hybrid_fuse(*pool(spark, sf_dir)), None)
    return r.select("query_id", "doc_id", F.col("rerank_rank").alias("rank"), "rerank_score", "relevance_label")


@query(
    "rnk_rerank_scored",
    f"with {FUSED}, z as (select *, row_number() over (partition by query_id order by bm25 desc, fused_rank) as rank from h where fused_rank <= 25) select query_id, doc_id, rank, case when bm25 >= 3 then 'highly_relevant' when bm25 >= 0 then 'relevant' when bm25 >= -3 then 'marginally_relevant' else 'not_relevant' end as relevance_label from z where rank <= 15",
)
def rnk_rerank_scored(spark, sf_dir):
    r = R.rerank(R.hybrid_fuse(*pool(spark, sf_dir)), lambda df: F.col("bm25"))
    return r.select("query_id", "doc_id", F.col("rerank_rank").alias("rank"), "relevance_label")


@query("rnk_label", "select c_custkey, case when c_acctbal / 1000 >= 3 then 'highly_relevant' when c_acctbal / 1000 >= 0 then 'relevant' when c_acctbal / 1000 >= -3 then 'marginally_relevant' else 'not_relevant' end as label from customer")
def rnk_label(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", R.relevance(F.col("c_acctbal") / 1000).alias("label"))


@query("rnk_threshold_split", f"with {POOL} select query_id, count(*) filter (score >= 0.3) as above, count(*) filter (score < 0.3) as below, bool_or(score >= 0.3) as passed from p group by 1")
def rnk_threshold_split(spark, sf_dir):
    good = F.col("score") >= 0.3
    return pool(spark, sf_dir)[0].groupBy("query_id").agg(F.count_if(good).alias("above"), F.count_if(~good).alias("below"), F.bool_or(good).alias("passed"))


@query("rnk_dedup_prefix", "with k as (select doc_id, regexp_replace(left(text, 150), '^\\s+|\\s+$', '', 'g') as k, 0 as query_id from documents), r as (select *, row_number() over (partition by k order by doc_id) as n from k) select doc_id from r where n = 1 or k = ''")
def rnk_dedup_prefix(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("query_id"))
    return R.dedup_prefix(d, rank="doc_id").select("doc_id")


@query("rnk_observation", "select doc_id, '[' || doc_id || '] (' || source || case when doc_id % 4 > 0 then ', S. ' || doc_id % 4 else '' end || ') ' || left(text, 300) as line from documents")
def rnk_observation(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", R.observation(F.col("doc_id"), F.col("source"), F.col("doc_id") % 4, F.col("text")).alias("line"))


@query("rnk_pool_format", "select doc_id, '[' || doc_id || '] (' || source || ') ' || left(text, 400) as line from documents")
def rnk_pool_format(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", R.observation(F.col("doc_id"), F.col("source"), F.lit(None).cast("int"), F.col("text"), 400).alias("line"))


@query("rnk_sufficiency", "with n as (select conv_id, count(*) filter (length(text) / 1000.0 >= 0.5) as n from conversations group by 1) select conv_id, n >= 2 as sufficient, case when n >= 2 then n || ' Chunks über Threshold 0.5' else 'Nur ' || n || case when n = 1 then ' Chunk' else ' Chunks' end || ' über Threshold 0.5, mindestens 2 benötigt' end as reason, case when n >= 2 then 'proceed' else 'refine_query' end as recommended_action from n")
def rnk_sufficiency(spark, sf_dir):
    # messages are the hits of their conversation, a long one scores well
    return R.sufficiency(load(spark, sf_dir, "conversations").select("conv_id", (F.length("text") / 1000).alias("score")), "conv_id")


@query("rnk_refine_hint", "with t as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:5] as w, source from documents) select doc_id, array_to_string(w || list_filter([source, 'bohren'], lambda x: not list_contains(w, x)), ' ') as hint from t")
def rnk_refine_hint(spark, sf_dir):
    values = F.array("source", F.lit(None).cast("string"), F.lit("bohren"), "source")
    return load(spark, sf_dir, "documents").select("doc_id", R.refine_hint(F.col("text"), values).alias("hint"))


@query(
    "rnk_merge_chunks",
    "with d as (select doc_id // 50 as key, doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, (doc_id * 7 % 11) / 10.0 as score from documents), g as (select key, left(t, 200) as k, min(doc_id) as pos, max(score) as score from d where t <> '' group by 1, 2) select key, pos, score, row_number() over (partition by key order by pos) as rank from g",
)
def rnk_merge_chunks(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("key"), F.col("doc_id").alias("pos"), "text", ((F.col("doc_id") * 7 % 11) / 10).alias("score"))
    return R.merged_pool(d, "key").select("key", "pos", "score", "rank")


@query("cit_map", "with a as (select conv_id, turn, text, turn + 1 as rank from conversations), s as (select conv_id, max(turn) + 1 as n from conversations group by 1) select s.conv_id, o as \"order\", '[' || (o + 1) || ']' as ref, left(a.text, 200) as excerpt from s, unnest([0, 1, 2]) t(o) join a on a.conv_id = s.conv_id and a.rank = o + 1 and o + 1 <= 2")
def cit_map(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    answers = c.select("conv_id").distinct().withColumn("answer", F.lit("Erst [1], dann [02] und [2], nie [0] oder [9999]."))
    return R.citations(answers, c.select("conv_id", (F.col("turn") + 1).alias("rank"), F.left("text", F.lit(200)).alias("excerpt")), "conv_id").select("conv_id", "order", "ref", "excerpt")


@query("cit_strip_unresolved", "select conv_id, turn, case when turn % 2 = 0 then 'Laut [1] gilt das. Ende' else 'Laut [1] gilt [2] das (Quelle ).' end as answer from conversations")
def cit_strip_unresolved(spark, sf_dir):
    answer = F.when(F.col("turn") % 2 == 0, "Laut [1] gilt  [7] das (siehe [8]). Ende [99]").otherwise("Laut [1] gilt [2] das (Quelle ).")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", R.strip_unresolved(answer, F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("answer"))


@query("cit_badges", "select conv_id, turn, regexp_replace(text || ' [' || (turn + 1) || ']', '\\[(\\d+)\\]', '<span class=\"cite\">\\1</span>', 'g') as html from conversations")
def cit_badges(spark, sf_dir):
    t = F.concat("text", F.format_string(" [%d]", F.col("turn") + 1))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(t, r"\[(\d+)\]", '<span class="cite">$1</span>').alias("html"))


@query("diag_file_counts", "select source, count(*) as hits from documents group by 1")
def diag_file_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("hits"))


@query(
    "diag_retrieval",
    "with f as (select file_id, min(r) filter (lower(text) like '%the%' and lower(text) like '%that%') as rank from (select file_id, text, row_number() over (partition by doc_id // 50 order by doc_id) as r from (select *, doc_id // 50 as file_id from documents)) group by 1) select file_id, rank, case when rank is null then 'extraction' when rank > 7 then 'borderline' else 'ok' end as verdict from f",
)
def diag_retrieval(spark, sf_dir):
    low = F.lower("text")
    d = load(spark, sf_dir, "documents").withColumn("file_id", F.expr("doc_id div 50")).withColumn("r", F.row_number().over(W.partitionBy("file_id").orderBy("doc_id")))
    rank = d.groupBy("file_id").agg(F.min(F.when(low.contains("the") & low.contains("that"), F.col("r"))).alias("rank"))
    return rank.withColumn("verdict", F.when(F.col("rank").isNull(), "extraction").when(F.col("rank") > 7, "borderline").otherwise("ok"))


@query("diag_extraction", "select doc_id, length(text) as chars, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 as keyword_hits, case when length(text) < 2000 then 'nothing_extracted' when lower(text) not like '%the%' then 'content_missing' else 'chunker_drops_it' end as verdict from documents")
def diag_extraction(spark, sf_dir):
    n = F.regexp_count(F.lower("text"), F.lit("the"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), n.cast("long").alias("keyword_hits"), F.when(F.length("text") < 2000, "nothing_extracted").when(n == 0, "content_missing").otherwise("chunker_drops_it").alias("verdict"))


#: Fusion of ids that stand in several rows of a pool: three rows in four of an id's block of ten share it with others.
REPEATED = FUSED.split(", f as (select", 1)[0] + """, g as (select query_id, pos // 10 * 10 + case when pos % 4 = 0 then pos % 10 else 1 end as chunk_id, max(pos) as pos, min(dense_rank) as dense_rank, min(sparse_rank) as sparse_rank, round(sum(1.0 / (60 + dense_rank) + 1.0 / (60 + sparse_rank)), 9) as rrf from r group by 1, 2)"""


@query(
    "rnk_fuse_repeated",
    f"with {REPEATED} select g.query_id, g.chunk_id, r.doc_id, g.dense_rank, g.sparse_rank, g.rrf, row_number() over (partition by g.query_id order by g.rrf desc, g.dense_rank) as fused_rank from g join r using (query_id, pos)",
)
def rnk_fuse_repeated(spark, sf_dir):
    """Candidates that share an id: one row for each id, with what all its places add up to and the document of the last."""
    p, q = pool(spark, sf_dir)
    p = p.withColumn("chunk_id", F.expr("pos div 10 * 10 + if(pos % 4 = 0, pos % 10, 1)"))
    return R.hybrid_fuse(p, q, id_column="chunk_id").select("query_id", "chunk_id", "doc_id", "dense_rank", "sparse_rank", "rrf", "fused_rank")


# The default embedder in SQL: crc32 of the UTF-8 bytes of each word, modulo its dimension.
_SHIFTED = "range(256)"
for _ in range(8):
    _SHIFTED = f"list_transform({_SHIFTED}, lambda x: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
_BYTES = "list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::int + 1, 2))::bigint)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, {_BYTES}), lambda a, b: xor(a >> 8, c.t[(xor(a, b) & 255) + 1])), 4294967295::bigint)"
EMBEDDED = f"""crc_table as (select {_SHIFTED}::bigint[] as t),
    dw as (select doc_id, unnest({WORDS.format('text')}) as word from documents), qs as (QUERIES), qw as (select item_id, unnest({WORDS.format('text')}) as word from qs),
    voc as (select word, {_CRC} % {providers.DIMENSION} as d from (select word from dw union select word from qw), crc_table c),
    dn as (select doc_id, d, count(*) as n from dw join voc using (word) group by all), qn as (select item_id, d, count(*) as n from qw join voc using (word) group by all),
    dv as (select i.doc_id, list(coalesce(n, 0)::double order by d) as v from (select doc_id, unnest(range({providers.DIMENSION})) as d from documents) i left join dn using (doc_id, d) group by 1),
    qv as (select i.item_id, list(coalesce(n, 0)::double order by d) as v from (select item_id, unnest(range({providers.DIMENSION})) as d from qs) i left join qn using (item_id, d) group by 1)"""


@query("emb_hash_embed", f"with {EMBEDDED.replace('QUERIES', 'select item_id, text from benchmark')} select item_id, len(v)::int as dimension, array_to_string(list_transform(v, lambda x: x::bigint), ',') as counts from qv")
def emb_hash_embed(spark, sf_dir):
    """The default embedder: how many words of a text fall in each dimension."""
    v = load(spark, sf_dir, "benchmark").select("item_id", providers.embed(F.col("text")).alias("v"))
    return v.select("item_id", F.size("v").alias("dimension"), F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ",").alias("counts"))


def search_sql(points: str, scored: bool = False, queries: str = "select item_id, text from benchmark") -> str:
    """The whole search over ``points``: SQL of (collection, doc_id, file_name, page, text)."""
    embedded = EMBEDDED.replace("QUERIES", queries)
    rerank = "row_number() over (partition by query_id order by bm25 desc, fused_rank)" if scored else "fused_rank"
    label = "case when bm25 >= 3 then 'highly_relevant' when bm25 >= 0 then 'relevant' when bm25 >= -3 then 'marginally_relevant' else 'not_relevant' end" if scored else "'unranked'"
    return f"""with {embedded}, pts as ({points}),
    s as (select qv.item_id as query_id, collection, doc_id, coalesce(round(case when isnan(list_cosine_similarity(dv.v, qv.v)) then 0 else list_cosine_similarity(dv.v, qv.v) end, 6), 0) as score from pts join dv using (doc_id), qv),
    o as (select *, row_number() over (partition by query_id, collection order by score desc, doc_id) as rank from s),
    p as (select query_id, collection, doc_id, score, row_number() over (partition by query_id order by collection, rank) as pos from o where rank <= 40),
    dl as (select doc_id, len({WORDS.format('text')}) as dl from documents), dt as (select doc_id, word, count(*) as tf from dw group by all),
    st as (select query_id, count(*) as n, avg(dl) as avgdl from p join dl using (doc_id) group by 1),
    tf as (select query_id, pos, doc_id, word, tf from p join dt using (doc_id)),
    df as (select query_id, word, count(*) as df from tf group by all),
    i as (select query_id, word, avgdl, ln(n - df + 0.5) - ln(df + 0.5) as idf from df join st using (query_id)),
    fl as (select query_id, avg(idf) * 0.25 as fl from i group by 1), w as (select item_id as query_id, word, count(*) as times from qw group by all),
    z as (select tf.query_id, tf.pos, sum(times * case when idf < 0 then fl else idf end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as b from tf join w using (query_id, word) join i using (query_id, word) join fl using (query_id) join dl using (doc_id) group by all),
    r as (select p.*, round(coalesce(z.b, 0), 6) as bm25 from p left join z using (query_id, pos)),
    k as (select *, row_number() over (partition by query_id order by score desc, pos) as dense_rank, row_number() over (partition by query_id order by bm25 desc, pos) as sparse_rank from r),
    g as (select query_id, doc_id, max(pos) as pos, min(dense_rank) as dense_rank, round(sum(1.0 / (60 + dense_rank) + 1.0 / (60 + sparse_rank)), 9) as rrf from k group by 1, 2),
    h as (select g.query_id, g.doc_id, g.rrf, k.collection, k.score, k.bm25, row_number() over (partition by g.query_id order by g.rrf desc, g.dense_rank) as fused_rank from g join k using (query_id, pos)),
    x as (select *, {rerank} as place, {label} as label from h where fused_rank <= 25),
    y as (select x.*, pts.file_name, pts.page, pts.text, regexp_replace(left(pts.text, 150), '^\\s+|\\s+$', '', 'g') as k from x join pts using (collection, doc_id) where place <= 15),
    u as (select *, row_number() over (partition by query_id, k order by place) as first from y),
    v as (select *, row_number() over (partition by query_id order by place)::int as rank from u where first = 1 or k = '')
    select query_id, rank, doc_id, collection, score, bm25, rrf, label, '[' || rank || '] (' || file_name || case when page <> 0 then ', S. ' || page else '' end || ') ' || left(text, 300) as observation from v where rank <= 7"""


#: Each item whole and the first half of its text, as two queries.
HALVES = "select item_id * 2 as item_id, text from benchmark union all select item_id * 2 + 1, left(text, length(text) // 2) from benchmark"
NEAR = "coalesce(case when isnan(list_cosine_similarity({0}.v, {1}.v)) then 0 else list_cosine_similarity({0}.v, {1}.v) end, 0)"


@query(
    "diag_similarity",
    f"with {EMBEDDED.replace('QUERIES', HALVES)}, n as (select count(*) as n from benchmark), s as (select a.item_id // 2 as item_id, round({NEAR.format('a', 'h')}, 6) as near, round({NEAR.format('a', 'o')}, 6) as far from qv a join qv h on h.item_id = a.item_id + 1 join n on true join qv o on o.item_id = (a.item_id // 2 + 1) % n * 2 where a.item_id % 2 = 0) select item_id, near, far, near > 0.5 and near - far > 0.2 as healthy from s",
)
def diag_similarity(spark, sf_dir):
    """Whether an item is closer to a part of itself than to the next item."""
    from lectern.operators.vectors import dot, norm

    b = load(spark, sf_dir, "benchmark")
    n = b.count()
    e = b.select("item_id", providers.embed(F.col("text")).alias("v"), providers.embed(F.expr("left(text, length(text) div 2)")).alias("h"))
    other = e.select(((F.col("item_id") + n - 1) % n).alias("item_id"), F.col("v").alias("o"))
    # a vector without length is like nothing
    like = lambda x, y: F.round(F.when(norm(F.col(x)) * norm(F.col(y)) > 0, dot(F.col(x), F.col(y)) / (norm(F.col(x)) * norm(F.col(y)))).otherwise(0.0), 6)
    return e.join(other, "item_id").select("item_id", like("v", "h").alias("near"), like("v", "o").alias("far")).withColumn("healthy", (F.col("near") > 0.5) & (F.col("near") - F.col("far") > 0.2))


def search_points(spark, sf_dir):
    """Documents as points of a collection for each language, with the default embedder."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("wl_"), "lang").alias("collection"), "doc_id", F.col("source").alias("file_name"), (F.col("doc_id") % 5).alias("page"), "text", providers.embed(F.col("text")).alias("vector"))


def item_queries(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("search_pipeline", search_sql("select 'wl_' || lang as collection, doc_id, source as file_name, doc_id % 5 as page, text from documents"))
def search_pipeline(spark, sf_dir):
    return search(search_points(spark, sf_dir), item_queries(spark, sf_dir))


@query(
    "search_use_case",
    search_sql("select case when doc_id % 7 = 0 then 'neumann_' else 'wl_' end || lang as collection, doc_id, source as file_name, doc_id % 5 as page, text from documents where doc_id % 7 <> 0 union all select 'wl_all', doc_id, source, doc_id % 5, text from documents where doc_id % 3 = 0", True),
)
def search_use_case(spark, sf_dir):
    """A use case asks for a collection that is missing, so all its own are searched, and no others; a third of the documents lies in two of them; the best are reranked by a scorer."""
    p = search_points(spark, sf_dir)
    other = p.withColumn("collection", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("neumann_"), F.substring("collection", 4, 100))).otherwise(F.col("collection")))
    both = other.unionByName(p.where("doc_id % 3 = 0").withColumn("collection", F.lit("wl_all")))
    return search(both, item_queries(spark, sf_dir), "wiener_linien", "wl_fehlt", scorer=lambda df: F.col("bm25"))
