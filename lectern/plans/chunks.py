"""Queries on chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators import chunking as C
from lectern.operators import pages as P
from lectern.plans.registry import query
from lectern.session import load

# A Markdown file for each ten documents: a title, a section for each document, page anchors.
MARKDOWN = "with p as (select doc_id // 10 as file_id, doc_id, '<!-- page:' || (doc_id % 10 + 1) || ' -->' || chr(10) || '## doc ' || doc_id || chr(10) || text as t from documents), m as (select file_id, '# file ' || file_id || chr(10) || string_agg(t, chr(10) order by doc_id) as md from p group by 1)"


def markdown(spark, sf_dir):
    part = F.concat(F.lit("<!-- page:"), (F.col("doc_id") % 10 + 1).cast("string"), F.lit(" -->\n## doc "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    rows = load(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("file_id"), "doc_id", part.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), "\n")
    return rows.groupBy("file_id").agg(F.concat(F.lit("# file "), F.col("file_id").cast("string"), F.lit("\n"), joined).alias("md"))


@query(
    "chk_boilerplate",
    r"""with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
    n as (select doc_id, t, length(regexp_replace(t, '[^\p{L}]', '', 'g')) as a, length(t) - length(replace(t, '|', '')) as p from t)
    select doc_id, case when length(t) < 30 then true when p >= 4 and a >= 40 then false when a / length(t) < 0.3 then true else length(regexp_replace(t, '\.{5,}', '', 'g')) < length(t) * 0.5 end as boilerplate from n""",
)
def chk_boilerplate(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", C.boilerplate(F.col("text")).alias("boilerplate"))


@query(
    "chk_split_pages",
    f"{MARKDOWN} select file_id, 0 as pos, null as page, md5('# file ' || file_id || chr(10)) as digest from m union all "
    "select doc_id // 10, doc_id - min(doc_id) over (partition by doc_id // 10) + 1, doc_id % 10 + 1, md5(chr(10) || '## doc ' || doc_id || chr(10) || text || case when doc_id = max(doc_id) over (partition by doc_id // 10) then '' else chr(10) end) from documents",
)
def chk_split_pages(spark, sf_dir):
    return P.split_pages(markdown(spark, sf_dir), "file_id", "md").select("file_id", "pos", "page", F.md5(F.col("text").cast("binary")).alias("digest"))


HEADS = f"""{MARKDOWN}, l as (select file_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as n from m),
    o as (select *, coalesce(sum(length(line) + 1) over (partition by file_id order by n rows between unbounded preceding and 1 preceding), 0) as off from l),
    h as (select file_id, off, length(regexp_extract(line, '^(#{{1,6}})\\s+\\S', 1)) as level, regexp_extract(line, '^#{{1,6}}\\s+(.+?)\\s*$', 1) as title from o where regexp_matches(line, '^#{{1,6}}\\s+\\S'))"""


@query("chk_heading_index", f"{HEADS} select file_id, off::bigint as off, level::bigint as level, title from h")
def chk_heading_index(spark, sf_dir):
    found = C.heading_rows(markdown(spark, sf_dir), "file_id", "md").where("level > 0")
    return found.select("file_id", F.col("off").cast("long").alias("off"), F.col("level").cast("long").alias("level"), "title")


@query("chk_breadcrumb", f"{HEADS} select file_id, off::bigint as off, case when level = 1 then title else 'file ' || file_id || ' > ' || title end as breadcrumb from h")
def chk_breadcrumb(spark, sf_dir):
    rows = C.heading_rows(markdown(spark, sf_dir), "file_id", "md").withColumn("kind", F.lit(0))
    return C.breadcrumbs(rows, "file_id").where("level > 0").select("file_id", F.col("off").cast("long").alias("off"), "breadcrumb")


@query(
    "chk_page_asof",
    "with a as (select user_id, row_number() over (partition by user_id order by event_id) as page, event_id as off from events where event_type = 'signup') "
    "select e.event_id, a.page from events e asof left join a on e.user_id = a.user_id and e.event_id >= a.off",
)
def chk_page_asof(spark, sf_dir):
    """As-of lookup as a window: the last anchor at or before each row of its group."""
    from pyspark.sql import Window as W

    e = load(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("event_id")
    anchor = F.col("event_type") == "signup"
    page = F.sum(F.when(anchor, 1).otherwise(0)).over(order)
    return e.select("event_id", F.when(page > 0, page).alias("page"))


@query("chk_sentence_pack")
def chk_sentence_pack(spark, sf_dir):
    return C.sentence_chunks(load(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "seq", "offset", "tokens", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query("chk_pipeline")
def chk_pipeline(spark, sf_dir):
    made = C.chunked(markdown(spark, sf_dir), "file_id", F.concat(F.lit("file_"), F.col("file_id").cast("string"), F.lit(".md")), "md")
    return made.select("chunk_id", "file_id", "page", "seq", "breadcrumb", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("chk_table_rows", "select p_partkey as row_index, 'p_name: ' || p_name || case when p_size % 3 = 0 then '' else chr(10) || 'p_type: ' || p_type end || chr(10) || 'p_size: ' || p_size as text from part")
def chk_table_rows(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return C.row_chunks(p.select((F.col("p_partkey") - 1).alias("n"), "p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("p_type"), "p_size"), ["p_name", "p_type", "p_size"], "n")


@query("chk_table_preview", "select n_nationkey + 1 as row_index, 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey as text from nation order by 1 limit 3")
def chk_table_preview(spark, sf_dir):
    return C.row_chunks(load(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], "n_nationkey").orderBy("row_index").limit(3)


@query("chk_embed_text", "select doc_id, case when doc_id % 3 = 0 then '[f' || doc_id || ']' || chr(10) || chr(10) when doc_id % 3 = 1 then '[f' || doc_id || ' | A > B]' || chr(10) || chr(10) else '' end || text as text from documents")
def chk_embed_text(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 != 2, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).otherwise("")
    return load(spark, sf_dir, "documents").select("doc_id", C.chunk_text(name, F.when(F.col("doc_id") % 3 == 1, "A > B"), F.col("text")).alias("text"))


@query("chk_strip_anchors", r"select doc_id, regexp_replace(regexp_replace(text, '<!--\s*[Pp]age\s*[:.]?\s*(\d+)\s*-->', '', 'g'), '^\s+|\s+$', '', 'g') as text from documents")
def chk_strip_anchors(spark, sf_dir):
    from lectern.functions.text import PAGE_ANCHOR

    return load(spark, sf_dir, "documents").select("doc_id", strip(F.regexp_replace(F.concat(F.lit("<!-- Page 3 -->"), F.col("text"), F.lit("\n<!--page: 12-->")), PAGE_ANCHOR, "")).alias("text"))
