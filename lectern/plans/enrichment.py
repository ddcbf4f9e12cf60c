"""Queries on enrichment and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import enrich as E
from lectern.plans.registry import query
from lectern.session import load



def _text():
    return F.col("text")


def docs(spark, sf_dir):
    return load(spark, sf_dir, "documents")


def sql_label(labels, default):
    return "case " + " ".join(f"when regexp_matches(lower(text), '{'|'.join(w)}') then '{k}'" for k, w in labels.items()) + f" else '{default}' end"


@query("enr_area_topic", f"select doc_id, coalesce(nullif(case when doc_id % 5 = 0 then 'vorgabe' when doc_id % 5 = 1 then '' end, ''), {sql_label(E.AREAS, 'allgemein')}) as area, {sql_label(E.TOPICS, 'allgemein')} as topic from documents")
def enr_area_topic(spark, sf_dir):
    given = F.when(F.col("doc_id") % 5 == 0, "vorgabe").when(F.col("doc_id") % 5 == 1, "")
    return docs(spark, sf_dir).select("doc_id", E.area(_text(), given).alias("area"), E.first_label(_text(), E.TOPICS).alias("topic"))


@query("enr_route_machine", "select doc_id, 'neumann_' || replace(lower(coalesce(case when doc_id % 3 > 0 then 'M-' || doc_id || '-X' end, 'unknown')), '-', '_') as collection from documents")
def enr_route_machine(spark, sf_dir):
    machine = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("M-"), F.col("doc_id").cast("string"), F.lit("-X")))
    return docs(spark, sf_dir).select("doc_id", E.machine_collection(machine).alias("collection"))


CNC = E.CNC.replace("'", "''")


@query("enr_cnc_block", f"select doc_id, len(regexp_extract_all(text, '{CNC}')) >= 3 as is_cnc from documents")
def enr_cnc_block(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", E.is_cnc(_text()).alias("is_cnc"))


OP = "case regexp_extract(text, '(?i)G\\s*0?([1-3]|81|83)\\b', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in E.OPERATIONS.items()) + " else 'unbekannt' end"


@query("enr_cnc_operation", f"select doc_id, {OP} as operation_type from (select doc_id, 'N10 G0' || doc_id % 5 || ' X1 ' || text as text from documents)")
def enr_cnc_operation(spark, sf_dir):
    t = F.concat(F.lit("N10 G0"), (F.col("doc_id") % 5).cast("string"), F.lit(" X1 "), "text")
    return docs(spark, sf_dir).select("doc_id", E.operation(t).alias("operation_type"))


@query("enr_cnc_speed", "select doc_id, try_cast(nullif(regexp_extract(text, '(?i)S\\s*(\\d+)', 1), '') as bigint) as cutting_speed from documents")
def enr_cnc_speed(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", E.cutting_speed(_text()).alias("cutting_speed"))


ROUTE = f"case when len(regexp_extract_all(text, '{CNC}')) >= 3 then 'gw_cnc_steps' when lower(text) like '%material%' then 'gw_material_info' else 'gw_ruest_data' end"


@query("enr_cnc_route", f"select doc_id, {ROUTE} as collection from documents")
def enr_cnc_route(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", E.cnc_collection(_text()).alias("collection"))


@query("enr_cnc_split", f"select collection, count(*) as chunks, count(cutting_speed) as with_speed from (select {ROUTE} as collection, case when {ROUTE} = 'gw_cnc_steps' then try_cast(nullif(regexp_extract(text, '(?i)S\\s*(\\d+)', 1), '') as bigint) end as cutting_speed from documents) group by 1")
def enr_cnc_split(spark, sf_dir):
    return E.enriched(docs(spark, sf_dir), "gw_stpoelten").groupBy("collection").agg(F.count("*").alias("chunks"), F.count("cutting_speed").alias("with_speed"))


LAWTEXT = "case when doc_id % 4 = 0 then 'Gemäß § ' || doc_id || ' Abs. 2 EisbG ' || text when doc_id % 4 = 1 then text || ' § 7 StVO' else text end"
LAW = "regexp_replace(regexp_extract(text, '§\\s*\\d+\\s*(Abs\\.\\s*\\d+)?\\s*[\\p{L}\\p{N}_]+', 0), '^\\s+|\\s+$', '', 'g')"


def law_docs(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Gemäß § "), F.col("doc_id").cast("string"), F.lit(" Abs. 2 EisbG "), "text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" § 7 StVO"))).otherwise(_text()))


@query("enr_law_ref", f"select doc_id, {LAW} as law_ref, case when {LAW} <> '' then 'high' else 'medium' end as criticality from (select doc_id, {LAWTEXT} as text from documents)")
def enr_law_ref(spark, sf_dir):
    return E.enriched(law_docs(spark, sf_dir), "wiener_linien").select("doc_id", "law_ref", "criticality")


@query(
    "enr_difficulty",
    f"""with t as (select doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n from (select doc_id, {LAWTEXT} as text from documents))
    select doc_id, least(1 + (n > 200)::int + (n > 400)::int + ({LAW} <> '')::int + regexp_matches(lower(text), 'frequenz|impedanz|nennspannung')::int, 5) as difficulty from t""",
)
def enr_difficulty(spark, sf_dir):
    return law_docs(spark, sf_dir).select("doc_id", E.difficulty(_text()).alias("difficulty"))


@query("enr_audience", "select doc_id, coalesce(case when doc_id % 2 = 0 then 'trainee' end, 'both') as audience from documents")
def enr_audience(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("audience"), F.lit("trainee"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return E.enriched(docs(spark, sf_dir).withColumn("raw", raw), "wiener_linien", raw="raw").select("doc_id", "audience")


@query("enr_warning_flag", "select doc_id, contains(text, 'ACHTUNG') or contains(text, 'WARNUNG') as ist_wichtig from (select doc_id, case when doc_id % 9 = 0 then text || ' ACHTUNG' else text end as text from documents)")
def enr_warning_flag(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" ACHTUNG"))).otherwise(_text()))
    return E.enriched(d, "beispiel").select("doc_id", "ist_wichtig")


@query("enr_passthrough", "select doc_id, source as source, case when doc_id % 2 = 0 then 'roh' else lang end as lang from documents")
def enr_passthrough(spark, sf_dir):
    base = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")
    raw = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("roh"))).otherwise(F.create_map().cast("map<string,string>"))
    m = docs(spark, sf_dir).select("doc_id", E.merged(base, raw).alias("m"))
    return m.select("doc_id", F.col("m")["source"].alias("source"), F.col("m")["lang"].alias("lang"))


@query("enr_default_collection", "select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then 'ziel' when doc_id % 3 = 1 then '' end, ''), 'gw_cnc_steps') as collection from documents")
def enr_default_collection(spark, sf_dir):
    wanted = F.when(F.col("doc_id") % 3 == 0, "ziel").when(F.col("doc_id") % 3 == 1, "")
    return docs(spark, sf_dir).select("doc_id", F.coalesce(F.nullif(wanted, F.lit("")), F.lit(E.plugin("gw_stpoelten").collections[0])).alias("collection"))


@query("ingest_group_collections", f"with g as (select {ROUTE} as collection, count(*) as n from documents group by 1) select string_agg(collection, ', ' order by collection) as collections, sum(n)::bigint as chunks from g")
def ingest_group_collections(spark, sf_dir):
    g = E.enriched(docs(spark, sf_dir), "gw_stpoelten").groupBy("collection").agg(F.count("*").alias("n"))
    return g.agg(F.array_join(F.array_sort(F.collect_list("collection")), ", ").alias("collections"), F.sum("n").alias("chunks"))


@query("ingest_payload", "select doc_id, left(text, 500) as text, sha256(text) as file_hash, 'uc/' || sha256(text)[1:2] || '/' || sha256(text)[1:12] || '_doc_' || doc_id as stored_path, source from documents")
def ingest_payload(spark, sf_dir):
    from lectern.functions.text import stored_path

    digest = F.sha2(_text(), 256)
    path = stored_path(digest, F.lit("uc"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return docs(spark, sf_dir).select("doc_id", F.left("text", F.lit(500)).alias("text"), digest.alias("file_hash"), path.alias("stored_path"), "source")


PLUGIN_ROWS = "(values " + ", ".join(f"('{p.name}', '{', '.join(p.collections)}', {len(p.actions)})" for p in E.PLUGINS.values()) + ") p(use_case, collections, actions)"


@query("cat_plugins", f"select *, (select count(*) from documents where list_extract({list(E.PLUGINS)!r}, (doc_id % 5)::int + 1) = use_case) as chunks from {PLUGIN_ROWS}")
def cat_plugins(spark, sf_dir):
    """The plugins, with the documents that are dealt to each."""
    known = spark.createDataFrame([(n, p.name, ", ".join(p.collections), len(p.actions)) for n, p in enumerate(E.PLUGINS.values())], "n long, use_case string, collections string, actions int")
    dealt = docs(spark, sf_dir).groupBy((F.col("doc_id") % 5).alias("n")).agg(F.count("*").alias("c"))
    return known.join(dealt, "n", "left").select("use_case", "collections", "actions", F.coalesce("c", F.lit(0)).cast("long").alias("chunks"))
