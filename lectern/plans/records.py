"""Queries on log lines, settings, import gates and other records of the service."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import records as R
from lectern.operators import vectors as V
from lectern.plans.registry import query
from lectern.plans.sources import KNOWN, NAMED
from lectern.session import fresh_path, load
from lectern.sources import files as S


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("log_json_line", "select event_id, to_json({timestamp: strftime(ts, '%Y-%m-%dT%H:%M:%S'), level: case event_type when 'error' then 'ERROR' else 'INFO' end, service: 'evaluation', request_id: user_id::varchar, message: event_type, extra: {event_id: event_id}})::varchar as line from events")
def log_json_line(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = R.log_line(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), level, F.lit("evaluation"), F.col("user_id").cast("string"), F.col("event_type"), F.struct("event_id"))
    return e.select("event_id", line.alias("line"))


@query("sink_error_log", f"with {NAMED}, e as (select doc_id, file_name, lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) as ext from n) select doc_id, to_json({{timestamp: 't' || doc_id, file_name: file_name, error: 'unsupported_format', detail: 'Unsupported format ''' || ext || '''. Supported: .csv, .docx, .md, .pdf, .txt'}})::varchar as line from e where ext not in {KNOWN}")
def sink_error_log(spark, sf_dir):
    bad = S.dispatched(S.named_files(load(spark, sf_dir, "documents"))).where(~F.col("supported"))
    line = R.error_line(F.concat(F.lit("t"), F.col("doc_id").cast("string")), F.col("file_name"), F.lit("unsupported_format"), F.col("error"))
    return bad.select("doc_id", line.alias("line"))


@query("sink_resolve_path", "with s as (select distinct 'uc/' || sha256(text)[1:2] || '/' || sha256(text)[1:12] || '_' || doc_id as path from documents join labels using (doc_id)), w as (select doc_id, 'uc/' || sha256(text)[1:2] || '/' || sha256(text)[1:12] || '_' || doc_id as path from documents) select doc_id, s.path from w left join s using (path)")
def sink_resolve_path(spark, sf_dir):
    """Stored are the originals of labelled documents; asked for are all."""
    digest = F.sha2("text", 256)
    wanted = load(spark, sf_dir, "documents").select("doc_id", T.stored_path(digest, F.lit("uc"), F.col("doc_id").cast("string")).alias("path"))
    stored = wanted.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path").distinct()
    return S.resolved_path(wanted, stored).select("doc_id", F.col("resolved").alias("path"))


@query("log_query_append", "select 'uc' as use_case, role, text as query_text, true as sufficient, conv_id || ':' || turn as id from conversations where role = 'user' union all select 'uc', role, text, false, conv_id || ':' || turn from conversations where role <> 'user'")
def log_query_append(spark, sf_dir):
    """Two appends to the query log, read back as one table."""
    c = load(spark, sf_dir, "conversations").select(F.lit("uc").alias("use_case"), "role", F.col("text").alias("query_text"), (F.col("role") == "user").alias("sufficient"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))
    path = fresh_path(spark, "queries")
    for own in (F.col("role") == "user", F.col("role") != "user"):
        R.append_rows(c.where(own), "queries", path)
    return spark.read.schema(R.SCHEMAS["queries"]).parquet(path).select("use_case", "role", "query_text", "sufficient", "id")


RAW = "case c_custkey % 6 when 0 then c_custkey::varchar when 1 then '' when 2 then ' ' || c_nationkey || ' ' when 3 then c_nationkey || '.5' when 4 then c_name end"


@query("cfg_env_numbers", f"with r as (select c_custkey, {RAW} as raw from customer) select c_custkey, coalesce(case when regexp_full_match(raw, '\\s*[+-]?\\d+\\s*') then trim(raw)::bigint end, 7) as whole, coalesce(case when regexp_full_match(raw, '\\s*[+-]?\\d+(\\.\\d+)?\\s*') then trim(raw)::double end, 0.5::double) as real from r")
def cfg_env_numbers(spark, sf_dir):
    n = F.col("c_custkey") % 6
    raw = F.when(n == 0, F.col("c_custkey").cast("string")).when(n == 1, "").when(n == 2, F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" "))).when(n == 3, F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))).when(n == 4, F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", R.whole_number(raw, 7).alias("whole"), R.real_number(raw, 0.5).alias("real"))


@query("tbl_dispatch", "with f as (select n_nationkey, n_name || list_extract(['.csv', '.XLSX', '.xls', '.pdf', ''], n_nationkey % 5 + 1) as f from nation), e as (select n_nationkey, lower(regexp_extract(f, '\\.([^.]*)$', 1)) as ext from f) select n_nationkey, case when ext in ('csv', 'xlsx', 'xls') then ext end as kind, case when ext not in ('csv', 'xlsx', 'xls') then case when ext = '' then '?' else ext end end as error from e")
def tbl_dispatch(spark, sf_dir):
    ending = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".XLSX", ".xls", ".pdf", "")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "nation").select("n_nationkey", R.table_kind(F.concat("n_name", ending)).alias("k")).select("n_nationkey", "k.kind", "k.error")


@query("ingest_import_gate", f"with o as (select c_custkey, count(o_orderkey) as n, max(o_orderdate) as released_at, c_mktsegment from customer left join orders on c_custkey = o_custkey and o_orderstatus <> 'O' group by all), e as (select *, case when released_at is null then {quoted(R.NOT_RELEASED)} when n = 0 then {quoted(R.NO_ROWS)} end as error from o) select c_custkey, case when error is null then case when c_mktsegment = 'BUILDING' then 'rows' else 'file' end end as target, error from e")
def ingest_import_gate(spark, sf_dir):
    """A customer's closed orders are a snapshot; without any it is not released."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("released_at"))
    c = load(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    gate = R.import_gate(F.col("released_at"), F.coalesce("n", F.lit(0)), F.when(F.col("c_mktsegment") == "BUILDING", "per-row").otherwise("whole-file"))
    return c.select("c_custkey", gate.alias("g")).select("c_custkey", "g.target", "g.error")


@query("agt_audit", "select user_id, 'm' as model, 'p' as llm_provider, max(value) as temperature, count(*) as max_tokens, max(ts) as generated_at, ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0).round()::bigint as processing_ms from events group by 1")
def agt_audit(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("value").alias("t"), F.count("*").alias("n"))
    block = R.audit(F.lit("m"), F.lit("p"), F.col("t"), F.col("n"), F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    return e.select("user_id", "b", block.alias("x")).select("user_id", "x.model", "x.llm_provider", "x.temperature", "x.max_tokens", F.col("b").alias("generated_at"), "x.processing_ms")


@query("vis_prompt", f"select doc_id, {quoted(R.VISION_PROMPT)} || case when coalesce(text, '') = '' then '' else chr(10) || chr(10) || 'Kontext aus dem Dokument: ' || left(text, 300) end as prompt from documents")
def vis_prompt(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", R.vision_prompt(F.col("text")).alias("prompt"))


@query("emb_model_list", "select n_regionkey, case when n_nationkey % 2 = 0 then 'N ' || n_name else n_name end as name, n_name as id from nation")
def emb_model_list(spark, sf_dir):
    model = F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("N "), "n_name")).alias("name"), F.col("n_name").alias("id"), F.lit("model").alias("object"))
    answers = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(model).alias("data"))).alias("answer"))
    return answers.select("n_regionkey", F.explode(R.model_list(F.col("answer"))).alias("m")).select("n_regionkey", "m.name", "m.id")


@query("rnk_searchable_text", "select conv_id, turn, case when role = 'user' and text <> '' then text else role end as text, case when role = 'user' then 'c' || conv_id when role = 'assistant' then 'm' || turn else conv_id || ':' || turn end as candidate from conversations")
def rnk_searchable_text(spark, sf_dir):
    """Users' texts are in the metadata, others have their role for a text; ids are where the role puts them."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    text = R.searchable_text(F.when(user, F.col("text")), F.col("role"))
    own = F.when(user, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    meta = F.when(assistant, F.concat(F.lit("m"), F.col("turn").cast("string")))
    row = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), R.candidate_id(own, meta, row).alias("candidate"))


@query("agt_refine_query", f"select conv_id, turn, case when regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' then {quoted(R.NO_QUERY)} else case when role = 'user' then '[Verfeinerte Suche: user]' else '[Verfeinerte Suche]' end || chr(10) || text end as observation from conversations")
def agt_refine_query(spark, sf_dir):
    reason = F.when(F.col("role") == "user", F.lit(" user ")).otherwise("")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", R.refined(F.col("text"), reason, F.col("text")).alias("observation"))


@query("cat_table_columns", "select t.*, (select count(*) from events) as n_rows from (values " + ", ".join(f"('{t}', {len(c.split(', '))})" for t, c in R.SCHEMAS.items()) + ") t(table_name, n_columns)")
def cat_table_columns(spark, sf_dir):
    """The tables of the service, each filled with the log's rows: columns and rows of what is read back."""
    e = load(spark, sf_dir, "events")
    have = {"id": F.col("event_id").cast("string"), "use_case": F.col("user_id").cast("string"), "created_at": F.col("ts"), "updated_at": F.col("ts")}
    out = []
    for t, ddl in R.SCHEMAS.items():
        path = fresh_path(spark, t)
        R.append_rows(e.select(*[c.alias(n) for n, c in have.items() if n in [x.split()[0] for x in ddl.split(", ")]]), t, path)
        back = spark.read.parquet(path)
        out.append(back.agg(F.lit(t).alias("table_name"), F.lit(len(back.columns)).alias("n_columns"), F.count("*").alias("n_rows")))
    return reduce(lambda a, b: a.unionByName(b), out)


POINT = "select 'chunk_' || vec_id % 100 as chunk_id, arg_max(label, vec_id)::varchar as label, arg_max(vec_id, vec_id)::varchar as seq, 'm2' as model from embeddings group by 1"


@query("vec_upsert_points", POINT)
def vec_upsert_points(spark, sf_dir):
    """Every embedding in order, a hundred ids in all: the last one of each id stays, stamped with its model."""
    e = load(spark, sf_dir, "embeddings")
    meta = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("seq"), F.col("vec_id").cast("string"), F.lit("chunk_id"), F.lit("überschrieben"))
    batch = e.select(F.concat(F.lit("chunk_"), (F.col("vec_id") % 100).cast("string")).alias("chunk_id"), F.col("embedding").alias("vector"), meta.alias("metadata"), F.col("vec_id").alias("seq"))
    p = V.upserted(None, batch, "neumann_x", "m2")
    return p.select(*[F.col("payload")[k].alias(a) for k, a in (("chunk_id", "chunk_id"), ("label", "label"), ("seq", "seq"), ("_embed_model", "model"))])
