"""Queries on sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.protocol import protocol
from lectern.plans.registry import query
from lectern.session import fresh_path, load
from lectern.sources import files as S

NAMED = "n as (select doc_id, text, 'doc_' || doc_id || list_extract(['.csv', '.DOCX', '.md', '.Pdf', '.txt', '.xyz', ''], doc_id % 7 + 1) as file_name from documents)"
KNOWN = "('.csv', '.docx', '.md', '.pdf', '.txt')"


@query("src_format_dispatch", f"with {NAMED}, e as (select doc_id, file_name, lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) as ext from n) select *, ext in {KNOWN} as supported, case when ext not in {KNOWN} then 'Unsupported format ''' || ext || '''. Supported: .csv, .docx, .md, .pdf, .txt' end as error from e")
def src_format_dispatch(spark, sf_dir):
    return S.dispatched(S.named_files(load(spark, sf_dir, "documents"))).select("doc_id", "file_name", "ext", "supported", "error")


@query("src_supported_formats", f"with {NAMED}, e as (select lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) as ext from n) select format, count(ext) as files from (select unnest(['.csv', '.docx', '.md', '.pdf', '.txt']) as format) left join e on ext = format group by 1")
def src_supported_formats(spark, sf_dir):
    """Every format that is read, in order, with the number of files that have it."""
    known = spark.createDataFrame([(f,) for f in sorted(S.FORMATS)], "format string")
    found = S.dispatched(S.named_files(load(spark, sf_dir, "documents"))).where("supported").groupBy(F.col("ext").alias("format")).agg(F.count("*").alias("n"))
    return known.join(found, "format", "left").select("format", F.coalesce("n", F.lit(0)).cast("long").alias("files")).orderBy("format")


@query("src_text_pages", "select doc_id, 1 as page, md5(text) as digest from documents")
def src_text_pages(spark, sf_dir):
    valid = F.expr("make_valid_utf8(cast(cast(text as binary) as string))")
    return load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.md5(valid.cast("binary")).alias("digest"))


@query(
    "src_csv_markdown",
    """with r as (select *, row_number() over (order by n_nationkey, n_name, n_regionkey) as i from nation),
    l as (select 1 as line, 'n_nationkey | n_name | n_regionkey' as text union all select 2, '--- | --- | ---' union all select i + 2, coalesce(n_nationkey::varchar, '') || ' | ' || coalesce(n_name, '') || ' | ' || coalesce(n_regionkey::varchar, '') from r)
    select line, text, (select count(*) from nation) as row_count, 'n_nationkey, n_name, n_regionkey' as columns from l""",
)
def src_csv_markdown(spark, sf_dir):
    """A table as a document: its lines in order, and beside each the number of rows and the columns."""
    return S.csv_lines(load(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey", "n_name", "n_regionkey"])


@query(
    "src_csv_files",
    """with c as (select c_nationkey as nation, c_custkey, c_name || case when c_custkey % 3 = 0 then ' "neu"' else '' end as name, case when c_custkey % 5 = 0 then 'a,' || chr(10) || 'b' else c_mktsegment end as note, row_number() over (partition by c_nationkey order by c_custkey) as n from customer)
    select nation, 0 as page, null as text, count(*) as row_count, 'name,note,key' as columns from c group by 1 union all select distinct nation, 1, 'name | note | key', null, null from c union all select nation, n::int + 1, name || ' | ' || note || ' | ' || c_custkey, null, null from c""",
)
def src_csv_files(spark, sf_dir):
    """Customers written as a CSV file for each nation, with marks, quotes and line breaks, and read back as pages."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, ' "neu"').otherwise(""))
    note = F.when(F.col("c_custkey") % 5 == 0, "a,\nb").otherwise(F.col("c_mktsegment"))
    line = F.concat_ws(",", T.csv_field(name), quoted(note), F.col("c_custkey").cast("string"))
    # rows of a file are put in order by a sort in its partition; the writer makes a file for each nation
    head = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct().select("nation", F.lit(-1).cast("long").alias("k"), F.lit("\ufeffname,note,key").alias("value"))
    rows = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").cast("long").alias("k"), line.alias("value"))
    path = fresh_path(spark, "csv")
    head.unionByName(rows).repartition("nation").sortWithinPartitions("nation", "k").select("nation", "value").write.partitionBy("nation").text(path)
    read = S.read_csv_files(spark, f"{path}/nation=*/*.txt")
    return read.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("long").alias("nation"), "page", "text", "row_count", F.array_join("columns", ",").alias("columns"))


@query("src_csv_pages", "select 1 as page, 'n_name | n_regionkey' as text union all select n_nationkey + 2, n_name || ' | ' || n_regionkey from nation")
def src_csv_pages(spark, sf_dir):
    return S.csv_pages(load(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], "n_nationkey")


@query(
    "src_docx_blocks",
    "select r_regionkey, r_name || chr(10) || chr(10) || '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as text from region join nation on r_regionkey = n_regionkey group by r_regionkey, r_name",
)
def src_docx_blocks(spark, sf_dir):
    from lectern.sources.office import blocks

    rows = F.array_sort(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.col("n_nationkey").cast("string"), "n_name")))
    tables = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(rows, lambda r: F.slice(r, 2, 2)).alias("rows"))
    r = load(spark, sf_dir, "region").join(tables, F.col("r_regionkey") == F.col("n_regionkey"))
    table = F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"))), F.col("rows"))
    return r.select("r_regionkey", blocks(F.array("r_name", F.lit("  ")), F.array(table)).alias("text"))


OCR = "select doc_id // 20 as file_id, doc_id % 5 as page_idx, doc_id, text, 'img/' || doc_id || '.png' as img_path from documents"


def ocr(spark, sf_dir):
    """OCR answers as JSON text: a list of items for each file."""
    d = load(spark, sf_dir, "documents")
    item = F.struct("doc_id", (F.col("doc_id") % 5).cast("int").alias("page_idx"), "text", F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("img_path"))
    return d.groupBy(F.expr("doc_id div 20").alias("file_id")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("content"))


def ocr_items(spark, sf_dir):
    from lectern.sources.office import ocr_content

    return ocr_content(ocr(spark, sf_dir), "file_id", "content")


@query("src_ocr_pages", f"with o as ({OCR}) select file_id, page_idx + 1 as page, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) order by doc_id) as text from o where regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' group by 1, 2")
def src_ocr_pages(spark, sf_dir):
    from lectern.sources.office import item_text

    made = ocr_items(spark, sf_dir).withColumn("t", T.strip(item_text())).where("t <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n")
    return made.groupBy("file_id", "page").agg(text.alias("text"))


@query("src_ocr_images", f"with o as ({OCR}) select file_id, doc_id || '.png' as name, page_idx + 1 as page from o where doc_id % 3 = 0 union all select distinct file_id, 'ohne.png', 1 from o")
def src_ocr_images(spark, sf_dir):
    items = ocr_items(spark, sf_dir)
    named = items.where("cast(substring_index(substring_index(img_path, '/', -1), '.', 1) as long) % 3 = 0").select("file_id", F.substring_index("img_path", "/", -1).alias("name"))
    images = named.unionByName(items.select("file_id", F.lit("ohne.png").alias("name")).distinct())
    pages = items.select("file_id", F.substring_index("img_path", "/", -1).alias("name"), "page")
    return images.join(pages, ["file_id", "name"], "left").select("file_id", "name", F.coalesce("page", F.lit(1)).alias("page"))


@query("src_ocr_item_text", "select n_nationkey, n_name || chr(10) || 'Bild ' || n_nationkey || chr(10) || '| ' || n_regionkey || ' |' as text from nation")
def src_ocr_item_text(spark, sf_dir):
    from lectern.sources.office import item_text

    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text"), F.array().cast("array<string>").alias("table_caption"), F.array(F.concat(F.lit("Bild "), F.col("n_nationkey").cast("string")), F.lit("")).alias("img_caption"), F.lit(None).cast("array<string>").alias("image_caption"), F.concat(F.lit("<table><tr><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr></table>")).alias("table_body"))
    return n.select("n_nationkey", item_text().alias("text"))


@query("src_csv_dual_delim", "select n_nationkey, n_name as a, 'x;\"y' as b, n_regionkey::varchar as c, '' as d from nation")
def src_csv_dual_delim(spark, sf_dir):
    line = F.concat("n_name", F.lit(',"x;""y";'), F.col("n_regionkey").cast("string"), F.lit(","))
    f = S.dual_delimiter_fields(line)
    return load(spark, sf_dir, "nation").select("n_nationkey", *[F.get(f, i).alias(c) for i, c in enumerate("abcd")])


@query("src_table_headers", "select r_regionkey, list_extract([r_name, 'Spalte 2', 'Spalte 3'], 1) as h1, 'Spalte 2' as h2, 'Spalte 3' as h3 from region")
def src_table_headers(spark, sf_dir):
    h = S.table_headers(F.array("r_name", F.lit("")), F.lit(3))
    return load(spark, sf_dir, "region").select("r_regionkey", *[F.get(h, i).alias(f"h{i + 1}") for i in range(3)])


@query(
    "src_document_display",
    f"with {NAMED} select doc_id, file_name as display_name, case lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) when '.pdf' then 'application/pdf' when '.txt' then 'text/plain' when '.md' then 'text/markdown' when '.csv' then 'text/csv' end as media_type from n",
)
def src_document_display(spark, sf_dir):
    path = T.stored_path(F.sha2("text", 256), F.lit("uc"), F.col("file_name"))
    shown = S.display_name(path)
    return S.named_files(load(spark, sf_dir, "documents")).select("doc_id", shown.alias("display_name"), S.media_type(shown).alias("media_type"))


@query("sink_content_address", "select doc_id, sha256(text) as file_hash, 'uc/' || sha256(text)[1:2] || '/' || sha256(text)[1:12] || '_a_b_' || doc_id || '.txt' as path from documents")
def sink_content_address(spark, sf_dir):
    digest = F.sha2("text", 256)
    name = F.concat(F.lit("a/b\\"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return load(spark, sf_dir, "documents").select("doc_id", digest.alias("file_hash"), T.stored_path(digest, F.lit("uc"), name).alias("path"))


@query("sink_csv_quote", "select doc_id, case when regexp_matches(text, '[\",\\n\\r]') then '\"' || replace(text, '\"', '\"\"') || '\"' else text end as field from documents")
def sink_csv_quote(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.csv_field(F.col("text")).alias("field"))


@query("sink_release_name", "select n_nationkey, n_name || '.x' || case when n_nationkey % 2 = 0 then '.released-anon' else '.released' end || '.csv' as name from nation")
def sink_release_name(spark, sf_dir):
    name = F.concat("n_name", F.lit(".x.xlsx"))
    suffix = F.when(F.col("n_nationkey") % 2 == 0, ".released-anon").otherwise(".released")
    return load(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), suffix, F.lit(".csv")).alias("name"))


@query(
    "sink_protocol_export",
    """with m as (select conv_id, turn, '{"index":' || turn || ',"role":"' || role || '","text":' || to_json(text) || case when role = 'assistant' then ',"duration_ms":' || turn * 10 else '' end
        || case when turn % 4 = 1 then ',"sub_agents":[{"subagent_id":"sub-1-facts","sub_query":' || to_json(text) || ',"sufficient":true,"agent_steps":[{"step":1,"action":"SEARCH","args":{"query":' || to_json(text) || '},"chunks":[{"n":' || turn || '}]},{"step":2,"action":"FINAL_ANSWER"}]}]'
                when turn % 4 = 3 then ',"agent_steps":[{"step":1,"action":"SEARCH","args":{"query":' || to_json(text) || '},"chunks":[{"n":' || turn || '}],"subagent_id":"x"},{"step":2,"action":"FINAL_ANSWER","subagent_id":"x"}]' else '' end
        || case when turn % 2 = 1 then ',"compliance":{"phase":"done","detail":{"deep":[{"x":1},{}]}}' else '' end || case when turn % 5 = 4 then ',"error":true' else '' end || '}' as j from conversations)
    select conv_id, count(*) as message_count, '{"schema_version":1,"use_case":"uc","message_count":' || count(*) || ',"messages":[' || string_agg(j, ',' order by turn) || ']}' as document from m group by 1""",
)
def sink_protocol_export(spark, sf_dir):
    """A protocol for each conversation, whose messages have nested steps with nulls and empty things at every depth."""
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.expr("cast(array() as array<struct<n:int>>)")
    first = F.struct(F.lit(1).alias("step"), none("string").alias("thought"), F.lit("SEARCH").alias("action"), F.create_map(F.lit("query"), F.col("text"), F.lit("leer"), none("string")).alias("args"), none("string").alias("observation"), F.array(F.struct(F.col("turn").cast("int").alias("n"))).alias("chunks"), F.lit("roh").alias("llm_response"), F.lit("x").alias("subagent_id"))
    second = F.struct(F.lit(2).alias("step"), none("string").alias("thought"), F.lit("FINAL_ANSWER").alias("action"), F.create_map(F.lit("leer"), none("string")).alias("args"), none("string").alias("observation"), empty.alias("chunks"), F.lit("roh").alias("llm_response"), F.lit("x").alias("subagent_id"))
    steps = F.array(first, second)
    sub = F.struct(F.lit("sub-1-facts").alias("subagent_id"), none("string").alias("role"), F.col("text").alias("sub_query"), F.lit(True).alias("sufficient"), F.expr("cast(array() as array<string>)").alias("searched_collections"), steps.alias("agent_steps"), empty.alias("chunks"))
    deep = F.struct(F.lit("done").alias("phase"), F.struct(F.array(F.struct(F.lit(1).alias("x"), none("int").alias("y")), F.struct(none("int").alias("x"), none("int").alias("y"))).alias("deep"), F.struct(none("int").alias("z")).alias("gone")).alias("detail"))
    m = load(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("index"), "role", "text", (F.col("turn") * 10).alias("duration_ms"), F.col("text").alias("enriched_query"), F.when(F.col("turn") % 4 == 1, F.array(sub)).alias("sub_agents"),
        F.when(F.col("turn") % 2 == 1, steps).alias("agent_steps"), F.when(F.col("turn") % 2 == 1, deep).alias("compliance"), F.when(F.col("turn") % 5 == 4, F.lit("Fehler")).alias("error"),
    )
    return protocol(m, "conv_id", {"schema_version": F.lit(1), "use_case": F.lit("uc"), "gone": none("string")})


USE_CASE = "list_extract(['neumann', 'gw_stpoelten', 'wiener_linien', 'ustp'], (user_id % 4)::int + 1)"


@query("cat_use_cases", f"select c.*, count(e.user_id) as requests from (values ('gw_stpoelten', 'gw_cnc_steps', 1), ('neumann', 'neumann_machines', 1), ('ustp', 'ustp_default', 1), ('wiener_linien', 'wl_default', 2)) c(use_case, default_collection, roles) left join events e on {USE_CASE} = c.use_case group by all")
def cat_use_cases(spark, sf_dir):
    """The catalogue of use cases, with the requests that the log has for each."""
    from lectern.operators.agents import USE_CASES
    from lectern.plans.admin import log

    known = spark.createDataFrame([(k, v["default_collection"], len(v["roles"])) for k, v in USE_CASES.items()], "use_case string, default_collection string, roles int")
    asked = log(spark, sf_dir).groupBy("use_case").agg(F.count("*").alias("n"))
    return known.join(asked, "use_case", "left").select("use_case", "default_collection", "roles", F.coalesce("n", F.lit(0)).cast("long").alias("requests"))
