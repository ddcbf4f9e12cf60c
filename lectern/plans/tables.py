"""Queries on imported tables and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import tables as T
from lectern.plans.registry import query
from lectern.session import load

#: A table with personal data: a name, a text with an address and a number, and an empty cell.
COLUMNS = ["name", "contact", "note"]
SQL = "t as (select c_custkey as row_idx, c_name as name, 'Mail an k' || c_custkey % 40 || '@firma.at oder 10.0.0.' || c_custkey % 9 || ', Kunde' as contact, case when c_custkey % 3 = 0 then '' else 'an K' || c_custkey % 40 || '@firma.at' end as note from customer)"


def table(spark, sf_dir):
    mail = F.concat((F.col("c_custkey") % 40).cast("string"), F.lit("@firma.at"))
    contact = F.concat(F.lit("Mail an k"), mail, F.lit(" oder 10.0.0."), (F.col("c_custkey") % 9).cast("string"), F.lit(", Kunde"))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.col("c_name").alias("name"), contact.alias("contact"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("an K"), mail)).alias("note"))


def found(spark, sf_dir):
    return T.cells(table(spark, sf_dir), COLUMNS, "row_idx")


def detected(spark, sf_dir):
    return T.detections(found(spark, sf_dir))


# names of the test data end in a number with zeros before it, which the phone pattern takes
SPANS = f"""{SQL}, d as (
    select row_idx, 0 as col_idx, 9 as start, 18 as "end", 'PHONE' as type, right(name, 9) as text from t union all
    select row_idx, 1 as col_idx, 8 as start, 8 + length('k' || row_idx % 40 || '@firma.at') as "end", 'EMAIL' as type, 'k' || row_idx % 40 || '@firma.at' as text from t union all
    select row_idx, 1, 8 + length('k' || row_idx % 40 || '@firma.at') + 6, 8 + length('k' || row_idx % 40 || '@firma.at') + 14, 'IP', '10.0.0.' || row_idx % 9 from t union all
    select row_idx, 2, 3, 3 + length('k' || row_idx % 40 || '@firma.at'), 'EMAIL', 'K' || row_idx % 40 || '@firma.at' from t where row_idx % 3 <> 0)"""


@query("pii_scan_cells", f"with {SPANS} select * from d")
def pii_scan_cells(spark, sf_dir):
    return detected(spark, sf_dir)


LABELS = (("B-private_person", "NAME"), ("private_email", "EMAIL"), ("I-PER", "NAME"), ("s-Org", "ORG"), ("GPE", "LOC"), ("MISC", "MISC"), ("x-unknown", None), ("SOME_LOCATION", "LOC"))


@query("pii_label_map", "select c_custkey, list_extract([" + ", ".join("null" if t is None else f"'{t}'" for _, t in LABELS) + "], (c_custkey % 8)::int + 1) as type from customer")
def pii_label_map(spark, sf_dir):
    """A model's label for each customer, as types of personal data."""
    label = F.element_at(F.array(*[F.lit(x) for x, _ in LABELS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", T.label_type(label).alias("type"))


@query("pii_offsets", "select n_nationkey, 0 as s1, length(n_name) as e1, length(n_name) + 5 as s2, 2 * length(n_name) + 5 as e2 from nation")
def pii_offsets(spark, sf_dir):
    o = T.offsets(F.concat("n_name", F.lit(" und "), "n_name"), F.array("n_name", F.lit("fehlt!"), "n_name"))
    n = load(spark, sf_dir, "nation").select("n_nationkey", o.alias("o"))
    return n.select("n_nationkey", F.col("o")[0]["start"].alias("s1"), F.col("o")[0]["end"].cast("long").alias("e1"), F.col("o")[1]["start"].cast("long").alias("s2"), F.col("o")[1]["end"].cast("long").alias("e2"))


NAMED = f"""{SPANS}, f as (select type, lower(text) as key, min((row_idx, col_idx, -start)) as p from d group by 1, 2), n as (select type, key, '[' || type || '_' || row_number() over (partition by type order by p) || ']' as placeholder from f)"""


@query("pii_placeholders", f"with {NAMED} select * from n")
def pii_placeholders(spark, sf_dir):
    return T.placeholders(detected(spark, sf_dir))


@query(
    "pii_apply",
    f"""with {NAMED}, m as (select 'k' || row_idx % 40 || '@firma.at' as mail, '10.0.0.' || row_idx % 9 as ip, t.* from t)
    select row_idx, 0 as col_idx, left(name, 9) || a.placeholder as text from m join n a on a.type = 'PHONE' and a.key = right(name, 9) union all select row_idx, 1, 'Mail an ' || a.placeholder || ' oder ' || b.placeholder || ', Kunde' from m join n a on a.type = 'EMAIL' and a.key = mail join n b on b.type = 'IP' and b.key = ip
    union all select row_idx, 2, case when note = '' then '' else 'an ' || a.placeholder end from m join n a on a.type = 'EMAIL' and a.key = mail""",
)
def pii_apply(spark, sf_dir):
    return T.rewritten(found(spark, sf_dir), detected(spark, sf_dir))


@query("pii_approvals", f"with {SPANS} select row_idx || ':' || col_idx || ':' || start || ':' || \"end\" || ':' || type as key from d where type = 'EMAIL' and row_idx % 2 = 0")
def pii_approvals(spark, sf_dir):
    d = detected(spark, sf_dir).withColumn("key", T.detection_key())
    approved = d.where("type = 'EMAIL'").select("key")
    refused = d.where("row_idx % 2 = 1").select("key")
    return d.join(approved, "key", "left_semi").join(refused, "key", "left_anti").select("key")


@query("pii_group_counts", f"with {SPANS} select type, count(*) as n from d group by 1")
def pii_group_counts(spark, sf_dir):
    return detected(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("pii_snapshot", f"with {SQL} select count(*) as row_count, 3 as column_count, sum((note = '')::int)::bigint as empty_cells, true as anonymized from t")
def pii_snapshot(spark, sf_dir):
    made = T.rewritten(found(spark, sf_dir), detected(spark, sf_dir))
    return made.agg(F.countDistinct("row_idx").alias("row_count"), F.countDistinct("col_idx").cast("int").alias("column_count"), F.count_if(F.col("text") == "").alias("empty_cells")).withColumn("anonymized", F.lit(True))


@query("tbl_preview", f"with {SQL}, c as (select count(*) as total from t) select row_idx, name, total > 10 as truncated from t, c order by row_idx limit 10")
def tbl_preview(spark, sf_dir):
    t = table(spark, sf_dir)
    more = t.limit(11).agg((F.count("*") > 10).alias("truncated"))  # one row
    return t.orderBy("row_idx").limit(10).crossJoin(F.broadcast(more)).select("row_idx", "name", "truncated")


@query("ingest_table_rows", f"with {SQL} select sha256('table.csv|' || row_idx) as chunk_id, 'wl_default' as collection, 'name: ' || name || chr(10) || 'contact: ' || contact || case when note = '' then '' else chr(10) || 'note: ' || note end as text from t")
def ingest_table_rows(spark, sf_dir):
    from lectern.operators.chunking import row_chunks

    rows = row_chunks(table(spark, sf_dir).withColumn("n", F.col("row_idx") - 1), COLUMNS, "n")
    return rows.select(F.sha2(F.concat(F.lit("table.csv|"), F.col("row_index").cast("string")), 256).alias("chunk_id"), F.lit("wl_default").alias("collection"), "text")
