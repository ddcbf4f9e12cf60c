"""Queries on logs, configuration, prompts and skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import redact_secret
from lectern.operators import admin as A
from lectern.plans.registry import query
from lectern.session import load

USE = "list_extract(['neumann', 'gw_stpoelten', 'wiener_linien', 'ustp'], ({} % 4)::int + 1)"


def use_case(c):
    return F.element_at(F.array(*[F.lit(x) for x in ("neumann", "gw_stpoelten", "wiener_linien", "ustp")]), (c % 4 + 1).cast("int"))


def log(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("use_case", use_case(F.col("user_id")))


@query("adm_query_history", f"select event_id, ts as created_at, event_type from events where {USE.format('user_id')} = 'neumann' order by ts desc, event_id limit 50 offset 10")
def adm_query_history(spark, sf_dir):
    rows = log(spark, sf_dir).where("use_case = 'neumann'").select("event_id", F.col("ts").alias("created_at"), "event_type")
    return A.page_of(rows, [F.desc("created_at"), "event_id"], 50, 10)


@query("adm_documents", f"select event_id, ts as created_at, {USE.format('user_id')} as use_case from events where event_type = 'error'")
def adm_documents(spark, sf_dir):
    return log(spark, sf_dir).where("event_type = 'error'").select("event_id", F.col("ts").alias("created_at"), "use_case").orderBy(F.desc("created_at"), "event_id")


@query("log_ingest_upsert", f"select user_id::varchar as file_hash, arg_min(event_type, event_id) as file_name, arg_min({USE.format('event_id')}, event_id) as use_case, min(ts) as created_at, arg_max(event_id % 100, event_id) as chunk_count, arg_max('p/' || event_id, event_id) as stored_path from events group by 1")
def log_ingest_upsert(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_hash"), F.col("event_id").alias("seq"), F.col("event_type").alias("file_name"), use_case(F.col("event_id")).alias("use_case"), F.col("ts").alias("created_at"), (F.col("event_id") % 100).alias("chunk_count"), F.concat(F.lit("p/"), F.col("event_id").cast("string")).alias("stored_path"))
    return A.ingestion_log(e)


@query("adm_feedback_validate", "select event_type in ('signup', 'purchase') as valid, count(*) as n from events group by 1")
def adm_feedback_validate(spark, sf_dir):
    rating = F.when(F.col("event_type") == "signup", "positive").when(F.col("event_type") == "purchase", "negative").otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").groupBy(rating.isin(*A.RATINGS).alias("valid")).agg(F.count("*").alias("n"))


@query("adm_use_case_totals", f"select {USE.format('user_id')} as use_case, count(*) as queries, count(distinct user_id) as users from events group by 1")
def adm_use_case_totals(spark, sf_dir):
    return log(spark, sf_dir).groupBy("use_case").agg(F.count("*").alias("queries"), F.countDistinct("user_id").alias("users"))


@query("adm_redact_secret", "select n_nationkey, case when n_nationkey % 4 = 0 then '' when n_nationkey % 4 = 1 then '****' else '****' || right(n_name || n_nationkey, 4) end as shown from nation")
def adm_redact_secret(spark, sf_dir):
    key = F.when(F.col("n_nationkey") % 4 == 0, F.lit(None)).when(F.col("n_nationkey") % 4 == 1, "abcd").otherwise(F.concat("n_name", F.col("n_nationkey").cast("string")))
    return load(spark, sf_dir, "nation").select("n_nationkey", redact_secret(key).alias("shown"))


#: A configuration for each user of the log: a column is set, empty or missing by user and column.
STORED = "s as (select distinct user_id::varchar as use_case, " + ", ".join(f"case (user_id + {n}) % 3 when 0 then 'v{n}_' || user_id when 1 then '' end as {c}" for n, c in enumerate(A.MERGED)) + " from events)"
OVERLAID = ", ".join(f"coalesce(nullif({c}, ''), 'env_{c}') as {c}" for c in A.MERGED)


def stored(spark, sf_dir):
    u = F.col("user_id")
    cell = lambda n, c: F.when((u + n) % 3 == 0, F.concat(F.lit(f"v{n}_"), u.cast("string"))).when((u + n) % 3 == 1, "").alias(c)
    return load(spark, sf_dir, "events").select("user_id").distinct().select(u.cast("string").alias("use_case"), *[cell(n, c) for n, c in enumerate(A.MERGED)])


@query("cfg_resolve", f"with {STORED} select use_case, {OVERLAID} from s")
def cfg_resolve(spark, sf_dir):
    base = spark.createDataFrame([tuple(f"env_{c}" for c in A.MERGED)], ", ".join(f"{c} string" for c in A.MERGED))
    return A.resolved(base, stored(spark, sf_dir))


@query(
    "cfg_upsert",
    f"with {STORED} select use_case, case when use_case::bigint % 2 = 0 then 'neu' || use_case else chat_provider end as chat_provider, case when use_case::bigint % 4 = 0 then null when use_case::bigint % 4 = 2 then 'k' || use_case else chat_key end as chat_key from s union all select 'neu_' || r_regionkey, r_name, null from region",
)
def cfg_upsert(spark, sf_dir):
    """Patches of half of the users' rows, whose empty keys clear what is stored, and of new ones."""
    rows = stored(spark, sf_dir).select("use_case", "chat_provider", "chat_key")
    n = F.col("use_case").cast("long")
    patch = rows.where(n % 2 == 0).select("use_case", F.concat(F.lit("neu"), "use_case").alias("chat_provider"), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("k"), "use_case")).alias("chat_key"))
    new = load(spark, sf_dir, "region").select(F.concat(F.lit("neu_"), F.col("r_regionkey").cast("string")).alias("use_case"), F.col("r_name").alias("chat_provider"), F.lit("").alias("chat_key"))
    return A.patched(rows, patch.unionByName(new), "use_case", ("chat_key",))


#: Prompts: one for each kind of event of user 1, some of them empty, and one for all of those kinds that begin early in the alphabet.
PROMPTS = "r as (select '1' as use_case, event_type as prompt_key, case when max(event_id) % 2 = 0 then '' else 'eigener ' || max(event_id) end as content from events where user_id = 1 group by 2 union all select '*', event_type, 'alle ' || max(event_id) from events where event_type < 'm' group by 2), d as (select event_type as prompt_key, 'd_' || min(event_id) as content from events group by 1)"


def stored_prompts(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    key, last = F.col("event_type").alias("prompt_key"), F.max("event_id")
    own = e.where("user_id = 1").groupBy(key).agg(F.when(last % 2 == 0, "").otherwise(F.concat(F.lit("eigener "), last.cast("string"))).alias("content")).withColumn("use_case", F.lit("1"))
    every = e.where("event_type < 'm'").groupBy(key).agg(F.concat(F.lit("alle "), last.cast("string")).alias("content")).withColumn("use_case", F.lit("*"))
    return own.unionByName(every), e.groupBy(key).agg(F.concat(F.lit("d_"), F.min("event_id").cast("string")).alias("content"))


FOUND = "select d.prompt_key, coalesce(nullif(o.content, ''), a.content, d.content) as content, coalesce(nullif(o.content, ''), a.content) is not null as is_override from d left join r o on o.prompt_key = d.prompt_key and o.use_case = '1' left join r a on a.prompt_key = d.prompt_key and a.use_case = '*'"


@query("cfg_prompt_resolve", f"with {PROMPTS} select prompt_key, content from ({FOUND})")
def cfg_prompt_resolve(spark, sf_dir):
    return cfg_prompt_overrides(spark, sf_dir).select("prompt_key", "content")


@query("cfg_prompt_overrides", f"with {PROMPTS} {FOUND}")
def cfg_prompt_overrides(spark, sf_dir):
    rows, defaults = stored_prompts(spark, sf_dir)
    return A.prompt(rows, "1", defaults)


@query("cfg_prompt_upsert", "with c as (select user_id as u, event_type as k, case when event_id % 5 = 0 then '' else 'c' || event_id end as content, event_id from events) select u::varchar as use_case, k as prompt_key, arg_max(content, event_id) as content from c group by u, k having arg_max(content, event_id) <> ''")
def cfg_prompt_upsert(spark, sf_dir):
    c = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("use_case"), F.col("event_type").alias("prompt_key"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("content"), F.col("event_id").alias("seq"))
    return A.last_prompts(c)


@query("cfg_skills", "select n_regionkey::varchar as use_case, n_name as name, n_nationkey % 3 as position from nation where n_nationkey % 4 <> 0")
def cfg_skills(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("use_case"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3).alias("position"), (F.col("n_nationkey") % 4 != 0).alias("enabled"))
    return A.skills(n).drop("enabled")


@query("cfg_skill_patch", "select n_nationkey as id, case when n_nationkey % 2 = 0 then 'neu ' || n_nationkey else n_name end as name, n_regionkey as position from nation where n_nationkey % 7 <> 0")
def cfg_skill_patch(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("position"))
    patch = n.where("id % 2 = 0").select("id", F.concat(F.lit("neu "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("int").alias("position"))
    return A.patched(n, patch, "id").join(n.where("id % 7 = 0").select("id"), "id", "left_anti")


@query("cfg_role_prompt", "with p as (select conv_id, role, arg_min(text, turn) as prompt from conversations group by 1, 2), a as (select distinct conv_id, unnest(['user', 'assistant', 'trainee']) as role from conversations) select a.conv_id, a.role, coalesce(p.prompt, d.prompt) as prompt from a left join p on p.conv_id = a.conv_id and p.role = a.role left join p d on d.conv_id = a.conv_id and d.role = 'user'")
def cfg_role_prompt(spark, sf_dir):
    """A prompt for each role of a conversation; a role without one has that of the default role."""
    c = load(spark, sf_dir, "conversations")
    prompts = c.groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("prompt"))
    asked = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(r) for r in ("user", "assistant", "trainee")])).alias("role"))
    return A.role_prompts(asked, prompts, "conv_id", "user")
