"""Driver queries of names, files, recall and search helpers that others don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import names
from loomgraph.operators import mapping, match, render, search
from loomgraph.plans.registry import query
from loomgraph.sources.tables import table


@query("SELECT page_id, regexp_replace(url, '^(service|lib|nats|db-table|queue|module|provider|external|file):', '') AS bare, CASE WHEN starts_with(url, 'http:') THEN url ELSE 'http:' || url END AS full_ FROM pages")
def name_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.strip_prefix(F.col("url")).alias("bare"), names.add_prefix("http", F.col("url")).alias("full_"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace('/' || split_part(url, '/', 4) || '/' || split_part(url, '/', 5), '/+', '/', 'g') AS whole FROM pages)
SELECT page_id, CASE WHEN regexp_replace(whole, '/$', '') = '' THEN '/' ELSE regexp_replace(whole, '/$', '') END AS path FROM p"""
)
def joined_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.coalesce(F.get(F.split("url", "/"), F.lit(n)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", names.join_path(part(3), part(4)).alias("path"))


@query(
    """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '@' ELSE '' END || lower(p_brand) || '/' || p_type || '/' || p_size AS spec FROM part)
SELECT p_partkey, CASE WHEN starts_with(spec, '@') THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) ELSE split_part(spec, '/', 1) END AS package FROM s"""
)
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat_ws("/", F.concat(F.when(F.col("p_partkey") % 3 == 0, "@").otherwise(""), F.lower("p_brand")), "p_type", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", names.package_name(spec).alias("package"))


@query(r"SELECT item_id, replace(replace(replace(replace(text, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS label FROM benchmark".replace('\\"', '"'))
def escaped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", names.escape_label(F.col("text")).alias("label"))


@query("SELECT page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host FROM pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.host_of(F.col("url")).alias("host"))


@query(r"SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(initcap_, ' ', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')) AS snake FROM (SELECT p_partkey, p_name || 'ID' || upper(p_type[1]) || lower(p_type[2:]) AS initcap_ FROM part)")
def snake_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    camel = F.concat("p_name", F.lit("ID"), F.upper(F.substring("p_type", 1, 1)), F.lower(F.expr("substring(p_type, 2)")))
    return table(spark, sf_dir, "part").select("p_partkey", names.snake_case(F.replace(camel, F.lit(" "), F.lit(""))).alias("snake"))


@query(
    r"""WITH f AS (SELECT p_partkey, 'src/pages/' || CASE p_size % 6 WHEN 0 THEN 'index.tsx' WHEN 1 THEN lower(p_type) || '/[id].tsx' WHEN 2 THEN '_app.tsx' WHEN 3 THEN 'api/x.ts' WHEN 4 THEN 'a/[...rest].jsx' ELSE 'b/[[...all]].tsx' END AS file, p_size, p_type FROM part)
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '/' WHEN 1 THEN '/' || lower(p_type) || '/:id' WHEN 4 THEN '/a/*rest' WHEN 5 THEN '/b/*all?' END AS route FROM f"""
)
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 6
    file = F.when(n == 0, "index.tsx").when(n == 1, F.concat(F.lower("p_type"), F.lit("/[id].tsx"))).when(n == 2, "_app.tsx").when(n == 3, "api/x.ts").when(n == 4, "a/[...rest].jsx").otherwise("b/[[...all]].tsx")
    return table(spark, sf_dir, "part").select("p_partkey", names.page_route(F.concat(F.lit("src/pages/"), file), F.lit("src/pages")).alias("route"))


@query(
    """WITH e AS (SELECT DISTINCT 'events.' || event_type || '.' || (user_id % 10) AS s FROM events), q(p) AS (VALUES ('events.*.3'), ('events.>'), ('*.view.*'), ('events.click.1'), ('events.*'))
SELECT s AS subject, p AS pattern, CASE p WHEN 'events.>' THEN TRUE WHEN 'events.*' THEN FALSE WHEN 'events.*.3' THEN ends_with(s, '.3') WHEN '*.view.*' THEN split_part(s, '.', 2) = 'view' ELSE s = p END AS meets FROM e, q"""
)
def subject_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = table(spark, sf_dir, "events").select(F.concat_ws(".", F.lit("events"), "event_type", (F.col("user_id") % 10).cast("string")).alias("subject")).distinct()
    patterns = F.explode(F.array(*map(F.lit, ("events.*.3", "events.>", "*.view.*", "events.click.1", "events.*")))).alias("pattern")
    return subjects.select("subject", patterns).withColumn("meets", names.subject_matches(F.col("subject"), F.col("pattern")))


@query("SELECT coalesce(CASE l_linenumber % 4 WHEN 0 THEN 'literal' WHEN 1 THEN 'pattern' WHEN 2 THEN 'dynamic' END, 'unresolved') AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def subject_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.kind_histogram(_kinds(spark, sf_dir))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber % 4 < 2) AS n_resolved, (count(*) FILTER (WHERE l_linenumber % 4 < 2))::DOUBLE / count(*) AS rate FROM lineitem")
def subject_resolve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.resolve_rate(_kinds(spark, sf_dir))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select(F.when(n == 0, "literal").when(n == 1, "pattern").when(n == 2, "dynamic").alias("subject_kind"))


@query(
    """WITH r AS (SELECT user_id AS query_id, event_type AS kind, event_type || '-' || event_id AS label, event_id % 97 AS score, event_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS nth FROM r)
SELECT query_id, min(nth) FILTER (WHERE kind IN ('click', 'purchase') AND (contains(lower(label), 'click-1') OR contains(lower(label), 'chase'))) AS rank FROM n GROUP BY query_id"""
)
def rank_of_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    results = events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("kind"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("label"), (F.col("event_id") % 97).alias("score"), F.col("event_id").alias("node_id"))
    expected = events.select(F.col("user_id").alias("query_id")).distinct().select("query_id", F.array(F.lit("click"), F.lit("purchase")).alias("kinds"), F.array(F.lit("CLICK-1"), F.lit("chase")).alias("labels"))
    return search.ranks_of_first_hit(results, expected).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT e.vec_id AS node_id, p_size AS score, e.embedding[1]::DOUBLE AS head FROM (SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 50) p JOIN embeddings e ON e.vec_id = p.p_partkey")
def results_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").limit(50).select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("score"))
    records = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    return search.with_vectors(results, records).filter("vector IS NOT NULL").select("node_id", "score", F.get("vector", F.lit(0)).cast("double").alias("head"))


@query(
    """WITH i AS (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '_' END || p_type AS id FROM part), b AS (SELECT id, regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') AS base FROM i)
SELECT base, string_agg(id, ' ' ORDER BY id) AS ids FROM b GROUP BY base HAVING count(*) > 1"""
)
def chart_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("p_size") % 3 == 0, ".").when(F.col("p_size") % 3 == 1, "-").otherwise("_")
    return render.collisions(table(spark, sf_dir, "part").select(F.concat("p_brand", sign, "p_type").alias("id"))).select("base", F.array_join("ids", " ").alias("ids"))


@query(
    """WITH e(kind) AS (VALUES ('nats-request'), ('db-relation'), ('lib-usage'), ('endpoint-of'), ('rmq-subscribe'), ('entity-has-field'))
SELECT kind, CASE kind WHEN 'nats-request' THEN '==>|request|' WHEN 'db-relation' THEN '--o|rel|' WHEN 'lib-usage' THEN '-.->|lib|' WHEN 'endpoint-of' THEN '-.->|endpoint-of|' WHEN 'rmq-subscribe' THEN '-.->|rmq-sub|' ELSE '--o|has-field|' END AS arrow FROM e"""
)
def chart_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("nats-request", "db-relation", "lib-usage", "endpoint-of", "rmq-subscribe", "entity-has-field")], "kind string")
    return kinds.withColumn("arrow", render.arrow(F.col("kind")))


@query(
    """WITH s AS (SELECT doc_id, source AS file, 'h' || doc_id AS slug, 'H ' || lang AS heading FROM documents)
SELECT 'doc-section:' || file || '#' || slug AS id, 'doc-section' AS kind, heading AS label, file AS path, '{"heading_chain":["Top","' || heading || '"],"heading_level":2,"start_line":' || (doc_id % 50) || '}' AS meta, doc_id AS ord FROM s"""
)
def map_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sections = docs.select(F.col("source").alias("file"), F.format_string("h%d", "doc_id").alias("slug"), F.array(F.lit("Top"), F.concat(F.lit("H "), "lang")).alias("heading_chain"), F.lit(2).alias("heading_level"), (F.col("doc_id") % 50).cast("int").alias("start_line"), F.col("doc_id").alias("ord"))
    return mapping.map_docs(sections).drop("anchor")


@query(
    """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'get' ELSE 'POST' END AS method, '/Parts/' || lower(p_type) || '/:id/' AS pattern, 'h' || p_partkey AS handler FROM part),
o AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'h' || p_partkey ELSE 'x' || p_partkey END AS op, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS om, lower(p_type) AS path FROM part WHERE p_partkey % 5 < 3),
by_path AS (SELECT om, path, min(op) AS op, count(*) AS n FROM o GROUP BY ALL)
SELECT e.id, coalesce(a.op, b.op) AS operation, CASE WHEN a.op IS NOT NULL THEN 'operation id' WHEN b.op IS NOT NULL THEN 'path' END AS matched_by, CASE WHEN a.op IS NOT NULL THEN FALSE ELSE coalesce(b.n > 1, FALSE) END AS ambiguous
FROM e LEFT JOIN o a ON a.op = e.handler LEFT JOIN by_path b ON b.om = upper(e.method) AND '/parts/' || b.path || '/:id/' = lower(e.pattern)"""
)
def enrich_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    endpoints = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "get").otherwise("POST").alias("method"), F.concat(F.lit("/Parts/"), F.lower("p_type"), F.lit("/:id/")).alias("pattern"), F.format_string("h%d", "p_partkey").alias("handler"))
    operations = part.filter("p_partkey % 5 < 3").select(F.when(F.col("p_partkey") % 3 == 0, F.format_string("h%d", "p_partkey")).otherwise(F.format_string("x%d", "p_partkey")).alias("operation_id"), F.lit("s").alias("summary"), F.when(F.col("p_size") % 2 == 0, "GET").otherwise("post").alias("method"), F.concat(F.lit("/parts/"), F.lower("p_type"), F.lit("/{id}")).alias("path"))
    return mapping.enrich_endpoints(endpoints, operations).select("id", F.col("operation.operation_id").alias("operation"), "matched_by", "ambiguous")


@query("SELECT 'queue:' || p_brand AS id, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS job_types FROM part GROUP BY p_brand")
def enrich_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    queues = part.select(F.concat(F.lit("queue:"), "p_brand").alias("id")).distinct()
    return mapping.enrich_jobs(queues, part.select(F.col("p_brand").alias("queue"), F.col("p_type").alias("type"))).select("id", F.array_join("job_types", " ").alias("job_types"))
