"""Driver queries over the shared tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import names
from loomgraph.operators import index, match, search
from loomgraph.plans import graph as G
from loomgraph.plans import paths, projection
from loomgraph.sources.tables import materialize, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


EVENT_EDGES = """
e AS (SELECT event_id, event_type, user_id, 'nats:events.' || event_type || '.' || (user_id % 10)::VARCHAR AS subject, 'service:' || user_id::VARCHAR AS owner, event_type IN ('view', 'click') AS hears FROM events)
"""
ANSWER = """SELECT '{role}' AS role, owner, subject AS counterpart, '{kind}' AS kind, event_type AS file, (event_id % 1000)::INTEGER AS line, NULL::VARCHAR AS subject_pattern, FALSE AS dynamic
FROM e WHERE {hears} hears AND ({test})"""


@query("WITH" + EVENT_EDGES + ANSWER.format(role="sender", kind="nats-publish", hears="NOT", test="regexp_full_match(subject, 'nats:events\\.[^.]+\\.3')"))
def publishers_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.publishers(projection.event_graph(spark, sf_dir), "events.*.3").rows


@query("WITH" + EVENT_EDGES + ANSWER.format(role="receiver", kind="nats-subscribe", hears="", test="regexp_full_match(subject, 'nats:events\\.view\\..+')"))
def subscribers_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.subscribers(projection.event_graph(spark, sf_dir), "events.view.>").rows


TRADE = """
l AS (SELECT *, l_orderkey * 8 + l_linenumber AS at_ FROM lineitem),
edges AS (
  SELECT 'of-region' AS kind, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, n_nationkey::BIGINT AS ord FROM nation
  UNION ALL SELECT 'of-nation', 'customer:' || c_custkey, 'nation:' || c_nationkey, c_custkey + 1 * (1::BIGINT << 40) FROM customer
  UNION ALL SELECT 'of-nation', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, s_suppkey + 2 * (1::BIGINT << 40) FROM supplier
  UNION ALL SELECT 'places', 'customer:' || o_custkey, 'order:' || o_orderkey, o_orderkey + 3 * (1::BIGINT << 40) FROM orders
  UNION ALL SELECT 'holds', 'order:' || l_orderkey, 'part:' || l_partkey, min(at_) + 4 * (1::BIGINT << 40) FROM l GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'made-by', 'part:' || l_partkey, 'supplier:' || l_suppkey, min(at_) + 5 * (1::BIGINT << 40) FROM l GROUP BY l_partkey, l_suppkey
)
"""


@query(
    "WITH" + TRADE + """, n AS (
  SELECT 'region' AS kind FROM region UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'customer' FROM customer
  UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'part' FROM part UNION ALL SELECT 'order' FROM orders
), b AS (SELECT 'nodes' AS part, kind FROM n UNION ALL SELECT 'edges', kind FROM edges)
SELECT part, kind, count(*) AS n FROM b GROUP BY GROUPING SETS ((part, kind), (part))"""
)
def stats_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stats(projection.trade_graph(spark, sf_dir))


SUPPLY = """
p AS (SELECT l_suppkey, l_partkey, min(l_orderkey * 8 + l_linenumber) AS at_ FROM lineitem GROUP BY ALL),
produce AS (SELECT 'service:' || l_suppkey AS src, 'queue:' || l_partkey AS dst, 'queue-produce' AS kind, (at_ // 8)::VARCHAR AS file, (at_ % 8)::INTEGER AS line, at_ AS ord FROM p),
access AS (SELECT 'service:' || l_suppkey AS src, 'db-table:' || p_brand AS dst, 'db-access' AS kind, p_brand AS file, (min(at_) % 8)::INTEGER AS line, min(at_) AS ord FROM p JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand),
relation AS (SELECT 'db-table:' || p_partkey AS src, 'db-table:' || p_brand AS dst, 'db-relation' AS kind, 'part' AS file, 0 AS line, p_partkey AS ord FROM part)
"""
SITES = "SELECT '{role}' AS role, src AS owner, dst AS counterpart, kind, file, line, NULL::VARCHAR AS subject_pattern, FALSE AS dynamic FROM {of} WHERE dst = '{dst}'"


@query("WITH" + SUPPLY + SITES.format(role="producer", of="produce", dst="queue:7"))
def queue_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.queue_producers(projection.supply_graph(spark, sf_dir), "7").rows


@query("WITH" + SUPPLY + SITES.format(role="accessor", of="(SELECT * FROM access UNION ALL SELECT * FROM relation)", dst="db-table:Brand#7"))
def table_users_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.table_users(projection.supply_graph(spark, sf_dir), "Brand#7").rows


@query("WITH" + SUPPLY + "SELECT src, dst, kind, file, line, ord FROM produce")
def edge_list_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = projection.supply_graph(spark, sf_dir).edges
    return edges.filter("kind = 'queue-produce'").select("src", "dst", "kind", "file", "line", "ord")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("kind", "n", F.transform("neighbours", lambda x: x["counterpart"]).alias("c")).select("kind", "n", F.array_join("c", ",").alias("neighbours"))


GROUPED = "SELECT kind, count(*) AS n, string_agg({other}, ',' ORDER BY ord, {other}) AS neighbours FROM (SELECT * FROM produce UNION ALL SELECT * FROM access UNION ALL SELECT * FROM relation) WHERE {own} = '{id}' GROUP BY kind"


@query("WITH" + SUPPLY + GROUPED.format(own="src", other="dst", id="service:3"))
def deps_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(G.dependencies(projection.supply_graph(spark, sf_dir), "service:3"))


@query("WITH" + SUPPLY + GROUPED.format(own="dst", other="src", id="db-table:Brand#7"))
def dependents_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(G.dependents(projection.supply_graph(spark, sf_dir), "db-table:Brand#7"))


@query("WITH" + TRADE + "SELECT 'outgoing' AS direction, kind, dst AS neighbour, ord FROM edges WHERE src = 'nation:5' UNION ALL SELECT 'incoming', kind, src, ord FROM edges WHERE dst = 'nation:5'")
def explain_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.explain(projection.trade_graph(spark, sf_dir), "nation:5").rows


@query(
    """SELECT cn.n_name AS src, sn.n_name AS dst, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS first_seen, cn.n_regionkey = sn.n_regionkey AS antipattern
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE c_nationkey <> s_nationkey
GROUP BY cn.n_name, sn.n_name, cn.n_regionkey, sn.n_regionkey"""
)
def usage_counts_antipattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses between owners, counted, with the first place, same-owner uses left out and those within a region marked."""
    t = lambda name: table(spark, sf_dir, name)
    used = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    ends = used.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
    counted = ends.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"))
    nation = t("nation")
    side = lambda n: nation.select(F.col("n_nationkey").alias(n), F.col("n_name").alias(f"{n}_name"), F.col("n_regionkey").alias(f"{n}_region"))
    return counted.join(side("a"), "a").join(side("b"), "b").select(F.col("a_name").alias("src"), F.col("b_name").alias("dst"), "n", "first_seen", (F.col("a_region") == F.col("b_region")).alias("antipattern"))


@query(
    """WITH parts AS (
  SELECT 0 AS part, doc_id AS ord, 'source:' || source AS id, lang AS label, NULL AS path, doc_id AS place FROM documents
  UNION ALL SELECT 1, doc_id, 'source:' || source, NULL, lang || '/' || source, doc_id FROM documents
  UNION ALL SELECT 2, doc_id, 'lang:' || lang, lang, source, doc_id FROM documents
), m AS (SELECT id, arg_max(label, (part, ord)) FILTER (WHERE label IS NOT NULL) AS label, arg_max(path, (part, ord)) FILTER (WHERE path IS NOT NULL) AS path, min((part, ord)) AS at_ FROM parts GROUP BY id)
SELECT id, label, path, at_[1] * (1::BIGINT << 40) + at_[2] AS ord FROM m"""
)
def assemble_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping node parts merged, the last value of each field winning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    none = F.lit(None).cast("string")
    of_source, of_lang = F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")
    parts = [(of_source, F.col("lang"), none), (of_source, none, F.concat_ws("/", "lang", "source")), (of_lang, F.col("lang"), F.col("source"))]
    rows = [docs.select(F.lit(n).alias("part"), F.col("doc_id").alias("ord"), i.alias("id"), label.alias("label"), path.alias("path")) for n, (i, label, path) in enumerate(parts)]
    nodes = rows[0].unionByName(rows[1]).unionByName(rows[2])
    edges = nodes.select("part", "ord", F.col("id"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("db-relation").alias("kind"))
    return G.assemble(nodes, edges).nodes.select("id", "label", "path", "ord")


def _at_rest(graph: G.Graph) -> G.Graph:
    """Walks read the edges once a level: a projected graph is written before."""
    return G.Graph(graph.nodes.select("id"), materialize(graph.edges.select("src", "dst", "kind", "ord")))


@query(
    "WITH RECURSIVE" + TRADE + """, walk AS (
  SELECT 'customer:1' AS node, 0 AS depth, []::STRUCT(ord BIGINT, node VARCHAR)[] AS ords, []::STRUCT(src VARCHAR, dst VARCHAR, kind VARCHAR)[] AS hops
  UNION ALL SELECT e.dst, w.depth + 1, list_append(w.ords, {'ord': e.ord, 'node': e.dst}), list_append(w.hops, {'src': e.src, 'dst': e.dst, 'kind': e.kind}) FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 5
), best AS (SELECT hops FROM walk WHERE node = 'supplier:1' ORDER BY depth, ords LIMIT 1)
SELECT (i - 1)::INTEGER AS hop, hops[i].src AS src, hops[i].dst AS dst, hops[i].kind AS kind FROM (SELECT hops, unnest(range(1, len(hops) + 1)) AS i FROM best)"""
)
def bfs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of the shortest path from a customer to a region, with ties by the order in which edges were seen."""
    graph = _at_rest(projection.trade_graph(spark, sf_dir))
    path = paths.find_path(graph, "customer:1", "supplier:1")
    rows = [(n, h["from"], h["to"], h["kind"]) for n, h in enumerate(path.edges)]
    return spark.createDataFrame(rows, "hop int, src string, dst string, kind string")


@query(
    "WITH RECURSIVE" + TRADE + """, walk AS (
  SELECT 'customer:1' AS node, 0 AS depth
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 5
) SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node"""
)
def reachability_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _at_rest(projection.trade_graph(spark, sf_dir))
    return paths.bfs_levels(graph.edges, "customer:1", max_depth=5).select("node", "depth")


@query(
    """WITH RECURSIVE t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
h AS (SELECT DISTINCT a, b FROM t WHERE b IS NOT NULL),
p AS (
  SELECT [a] AS nodes, b AS nxt FROM h
  UNION ALL SELECT list_append(nodes, nxt), h.b FROM p JOIN h ON h.a = p.nxt WHERE nxt > nodes[1] AND NOT list_contains(nodes, nxt)
) SELECT array_to_string(nodes, '>') AS cycle, len(nodes)::INTEGER AS length FROM p WHERE nxt = nodes[1]"""
)
def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary cycles of the transitions between event types."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select(F.lit("ts-import").alias("kind"), F.col("event_type").alias("src"), after.alias("dst")).filter("dst IS NOT NULL")
    found, _ = paths.cycles(edges)
    return found.select(F.array_join("nodes", ">").alias("cycle"), F.size("nodes").alias("length"))


OWNERS = [("example.com", "lib"), ("blog.example.com", "service"), ("example.net", "service"), ("example.net/en", "lib"), ("example.org/fr", "service")]


@query(
    """WITH o(root, kind) AS (VALUES ('example.com', 'lib'), ('example.net', 'service'), ('example.net/en', 'lib'), ('example.org/fr', 'service')),
u AS (SELECT page_id, regexp_extract(url, '://(?:[^/?#]*\\.)?(example\\.[a-z]+[^?#]*)', 1) AS path FROM pages)
SELECT page_id, arg_min(root, (kind = 'lib', -length(root))) AS owner, arg_min(kind, (kind = 'lib', -length(root))) AS kind FROM u LEFT JOIN o ON path = root OR starts_with(path, root || '/') GROUP BY page_id"""
)
def owner_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner of each url by the deepest root that it lies under, services before libs. Every prefix of a path is a key, so the join is an equal one."""
    from loomgraph.operators.mapping import find_owner

    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://(?:[^/?#]*\.)?(example\.[a-z]+[^?#]*)", 1).alias("path"))
    owners = spark.createDataFrame([(kind, root, root) for root, kind in OWNERS if not root.startswith("blog")], "kind string, id string, root_dir string")
    return find_owner(pages, owners, "path").select("page_id", F.col("owner_id").alias("owner"), F.col("owner_kind").alias("kind"))


@query(
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host FROM pages)
SELECT CASE WHEN contains(url, 'example.net') THEN 'internal:net' WHEN contains(url, 'example.org') THEN 'internal:org' WHEN host <> '' THEN 'external' ELSE 'unresolved' END AS target,
  CASE WHEN NOT contains(url, 'example.net') AND NOT contains(url, 'example.org') AND host <> '' THEN lower(host) END AS host, count(*) AS n FROM u GROUP BY ALL"""
)
def url_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators.mapping import classify_url

    pages = table(spark, sf_dir, "pages").select("url")
    target, host = classify_url(F.col("url"), {"net": ["example.net"], "org": ["example.org"]})
    return pages.groupBy(target.alias("target"), host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT labels.doc_id, CASE quality WHEN 1 THEN 'en' ELSE 'fr' END AS lang FROM labels),
s AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang)
SELECT l.doc_id, coalesce(d.doc_id, s.doc_id) AS matched, CASE WHEN d.doc_id IS NOT NULL THEN 1 WHEN s.doc_id IS NOT NULL THEN 2 END AS stage
FROM l LEFT JOIN (SELECT * FROM documents WHERE lang IN ('en', 'de')) d ON l.doc_id = d.doc_id LEFT JOIN (SELECT lang, min(doc_id) AS doc_id FROM documents WHERE lang IN ('en', 'de') GROUP BY lang) s ON l.lang = s.lang"""
)
def two_stage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to documents of two languages by id, else to the first of their own language."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("fr").alias("lang"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang")).filter(F.col("lang").isin("en", "de"))
    out = match.two_stage(labels, docs, ["doc_id"], ["lang"], "doc_id")
    return out.select("doc_id", F.col("match.doc_id").alias("matched"), "stage")


TOKENS = "[t FOR t IN regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9а-яё_]+') IF length(t) >= 2]"


@query(
    f"""WITH a AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS t FROM benchmark) GROUP BY 1),
b AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS t FROM documents) GROUP BY 1)
SELECT length(token)::INTEGER AS size, sum(coalesce(a.n, 0))::BIGINT AS n_truth, sum(coalesce(b.n, 0))::BIGINT AS n_found, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS n_matched,
  CASE WHEN sum(coalesce(a.n, 0)) = 0 THEN 1.0 ELSE sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::DOUBLE / sum(coalesce(a.n, 0)) END AS recall
FROM a FULL JOIN b USING (token) GROUP BY 1"""
)
def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = projection.token_rows(table(spark, sf_dir, "benchmark"), "text")
    found = projection.token_rows(table(spark, sf_dir, "documents"), "text")
    sized = lambda df: df.withColumn("size", F.length("token"))
    return match.multiset_recall(sized(truth), sized(found), ["token", "size"], ["size"])


@query(
    """WITH t AS (SELECT source AS file, count(*) AS n_truth FROM documents GROUP BY 1), f AS (SELECT source AS file, count(*) AS n_found FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT file, n_truth, coalesce(n_found, 0) AS n_found, least(1.0::DOUBLE, coalesce(n_found, 0) / n_truth) AS recall, greatest(0, n_truth - coalesce(n_found, 0)) AS gap
FROM t LEFT JOIN f USING (file) WHERE n_truth > coalesce(n_found, 0) ORDER BY gap DESC, file LIMIT 20"""
)
def per_file_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with the largest gap between truth and what was found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"))
    found = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return match.worst_files(match.file_recall(docs, found))


@query("SELECT lang AS kind, count(*) AS n, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) > 0) AS n_filled, (count(*) FILTER (WHERE length(trim(coalesce(text, ''))) > 0))::DOUBLE / count(*) AS rate, (count(*) FILTER (WHERE length(trim(coalesce(text, ''))) > 0))::DOUBLE / count(*) >= 0.85 AS ok FROM documents GROUP BY lang")
def fill_rate_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.fill_rate(table(spark, sf_dir, "documents").select("lang", "text"), "lang", "text")


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS b, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT item, count(*) AS n_item FROM s GROUP BY 1),
p AS (SELECT x.item, y.item AS other, count(*) AS n FROM s x JOIN s y ON x.b = y.b AND x.item <> y.item GROUP BY ALL)
SELECT item, other, n, n_item, n / n_item AS confidence FROM p JOIN c USING (item) WHERE n >= 3 AND n / n_item > 0.3"""
)
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return match.association_rules(lines, "l_orderkey", "p_type", 3, 0.3)


@query(
    """WITH c AS (SELECT p_brand AS kind, p_type AS place, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY kind) AS total FROM c)
SELECT kind, place, n, total::BIGINT AS total, n / total AS share FROM t WHERE total >= 5 AND n / total > 0.18"""
)
def placement_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.placement_shares(table(spark, sf_dir, "part").select("p_brand", "p_type"), "p_brand", "p_type", share=0.18)


@query(
    """WITH x AS (SELECT p_type AS kind, s AS suffix, count(*) FILTER (WHERE ends_with(p_name, s)) AS n, count(*) AS total FROM part, (VALUES ('ring'), ('bolt'), ('widget'), ('gear')) v(s) GROUP BY ALL)
SELECT kind, suffix, n, total, n / total AS share FROM x WHERE n / total > 0.1"""
)
def naming_suffix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.suffix_shares(table(spark, sf_dir, "part").select("p_type", "p_name"), "p_type", "p_name", ["ring", "bolt", "widget", "gear"], 0.1)


@query(
    """WITH g AS (SELECT p_name AS fqn, count(*) AS n, count(DISTINCT p_brand) AS owners, bool_and(p_size <= 5) AS small FROM part GROUP BY 1)
SELECT fqn, n, owners, CASE WHEN small THEN 'structural-noise' WHEN owners > 1 THEN 'cross-service' ELSE 'intra-service' END AS class FROM g WHERE n > 1"""
)
def collision_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.codeintel import collision_groups

    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("fqn"), F.col("p_brand").alias("owner"), (F.col("p_size") <= 5).alias("noise"))
    return collision_groups(parts)


BENCH_QUERY = f"SELECT {TOKENS.format('text')} AS q FROM benchmark WHERE item_id = 0"
BM25_SQL = f"""
b25 AS (
  WITH c AS (SELECT doc_id AS ord, {{tokens}} AS t FROM {{corpus}}), q AS (SELECT unnest(q) AS w FROM ({{query}})), qc AS (SELECT w, count(*) AS m FROM q GROUP BY w),
  st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM c),
  tf AS (SELECT ord, len(t) AS dl, w, m, len([x FOR x IN t IF x = w]) AS tf FROM c, qc),
  df AS (SELECT w, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY w)
  SELECT ord, sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS bm25 FROM tf JOIN df USING (w), st WHERE tf > 0 GROUP BY ord
)"""


def _bench_words(spark: SparkSession, sf_dir: str) -> str:
    return table(spark, sf_dir, "benchmark").filter("item_id = 0").select("text").first()[0]


@query("WITH" + BM25_SQL.format(tokens=TOKENS.format("text"), corpus="documents", query=BENCH_QUERY) + " SELECT ord AS doc_id, round(bm25, 6) AS score FROM b25 ORDER BY bm25 DESC, ord LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search.bm25(docs, search.query_tokens(_bench_words(spark, sf_dir)), F.col("text"), "doc_id")
    return found.orderBy(F.desc("bm25"), "key").limit(50).select(F.col("key").alias("doc_id"), F.round("bm25", 6).alias("score"))


COSINE = "list_dot_product({0}::DOUBLE[], q.v) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({COSINE.format('embedding')}, 9) AS score FROM embeddings, q ORDER BY {COSINE.format('embedding')} DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    return search.knn(vectors, _first_vector(spark, sf_dir)).select(F.col("ord").alias("vec_id"), F.round("score", 9).alias("score"))


@query(
    "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), cand AS (SELECT d.*, lang || ' ' || source || '  ' || text AS body, " + COSINE.format("embedding") + " AS cosine FROM documents d JOIN embeddings e ON doc_id = vec_id, q), pool AS (SELECT * FROM cand WHERE cosine >= 0.0),"
    + BM25_SQL.format(tokens=TOKENS.format("body"), corpus="pool", query=BENCH_QUERY)
    + """, r AS (SELECT p.doc_id, p.lang, p.cosine, row_number() OVER (ORDER BY p.cosine DESC, p.doc_id) AS dense FROM pool p),
lx AS (SELECT b25.ord AS doc_id, row_number() OVER (ORDER BY bm25 DESC, cosine DESC, b25.ord) AS lexical FROM b25 JOIN pool ON b25.ord = pool.doc_id),
s AS (SELECT r.*, lexical, (1.0::DOUBLE / (60 + dense) + coalesce(1.0::DOUBLE / (60 + lexical), 0)) * CASE lang WHEN 'en' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS score FROM r LEFT JOIN lx USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, cosine DESC, doc_id::VARCHAR) AS nth FROM s)
SELECT doc_id::VARCHAR AS node_id, lang AS kind, dense::INTEGER AS dense, lexical::INTEGER AS lexical, round(score, 9) AS score FROM n WHERE nth <= CASE lang WHEN 'en' THEN 4 ELSE 3 END ORDER BY score DESC, cosine DESC, node_id LIMIT 10"""
)
def hybrid_rrf_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid(projection.records(spark, sf_dir), _first_vector(spark, sf_dir), _bench_words(spark, sf_dir), least=0.0, boosts={"en": 1.2}, quotas={"en": 4, "fr": 3, "de": 3, "es": 3})
    return found.select("node_id", "kind", "dense", "lexical", F.round("score", 9).alias("score"))


@query(
    """WITH cur AS (SELECT doc_id::VARCHAR AS id, sha256(lang || '|' || source || '|' || coalesce(text, '') || '|m') AS h FROM documents),
old AS (SELECT d.doc_id::VARCHAR AS id, sha256(lang || '|' || source || '|' || coalesce(CASE toxic WHEN 1 THEN upper(text) ELSE text END, '') || '|m') AS h FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'gone-' || region.r_regionkey, '' FROM region)
SELECT CASE WHEN cur.id IS NULL THEN 'deleted' WHEN cur.h = old.h THEN 'reused' ELSE 'recompute' END AS state, count(*) AS n FROM cur FULL JOIN old USING (id) GROUP BY 1"""
)
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of an index of labelled documents, some changed and some gone since."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    h = lambda text: index.content_hash(F.col("lang"), F.col("source"), text, "m")
    current = docs.select(F.col("doc_id").cast("string").alias("node_id"), h(F.col("text")).alias("content_hash"))
    prior = docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("node_id"), h(F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text"))).alias("content_hash"))
    gone = table(spark, sf_dir, "region").select(F.concat(F.lit("gone-"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("").alias("content_hash"))
    return index.split_changes(current, prior.unionByName(gone)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, target, count(*) AS n FROM m GROUP BY ALL"""
)
def html_regex_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by pattern, the independent truth that parsed links are held against."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    return pages.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH f AS (SELECT doc_id, source, regexp_replace(lower(split_part(coalesce(text, ''), E'\n', 1)), '[^\p{L}\p{N} -]', '', 'g') AS kept FROM documents),
b AS (SELECT doc_id, source, coalesce(nullif(trim(regexp_replace(kept, '[ -]+', '-', 'g'), '-'), ''), 'section') AS base FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY doc_id) - 1 AS k FROM b)
SELECT doc_id, source, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS slug FROM n"""
)
def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators.docs import number_slugs

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("heading"))
    return number_slugs(docs, "source", "heading", "doc_id").select("doc_id", "source", "slug")


@query(
    """WITH r AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 5 END AS sink FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sink, event_id) AS nth FROM r) SELECT user_id, event_id, event_type, nth::INTEGER AS nth FROM n WHERE nth <= 10"""
)
def sink_ranked_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.codeintel import rank_of

    order = {"purchase": 0, "signup": 1, "error": 2, "click": 3}
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(rank_of(F.col("event_type"), order, 5), "event_id"))
    return events.withColumn("nth", nth).filter("nth <= 10")


@query(
    r"""WITH p AS (SELECT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages), r AS (SELECT regexp_replace(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '/+$', '') AS bare FROM p)
SELECT CASE WHEN bare = '' THEN '/' ELSE regexp_replace(bare, '/[0-9]+$', '/:id') END AS route, count(*) AS n FROM r GROUP BY 1"""
)
def route_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    return pages.groupBy(names.route_of(F.col("path")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH RECURSIVE lines AS (SELECT doc_id::VARCHAR AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
parts AS (SELECT file, t, row_number() OVER (PARTITION BY file ORDER BY i) AS i, len(regexp_extract_all(t, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM lines WHERE regexp_matches(t, '\S')),
walk AS (
  SELECT file, i, 0 AS chunk, n AS used, n, length(t) AS chars FROM parts WHERE i = 1
  UNION ALL SELECT p.file, p.i, w.chunk + CASE WHEN w.used + p.n <= 100 THEN 0 ELSE 1 END, CASE WHEN w.used + p.n <= 100 THEN w.used + p.n ELSE p.n END, p.n, length(p.t) FROM walk w JOIN parts p ON p.file = w.file AND p.i = w.i + 1
) SELECT file, chunk::INTEGER AS chunk_index, sum(n)::INTEGER AS token_count, (sum(chars) + 2 * (count(*) - 1))::INTEGER AS char_count FROM walk GROUP BY file, chunk"""
)
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed greedily into chunks of a hundred tokens."""
    from loomgraph.operators.docs import pack_documents

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return pack_documents(docs, "file", "text", 100)


@query()
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flowchart of one supplier's slice, a row a line."""
    from loomgraph.operators.render import mermaid_lines as lines

    graph = G.slice_service(projection.supply_graph(spark, sf_dir), "3")
    return lines(graph)


CODE = """
s AS (
  SELECT 'symbol:' || p_partkey AS id, CASE WHEN p_size <= 10 THEN 'method' WHEN p_size <= 30 THEN 'class' ELSE 'field' END AS kind, p_name AS name, p_brand || '.' || p_name AS fqn,
    CASE WHEN p_partkey % 2 = 0 THEN 'apps/' ELSE 'libs/' END || p_brand || '/src/' || lower(p_type) || '.ts' AS file, p_partkey AS line, round(p_retailprice / 10000, 6) AS quality_score FROM part
),
c AS (
  SELECT l_orderkey * 8 + l_linenumber AS n, 'symbol:' || l_partkey AS caller_id, 'f' || l_partkey AS caller, CASE WHEN l_returnflag <> 'R' THEN 'symbol:' || l_suppkey END AS callee_id,
    'Supplier' || l_suppkey AS callee, l_shipmode AS receiver, 'apps/o' || (l_orderkey % 100) || '.ts' AS file, l_linenumber AS line FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)
)
"""


@query("WITH" + CODE + "SELECT fqn, count(*) AS n, count(DISTINCT regexp_extract(file, '((?:apps|libs)/[^/]+)', 1)) AS owners FROM s GROUP BY fqn HAVING count(*) > 1")
def code_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several symbols have, with how many owners."""
    from loomgraph.plans.codeintel import self_check

    return self_check(projection.code_tables(spark, sf_dir))[1].select("fqn", "n", "owners")


@query("WITH" + CODE + "SELECT id, fqn, file, line::INTEGER AS line FROM s WHERE fqn = 'ring' OR contains(fqn, 'ring') ORDER BY CASE kind WHEN 'method' THEN 0 WHEN 'class' THEN 1 ELSE 2 END, length(fqn), fqn, file, line LIMIT 10")
def code_resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.codeintel import resolve_symbol

    return resolve_symbol(projection.code_tables(spark, sf_dir), "ring").select("id", "fqn", "file", "line")


@query("WITH" + CODE + "SELECT fqn, quality_score FROM s WHERE kind = 'class' ORDER BY quality_score DESC, file, line LIMIT 3")
def code_blueprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.codeintel import blueprint

    return blueprint(projection.code_tables(spark, sf_dir), "class").select("fqn", "quality_score")


@query("WITH" + CODE + "SELECT caller AS \"by\", file, line::INTEGER AS line FROM c WHERE callee = 'Supplier7' OR ends_with(callee, '.Supplier7') OR contains(callee, 'Supplier7') ORDER BY file, line, caller LIMIT 50")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.codeintel import references

    return references(projection.code_tables(spark, sf_dir), "Supplier7").select("by", "file", "line")


@query("WITH" + CODE + "SELECT receiver, count(*) AS n FROM c WHERE callee_id IS NULL GROUP BY receiver ORDER BY n DESC, receiver LIMIT 10")
def code_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.codeintel import diagnostics

    return diagnostics(projection.code_tables(spark, sf_dir))[1].select("receiver", "n")


@query()
def code_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that one symbol makes, and those that they make, in order."""
    from loomgraph.plans.codeintel import trace

    steps = trace(projection.code_tables(spark, sf_dir), "Brand#7.")
    return spark.createDataFrame([(n, s["depth"], s["caller"], s["callee"]) for n, s in enumerate(steps)], "n int, depth int, caller string, callee string")


@query(
    """WITH e AS (SELECT doc_id, quality, toxic FROM labels), r AS (SELECT doc_id, lang, source, n_chars / 10000 AS score FROM documents),
h AS (SELECT e.*, coalesce(bool_or(score >= 0.05 AND lang IN ('en', 'fr') AND contains(lower(source), 'src1')), FALSE) AS hit FROM e LEFT JOIN r USING (doc_id) GROUP BY ALL)
SELECT quality::VARCHAR AS project, toxic::VARCHAR AS category, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, avg(hit::INT) AS rate FROM h GROUP BY ROLLUP (quality, toxic)"""
)
def eval_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of golden queries by project and category, with subtotals."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query_id"), F.col("quality").cast("string").alias("project"), F.col("toxic").cast("string").alias("category"))
    expected = labels.select("*", F.array(F.lit("en"), F.lit("fr")).alias("kinds"), F.array(F.lit("SRC1")).alias("labels"), F.lit(0.05).alias("min_score"))
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("query_id"), F.col("lang").alias("kind"), F.col("source").alias("label"), (F.col("n_chars") / 10000).alias("score"))
    return search.hit_rate(results, expected)


@query(
    """WITH s AS (SELECT source AS file, max_by(lang, doc_id) AS site FROM documents GROUP BY source) SELECT l.doc_id, d.source AS file, s.site FROM labels l JOIN documents d USING (doc_id) LEFT JOIN s ON s.file = d.source"""
)
def lookup_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth rows with the last site of their key, which they may share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), "lang")
    truth = table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", "file"), "doc_id")
    return match.lookup_match(truth, docs.withColumnRenamed("doc_id", "at"), ["file"], F.col("at")).select("doc_id", "file", F.col("site.lang").alias("site"))


@query("WITH" + SUPPLY + ", e AS (SELECT * FROM access UNION ALL SELECT * FROM relation) SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY kind")
def slice_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the database domain."""
    part = G.slice_domain(projection.supply_graph(spark, sf_dir), "typeorm")
    return part.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(
    r"""WITH b AS (SELECT doc_id::VARCHAR AS id, regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') AS base FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b)
SELECT id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS safe, n > 1 AS collides FROM n"""
)
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of letters and digits with suffixes where several come to the same."""
    from loomgraph.operators.render import numbered_ids

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.regexp_replace("source", "[^A-Za-z0-9_]", "_").alias("base"))
    return numbered_ids(docs).select("id", "safe", F.col("collides"))


@query()
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and chunks of all documents, taken as Markdown."""
    from loomgraph.operators.docs import split_markdown

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return split_markdown(docs).select("file", "heading_level", "start_line", "end_line", "chunk_index", "chunk_of", "token_count", "char_count")


@query(
    """SELECT doc_id::VARCHAR AS node_id, sha256(lang || '|' || source || '|' || source || ' ' || lang || CASE WHEN length(text) > 0 THEN chr(10) || text ELSE '' END || '|hashing') AS content_hash, 256 AS dim FROM documents"""
)
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search records of all documents, embedded offline."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("label"), F.lit("").alias("path"), F.col("text").alias("snippet"), F.col("doc_id").alias("ord"))
    return index.build_index(docs, None, "hashing").select("node_id", "content_hash", F.size("vector").alias("dim"))
