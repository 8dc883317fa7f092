"""Driver queries of the mappers: site tables made of the shared tables, mapped to nodes, edges and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import mapping
from loomgraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: A call site a line item: its file lies below one of 20 folders, of which the first 12 are services, the next 4 libs and the others nobody's.
SITES = """
s AS (
  SELECT l_suppkey % 20 AS k, 'apps/s' || (l_suppkey % 20) || '/p' || (l_partkey % 50) || '.ts' AS file, (l_orderkey % 300)::INTEGER AS line, ((l_orderkey * 8 + l_linenumber) * 10000 + l_suppkey) * 1000000 + l_partkey AS ord,
    CASE WHEN l_suppkey % 20 < 12 THEN 'service' WHEN l_suppkey % 20 < 16 THEN 'lib' END AS owner_kind, CASE WHEN l_suppkey % 20 < 16 THEN 's' || (l_suppkey % 20) END AS owner_id,
    CASE WHEN l_suppkey % 20 < 12 THEN 'service:s' WHEN l_suppkey % 20 < 16 THEN 'lib:s' END || (l_suppkey % 20) AS own, l_partkey % 30 AS p, l_linenumber % 4 AS q, l_returnflag AS flag, l_orderkey % 7 AS o
  FROM lineitem
),
owners AS (SELECT CASE WHEN k < 12 THEN 'service' ELSE 'lib' END AS kind, 's' || k AS id, 'apps/s' || k AS root_dir FROM (SELECT unnest(range(16)) AS k))
"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    file = F.format_string("apps/s%d/p%d.ts", F.col("l_suppkey") % 20, F.col("l_partkey") % 50)
    return lines.select(file.alias("file"), (F.col("l_orderkey") % 300).cast("int").alias("line"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000 + F.col("l_suppkey")) * 1000000 + F.col("l_partkey")).alias("ord"), (F.col("l_partkey") % 30).alias("p"), (F.col("l_linenumber") % 4).alias("q"), F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") % 7).alias("o"))


def _owners(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("service" if k < 12 else "lib", f"s{k}", f"apps/s{k}") for k in range(16)], "kind string, id string, root_dir string")


def node_sql(of: str, node: str, kind: str, label: str, path: str = "NULL::VARCHAR", meta: str = "NULL::VARCHAR", ord_: str = "ord") -> str:
    """The first node of each id."""
    return f"SELECT id, r.kind AS kind, r.label AS label, r.path AS path, r.meta AS meta, r.ord AS ord FROM (SELECT {node} AS id, arg_min({{'kind': {kind}, 'label': {label}, 'path': {path}, 'meta': {meta}, 'ord': {ord_}}}, {ord_}) AS r FROM {of} WHERE ({node}) IS NOT NULL GROUP BY 1)"


def edge_sql(of: str, kind: str, src: str, dst: str, by: str = "NULL", meta: str = "NULL::VARCHAR", dynamic: str = "FALSE", pattern: str = "NULL::VARCHAR") -> str:
    """The first edge of each id."""
    whole = f"concat_ws(':', {kind} || ':' || ({src}) || '->' || ({dst}), {by})"
    return (
        f"SELECT id, r.src AS src, r.dst AS dst, r.kind AS kind, r.dynamic AS dynamic, r.pattern AS subject_pattern, r.file AS file, r.line AS line, r.meta AS meta, r.ord AS ord "
        f"FROM (SELECT {whole} AS id, arg_min({{'src': {src}, 'dst': {dst}, 'kind': {kind}, 'dynamic': {dynamic}, 'pattern': {pattern}, 'file': file, 'line': line, 'meta': {meta}, 'ord': ord}}, ord) AS r FROM {of} WHERE ({src}) IS NOT NULL AND ({dst}) IS NOT NULL GROUP BY 1)"
    )


def note_sql(of: str, domain: str, reason: str) -> str:
    """Counts by reason, with the first five places."""
    return (
        f"SELECT '{domain}' AS domain, reason, any_value(n)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(place))), ' ') AS examples FROM "
        f"(SELECT reason, file || ':' || line AS place, count(*) OVER (PARTITION BY reason) AS n, row_number() OVER (PARTITION BY reason ORDER BY file, line) AS nth FROM (SELECT *, {reason} AS reason FROM {of}) WHERE reason IS NOT NULL) WHERE nth <= 5 GROUP BY reason"
    )


OWNER_NODES = node_sql("ok", "own", "owner_kind", "owner_id")


def rows(name: str, given: str, nodes: list[str] | None, edges: list[str] | None, notes: list[str] | None):
    """Register a mapper's three tables under ``name_nodes``, ``name_edges`` and ``name_notes``."""

    def put(f):
        parts = {"nodes": (0, nodes, None), "edges": (1, edges, None), "notes": (2, notes, "examples")}
        for part, (at, sql, joined) in parts.items():
            if sql is None:
                continue

            def run(spark: SparkSession, sf_dir: str, at=at, joined=joined) -> DataFrame:
                found = f(spark, sf_dir)[at]
                if joined:
                    return found.withColumn(joined, F.array_join(joined, " "))
                return found.drop("anchor")

            QUERIES[f"{name}_{part}"] = run
            ORACLE_SQL[f"{name}_{part}"] = "WITH" + SITES + "," + given + "\n" + "\nUNION ALL ".join(sql)
        return f

    return put


SUBJECT_KIND = "CASE q WHEN 2 THEN 'pattern' WHEN 3 THEN 'dynamic' ELSE 'literal' END"
SERVICES = "SELECT 'service:' || id AS id, 'service' AS kind, id AS label, root_dir AS path, NULL::VARCHAR AS meta, -1::BIGINT AS ord FROM owners WHERE kind = 'service'"


@rows(
    "map_subjects",
    f"""own AS (SELECT *, {SUBJECT_KIND} AS subject_kind, CASE q WHEN 2 THEN 'a.*.' ELSE 'a.b.' END || p AS subject, CASE flag WHEN 'A' THEN 'nats-publish' WHEN 'N' THEN 'nats-subscribe' ELSE 'nats-request' END AS edge_kind FROM s),
ok AS (SELECT *, 'nats:' || subject AS node FROM own WHERE own IS NOT NULL AND subject_kind <> 'dynamic')""",
    [SERVICES, OWNER_NODES, node_sql("ok", "node", "'nats-subject'", "subject")],
    [edge_sql("ok", "edge_kind", "CASE WHEN flag = 'N' THEN node ELSE own END", "CASE WHEN flag = 'N' THEN own ELSE node END", by="file || ':' || line", dynamic="subject_kind = 'pattern'", pattern="CASE WHEN subject_kind = 'pattern' THEN subject END")],
    [note_sql("own", "nats", "CASE WHEN own IS NULL THEN 'unowned' WHEN subject_kind = 'dynamic' THEN 'dynamic' END")],
)
def map_subjects(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    kind = F.when(F.col("q") == 2, "pattern").when(F.col("q") == 3, "dynamic").otherwise("literal")
    subject = F.concat(F.when(F.col("q") == 2, "a.*.").otherwise("a.b."), F.col("p").cast("string"))
    edge = F.when(F.col("flag") == "A", "nats-publish").when(F.col("flag") == "N", "nats-subscribe").otherwise("nats-request")
    return mapping.map_subjects(_sites(spark, sf_dir).select("file", "line", "ord", kind.alias("subject_kind"), subject.alias("subject"), edge.alias("edge_kind")), _owners(spark))


@rows(
    "map_rmq",
    "own AS (SELECT *, CASE WHEN q <> 3 THEN 'r.' || p END AS subject FROM s), ok AS (SELECT *, 'rmq:' || subject AS node FROM own WHERE own IS NOT NULL AND subject IS NOT NULL)",
    [SERVICES, OWNER_NODES, node_sql("ok", "node", "'rmq-pattern'", "subject")],
    [edge_sql("ok", "'rmq-subscribe'", "node", "own", by="file || ':' || line")],
    [note_sql("own", "rmq", "CASE WHEN own IS NULL THEN 'unowned' WHEN subject IS NULL THEN 'unresolved' END")],
)
def map_rmq(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    return mapping.map_rmq(_sites(spark, sf_dir).select("file", "line", "ord", F.when(F.col("q") != 3, F.format_string("r.%d", "p")).alias("subject")), _owners(spark))


DECORATOR = "CASE p % 4 WHEN 0 THEN 'ManyToOne' WHEN 1 THEN 'OneToOne' WHEN 2 THEN 'ManyToMany' ELSE 'OneToMany' END"


@rows(
    "map_tables",
    f"""own AS (SELECT *, CASE WHEN q <> 3 THEN 't' || p END AS tab FROM s), ok AS (SELECT *, 'db-table:' || tab AS node FROM own WHERE own IS NOT NULL AND tab IS NOT NULL),
r AS (SELECT *, {DECORATOR} AS decorator, 't' || p AS owner_table, CASE WHEN o <> 0 THEN 't' || o END AS target_table, 'f' || q AS property, CASE WHEN p % 8 = 2 THEN 'j' || p END AS join_table, o > 3 AS has_join FROM s),
rel AS (SELECT * FROM r WHERE target_table IS NOT NULL AND (decorator = 'ManyToOne' OR (decorator = 'OneToOne' AND has_join) OR (decorator = 'ManyToMany' AND join_table IS NOT NULL)))""",
    [OWNER_NODES, node_sql("ok", "node", "'db-table'", "tab"), *[node_sql("rel", f"'db-table:' || {c}", "'db-table'", c) for c in ("owner_table", "target_table", "join_table")]],
    [edge_sql("ok", "'db-access'", "own", "node"), edge_sql("rel", "'db-relation'", "'db-table:' || owner_table", "'db-table:' || target_table", by="property", meta="""'{"decorator":"' || decorator || '","property":"' || property || '"' || coalesce(',"join_table":"' || join_table || '"', '') || '}'""")],
    [note_sql("own", "typeorm", "CASE WHEN own IS NULL THEN 'unowned' WHEN tab IS NULL THEN 'unknown entity' END"), note_sql("r", "typeorm", "CASE WHEN target_table IS NULL THEN 'unresolved relation' END")],
)
def map_tables(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    sites = _sites(spark, sf_dir)
    decorator = F.element_at(F.array(*map(F.lit, ("ManyToOne", "OneToOne", "ManyToMany", "OneToMany"))), (F.col("p") % 4 + 1).cast("int"))
    relations = sites.select("file", "line", "ord", decorator.alias("decorator"), F.format_string("t%d", "p").alias("owner_table"), F.when(F.col("o") != 0, F.format_string("t%d", "o")).alias("target_table"), F.format_string("f%d", "q").alias("property"), F.when(F.col("p") % 8 == 2, F.format_string("j%d", "p")).alias("join_table"), (F.col("o") > 3).alias("has_join_column"))
    return mapping.map_tables(sites.select("file", "line", "ord", F.format_string("E%d", "p").alias("entity_class"), F.when(F.col("q") != 3, F.format_string("t%d", "p")).alias("table")), relations, _owners(spark))


ROLE = "CASE o WHEN 0 THEN 'produce' WHEN 1 THEN 'consume' WHEN 2 THEN 'register' WHEN 3 THEN 'listen' WHEN 4 THEN 'repeat' WHEN 5 THEN 'fails-into' ELSE 'produce' END"


@rows(
    "map_queues",
    f"""own AS (SELECT *, {ROLE} AS role, CASE WHEN q <> 3 THEN 'q' || p END AS queue, CASE WHEN o = 5 THEN 'q' || (p // 2) END AS other, CASE WHEN o = 3 THEN 'on' || q END AS event, CASE WHEN o = 4 AND q = 1 THEN '* * ' || p END AS cron,
  CASE WHEN o = 2 AND q = 0 THEN p::INTEGER END AS concurrency, CASE WHEN o = 2 AND q = 1 THEN 5 END AS delay, p % 3 = 0 AND o = 2 AS repeat FROM s),
ok AS (SELECT *, 'queue:' || queue AS node FROM own WHERE own IS NOT NULL AND queue IS NOT NULL),
m AS (SELECT queue, coalesce(arg_min(concurrency, ord) FILTER (WHERE concurrency IS NOT NULL), CASE WHEN bool_or(role = 'consume') THEN 1 END) AS concurrency, arg_min(delay, ord) FILTER (WHERE delay IS NOT NULL) AS delay, bool_or(repeat) AS repeat,
  '[' || string_agg('"' || file || ':' || line || '"', ',' ORDER BY ord) FILTER (WHERE role = 'register') || ']' AS at_, min(ord) AS ord FROM ok GROUP BY queue)""",
    [
        OWNER_NODES,
        """SELECT 'queue:' || queue AS id, 'queue' AS kind, queue AS label, NULL::VARCHAR AS path, '{' || coalesce('"concurrency":' || concurrency || ',', '') || coalesce('"delay":' || delay || ',', '') || '"repeat":' || repeat || ',"fail_over":false,"declared_at":' || coalesce(at_, '[]') || '}' AS meta, ord FROM m""",
        node_sql("(SELECT * FROM ok WHERE other IS NOT NULL)", "'queue:' || other", "'queue'", "other"),
    ],
    [
        edge_sql("(SELECT * FROM ok WHERE role = 'produce')", "'queue-produce'", "own", "node"),
        edge_sql("(SELECT * FROM ok WHERE role = 'consume')", "'queue-consume'", "node", "own"),
        edge_sql("(SELECT * FROM ok WHERE role = 'listen')", "'queue-event-listener'", "own", "node", by="event"),
        edge_sql("(SELECT * FROM ok WHERE role = 'fails-into' AND other <> queue)", "'queue-fails-into'", "node", "'queue:' || other"),
        edge_sql("(SELECT * FROM ok WHERE role = 'repeat' AND cron IS NOT NULL)", "'queue-repeat'", "node", "'cron-schedule:queue:' || cron || ':' || file || ':' || line"),
    ],
    [note_sql("own", "bullmq", "CASE WHEN own IS NULL THEN 'unowned' WHEN queue IS NULL THEN 'unresolved queue' END")],
)
def map_queues(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    role = F.element_at(F.array(*map(F.lit, ("produce", "consume", "register", "listen", "repeat", "fails-into", "produce"))), (F.col("o") + 1).cast("int"))
    o, q, p = F.col("o"), F.col("q"), F.col("p")
    sites = _sites(spark, sf_dir).select(
        "file", "line", "ord", role.alias("role"), F.when(q != 3, F.format_string("q%d", "p")).alias("queue"), F.when(o == 5, F.format_string("q%d", F.floor(p / 2))).alias("other"), F.when(o == 3, F.format_string("on%d", "q")).alias("event"), F.when((o == 4) & (q == 1), F.format_string("* * %d", "p")).alias("cron"),
        F.when((o == 2) & (q == 0), p.cast("int")).alias("concurrency"), F.when((o == 2) & (q == 1), 5).alias("delay"), F.lit(None).cast("int").alias("attempts"), ((p % 3 == 0) & (o == 2)).alias("repeat"), F.lit(False).alias("fail_over"),
    )
    return mapping.map_queues(sites, _owners(spark))


@rows(
    "map_schedules",
    """own AS (SELECT *, CASE WHEN o < 4 THEN 'cron' ELSE 'interval' END AS category, CASE WHEN q <> 3 THEN '* * ' || p END AS expression, 'n' || p AS name, CASE WHEN p % 2 = 0 THEN 'every ' || p END AS label, flag = 'R' AS dynamic FROM s),
ok AS (SELECT *, CASE WHEN dynamic THEN concat_ws(':', 'cron-schedule', category, owner_id, expression) ELSE concat_ws(':', 'cron-schedule', category, expression) END AS node FROM own WHERE own IS NOT NULL AND expression IS NOT NULL)""",
    [OWNER_NODES, node_sql("ok", "node", "'cron-schedule'", "coalesce(label, expression)", meta="""'{"category":"' || category || '","expression":"' || expression || '","name":"' || name || '"}'""")],
    [edge_sql("ok", "'cron-triggers'", "node", "own")],
    [note_sql("own", "cron", "CASE WHEN own IS NULL THEN 'unowned' WHEN expression IS NULL THEN 'unresolved expression' END")],
)
def map_schedules(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    sites = _sites(spark, sf_dir).select("file", "line", "ord", F.when(F.col("o") < 4, "cron").otherwise("interval").alias("category"), F.when(F.col("q") != 3, F.format_string("* * %d", "p")).alias("expression"), F.format_string("n%d", "p").alias("name"), F.when(F.col("p") % 2 == 0, F.format_string("every %d", "p")).alias("label"), (F.col("flag") == "R").alias("dynamic"))
    return mapping.map_schedules(sites, _owners(spark))


@rows(
    "map_modules",
    """refs AS (SELECT *, 'M' || p AS module, CASE o % 4 WHEN 0 THEN 'imports' WHEN 1 THEN 'providers' WHEN 2 THEN 'exports' ELSE 'controllers' END AS field, CASE q WHEN 3 THEN 'unresolved' WHEN 2 THEN 'dynamic' ELSE 'class' END AS ref_kind, CASE WHEN q <> 3 THEN CASE WHEN o % 4 = 0 THEN 'M' || (p // 2) ELSE 'P' || (p // 3) END END AS ref FROM s),
ok AS (SELECT *, 'module:' || module AS src, CASE WHEN field = 'imports' THEN 'module:' ELSE 'provider:' END || ref AS dst, CASE field WHEN 'imports' THEN 'di-import' WHEN 'providers' THEN 'di-provides' WHEN 'exports' THEN 'di-exports' ELSE 'di-controller' END AS kind FROM refs WHERE ref_kind <> 'unresolved'),
known AS (SELECT DISTINCT dst AS id FROM ok WHERE field <> 'imports'),
uses AS (SELECT *, 'provider:P' || (p % 12) AS a, 'provider:P' || (p % 9) AS b FROM s WHERE o = 1),
chain AS (SELECT *, CASE WHEN q < 2 THEN 'guard' ELSE 'pipe' END AS kind, 'P' || (p % 11) || '.run' AS attached, 'provider:P' || (p % 11) AS a, 'provider:P' || (p % 14) AS b FROM s WHERE o = 2)""",
    [node_sql("refs", "'module:' || module", "'module'", "module", path="file"), node_sql("ok", "dst", "CASE WHEN field = 'imports' THEN 'module' ELSE 'provider' END", "ref")],
    [
        edge_sql("ok", "kind", "src", "dst", dynamic="ref_kind = 'dynamic'"),
        edge_sql("(SELECT * FROM uses WHERE a IN (FROM known) AND b IN (FROM known))", "'di-uses'", "a", "b"),
        edge_sql("(SELECT * FROM chain WHERE a IN (FROM known) AND b IN (FROM known))", "'di-' || kind", "a", "b", by="attached"),
    ],
    [note_sql("refs", "di", "CASE WHEN ref_kind = 'unresolved' THEN 'unresolved' END"), note_sql("chain", "di", "CASE WHEN b NOT IN (FROM known) THEN 'unknown provider' END")],
)
def map_modules(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    sites = _sites(spark, sf_dir)
    o, q, p = F.col("o"), F.col("q"), F.col("p")
    field = F.when(o % 4 == 0, "imports").when(o % 4 == 1, "providers").when(o % 4 == 2, "exports").otherwise("controllers")
    ref = F.when(q != 3, F.when(o % 4 == 0, F.format_string("M%d", F.floor(p / 2))).otherwise(F.format_string("P%d", F.floor(p / 3))))
    refs = sites.select("file", "line", "ord", F.format_string("M%d", "p").alias("module"), field.alias("field"), F.when(q == 3, "unresolved").when(q == 2, "dynamic").otherwise("class").alias("ref_kind"), ref.alias("ref_name"))
    uses = sites.filter("o = 1").select("file", "line", "ord", F.format_string("P%d", p % 12).alias("class"), F.format_string("P%d", p % 9).alias("provider"))
    chain = sites.filter("o = 2").select("file", "line", "ord", F.when(q < 2, "guard").otherwise("pipe").alias("kind"), F.format_string("P%d.run", p % 11).alias("attached_to"), F.format_string("P%d", p % 14).alias("provider"))
    return mapping.map_modules(refs, uses, chain)


URL = "CASE WHEN p < 10 THEN 'http://orders.svc/x' || p WHEN p < 25 THEN 'https://api' || (p % 4) || '.example.com:80/y' ELSE '/relative' END"


@rows(
    "map_http",
    f"""own AS (SELECT *, CASE q WHEN 0 THEN 'literal' WHEN 1 THEN 'pattern' WHEN 2 THEN 'env-ref' ELSE 'unresolved' END AS url_kind, {URL} AS url, CASE WHEN p % 2 = 0 THEN 'ORDERS_URL' ELSE 'OTHER_URL' END AS env, CASE WHEN o < 3 THEN 'GET' ELSE 'POST' END AS method FROM s),
t AS (SELECT *, CASE WHEN q = 2 THEN CASE WHEN p % 2 = 0 THEN 'service:orders' END WHEN q < 2 THEN CASE WHEN p < 10 THEN 'service:orders' WHEN p < 25 THEN 'external:api' || (p % 4) || '.example.com' END END AS node FROM own),
ok AS (SELECT *, starts_with(node, 'service:') AS inside FROM t WHERE own IS NOT NULL AND node IS NOT NULL)""",
    [OWNER_NODES, node_sql("ok", "node", "CASE WHEN inside THEN 'service' ELSE 'external' END", "split_part(node, ':', 2)")],
    [edge_sql("ok", "CASE WHEN inside THEN 'http-call' ELSE 'http-external' END", "own", "node", meta="""'{"method":"' || method || '","url":"' || url || '"}'""")],
    [note_sql("t", "http", "CASE WHEN own IS NULL THEN 'unowned' WHEN node IS NULL THEN 'unresolved ' || url_kind END")],
)
def map_http(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    q, p = F.col("q"), F.col("p")
    url = F.when(p < 10, F.format_string("http://orders.svc/x%d", "p")).when(p < 25, F.format_string("https://api%d.example.com:80/y", p % 4)).otherwise("/relative")
    sites = _sites(spark, sf_dir).select("file", "line", "ord", F.when(q == 0, "literal").when(q == 1, "pattern").when(q == 2, "env-ref").otherwise("unresolved").alias("url_kind"), url.alias("url"), F.when(p % 2 == 0, "ORDERS_URL").otherwise("OTHER_URL").alias("env_var"), F.when(F.col("o") < 3, "GET").otherwise("POST").alias("method"))
    return mapping.map_http(sites, _owners(spark), {"orders": ["orders.svc"]}, {"ORDERS_URL": "orders"})


@rows(
    "map_imports",
    """own AS (SELECT *, CASE WHEN q <> 3 THEN 'apps/s' || (p % 20) || '/p' || (p * 7 % 50) || '.ts' END AS target, CASE WHEN q = 3 THEN CASE WHEN o < 3 THEN 'broken-alias' ELSE 'external' END ELSE 'relative' END AS resolution, CASE WHEN o = 0 THEN 'dynamic' WHEN o = 1 THEN 'require' ELSE 'static' END AS shape,
  CASE WHEN q <> 3 AND p % 20 < 12 THEN 'service' WHEN q <> 3 AND p % 20 < 16 THEN 'lib' END AS b_kind, 's' || (p % 20) AS b_id FROM s),
n AS (SELECT owner_kind, owner_id, own, b_kind, b_id, count(*) AS n, arg_min({'file': file, 'line': line}, ord) AS at_, min(ord) AS ord FROM own WHERE own IS NOT NULL AND b_kind IS NOT NULL AND (owner_kind <> b_kind OR owner_id <> b_id) GROUP BY ALL),
pairs AS (SELECT *, b_kind || ':' || b_id AS dst, at_.file AS file, at_.line AS line FROM n),
g AS (SELECT file, target, bool_or(shape = 'dynamic') AS dynamic, bool_or(shape = 'require') AS cjs, min(line) AS line, min(ord) AS ord FROM own WHERE target IS NOT NULL GROUP BY ALL)""",
    [node_sql("pairs", "own", "owner_kind", "owner_id"), node_sql("pairs", "dst", "b_kind", "b_id"), node_sql("g", "'file:' || file", "'file'", "file", path="file"), node_sql("g", "'file:' || target", "'file'", "target", path="target")],
    [edge_sql("pairs", "'lib-usage'", "own", "dst", meta="""'{"importCount":' || n || ',"antipattern":' || (b_kind = 'service') || '}'"""), edge_sql("g", "'ts-import'", "'file:' || file", "'file:' || target", meta="""'{"dynamic":' || dynamic || ',"cjsRequire":' || cjs || '}'""")],
    [note_sql("own", "imports", "CASE WHEN starts_with(resolution, 'broken') THEN resolution WHEN own IS NULL THEN 'unowned' END")],
)
def map_imports(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    o, q, p = F.col("o"), F.col("q"), F.col("p")
    target = F.when(q != 3, F.format_string("apps/s%d/p%d.ts", p % 20, p * 7 % 50))
    sites = _sites(spark, sf_dir).select("file", "line", "ord", target.alias("target_file"), F.when((q == 3) & (o < 3), "broken-alias").when(q == 3, "external").otherwise("relative").alias("resolution_kind"), F.when(o == 0, "dynamic").when(o == 1, "require").otherwise("static").alias("shape"))
    return mapping.map_imports(sites, _owners(spark), file_edges=True)


@rows(
    "map_front",
    """c AS (SELECT file, line, ord, 'C' || (p % 12) AS name FROM s WHERE o = 0), h AS (SELECT file, line, ord, 'useH' || p AS name FROM s WHERE o = 1), g AS (SELECT file, line, ord, 'Page' || p AS name, '/r/' || p AS route FROM s WHERE o = 2 AND q = 0),
d AS (SELECT file, line, ord, 'C' || (p % 5) AS component, 'C' || (p % 20) AS target FROM s WHERE o = 3), i AS (SELECT file, line, ord, CASE WHEN q <> 3 THEN 'apps/s' || (p % 20) || '/p' || (p * 7 % 50) || '.ts' END AS target_file FROM s WHERE o = 4 AND q IN (0, 3)),
same AS (SELECT name, file, arg_min('fe-component:' || file || '#' || name, ord) AS id FROM c GROUP BY ALL), any_ AS (SELECT name, arg_min('fe-component:' || file || '#' || name, ord) AS id FROM c GROUP BY ALL),
drawn AS (SELECT d.*, coalesce(same.id, any_.id) AS dst FROM d LEFT JOIN same ON same.name = d.target AND same.file = d.file LEFT JOIN any_ ON any_.name = d.target),
nodes AS (SELECT DISTINCT 'fe-component:' || file || '#' || name AS id, file AS path FROM c UNION ALL SELECT DISTINCT 'fe-hook:' || file || '#' || name, file FROM h UNION ALL SELECT DISTINCT 'fe-page:' || file || '#' || name, file FROM g),
links AS (SELECT i.file, i.line, i.ord, a.id AS a, b.id AS b FROM i JOIN nodes a ON a.path = i.file JOIN nodes b ON b.path = i.target_file WHERE a.id <> b.id)""",
    [node_sql("c", "'fe-component:' || file || '#' || name", "'fe-component'", "name", path="file"), node_sql("h", "'fe-hook:' || file || '#' || name", "'fe-hook'", "name", path="file"), node_sql("g", "'fe-page:' || file || '#' || name", "'fe-page'", "name", path="file"), node_sql("g", "'fe-route:' || route", "'fe-route'", "route")],
    [edge_sql("drawn", "'fe-renders'", "'fe-component:' || file || '#' || component", "dst"), edge_sql("g", "'fe-routes-to'", "'fe-route:' || route", "'fe-page:' || file || '#' || name"), edge_sql("links", "'fe-imports'", "a", "b")],
    [note_sql("drawn", "fe", "CASE WHEN dst IS NULL THEN 'unknown component' END")],
)
def map_front(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    s = _sites(spark, sf_dir)
    p = F.col("p")
    named = lambda of, name: s.filter(of).select("file", "line", "ord", name.alias("name"))
    pages = s.filter("o = 2 AND q = 0").select("file", "line", "ord", F.format_string("Page%d", "p").alias("name"), F.format_string("/r/%d", "p").alias("route"))
    renders = s.filter("o = 3").select("file", "line", "ord", F.format_string("C%d", p % 5).alias("component"), F.format_string("C%d", p % 20).alias("target"))
    imports = s.filter("o = 4 AND q IN (0, 3)").select("file", "line", "ord", F.when(F.col("q") != 3, F.format_string("apps/s%d/p%d.ts", p % 20, p * 7 % 50)).alias("target_file"))
    return mapping.map_front(named("o = 0", F.format_string("C%d", p % 12)), named("o = 1", F.format_string("useH%d", "p")), pages, renders, imports)


ENDPOINT_META = """'{"method":"' || method || '","pattern":"' || pattern || '","controller":"C' || p || '","handler":"h' || p || '"' || CASE WHEN q = 1 THEN ',"version":"' || q || '"' ELSE '' END || ',"status":' || (200 + o) || '}'"""


@rows(
    "map_endpoints",
    "own AS (SELECT *, CASE WHEN o < 4 THEN 'GET' ELSE 'POST' END AS method, '/v/' || p || '/:id' AS pattern FROM s), ok AS (SELECT *, 'endpoint:' || method || ' ' || pattern AS node FROM own WHERE own IS NOT NULL)",
    [OWNER_NODES, node_sql("ok", "node", "'endpoint'", "method || ' ' || pattern", path="file", meta=ENDPOINT_META)],
    [edge_sql("ok", "'endpoint-of'", "node", "own")],
    [note_sql("own", "endpoint", "CASE WHEN own IS NULL THEN 'unowned' END")],
)
def map_endpoints(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    sites = _sites(spark, sf_dir).select("file", "line", "ord", F.when(F.col("o") < 4, "GET").otherwise("POST").alias("method"), F.format_string("/v/%d/:id", "p").alias("pattern"), F.format_string("C%d", "p").alias("controller"), F.format_string("h%d", "p").alias("handler"), F.when(F.col("q") == 1, "1").alias("version"), (F.col("o") + 200).cast("int").alias("status"))
    return mapping.map_endpoints(sites, _owners(spark))


@rows(
    "map_config",
    "own AS (SELECT *, CASE WHEN q <> 3 THEN 'KEY_' || p END AS key, CASE WHEN o < 4 THEN 'env' ELSE 'service' END AS source FROM s), ok AS (SELECT *, 'config-field:' || key AS node FROM own WHERE own IS NOT NULL AND key IS NOT NULL)",
    [OWNER_NODES, node_sql("ok", "node", "'config-field'", "key", meta="""'{"source":"' || source || '"}'""")],
    [edge_sql("ok", "'config-read-by'", "node", "own")],
    [note_sql("own", "config", "CASE WHEN key IS NULL THEN 'key is no literal' WHEN own IS NULL THEN 'unowned' END")],
)
def map_config(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    return mapping.map_config(_sites(spark, sf_dir).select("file", "line", "ord", F.when(F.col("q") != 3, F.format_string("KEY_%d", "p")).alias("key"), F.when(F.col("o") < 4, "env").otherwise("service").alias("source")), _owners(spark))


@rows(
    "map_fields",
    """own AS (SELECT *, CASE WHEN q <> 3 THEN 't' || o END AS tab, 'f' || p AS field, CASE WHEN p % 2 = 0 THEN 'int' ELSE 'text' END AS type, flag = 'R' AS nullable FROM s), ok AS (SELECT * FROM own WHERE tab IS NOT NULL),
nth AS (SELECT *, row_number() OVER (PARTITION BY tab, field ORDER BY ord) AS nth FROM ok)""",
    [node_sql("ok", "'db-table:' || tab", "'db-table'", "tab"), node_sql("ok", "'db-entity-field:' || tab || '/' || field", "'db-entity-field'", "field", meta="""'{"type":"' || type || '","nullable":' || nullable || '}'""")],
    [edge_sql("ok", "'entity-has-field'", "'db-table:' || tab", "'db-entity-field:' || tab || '/' || field")],
    [note_sql("nth", "entity-fields", "CASE WHEN nth > 1 THEN 'repeated field' END")],
)
def map_fields(spark: SparkSession, sf_dir: str) -> mapping.Parts:
    return mapping.map_fields(_sites(spark, sf_dir).select("file", "line", "ord", F.when(F.col("q") != 3, F.format_string("t%d", "o")).alias("table"), F.format_string("f%d", "p").alias("field"), F.when(F.col("p") % 2 == 0, "int").otherwise("text").alias("type"), (F.col("flag") == "R").alias("nullable")))
