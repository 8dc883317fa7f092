"""Answers as text: flowcharts, tables, compact graphs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.names import escape_label
from loomgraph.operators.search import ranked
from loomgraph.plans.graph import Graph
from loomgraph.schema import DOMAINS
from loomgraph.sources.stores import remove, write_text

LARGE = 200
# Fixed values of the notation: node kinds in the order of their groups, with the group's id and title, the style and the outline.
KINDS = [
    ("service", "services", "Services", "service", "[", "]"),
    ("lib", "libs", "Libraries", "lib", "[", "]"),
    ("module", "modules", "Modules", "module", "{{", "}}"),
    ("queue", "queues", "Queues", "queue", "([", "])"),
    ("nats-subject", "nats_subjects", "NATS subjects", "nats", "((", "))"),
    ("rmq-pattern", "rmq_patterns", "RMQ patterns", "rmq", "((", "))"),
    ("db-table", "db_tables", "DB tables", "db", "[(", ")]"),
    ("provider", "providers", "Providers", "module", "{{", "}}"),
    ("external", "externals", "External hosts", "lib", "[", "]"),
    ("file", "files", "Files", "file", "[", "]"),
    ("endpoint", "endpoints", "Endpoints", "endpoint", ">", "]"),
    ("config-field", "config_fields", "Config fields", "config", "[/", "/]"),
    ("scoped-marker", "scoped_markers", "Scoped markers", "scoped", "([", "])"),
    ("db-entity-field", "db_entity_fields", "DB entity fields", "db", "[", "]"),
    ("fe-page", "fe_pages", "FE pages", "fe", "[", "]"),
    ("fe-component", "fe_components", "FE components", "fe", "[", "]"),
    ("fe-route", "fe_routes", "FE routes", "fe", "([", "])"),
    ("fe-hook", "fe_hooks", "FE hooks", "fe", "[", "]"),
    ("doc-section", "docs", "Docs", "docs", "[", "]"),
    ("cron-schedule", "cron_schedules", "Cron schedules", "cron", "([", "])"),
]
# The word on an edge's arrow where it isn't the kind itself, and the kinds that are thick or end in a circle; all others are dotted.
WORDS = {
    "nats-publish": "publish", "nats-request": "request", "nats-subscribe": "subscribe", "nats-reply": "reply", "rmq-subscribe": "rmq-sub", "http-call": "http", "http-external": "http-ext",
    "queue-produce": "produce", "queue-consume": "consume", "queue-fails-into": "fails-into", "queue-event-listener": "event-listener", "db-read": "read", "db-write": "write", "db-access": "db", "db-relation": "rel",
    "di-import": "di", "di-provides": "provides", "di-exports": "exports", "di-controller": "controller", "di-uses": "uses", "di-guard": "guard", "di-interceptor": "interceptor", "di-pipe": "pipe",
    "ts-import": "import", "lib-usage": "lib", "fe-imports": "fe-import", "fe-renders": "renders", "fe-routes-to": "routes-to", "endpoint-calls": "calls", "config-read-by": "config-read", "entity-has-field": "has-field", "cron-triggers": "triggers",
}
ARROWS = {"==>": ("nats-request", "nats-reply", "http-call", "http-external", "endpoint-calls"), "--o": ("db-read", "db-write", "db-access", "db-relation", "entity-has-field")}
# Fill, stroke and text colour of the styles.
STYLES = [
    ("service", "#dbeafe", "#1d4ed8", "#1e3a8a"), ("lib", "#ede9fe", "#6d28d9", "#4c1d95"), ("queue", "#fef3c7", "#b45309", "#78350f"), ("nats", "#dcfce7", "#15803d", "#14532d"),
    ("rmq", "#ffedd5", "#ea580c", "#7c2d12"), ("db", "#fee2e2", "#b91c1c", "#7f1d1d"), ("module", "#e0f2fe", "#0369a1", "#0c4a6e"), ("file", "#f1f5f9", "#475569", "#0f172a"),
    ("endpoint", "#fdf4ff", "#a21caf", "#701a75"), ("config", "#fff7ed", "#c2410c", "#7c2d12"), ("scoped", "#ecfdf5", "#059669", "#064e3b"), ("fe", "#fce7f3", "#be185d", "#831843"),
    ("docs", "#f0fdf4", "#16a34a", "#14532d"), ("cron", "#fef9c3", "#a16207", "#713f12"),
]


def numbered_ids(rows: DataFrame) -> DataFrame:
    """Adds ``safe`` to (id, base): the base, with _2, _3, ... for the later ids of one base, and whether it has a suffix."""
    n = F.row_number().over(W.partitionBy("base").orderBy("id"))
    safe = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string")))
    return rows.withColumn("n", n).withColumn("safe", safe).withColumn("collides", F.col("n") > 1)


def safe_ids(nodes: DataFrame) -> DataFrame:
    """(id, safe, collides): ids of letters, digits and underscores, each of them once."""
    out = numbered_ids(nodes.select("id", F.regexp_replace("id", "[^A-Za-z0-9_]", "_").alias("base")))
    # A suffix can meet another base: such names get a hash of the id instead.
    taken = out.groupBy("safe").agg(F.count(F.lit(1)).alias("uses"))
    hashed = F.concat_ws("_", "base", F.substring(F.sha2("id", 256), 1, 12))
    return out.join(taken, "safe").select("id", F.when((F.col("uses") > 1) & F.col("collides"), hashed).otherwise(F.col("safe")).alias("safe"), "collides")


def arrow(kind: Column) -> Column:
    """Arrow of an edge kind with its word."""
    line = F.coalesce(*[F.when(kind.isin(*kinds), F.lit(a)) for a, kinds in ARROWS.items()], F.lit("-.->"))
    word = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in WORDS.items()], kind)
    return F.concat(line, F.lit("|"), word, F.lit("|"))


def mermaid_lines(graph: Graph, cycle_nodes: DataFrame | None = None) -> DataFrame:
    """(section, nth, line) of a flowchart: groups of nodes by kind and label, then edges by kind and ends, then styles. ``nth`` runs through all lines."""
    spark = graph.nodes.sparkSession
    ids = safe_ids(graph.nodes)
    kinds = spark.createDataFrame([(n, *k) for n, k in enumerate(KINDS)], "place int, kind string, group string, title string, style string, before string, after string")
    named = graph.nodes.join(ids, "id").join(F.broadcast(kinds), "kind")  # as many rows as there are kinds
    style = F.col("style")
    if cycle_nodes is not None:
        named = named.join(cycle_nodes.select("id", F.lit(True).alias("cyclic")), "id", "left")
        style = F.when(F.col("cyclic"), "cycle").otherwise(style)
    part = lambda df, section, place, step, k1, k2, k3, line: df.select(F.lit(section).alias("section"), place.alias("place"), F.lit(step).alias("step"), k1.alias("k1"), k2.alias("k2"), k3.alias("k3"), line.alias("line"))
    none = F.lit("")
    text = F.concat(F.lit("    "), "safe", "before", F.lit('"'), escape_label(F.coalesce("label", F.col("id"))), F.lit('"'), "after", F.lit(":::"), style)
    node_lines = part(named, 1, F.col("place"), 1, F.coalesce("label", F.col("id")), F.col("id"), none, text)
    used = kinds.join(graph.nodes.select("kind").distinct(), "kind")
    opened = part(used, 1, F.col("place"), 0, none, none, none, F.concat(F.lit("  subgraph "), "group", F.lit('["'), "title", F.lit('"]')))
    closed = part(used, 1, F.col("place"), 2, none, none, none, F.lit("  end"))
    a, b = ids.select(F.col("id").alias("src"), F.col("safe").alias("sa")), ids.select(F.col("id").alias("dst"), F.col("safe").alias("sb"))
    edges = graph.edges.join(a, "src").join(b, "dst")
    edge_lines = part(edges, 2, F.lit(0), 0, F.col("kind"), F.col("src"), F.col("dst"), F.concat(F.lit("  "), "sa", F.lit(" "), arrow(F.col("kind")), F.lit(" "), "sb")).distinct()
    head = [(0, 0, 0, "", "", "", "flowchart LR")] + [(3, n, 0, "", "", "", f"  classDef {k} fill:{fill},stroke:{stroke},color:{color};") for n, (k, fill, stroke, color) in enumerate(STYLES)] + [(3, len(STYLES), 0, "", "", "", "  classDef cycle stroke:#dc2626,stroke-width:3px;")]
    fixed = spark.createDataFrame(head, "section int, place int, step int, k1 string, k2 string, k3 string, line string")
    every = node_lines.unionByName(opened).unionByName(closed).unionByName(edge_lines).unionByName(fixed)
    return ranked(every, ["section", "place", "step", "k1", "k2", "k3"], "nth").select("section", "nth", "line")


def collisions(nodes: DataFrame) -> DataFrame:
    """(base, ids): groups of ids whose letters, digits and underscores are alike."""
    based = nodes.select("id", F.regexp_replace("id", "[^A-Za-z0-9_]", "_").alias("base")).distinct()
    several = based.groupBy("base").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("base")
    return based.join(several, "base").groupBy("base").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def write_collisions(nodes: DataFrame, path: str) -> bool:
    """Write the groups as JSON, or remove what an earlier full chart left there if there are none."""
    found = [{"base": r["base"], "ids": r["ids"]} for r in collisions(nodes).orderBy("base").toLocalIterator()]
    if not found:
        remove(nodes.sparkSession, path)
        return False
    write_text(nodes.sparkSession, path, json.dumps({"collisions": found}, indent=2) + "\n")
    return True


def mermaid(graph: Graph, cycle_nodes: DataFrame | None = None) -> tuple[str, list[str]]:
    """The flowchart as text, and warnings. What is drawn is meant to be looked at, and fits in memory."""
    warnings = []
    n = graph.nodes.count()
    if n > LARGE:
        warnings.append(f"{n} nodes are hard to read; draw a slice by service or domain")
    lines = [r["line"] for r in mermaid_lines(graph, cycle_nodes).orderBy("section", "nth").toLocalIterator()]
    return "\n".join(lines) + "\n", warnings


def parse_slice(text: str) -> tuple[str, str | None]:
    """``full``, ``service:<id>`` or ``domain:<name>``."""
    kind, _, value = text.partition(":")
    if text == "full":
        return "full", None
    if kind == "service" and value:
        return kind, value
    if kind == "domain" and value in DOMAINS:
        return kind, value
    raise ValueError(f"no slice {text!r}; domains are {', '.join(DOMAINS)}")


def table(rows: list[dict]) -> str:
    """Columns of fixed width."""
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    cells = [names, *([("" if r.get(c) is None else str(r[c])) for c in names] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(cells[0]), line(["-" * w for w in widths]), *map(line, cells[1:])])


def compact(graph: Graph) -> DataFrame:
    """One JSON row for each node and edge with the few fields that a reader of the graph needs."""
    nodes = graph.nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("id", "kind", "label", "path")).alias("json"))
    edges = graph.edges.select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind")).alias("json"))
    return nodes.unionAll(edges)


def envelope(found: bool, rows: list[dict]) -> str:
    """Answer of a list query as JSON, without fields that have no value."""
    if not found:
        return json.dumps({"found": False})
    return json.dumps({"found": True, "sites": [{k: v for k, v in r.items() if v is not None} for r in rows]}, ensure_ascii=False)
