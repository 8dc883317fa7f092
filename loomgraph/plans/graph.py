"""The graph as two tables, and the questions that are one pass over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import subject_matches
from loomgraph.schema import DOMAIN_OF, RECEIVERS, SENDERS


@dataclass(frozen=True)
class Graph:
    """nodes: id, kind, label, ...; edges: id, src, dst, kind, ... An ``ord`` column gives the order in which rows were seen."""

    nodes: DataFrame
    edges: DataFrame

    def has(self, node_id: str) -> bool:
        return not self.nodes.filter(F.col("id") == node_id).limit(1).isEmpty()


@dataclass(frozen=True)
class Answer:
    """Rows of an answer; ``found`` tells a node without rows from one that isn't there."""

    found: bool
    rows: DataFrame


def located(edges: DataFrame) -> Column:
    """The string by which places are sorted: file and line with a colon, so line 10 comes before line 9."""
    return F.concat_ws(":", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)).cast("string"))


def edge_answer(edges: DataFrame, owner: str, other: str, role: str) -> DataFrame:
    return edges.select(
        F.lit(role).alias("role"), F.col(owner).alias("owner"), F.col(other).alias("counterpart"), "kind", "file", "line", "subject_pattern", "dynamic"
    ).orderBy("owner", located(edges), "counterpart")


def matching_subjects(graph: Graph, subject: str) -> DataFrame:
    """Subject nodes that meet a subject or pattern; the wildcard test runs once a node and not once an edge."""
    own = graph.nodes.filter(F.col("kind").isin("nats-subject", "rmq-pattern"))
    name = F.regexp_replace("id", "^(nats|rmq):", "")
    return own.filter(subject_matches(name, F.lit(subject)))


def _by_subject(graph: Graph, subject: str, kinds: Iterable[str], end: str, other: str, role: str) -> Answer:
    nodes = matching_subjects(graph, subject).select(F.col("id").alias(end))
    found = not nodes.limit(1).isEmpty()
    hits = graph.edges.filter(F.col("kind").isin(*kinds)).join(nodes, end, "left_semi")
    return Answer(found, edge_answer(hits, other, end, role))


def publishers(graph: Graph, subject: str) -> Answer:
    return _by_subject(graph, subject, SENDERS, "dst", "src", "sender")


def subscribers(graph: Graph, subject: str) -> Answer:
    """Edges run from the subject to the owner here."""
    return _by_subject(graph, subject, (*RECEIVERS, "rmq-subscribe"), "src", "dst", "receiver")


def _into(graph: Graph, node_id: str, test: Column, role: str) -> Answer:
    hits = graph.edges.filter((F.col("dst") == node_id) & test)
    return Answer(graph.has(node_id), edge_answer(hits, "src", "dst", role))


def _prefixed(kind: str, name: str) -> str:
    return name if name.startswith(f"{kind}:") else f"{kind}:{name}"


def queue_producers(graph: Graph, queue: str) -> Answer:
    return _into(graph, _prefixed("queue", queue), F.col("kind") == "queue-produce", "producer")


def queue_consumers(graph: Graph, queue: str) -> Answer:
    node_id = _prefixed("queue", queue)
    hits = graph.edges.filter((F.col("kind") == "queue-consume") & ((F.col("src") == node_id) | (F.col("dst") == node_id)))
    out_of = hits.withColumn("owner_", F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src"))).withColumn("queue_", F.lit(node_id))
    return Answer(graph.has(node_id), edge_answer(out_of, "owner_", "queue_", "consumer"))


def table_users(graph: Graph, table: str) -> Answer:
    """Accessors and relations alike: every edge into the table whose kind begins with ``db-``."""
    return _into(graph, _prefixed("db-table", table), F.col("kind").startswith("db-"), "accessor")


def grouped_neighbours(graph: Graph, node_id: str, outgoing: bool) -> DataFrame:
    """(kind, n, neighbours) of one node in one direction, neighbours in the order seen."""
    own, other = ("src", "dst") if outgoing else ("dst", "src")
    hits = graph.edges.filter(F.col(own) == node_id)
    item = F.struct("ord", F.col(other).alias("counterpart"), "file", "line")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("ord"))
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), listed.alias("neighbours"))


def dependencies(graph: Graph, node_id: str) -> DataFrame:
    return grouped_neighbours(graph, node_id, True)


def dependents(graph: Graph, node_id: str) -> DataFrame:
    return grouped_neighbours(graph, node_id, False)


def explain(graph: Graph, node_id: str) -> Answer:
    """First-degree neighbours by direction and kind."""
    out = graph.edges.filter(F.col("src") == node_id).select(F.lit("outgoing").alias("direction"), "kind", F.col("dst").alias("neighbour"), "ord")
    into = graph.edges.filter(F.col("dst") == node_id).select(F.lit("incoming").alias("direction"), "kind", F.col("src").alias("neighbour"), "ord")
    return Answer(graph.has(node_id), out.unionAll(into))


def stats(graph: Graph) -> DataFrame:
    """(part, kind, n): nodes and edges by kind, with a total where kind is null."""
    both = graph.nodes.select(F.lit("nodes").alias("part"), "kind").unionAll(graph.edges.select(F.lit("edges").alias("part"), "kind"))
    return both.rollup("part", "kind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("part").isNotNull())


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One whole row for each key, the first in order; summed before it is sent."""
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(whole, order).alias("row")).select("row.*")


def assemble(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Union of domain parts. ``part`` numbers them, ``ord`` rows within one.

    Nodes of one id merge field by field, the later part's value winning where it has
    one, and ``meta`` key by key; of edges with one id the last stays whole.
    """
    at = F.struct("part", "ord")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    known = F.filter(F.array_sort(F.collect_list(F.when(F.col("meta").isNotNull(), F.struct("part", "ord", "meta")))), lambda x: x["meta"].isNotNull())
    keys = F.transform(known, lambda x: F.from_json(x["meta"], "map<string,string>"))
    # Later values replace earlier ones of the same key; parts are a dozen at most, sites of one node few.
    put = F.aggregate(keys, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(x, k)), x))
    meta = F.when(F.size(known) > 0, F.to_json(put)).alias("meta")
    merged = nodes.groupBy("id").agg(*[last(c) for c in nodes.columns if c not in ("id", "meta", "part", "ord")], *([meta] if "meta" in nodes.columns else []), F.min(at).alias("at"))
    out = merged.select("*", (F.col("at.part").cast("long") * F.lit(1 << 40) + F.col("at.ord")).alias("ord")).drop("at")
    whole = F.struct(*[c for c in edges.columns if c != "part"])
    final = edges.groupBy("id").agg(F.max_by(whole, at).alias("row")).select("row.*")
    return Graph(out, final)


def slice_service(graph: Graph, service: str) -> Graph:
    """A service, its direct neighbours and the edges between it and them."""
    node_id = _prefixed("service", service)
    edges = graph.edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).union(graph.nodes.filter(F.col("id") == node_id).select("id")).distinct()
    return Graph(graph.nodes.join(ends, "id", "left_semi"), edges)


def slice_domain(graph: Graph, domain: str) -> Graph:
    """Edges of one domain and their ends."""
    kinds = [k for k, d in DOMAIN_OF.items() if d == domain]
    edges = graph.edges.filter(F.col("kind").isin(*kinds))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(graph.nodes.join(ends, "id", "left_semi"), edges)
