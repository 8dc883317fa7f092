"""Questions that walk the graph: shortest path, import tree, cycles.

Each level of a walk is one join of the frontier with the edges. Only frontiers and
visited sets are kept, in the shared checkpoint folder; edges are scanned, not copied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.graph import Graph
from loomgraph.schema import CYCLE_KINDS
from loomgraph.sources.tables import Growing, materialize


@dataclass
class Path:
    found: bool
    nodes: list[str] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)


def bfs_levels(edges: DataFrame, start: str, target: str | None = None, max_depth: int = 1_000) -> DataFrame:
    """(node, depth, rank, parent, edge_ord, kind) of the nodes reachable from ``start``, as a queue would find them.

    Of the edges that reach a new node at one depth that of the earliest found parent
    counts, then the earliest edge. ``rank`` is the place within the depth by the same order.
    """
    spark = edges.sparkSession
    hop = edges.select("src", "dst", "kind", F.col("ord").alias("edge_ord"))
    empty = "node string, depth int, rank long, parent string, edge_ord long, kind string"
    levels = Growing(spark.createDataFrame([(start, 0, 0, None, None, None)], empty))
    frontier = seen = levels.all()
    for depth in range(1, max_depth + 1):
        reached = hop.join(frontier.select(F.col("node").alias("src"), "rank"), "src")
        best = reached.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("rank", "edge_ord", "src", "kind")).alias("by"))
        new = best.join(seen.select("node"), "node", "left_anti")
        # A sort deals the level to ranges in order, so the numbers it hands out keep that order.
        ordered = new.orderBy("by.rank", "by.edge_ord", "node").select("node", F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("rank"), F.col("by.src").alias("parent"), F.col("by.edge_ord").alias("edge_ord"), F.col("by.kind").alias("kind"))
        frontier = levels.add(ordered)
        if frontier.isEmpty():
            break
        seen = levels.all()
        if target is not None and not frontier.filter(F.col("node") == target).isEmpty():
            break
    return seen


def find_path(graph: Graph, start: str, target: str, kinds: list[str] | None = None) -> Path:
    """Shortest directed path, edges in the order seen breaking ties; an empty one from a node to itself."""
    if not graph.has(start) or not graph.has(target):
        return Path(False)
    if start == target:
        return Path(True, [start])
    edges = graph.edges.filter(F.col("kind").isin(*kinds)) if kinds else graph.edges
    seen = bfs_levels(edges, start, target)
    nodes, hops, at = [target], [], target
    while at != start:  # one small lookup a hop; the visited set stays where it is
        row = seen.filter(F.col("node") == at).select("parent", "kind").first()
        if row is None:
            return Path(False)
        hops.append({"from": row["parent"], "to": at, "kind": row["kind"]})
        at = row["parent"]
        nodes.append(at)
    return Path(True, nodes[::-1], hops[::-1])


def import_tree(graph: Graph, module: str, max_depth: int = 5) -> dict | None:
    """Tree of ``di-import`` edges; None if the module isn't there.

    A module that was walked before is an empty leaf; one at the depth limit is too, and
    doesn't count as walked. The part of the graph within reach is found by levels; only
    that part, which the answer spells out anyway, is shaped into the tree here.
    """
    start = module if module.startswith("module:") else f"module:{module}"
    if not graph.has(start):
        return None
    edges = graph.edges.filter(F.col("kind") == "di-import")
    near = bfs_levels(edges, start, max_depth=max_depth).select(F.col("node").alias("src"))
    rows = edges.join(near, "src", "left_semi").orderBy("ord").select("src", "dst").toLocalIterator()
    links: dict[str, list[str]] = {}
    for row in rows:
        links.setdefault(row["src"], []).append(row["dst"])
    walked: set[str] = set()

    def short(node: str) -> str:
        return node.removeprefix("module:")

    def walk(node: str, left: int) -> dict:
        if left <= 0 or node in walked:
            return {"module": short(node), "imports": [], "children": []}
        walked.add(node)
        to = links.get(node, [])
        return {"module": short(node), "imports": [short(x) for x in to], "children": [walk(x, left - 1) for x in to]}

    return walk(start, max_depth)


def trimmed(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Edges (kind, src, dst) that can lie on a cycle: ends that nothing enters or leaves are cut away again and again."""
    now = materialize(edges)
    size = now.count()
    for _ in range(rounds):
        into, out = now.select("kind", F.col("dst").alias("src")).distinct(), now.select("kind", F.col("src").alias("dst")).distinct()
        now = materialize(now.join(into, ["kind", "src"], "left_semi").join(out, ["kind", "dst"], "left_semi"))
        left = now.count()
        if left == size:
            break
        size = left
    return now


def cycles(edges: DataFrame, kinds: tuple[str, ...] = CYCLE_KINDS, max_length: int = 50, max_rows: int = 5_000_000) -> tuple[DataFrame, str | None]:
    """(kind, nodes) of the elementary cycles of each kind, and an error text if the search was given up.

    A path starts at its least node and goes on to greater ones only, so each cycle comes
    once, in the rotation that begins with its least node. Parallel edges count once; a
    self-loop is a cycle of one node. There can be exponentially many cycles: when a step would
    hold more than ``max_rows`` open paths, or after ``max_length`` steps, the search ends with an error.
    """
    spark: SparkSession = edges.sparkSession
    hop = edges.filter(F.col("kind").isin(*kinds)).select("kind", "src", "dst").distinct()
    loops = hop.filter("src = dst").select("kind", F.array("src").alias("nodes"))
    hop = trimmed(hop.filter("src <> dst"))
    found = Growing(loops)
    paths = materialize(hop.filter("dst > src").select("kind", F.array("src", "dst").alias("nodes")))
    for _ in range(max_length):
        n = paths.count()
        if n == 0:
            return found.all(), None
        if n > max_rows:
            return found.all(), f"gave up at {n} open paths"
        step = paths.withColumn("src", F.element_at("nodes", -1)).join(hop, ["kind", "src"])
        closed = step.filter(F.col("dst") == F.col("nodes")[0]).select("kind", "nodes")
        found.add(closed)
        open_ = step.filter((F.col("dst") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("dst")))
        paths = materialize(open_.select("kind", F.concat("nodes", F.array("dst")).alias("nodes")))
    return found.all(), (f"gave up at length {max_length}" if not paths.isEmpty() else None)


def cycles_with_places(graph: Graph) -> tuple[DataFrame, str | None]:
    """Cycles with the first place of each hop: (kind, nodes, places array<struct<hop, file, line>>)."""
    found, error = cycles(graph.edges)
    first = graph.edges.groupBy("kind", "src", "dst").agg(F.min_by(F.struct("file", "line"), "ord").alias("at"))
    following = F.expr("transform(nodes, (x, i) -> struct(i as hop, x as src, nodes[(i + 1) % size(nodes)] as dst))")
    hops = found.select("kind", "nodes", F.explode(following).alias("h")).select("kind", "nodes", "h.*")
    placed = hops.join(first, ["kind", "src", "dst"], "left").groupBy("kind", "nodes").agg(F.array_sort(F.collect_list(F.struct("hop", "at.file", "at.line"))).alias("places"))
    return placed, error
