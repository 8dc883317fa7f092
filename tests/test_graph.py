"""Graph questions, walks and merging on literal graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.functions import names
from loomgraph.plans import graph as G
from loomgraph.plans import paths, router


def make(spark, nodes, edges):
    rows = [(i, k, i.split(":")[-1], None, None, None, n) for n, (i, k) in enumerate(nodes)]
    links = [(f"{k}:{a}->{b}:{n}", a, b, k, False, None, f, line, None, n) for n, (a, b, k, f, line) in enumerate((*e, None, None)[:5] for e in edges)]
    return G.Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(links, schema.EDGES))


@pytest.fixture(scope="module")
def net(spark):
    nodes = [("service:a", "service"), ("service:b", "service"), ("nats:o.1.get", "nats-subject"), ("nats:o.*", "nats-subject"), ("queue:mail", "queue"), ("db-table:t", "db-table"), ("db-table:u", "db-table")]
    edges = [
        ("service:a", "nats:o.1.get", "nats-request", "f.ts", 10), ("service:a", "nats:o.1.get", "nats-request", "f.ts", 9), ("nats:o.*", "service:b", "nats-subscribe", "g.ts", 1),
        ("service:b", "queue:mail", "queue-produce", "g.ts", 2), ("queue:mail", "service:a", "queue-consume", "f.ts", 3), ("service:a", "db-table:t", "db-access", "f.ts", 4), ("db-table:u", "db-table:t", "db-relation", "e.ts", 5),
    ]
    return make(spark, nodes, edges)


def test_lists(net):
    rows = G.publishers(net, "o.*.get").rows.collect()
    assert [(r["owner"], r["line"]) for r in rows] == [("service:a", 10), ("service:a", 9)]  # places sort as text
    assert G.publishers(net, "o.x").found and G.publishers(net, "o.x").rows.count() == 0
    assert not G.publishers(net, "p.x").found
    assert [r["owner"] for r in G.subscribers(net, "o.>").rows.collect()] == ["service:b"]
    assert [r["owner"] for r in G.queue_producers(net, "mail").rows.collect()] == ["service:b"]
    assert [r["owner"] for r in G.queue_consumers(net, "mail").rows.collect()] == ["service:a"]
    assert [r["owner"] for r in G.table_users(net, "t").rows.collect()] == ["db-table:u", "service:a"]
    assert not G.table_users(net, "nope").found


def test_neighbours_and_slices(net):
    assert {r["kind"]: r["n"] for r in G.dependencies(net, "service:a").collect()} == {"nats-request": 2, "db-access": 1}
    assert {(r["direction"], r["neighbour"]) for r in G.explain(net, "queue:mail").rows.collect()} == {("incoming", "service:b"), ("outgoing", "service:a")}
    totals = {r["part"]: r["n"] for r in G.stats(net).collect() if r["kind"] is None}
    assert totals == {"nodes": 7, "edges": 7}
    assert {r["id"] for r in G.slice_domain(net, "bullmq").nodes.collect()} == {"queue:mail", "service:a", "service:b"}
    assert "db-table:u" not in {r["id"] for r in G.slice_service(net, "a").nodes.collect()}


@pytest.mark.parametrize(("a", "b", "want"), [("a.b", "a.b", True), ("a.*", "a.b", True), ("a.b", "a.*", True), ("a.*", "a.b.c", False), ("a.>", "a.b.c", True), ("a.>", "a", False), ("a.*.c", "a.b.*", False), ("*.x", "a.>", False), ("a.*", "a.>", True), ("a.(b)", "a.*", True), ("a.b", "a.c", False), ("a*", "ab", False), (">", "q.r", True)])
def test_subjects(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(names.subject_matches(F.col("a"), F.col("b")).alias("x"), names.subject_matches(F.col("b"), F.col("a")).alias("y")).first()
    assert (got["x"], got["y"]) == (want, want)


def test_names(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    lit = F.lit
    assert one(names.strip_prefix(lit("queue:a"))) == "a" and one(names.strip_prefix(lit("rmq:a"))) == "rmq:a"
    assert one(names.add_prefix("lib", lit("x"))) == "lib:x" and one(names.add_prefix("lib", lit("lib:x"))) == "lib:x"
    assert one(names.join_path(lit("a/"), lit("/b/"))) == "/a/b" and one(names.join_path(lit(""), lit(""))) == "/"
    assert [one(names.base_slug(lit(h))) for h in (" Héllo, World! a_b ", "a - b", "!!!", "Tab\there")] == ["héllo-world-ab", "a-b", "section", "tabhere"]
    assert one(names.snake_case(lit("HTTPServerError"))) == "http_server_error" and one(names.snake_case(lit("CustomerAccount"))) == "customer_account"
    assert one(names.package_name(lit("@a/b/c"))) == "@a/b" and one(names.package_name(lit("lodash/x"))) == "lodash"
    for file, root, want in [("src/pages/index.tsx", "src/pages", "/"), ("pages/blog/[slug].tsx", "pages", "/blog/:slug"), ("pages/_app.tsx", "pages", None), ("pages/api/x.ts", "pages", None), ("app/(shop)/cart/page.tsx", "app", "/cart"), ("app/@modal/page.tsx", "app", None), ("app/layout.tsx", "app", None), ("pages/[...all].tsx", "pages", "/*all"), ("pages/[[...opt]].tsx", "pages", "/*opt?")]:
        assert one(names.page_route(lit(file), lit(root))) == want, file
    assert one(names.escape_label(lit('a<b>&"c"'))) == "a&lt;b&gt;&amp;&quot;c&quot;"


def bfs(edges, start, target):
    parent, queue = {start: None}, [start]
    for x in queue:
        for a, b in edges:
            if a == x and b not in parent:
                parent[b] = a
                queue.append(b)
    if target not in parent:
        return None
    out = [target]
    while parent[out[-1]] is not None:
        out.append(parent[out[-1]])
    return out[::-1]


def test_paths_follow_discovery_order(spark):
    rng = random.Random(2)
    nodes = [f"n:{i}" for i in range(14)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(30)]
    graph = make(spark, [(n, "x") for n in nodes], [(a, b, "k") for a, b in edges])
    for target in ("n:3", "n:9", "n:13"):
        want = bfs(edges, "n:0", target)
        got = paths.find_path(graph, "n:0", target)
        assert (got.nodes if got.found else None) == want
    assert paths.find_path(graph, "n:0", "n:0").nodes == ["n:0"]
    assert not paths.find_path(graph, "n:0", "gone").found
    assert not paths.find_path(graph, "n:0", "n:3", ["other"]).found


def test_import_tree(spark):
    ids = [(f"module:{x}", "module") for x in "ABCD"]
    graph = make(spark, ids, [(f"module:{a}", f"module:{b}", "di-import") for a, b in ("AB", "AC", "BC", "CA", "CD")])
    tree = paths.import_tree(graph, "A")
    assert tree["imports"] == ["B", "C"]
    c = tree["children"][0]["children"][0]
    assert c["imports"] == ["A", "D"] and c["children"][0] == {"module": "A", "imports": [], "children": []}
    assert tree["children"][1] == {"module": "C", "imports": [], "children": []}
    assert paths.import_tree(graph, "A", 1)["children"][0]["imports"] == []
    assert paths.import_tree(graph, "Z") is None


def brute_cycles(nodes, edges):
    found = set()
    for n in range(1, len(nodes) + 1):
        for p in itertools.permutations(nodes, n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in edges for i in range(n)):
                found.add(p)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles(spark, seed):
    rng = random.Random(seed)
    nodes = "abcde"
    edges = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(11)}
    graph = make(spark, [(n, "file") for n in nodes], [(a, b, "ts-import") for a, b in sorted(edges) * 2])
    got, error = paths.cycles(graph.edges)
    assert error is None and sorted(tuple(r["nodes"]) for r in got.collect()) == sorted(brute_cycles(nodes, edges))
    _, error = paths.cycles(make(spark, [], [(a, b, "ts-import") for a in nodes for b in nodes]).edges, max_rows=3)
    assert "gave up" in error


def test_cycle_places(spark):
    graph = make(spark, [], [("a", "b", "ts-import", "a.ts", 3), ("a", "b", "ts-import", "a.ts", 9), ("b", "a", "ts-import", "b.ts", 1)])
    placed, _ = paths.cycles_with_places(graph)
    assert [(p["file"], p["line"]) for p in placed.first()["places"]] == [("a.ts", 3), ("b.ts", 1)]


def test_assemble(spark):
    nodes = spark.createDataFrame([("x", "queue", "one", None, '{"a":"1","b":"1"}', 0, 0), ("x", "queue", None, "p", '{"b":"2"}', 1, 0), ("y", "lib", "y", None, None, 1, 1)], "id string, kind string, label string, path string, meta string, part int, ord long")
    edges = spark.createDataFrame([("e", "x", "y", "k1", 0, 0), ("e", "x", "y", "k2", 1, 0)], "id string, src string, dst string, kind string, part int, ord long")
    graph = G.assemble(nodes, edges)
    x = graph.nodes.filter("id = 'x'").first()
    assert (x["label"], x["path"], x["meta"]) == ("one", "p", '{"a":"1","b":"2"}')
    assert [r["kind"] for r in graph.edges.collect()] == ["k2"]


def test_empty_graph(spark):
    graph = make(spark, [], [])
    assert G.stats(graph).count() == 0 and not G.explain(graph, "x").found
    assert paths.cycles(graph.edges)[0].count() == 0


def test_router():
    assert router.route("who publishes to nats subject 'a.b'?") == router.Route("subject_publishers", "subject", "a.b")
    assert router.route("stats about queue producers").tool == "stats"
    assert router.route("what workers consume the queue mail") == router.Route("queue_consumers", "queue", "mail")
    assert router.route("what does it depend on api").tool == "service_dependencies"
    assert router.route("hello").tool == "unknown"
    assert router.Shuffle("s").order(list(range(9))) == router.Shuffle("s").order(list(range(9))) != list(range(9))
    assert router.label_scores(["Order table", "x"], ["order", "queue"]) == (0.5, 0.5)
    assert router.routed_buckets("per-category", "D_docs") == ["docs"]


def test_golden_questions(net):
    found = router.golden_questions(net.edges, 5)
    assert 0 < len(found) <= 5 and found == router.golden_questions(net.edges, 5)


def test_growing_table(spark):
    from loomgraph.sources.tables import Growing

    table = Growing(spark.createDataFrame([(1, "a")], "n int, t string"))
    part = table.add(spark.createDataFrame([("b", 2)], "t string, n int"))
    assert [tuple(r) for r in part.collect()] == [(2, "b")]
    table.add(part.limit(0))
    assert sorted(tuple(r) for r in table.all().collect()) == [(1, "a"), (2, "b")]
