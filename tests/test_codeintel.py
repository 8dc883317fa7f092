"""Code-intelligence tables from the fixture, and questions over literal tables."""

from pathlib import Path

import pytest

from loomgraph import schema
from loomgraph.operators import codetables, extract
from loomgraph.plans import codeintel as C
from loomgraph.plans import graph as G
from loomgraph.sources import files, stores

ROOT = Path(__file__).parent.parent / "fixtures" / "mono"


def rows(spark, ddl, *items):
    names = [c.rsplit(" ", 1)[0].strip() for c in ddl.split(", ")]
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], ddl)


@pytest.fixture(scope="module")
def real(spark):
    sources = files.scan_sources(spark, f"file://{ROOT}")
    return codetables.code_intel(extract.extract(sources, ["symbols", "calls", "branches", "endpoint", "di-chain"]).cache())


def test_tables_of_the_fixture(real):
    names = {r["fqn"]: r for r in real.symbols.collect()}
    assert names["PlaceOrderDto"]["kind"] == "dto" and names["PlaceOrderDto.sku"]["type"] == "string"
    assert names["OrdersController.place"]["parent_id"] == names["OrdersController"]["id"]
    assert names["AuthGuard.check"]["override_kind"] == "delegation" and names["AuthGuard.check"]["inherits_from"] == names["BaseGuard.check"]["id"]
    calls = {(r["caller"], r["callee"]): r for r in real.calls.collect()}
    assert calls[("OrdersController.place", "OrdersService.place")]["callee_id"] == names["OrdersService.place"]["id"]
    assert calls[("MailProcessor.onPlaced", "MailProcessor.send")]["kind"] == "internal"
    exits = {(r["exit_kind"], r["function_name"]) for r in C.exceptions(real, "OrdersController.one").collect()}
    assert ("throw", "OrdersController.one") in exits and ("return", "OrdersService.find") in exits
    assert C.trace(real, "OrdersController.one")[0]["callee"] == "OrdersService.find"
    flows = {(r["target"], r["param"], r["to"]) for r in real.flows.collect()}
    assert ("OrdersController.place", "body", "OrdersService.place") in flows
    uses = {(r["symbol"], r["detail"]) for r in real.impacts.collect()}
    assert ("PlaceOrderDto", "OrdersService.place") in uses
    members, cut = C.type_definition(real, "AuthGuard")
    assert {(r["name"], r["defined_in"]) for r in members.collect()} == {("check", "AuthGuard"), ("subject", "AuthGuard")} and not cut
    assert [r["name"] for r in C.file_outline(real, "orders.controller.ts").collect()][:1] == ["OrdersController"]
    share, open_ = C.diagnostics(real)
    assert 0 < share < 1 and open_.count() > 0


@pytest.fixture(scope="module")
def ix(spark):
    s = lambda i, kind, fqn, file="apps/a/x.ts", **k: {"id": i, "kind": kind, "fqn": fqn, "name": fqn.split(".")[-1], "file": file, "line": 1, "column": 1, "end_line": 9, "quality_score": 0.5} | k
    symbols = rows(spark, schema.SYMBOLS, s("1", "class", "A", extends_class="Base"), s("2", "method", "A.go", parent_id="1", signature="go(x)", line=2), s("3", "method", "A.step", parent_id="1", line=3), s("4", "class", "Base", "libs/b/y.ts", extends_class="Gone"), s("5", "method", "Base.go", "libs/b/y.ts", parent_id="4"), s("6", "method", "W.go", "libs/b/y.ts", inherits_from="5", override_kind="delegation", signature="go(x)"), s("7", "class", "A", "apps/c/z.ts"), s("8", "field", "A.kept", parent_id="1"))
    c = lambda i, a, b, order, **k: {"id": i, "caller_id": a, "caller": f"f{a}", "callee_id": b, "callee": f"f{b}", "kind": "internal", "order": order, "file": "apps/a/x.ts", "line": order, "conditions": []} | k
    calls = rows(spark, schema.CALLS, c("c1", "2", "3", 1, conditions=["x > 1"]), c("c2", "3", "2", 1), c("c3", "2", "5", 2), c("c4", "2", None, 3, kind="external", receiver="http", callee="http.get"))
    flows = rows(spark, schema.FLOWS, *[{"id": f"f{n}", "target": "A.go", "param": "x", "sink_kind": k, "line": n, "file": "f"} for n, k in enumerate(["log", "db", "http", "other"])])
    branches = rows(spark, schema.BRANCHES, {"id": "b1", "function_id": "3", "function_name": "A.step", "then_text": "throw new E()", "file": "apps/a/x.ts", "line": 10}, {"id": "b2", "function_id": "2", "function_name": "A.go", "then_text": "return 1", "file": "apps/a/x.ts", "line": 12})
    impacts = rows(spark, schema.IMPACTS, {"id": "i1", "symbol_id": "4", "symbol": "Base", "kind": "type", "risk": "high", "file": "z", "line": 1}, {"id": "i2", "symbol_id": "4", "symbol": "Base", "field": "q", "kind": "field", "risk": "low", "file": "z", "line": 2})
    policies = rows(spark, schema.POLICIES, {"id": "p1", "kind": "placement", "rule": "service:apps/*/src", "confidence": 0.9}, {"id": "p2", "kind": "naming", "rule": "dto:Dto", "confidence": 0.8})
    return C.CodeIntel(symbols, calls, flows, branches, impacts, policies)


def test_questions(ix, spark):
    status, found = C.self_check(ix)
    assert status == "degraded" and [(r["fqn"], r["class"]) for r in found.collect()] == [("A", "class-level")]
    assert C.orientation(ix)["apps"] == 2 and C.orientation(ix)["policies"][0]["id"] == "p1"
    assert [r["id"] for r in C.resolve_symbol(ix, "go").collect()][0] == "2" and [r["id"] for r in C.resolve_symbol(ix, "go").collect()][-1] == "6"
    members, cut = C.type_definition(ix, "A")
    assert {(r["name"], r["defined_in"]) for r in members.collect()} == {("go", "A"), ("step", "A"), ("kept", "A")} and cut
    assert {r["kind"] for r in C.references(ix, "Base").collect()} >= {"impact:type", "impact:field", "delegation"}
    assert [r["sink_kind"] for r in C.data_flow(ix, "A.go").collect()] == ["db", "http", "log", "other"]
    assert [r["id"] for r in C.branch_at(ix, "x.ts", 11).collect()] == ["b1", "b2"]
    steps = C.trace(ix, "A.go")
    assert [(s["callee"], s["depth"]) for s in steps] == [("f3", 1), ("f2", 2), ("f5", 1)] and steps[1]["conditions"] == ["x > 1"]
    assert [r["exit_kind"] for r in C.exceptions(ix, "A.go").collect()] == ["throw", "return"]
    assert [r["kind"] for r in C.contract_impact(ix, "Base", "q").collect()] == ["field", "type", "delegation"]
    assert C.suggest_placement(ix, "X", "service")[0]["folder"] == "apps/*/src"
    assert C.validate_proposal("controller", ["OrderRepository"]) and not C.validate_proposal("service", ["OrderRepository"])
    assert C.blueprint(ix, "class").count() == 3 and C.policies(ix).count() == 2
    share, open_ = C.diagnostics(ix)
    assert share == 0.75 and [(r["receiver"], r["n"]) for r in open_.collect()] == [("http", 1)]
    edges = spark.createDataFrame([("e", "service:a", "nats:x.y", "nats-publish", False, None, "f", 1, '{"enclosingClass":"A"}', 0), ("g", "nats:x.y", "service:b", "nats-subscribe", False, None, "f", 1, '{"handlerName":"A.go"}', 1)], schema.EDGES)
    flow = C.message_flow(ix, G.Graph(spark.createDataFrame([], schema.NODES), edges), "x.y")
    assert [(f["role"], f["method"], len(f["calls"])) for f in flow] == [("publisher", "A", 0), ("handler", "A.go", 3)]


def test_store(ix, spark, tmp_path):
    stores.write_code_intel(ix, str(tmp_path / "ci"))
    again = stores.read_code_intel(spark, str(tmp_path / "ci"))
    assert again.calls.count() == 4 and again.symbols.filter("id = '1'").first()["extends_class"] == "Base"
    assert stores.read_code_intel(spark, str(tmp_path / "none")).calls.count() == 0


def test_streaming_index(spark, tmp_path):
    from loomgraph.streaming.ingest import version_path, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":"n1","kind":"service","label":"one","path":"p","snippet":"x","ord":1,"seen":"2024-01-01T00:00:00Z"}\n{"id":"n2","kind":"lib","label":"two","path":"p","snippet":"y","ord":2,"seen":"2024-01-01T00:00:00Z"}\n')
    go = lambda: watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    go()
    (tmp_path / "in/b.json").write_text('{"id":"n2","kind":"lib","label":"two","path":"p","snippet":"y","ord":2,"seen":"2024-01-02T00:00:00Z","deleted":true}\n{"id":"n3","kind":"lib","label":"three","path":"p","snippet":"z","ord":3,"seen":"2024-01-02T00:00:00Z"}\n')
    go()
    assert {r["node_id"] for r in spark.read.parquet(version_path(str(tmp_path / "out"), 1)).collect()} == {"n1", "n3"}
