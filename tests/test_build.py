"""Extraction, mapping and the whole build on the miniature sources."""

import os
import time
from pathlib import Path

import pytest

from loomgraph.operators import docs, extract, render
from loomgraph.plans import build, paths
from loomgraph.plans import graph as G
from loomgraph.sources import files, stores

ROOT = Path(__file__).parent.parent / "fixtures" / "mono"


@pytest.fixture(scope="module")
def built(spark):
    config = stores.load_config(f"id: mono\nroot: file://{ROOT}\napps_glob: apps/*\nfile_edges: true\ninternal_services: {{worker: [worker.local]}}\nenv_services: {{PAY_URL: worker}}\n")
    return build.build(spark, config, files.alias_rows((ROOT / "tsconfig.base.json").read_text()))


def ends(built, kind):
    return {(r["src"], r["dst"]) for r in built["graph"].edges.filter(f"kind = '{kind}'").collect()}


def test_graph_of_the_fixture(built):
    assert ends(built, "nats-publish") == {("service:api", "nats:orders.placed")}
    assert ends(built, "nats-request") == {("service:api", "nats:orders.*.get")}
    assert ends(built, "nats-subscribe") == {("nats:orders.placed", "service:worker")}
    assert ends(built, "nats-reply") == {("nats:orders.*.get", "service:worker"), ("nats:orders.ping", "service:worker")}
    assert ends(built, "endpoint-of") == {("endpoint:GET /orders", "service:api"), ("endpoint:GET /orders/:id", "service:api"), ("endpoint:POST /orders/place", "service:api")}
    assert ends(built, "queue-produce") == {("service:api", "queue:mail")}
    assert ends(built, "queue-consume") == {("queue:mail", "service:worker")}
    assert ends(built, "db-access") == {("service:api", "db-table:orders")}
    assert ends(built, "db-relation") == {("db-table:orders", "db-table:customer_account")}
    assert ends(built, "http-call") == {("service:api", "service:worker")}
    assert ends(built, "http-external") == {("service:api", "external:rates.example.org")}
    assert ends(built, "config-read-by") >= {("config-field:PAY_URL", "service:api"), ("config-field:MAIL_FROM", "service:worker")}
    assert {s for s, _ in ends(built, "cron-triggers")} == {"cron-schedule:cron:0 0-23/1 * * *", "cron-schedule:interval:5000"}
    assert ("module:AppModule", "module:DbModule") in ends(built, "di-import") and ("module:AppModule", "module:ConfigModule") in ends(built, "di-import")
    assert ("provider:OrdersController", "provider:OrdersService") in ends(built, "di-uses")
    assert {("service:api", "lib:core"), ("service:api", "lib:db"), ("service:worker", "lib:core")} <= ends(built, "lib-usage")
    assert ends(built, "fe-renders") == {("fe-component:apps/web/pages/index.tsx#Home", "fe-component:apps/web/components/Card.tsx#Card"), ("fe-component:apps/web/pages/blog/[slug].tsx#Post", "fe-component:apps/web/components/Card.tsx#Card")}
    assert {s for s, _ in ends(built, "fe-routes-to")} == {"fe-route:/", "fe-route:/blog/:slug"}
    assert ("db-table:orders", "db-entity-field:orders/createdAt") in ends(built, "entity-has-field")
    mail = built["graph"].nodes.filter("id = 'queue:mail'").first()["meta"]
    assert '"concurrency"' in mail and '"attempts"' in mail


def test_cycles_and_notes(built):
    found = {tuple(r["nodes"]) for r in built["cycles"].collect()}
    assert ("file:libs/core/src/auth.guard.ts", "file:libs/core/src/subjects.ts") in found and built["cycle_error"] is None
    reasons = {(r["domain"], r["reason"]) for r in built["diagnostics"].collect()}
    assert {("imports", "broken-relative"), ("di", "unresolved"), ("fe", "unknown component")} <= reasons
    assert built["skipped"].count() == 0


def test_recall(built):
    got = {(r["domain"], r["role"]): r["recall"] for r in built["recall"].collect() if r["n_truth"]}
    for key in (("endpoint", "handler"), ("bullmq", "consume"), ("typeorm", "entity"), ("entity-fields", "column"), ("cron", "cron"), ("di", "module"), ("nats", "receiver")):
        assert got[key] == 1.0, key


def test_docs(built, spark):
    ids = {r["id"] for r in built["graph"].nodes.filter("kind = 'doc-section'").collect()}
    assert {"doc-section:docs/guide.md#orders", "doc-section:docs/guide.md#placing", "doc-section:docs/guide.md#placing-1", "doc-section:docs/guide.md#setext-title", "doc-section:docs/bad.md#still-read"} <= ids
    assert built["docs_coverage"].first()["recall"] == 1.0
    skipped = {r["file"]: r["skipped"] for r in files.scan_markdown(spark, f"file://{ROOT}").collect()}
    assert skipped["docs/empty.md"] == "empty" and skipped["docs/guide.md"] is None


def test_strings_operations_and_imports(built, spark):
    tree = files.tree(spark, f"file://{ROOT}").selectExpr("file", "decode(content, 'UTF-8') text")
    texts = files.messages(tree)
    assert {r["lang"] for r in texts.collect()} == {"ru"}
    strings = files.resolve_strings(built["sites"].filter("domain = 'strings'"), texts).collect()
    assert [(r["file"], r["strings"]) for r in strings] == [("apps/web/pages/index.tsx", ["Добро пожаловать"])]
    ops = files.operations(tree.filter("file LIKE '%openapi.yaml'"))
    from loomgraph.operators.mapping import enrich_endpoints

    endpoints = built["sites"].filter("domain = 'endpoint'").select("method", "pattern", "handler")
    got = {r["handler"]: (r["matched_by"], r["operation"] and r["operation"]["operation_id"]) for r in enrich_endpoints(endpoints, ops).collect()}
    assert got == {"list": ("operation id", "list"), "one": ("path", "readOne"), "place": (None, None)}


def test_store_round_trip(built, spark, tmp_path):
    stores.write_graph_json(built["graph"], f"{tmp_path}/graph.json", "/", "now")
    again = stores.read_graph_json(spark, f"{tmp_path}/graph.json")
    assert again.edges.count() == built["graph"].edges.count()
    assert {r["owner"] for r in G.publishers(again, "orders.placed").rows.collect()} == {"service:api"}
    assert paths.find_path(again, "service:api", "service:worker").found
    text, _ = render.mermaid(G.slice_domain(again, "bullmq"))
    assert text.startswith("flowchart LR") and "queue_mail([" in text and "-.->|produce|" in text and 'subgraph queues["Queues"]' in text
    loader = stores.Reloading(spark, f"{tmp_path}/graph.json")
    n = loader.get().nodes.count()
    (tmp_path / "graph.json").write_text("{ torn")
    os.utime(tmp_path / "graph.json", (time.time() + 5, time.time() + 5))
    assert loader.get().nodes.count() == n and loader.reported
    assert render.parse_slice("domain:fe") == ("domain", "fe")
    with pytest.raises(ValueError):
        render.parse_slice("domain:nope")
    assert render.table([{"a": 1, "b": None}]).splitlines()[0] == "a  b"


def test_records_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "k", "l", "p", "s", "h", [1.0, 2.0], 0)], "node_id string, kind string, label string, path string, snippet string, content_hash string, vector array<float>, ord long")
    stores.write_records(rows, str(tmp_path / "ix"), {"schema_version": 2, "model": "m", "dim": 2})
    assert stores.read_manifest(spark, str(tmp_path / "ix"))["node_count"] == 1
    assert stores.read_records(spark, str(tmp_path / "ix/records"), 2).count() == 1
    with pytest.raises(Exception, match="another length"):
        stores.read_records(spark, str(tmp_path / "ix/records"), 3).collect()
    stores.merge_diagnostics(str(tmp_path / "d.json"), {"n": 1})
    assert (tmp_path / "d.json").read_text() == '{"semantic": {"n": 1}}'


def test_scanner_pieces():
    assert extract.strip_comments("a // b\n'// c' /* d\n */ e") == "a     \n'// c'     \n    e"
    assert extract.split_args("a, {b: [1, 2]}, 'x, y'") == ["a", "{b: [1, 2]}", "'x, y'"]
    assert extract.resolve("`a.${b}.c`", {}) == ("pattern", "a.*.c", ["b"])
    assert extract.resolve("`a.${B}.c`", {"B": "x"}) == ("literal", "a.x.c", [])
    assert extract.resolve("x ? 'a' : 'a'", {})[0] == "literal" and extract.resolve("x ? 'a' : 'b'", {})[0] == "unresolved"
    assert extract.resolve_url("process.env.A ?? 'http://x'", {})["env_var"] == "A"
    assert extract.resolve_url("`${process.env.A}/u/${id}`", {})["path_suffix"] == "/u/*"
    assert extract.constants("enum E { A = 'x', B = 2 } class K { static readonly Q = 'q'; }") == {"E.A": "x", "E.B": "2", "K.Q": "q"}
    found = extract.wrappers("class Bus { private c: ClientProxy; publish(subject: string, body: any) { return this.c.emit(subject, body); } }")
    assert found == [("Bus", "publish", 0)]
    calls = list(extract.wrapper_calls("f.ts", "class A { constructor(private bus: Bus) {} go() { this.bus.publish('s.t', 1); } }", {}, found))
    assert [(c["subject"], c["via"]) for c in calls] == [("s.t", "Bus.publish")]
    names = [(s["role"], s["subject"]) for s in extract.symbols("f.ts", "class A {\n  x: number = f({a: 1});\n  async go(a: string): Promise<void> {\n    if (a) { throw new E(); }\n  }\n}\nexport const h = (q) => q;\ninterface I { z: string }\n", {})]
    assert names == [("class", "A"), ("field", "A.x"), ("method", "A.go"), ("function", "h"), ("interface", "I")]


def test_markdown_pieces():
    assert docs.pack("a b\n\nc d\n\n" + "w " * 9, 4) == ["a b\n\nc d", "w " * 9]
    fields, body, skipped, error = docs.frontmatter("---\na: 1\n---\nx")
    assert (fields, body, skipped, error) == ({"a": 1}, "x", 3, None)
    got = [(s["chain"], s["level"], s["start"], s["end"]) for s in docs.sections("intro\n# A\n## B\ntext\n# C")]
    assert got == [([], 0, 1, 1), (["A"], 1, 2, 2), (["A", "B"], 2, 3, 4), (["C"], 1, 5, 5)]
