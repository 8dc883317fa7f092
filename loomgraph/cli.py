"""Command line: build a graph, ask it questions. Exit codes: 0 found, 1 error, 3 gate, 4 not found."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from loomgraph.operators import match, render, truth
from loomgraph.plans import graph as G
from loomgraph.plans import paths, router
from loomgraph.sources import stores

LISTS = {"publishers": G.publishers, "subscribers": G.subscribers, "producers": G.queue_producers, "consumers": G.queue_consumers, "table-users": G.table_users}


def _session() -> SparkSession:
    return SparkSession.builder.appName("loomgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("config")
    b.add_argument("out")
    b.add_argument("--strict", action="store_true")
    for name in (*LISTS, "deps", "dependents", "explain", "module-imports", "ask"):
        q = sub.add_parser(name)
        q.add_argument("graph")
        q.add_argument("name")
        q.add_argument("--table", action="store_true")
    s = sub.add_parser("stats")
    s.add_argument("graph")
    f = sub.add_parser("path")
    for a in ("graph", "start", "target"):
        f.add_argument(a)
    m = sub.add_parser("mermaid")
    m.add_argument("graph")
    m.add_argument("--slice", default="full")
    return p


def _load(spark: SparkSession, path: str) -> G.Graph:
    return stores.read_graph_json(spark, path) if path.endswith(".json") else stores.read_graph(spark, path)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(_session(), args)
    except Exception as e:  # one line for whoever called; the trace stays in the log
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "build":
        return _build(spark, args)
    graph = _load(spark, args.graph)
    command, name = args.command, getattr(args, "name", None)
    if command == "ask":
        to = router.route(name)
        tools = {"subject_publishers": "publishers", "subject_subscribers": "subscribers", "queue_producers": "producers", "queue_consumers": "consumers", "table_users": "table-users", "service_dependencies": "deps", "service_dependents": "dependents", "module_imports": "module-imports", "stats": "stats"}
        if to.tool not in tools:
            print("no question of this kind is known", file=sys.stderr)
            return 4
        command, name = tools[to.tool], to.target
    if command in LISTS:
        answer = LISTS[command](graph, name)
        rows = [r.asDict() for r in answer.rows.toLocalIterator()] if answer.found else []
        print(render.table(rows) if args.table and answer.found else render.envelope(answer.found, rows))
        return 0 if answer.found else 4
    if command in ("deps", "dependents", "explain"):
        node = name if ":" in name else f"service:{name}"
        if not graph.has(node):
            print(json.dumps({"found": False}))
            return 4
        found = G.explain(graph, node).rows if command == "explain" else G.grouped_neighbours(graph, node, command == "deps")
        print(json.dumps({"found": True, "rows": [r.asDict(recursive=True) for r in found.toLocalIterator()]}))
        return 0
    if command == "module-imports":
        tree = paths.import_tree(graph, name)
        print(json.dumps({"found": tree is not None} | (tree or {})))
        return 0 if tree else 4
    if command == "stats":
        print(json.dumps([r.asDict() for r in G.stats(graph).toLocalIterator()]))
        return 0
    if command == "path":
        path = paths.find_path(graph, args.start, args.target)
        print(json.dumps({"found": path.found, "nodes": path.nodes, "edges": path.edges}))
        return 0 if path.found else 4
    kind, value = render.parse_slice(args.slice)
    part = graph if kind == "full" else G.slice_service(graph, value) if kind == "service" else G.slice_domain(graph, value)
    text, warnings = render.mermaid(part)
    print(text, end="")
    for w in warnings:
        print(w, file=sys.stderr)
    return 0


def _build(spark: SparkSession, args: argparse.Namespace) -> int:
    from loomgraph.plans.build import build

    config = stores.load_config(Path(args.config).read_text(encoding="utf-8"))
    out = build(spark, config)
    stores.write_graph(out["graph"], args.out)
    rows = {(r["domain"], r["role"]): r for r in out["recall"].collect()}  # a row for each domain and role
    reports = {}
    for (domain, _), r in rows.items():
        got = reports.setdefault(domain, {"n_truth": 0, "n_matched": 0})
        got["n_truth"] += r["n_truth"]
        got["n_matched"] += r["n_matched"]
    for got in reports.values():
        got["recall"] = got["n_matched"] / got["n_truth"] if got["n_truth"] else 1.0
    print(json.dumps({"recall": reports, "cycle_error": out["cycle_error"]}))
    if args.strict:
        for r in match.resolve_rates(out["sites"]).collect():  # a row for each domain
            reports.setdefault(r["domain"], {"n_truth": 0, "recall": 1.0})["resolve_rate"] = r["rate"]
        enabled = {domain for domain, _ in truth.PATTERNS if config.domains.get(domain, True)}
        verdicts = match.strict_gate(reports, enabled)
        failed = [v for v in verdicts if not v.ok]
        for v in failed:
            print(f"{v.domain}: {v.reason}; {match.tips([v])[v.domain]}", file=sys.stderr)
        return 3 if failed else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
