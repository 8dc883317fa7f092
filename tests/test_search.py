"""Search, index and recall operators against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import index, match, search


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("a", "service", "order api", "p", "place order order", "h", [1.0, 0.0, 0.0, 0.0], 0), ("b", "doc-section", "guide", "p", "how to place an order", "h", [0.9, 0.1, 0.0, 0.0], 1),
        ("c", "endpoint", "GET /x", "p", "nothing", "h", [0.0, 1.0, 0.0, 0.0], 2), ("d", "service", "mail", "p", "", "h", [0.0, 0.0, 0.0, 0.0], 3), ("e", "service", "old", "p", None, "h", [-1.0, 0.0, 0.0, 0.0], 4),
    ]
    return spark.createDataFrame(rows, schema.RECORDS)


def test_cosine_and_knn(records):
    got = {r["node_id"]: r["score"] for r in search.knn(records, [1, 0, 0, 0], 5).collect()}
    assert got["a"] == 1 and got["c"] == 0 and got["d"] == 0 and got["e"] == -1
    assert [r["node_id"] for r in search.knn(records, [1, 0, 0, 0], 2).collect()] == ["a", "b"]
    assert search.knn(records, [1, 0, 0, 0], 9, least=0.5).count() == 2


def plain_bm25(texts, query):
    docs = [search.query_tokens(t or "") for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        s = 0.0
        for w in query:
            df, tf = sum(w in x for x in docs), d.count(w)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
        out.append(s)
    return out


def test_bm25(records):
    query = ["order", "place", "order"]
    want = plain_bm25([r["snippet"] for r in records.orderBy("ord").collect()], query)
    got = {r["key"]: r["bm25"] for r in search.bm25(records, query, F.col("snippet")).collect()}
    assert got == pytest.approx({i: s for i, s in enumerate(want) if s > 0})
    assert search.bm25(records, [], F.col("snippet")).count() == 0


def test_hybrid(records):
    rows = search.hybrid(records, [1, 0, 0, 0], "order place", least=0.0).collect()
    assert [r["node_id"] for r in rows][:2] in (["a", "b"], ["b", "a"]) and "e" not in {r["node_id"] for r in rows}
    by = {r["node_id"]: r for r in rows}
    assert by["a"]["score"] == pytest.approx(1 / (60 + by["a"]["dense"]) + 1 / (60 + by["a"]["lexical"]))
    assert by["c"]["lexical"] is None
    assert {r["kind"] for r in search.code_search(records, [1, 0, 0, 0], "order", least=0.0).collect()} == {"service", "endpoint"}
    assert [r["node_id"] for r in search.docs_search(records, [1, 0, 0, 0], "order", least=0.0).collect()] == ["b"]
    with pytest.raises(ValueError):
        search.docs_search(records, [1, 0, 0, 0], "x", kinds=["service"])
    assert len([r for r in search.hybrid(records, [1, 0, 0, 0], "order", least=0.0, quotas={"service": 1}).collect() if r["kind"] == "service"]) == 1
    first = search.hybrid(records, [1, 0, 0, 0], "", least=0.0, boosts={"endpoint": 9.0}).first()
    assert first["node_id"] == "c"
    assert search.resolve_floor(None, "e5-base") == 0.55 and search.resolve_floor(0.1, "e5-base") == 0.1 and search.resolve_floor(None, None) == 0.30


def test_ranks_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = search.ranked(df, [F.desc("v")], "n").collect()
    assert {r["v"]: r["n"] for r in got} == {v: 1000 - v for v in range(1000)}


def test_index(spark):
    nodes = spark.createDataFrame([(f"n{i}", "service", f"l{i}", "p", f"text {i}", i) for i in range(4)], "id string, kind string, label string, path string, snippet string, ord long")
    first = index.build_index(nodes, None, "m").cache()
    vector = first.filter("node_id = 'n1'").first()["vector"]
    assert len(vector) == index.DIM and sum(x * x for x in vector) == pytest.approx(1, abs=1e-5)
    changed = nodes.filter("id <> 'n3'").withColumn("snippet", F.when(F.col("id") == "n0", "other").otherwise(F.col("snippet")))
    marked = first.withColumn("vector", F.array(F.lit(7.0).cast("float")))
    second = {r["node_id"]: list(r["vector"]) for r in index.build_index(changed, marked, "m").collect()}
    assert set(second) == {"n0", "n1", "n2"} and second["n1"] == [7.0] and len(second["n0"]) == index.DIM
    states = {r["node_id"]: r["state"] for r in index.split_changes(index.build_index(changed, None, "m"), first).collect()}
    assert states == {"n0": "recompute", "n1": "reused", "n2": "reused", "n3": "deleted"}
    good = {"schema_version": 2, "model": "m", "dim": 3, "graph_hash": "x"}
    assert index.check_manifest(good, "m", 3, "y") == (None, ["the graph has changed since the index was built"])
    assert index.check_manifest(None)[0] == "missing" and index.check_manifest(good, "n")[0].startswith("corrupt")


def test_a_failed_batch_is_skipped(spark):
    def embed(batches):
        for texts in batches:
            if texts.str.contains("bad").any():
                raise RuntimeError("model")
            yield texts.map(lambda t: [1.0])

    rows = [(str(i), "service", "bad" if i == 40 else "good", "p", i) for i in range(100)]
    nodes = spark.createDataFrame(rows, "id string, kind string, label string, path string, ord long").coalesce(1)
    got = {int(r["node_id"]) for r in index.build_index(nodes, None, "m", embed).collect()}
    assert got == set(range(100)) - set(range(32, 64))
    with pytest.raises(Exception, match="model"):
        index.build_index(nodes, None, "m", embed, on_error="raise").collect()


def test_quotas_are_limits_by_kind(records):
    plan = search.hybrid(records, [1, 0, 0, 0], "order", least=0.0, quotas={"service": 1})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_multiset_match_is_symmetric(spark):
    a = spark.createDataFrame([("f", 1, 0), ("f", 1, 1), ("f", 2, 2), (None, 3, 3)], "file string, line int, ord int")
    b = spark.createDataFrame([("f", 1, 0), ("f", 4, 1), (None, 3, 2), (None, 3, 3)], "file string, line int, ord int")
    matched, missed, extra = match.multiset_match(a, b, ["file", "line"], ["ord"])
    assert (matched.count(), missed.count(), extra.count()) == (2, 2, 2)
    back = match.multiset_match(b, a, ["file", "line"], ["ord"])
    assert (back[0].count(), back[1].count(), back[2].count()) == (2, 2, 2)
    one = match.multiset_recall(a.withColumn("d", F.lit("x")), b.withColumn("d", F.lit("x")), ["d", "file", "line"], ["d"]).first()
    assert (one["n_truth"], one["n_found"], one["n_matched"], one["recall"]) == (4, 4, 2, 0.5)


def test_gates():
    reports = {"nats": {"n_truth": 10, "recall": 0.94}, "di": {"n_truth": 3, "recall": 1.0, "resolve_rate": 0.5}, "http": {"n_truth": 5, "recall": 1.0}}
    verdicts = {v.domain: v.ok for v in match.strict_gate(reports, {"nats", "di", "http", "cron"})}
    assert verdicts == {"nats": False, "di": False, "http": True, "cron": False}
    assert set(match.tips(match.strict_gate(reports, {"nats", "http"}))) == {"nats"}


def test_rules_and_shares(spark):
    rows = spark.createDataFrame([(b, i) for b in range(6) for i in ("x", "y")] + [(9, "x")], "b int, item string")
    got = {(r["item"], r["other"]): r["confidence"] for r in match.association_rules(rows, "b", "item").collect()}
    assert got == {("x", "y"): pytest.approx(6 / 7), ("y", "x"): 1.0}
    places = spark.createDataFrame([("k", "a")] * 4 + [("k", "b")] + [("few", "a")], "kind string, place string")
    assert [(r["kind"], r["place"], r["share"]) for r in match.placement_shares(places, "kind", "place").collect()] == [("k", "a", 0.8)]


def test_hit_rate(spark):
    results = spark.createDataFrame([("q1", "service", "Order API", 0.9), ("q2", "queue", "mail", 0.1)], "query_id string, kind string, label string, score double")
    expected = spark.createDataFrame([("q1", "p", "A", ["service"], ["order"], 0.5), ("q2", "p", "A", ["queue"], ["mail"], 0.5), ("q3", "p", "B", ["x"], ["y"], 0.0)], "query_id string, project string, category string, kinds array<string>, labels array<string>, min_score double")
    got = {(r["project"], r["category"]): (r["n"], r["n_hit"]) for r in search.hit_rate(results, expected).collect()}
    assert got == {("p", "A"): (2, 1), ("p", "B"): (1, 0), ("p", None): (3, 1), (None, None): (3, 1)}
