"""Quality classifier, nearest neighbours and the pipeline."""

import random
import zlib

import numpy as np

from loomgraph.llm import ann, quality

rng = random.Random(8)


def make_docs(n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 60))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + rng.choice(["$$$", "###", "!!"]) for w in words)
        rows.append((i, text, "clash"))
        if i % 3:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = make_docs(900)
    rows += [(5000, None, ""), (5001, "", ""), (5002, "a " * 400000, ""), (None, "no id", ""), (7, rows[7][1], "")]
    labels += [(1, None, 1), (2, 9, 0), (99999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["doc_id"]): r for r in quality.score_quality(docs, known).collect()}
    truth = {i: q for i, q, _ in labels if q in (0, 1)}
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if i is not None:
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in truth if i in got and got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    some = spark.createDataFrame([(i, f"word {i}") for i in range(40)], "doc_id long, text string")
    assert all(r["predicted"] == 1 for r in quality.score_quality(some, one).collect())


def test_isotonic_is_monotone_and_pools():
    x, h = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 3.0, 1.0, 5.0]), np.array([5.0, 4.0, 4.0, 5.0]))
    assert len(x) == 3 and (np.diff(h) >= 0).all() and 0 < h[0] and h[-1] < 1


def exact(vectors, queries, k):
    good = {i: np.asarray(v, np.float32).astype(float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            near = []
            for i, v in good.items():
                if i != q and len(v) == len(good[q]):
                    near.append((-float((v * good[q]).sum() / (np.sqrt((v * v).sum()) * np.sqrt((good[q] ** 2).sum()))), i))
            out[q] = sorted(near)[:k]
    return out


def test_neighbours(spark):
    gen = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in gen.normal(size=16).astype(np.float32)]) for i in range(1500)]
    for i in range(400):
        vectors[i * 3] = (i * 3, list(vectors[0][1]))  # a third are copies
    vectors += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 15 + [None]), (2004, [float("inf")] + [1.0] * 15), (2005, []), (None, [1.0] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 1.0]), vectors[50]]
    frame = spark.createDataFrame([(i, v, 3) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    asked = frame.filter("vec_id % 50 = 0 OR vec_id >= 2000")
    got = {}
    for r in ann.nearest_neighbours(frame, asked, shard_rows=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(vectors, [i for i, _ in vectors if i is not None and (i % 50 == 0 or i >= 2000)], 5)
    assert set(got) == {q for q in want if want[q]}
    hits = total = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(want[q])
        hits += len({r[1] for r in rows} & {i for _, i in want[q]})
        total += len(want[q])
        scores = {i: -s for s, i in want[q]}
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in rows if i in scores)
    assert hits >= 0.97 * total
    assert [i for _, i, _ in got[0]] == [3, 6, 9, 12, 15]  # ties to the smaller id
    assert ann.nearest_neighbours(frame.limit(0), asked).count() == 0
    assert ann.nearest_neighbours(frame, asked.limit(0)).count() == 0


def test_every_node_can_be_reached():
    gen = np.random.default_rng(2)
    spread = np.concatenate([gen.normal(size=(40, 8)) * 0.01 + c for c in gen.normal(size=(20, 8)) * 9]).astype(np.float32)
    arrays = ann.build_shard(np.arange(len(spread)), spread, 6)
    assert ann._reached(arrays["links0"]).all()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = make_docs(300)
    item = " ".join(f"bench{i}" for i in range(12))
    copy = rows[1][1]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    rows += [(900, "good words eat " + item + " note ton", "en", "s0", 1), (901, None, None, None, None), (902, "", "en", "s1", 0), (903, copy, "en", "s1", len(copy))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r["doc_id"] for r in docs.collect()}
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    bad = {i for i, q, _ in labels if q == 0}
    good = {i for i, q, _ in labels if q == 1}
    assert len(left["quality"] & bad) <= 0.03 * len(bad) and len(left["quality"] & good) >= 0.99 * len(good)
    assert 903 not in left["lines"] | left["near"]
    assert 900 in left["near"] and 900 not in left["decontaminate"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_neighbours_in_double_precision(spark):
    """Scores are those of the vectors as they are, also beyond the range of single precision."""
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.7]), (2, [1e39, 1.0]), (3, [1e-200, 1e-200]), (4, [-5.0, 1.0]), (5, [1e308, -1e308])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest_neighbours(frame, frame, k=5).collect()}
    from fractions import Fraction

    for i, a in rows:
        for j, b in rows:
            if i != j:
                x, y = [Fraction(v) for v in a], [Fraction(v) for v in b]
                dot, size = sum(p * q for p, q in zip(x, y)), sum(p * p for p in x) * sum(q * q for q in y)
                want = float(dot * dot / size) ** 0.5 * (1 if dot >= 0 else -1)
                assert abs(got[i, j] - want) < 1e-12, (i, j)
    whole = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [0, 0])], "vec_id long, embedding array<int>")
    assert {(r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(whole, whole).collect()} == {(1, 2), (2, 1)}


def test_sums_of_many_partitions_are_added_on_executors(spark):
    size = 7
    rows = [(p % quality.FOLDS, p, np.full(size, float(p)).tobytes()) for p in range(50)]
    got = {r["fold"]: np.frombuffer(r["sums"]) for r in quality._added(spark.createDataFrame(rows, quality._SUMS).repartition(9), 50).collect()}
    assert {k: v.tolist() for k, v in got.items()} == {k: [float(sum(p for p in range(50) if p % quality.FOLDS == k))] * size for k in range(quality.FOLDS)}
