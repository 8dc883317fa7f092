"""Near, line, substring and paragraph dedup and decontamination, held against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, kernels, line_dedup, near_dedup, paragraph_dedup, suffix_dedup, thin
from loomgraph.llm.components import connected_components
from loomgraph.llm.store import Scratch

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
    return " ".join(w)


def corpus():
    base = [prose(rng.randrange(3, 120)) for _ in range(60)]
    hub, passage = prose(150), prose(60)
    out = base + [edited(t, rng.randrange(0, 3)) for t in base[:40]] + [edited(hub, 2) for _ in range(90)] + [hub] * 5
    out += [prose(30) + " " + passage + " " + prose(30) for _ in range(6)]
    out += [None, "", " \t\n", "one", "Two Words", "two words", "a b c d", "a b c d", "der " * 300, "\x0b".join(["v"] * 6), prose(30000)]
    return list(enumerate(out))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, node int").repartition(5)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs, percent):
    sets = {i: shingles(t) for i, t in DOCS}
    want = components([i for i, _ in DOCS], lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    got = near_dedup.near_duplicates(docs, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_odd_rows(spark):
    text = prose(90)
    rows = [(5, text), (5, text), (None, text), (None, prose(20)), (9, prose(40)), (3, edited(text, 1))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3), (9, 9)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_repeated_ids(spark):
    """Rows of one id with different texts are judged each, whether what links them is an exact or a near copy."""
    a, b = prose(60), prose(90)
    for copy in (b, edited(b, 1)):
        got = near_dedup.near_duplicates(spark.createDataFrame([(5, a), (5, b), (3, copy)], "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted([(5, len(shingles(a)), 5, True), (5, len(shingles(b)), 3, False), (3, len(shingles(copy)), 3, True)])


def test_near_duplicates_star(spark):
    """Copies that are alike to the original alone, whose id is in the middle."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1200):
        own = list(words)
        if i != 600:
            for k in r.sample(range(1, 39), 3):
                own[5 * k + r.randrange(5)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(frame).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 1200


def star_batches(size, centre, batch):
    """Sorted rows of one region whose nodes tie in all values and are alike to one of them only."""
    r = np.random.default_rng(5)
    own = r.integers(0, 4, (near_dedup.SKETCH, 4))
    fields = np.where(r.random((size, near_dedup.SKETCH, 4)) < 0.12, r.integers(0, 4, (size, near_dedup.SKETCH, 4)), own)
    fields[centre] = own
    sketch = (fields[:, :, 0] | fields[:, :, 1] << 2 | fields[:, :, 2] << 4 | fields[:, :, 3] << 6).astype(np.uint8)
    for lo in range(0, size, batch):
        n = min(batch, size - lo)
        yield pa.record_batch([pa.array(np.zeros(n, np.int32)), pa.array([bytes(12)] * n), pa.array([bytes(20)] * n), pa.array(np.arange(lo, lo + n)), pa.array(np.full(n, 100, np.int32)), pa.array([x.tobytes() for x in sketch[lo : lo + n]])], ["tree", "root", "rest", "node", "n_shingles", "sketch"])


def test_leader_of_a_region():
    """All nodes of a dense region are held against the one most are alike to, with a few proposals a node."""
    pairs = {(a, b) for x in near_dedup._proposer(0.85)(star_batches(3000, 1700, 500)) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True) if a != b}
    assert {min(a, b) if max(a, b) == 1700 else max(a, b) for a, b in pairs if 1700 in (a, b)} == set(range(3000)) - {1700}
    assert len(pairs) <= 3000 * (near_dedup.NEXT + 1)


def test_leaders_of_a_region_in_pieces(monkeypatch):
    """A region that is held piece by piece: a piece's leader stands in the next one too."""
    monkeypatch.setattr(near_dedup, "HELD", 60)
    found = list(near_dedup._proposer(0.5)(star_batches(400, 170, 30)))
    assert len(found) > 3
    nodes = [{n for c in ("a", "b") for n in x[c].to_pylist()} for x in found]
    assert set.union(*nodes) == set(range(400)) and all(a & b for a, b in zip(nodes[:-1], nodes[1:], strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 200), (200, 300)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    want = {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 150)} | {300: 200}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_components_split_hot_nodes(spark):
    """The joins of a round stand between exchanges, so adaptive execution can split a node with very many links."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        scratch = Scratch(spark, "t")
        both = spark.range(20000).selectExpr("if(id < 15000, 1, id) u", "id + 20000 v").repartition(6)
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = both.join(least, "u").filter("m < v")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dedup_plain(rows):
    lines = [(i, k, x) for i, t in sorted(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    words = lambda x: tuple(x.strip(" \t\r").split(" "))
    seen, gone, keys = set(), set(), {}
    for i, k, x in lines:
        w = words(x)
        if len(w) < 3:
            continue
        if w in seen:
            gone.add((i, k))
            continue
        seen.add(w)
        if len(w) >= 8:
            own = {w} | {w[:j] + w[j + 1 :] for j in range(len(w))}
            if any(v in keys for v in own):
                gone.add((i, k))
            for v in own:
                keys.setdefault(v, (i, k))
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), sum(g[0] == i for g in gone)) for i, t in rows}


def test_lines(spark):
    pool = [prose(rng.randrange(1, 14)) for _ in range(40)]
    near = [edited(x, 1) for x in pool] + [" ".join(x.split(" ")[1:]) for x in pool] + [x + " more" for x in pool]
    rows = [(i, "\n".join(rng.choice(pool + near + ["", " "]) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, rows[0][1]), (64, "  " + pool[0] + "\r\n" + pool[0] + " "), (65, "\n".join(prose(9) for _ in range(3000))), (66, prose(20000))]
    frame = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, n_lines string").repartition(4)
    out = line_dedup.dedup_lines(frame)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()} == dedup_plain(rows)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, pool[3] + "\nb"), (1, pool[3] + "\nb"), (None, pool[3])], "doc_id long, text string")
    assert line_dedup.dedup_lines(twice).count() == 3


def test_lines_with_two_places(spark):
    """A moved word, and a first word left out with another one put at the end; no other line is near these."""
    rows = []
    for n in range(8, 15):
        w = [f"n{n}w{i}" for i in range(n)]
        rows += [(10 * n, " ".join(w)), (10 * n + 1, " ".join([*w[1:], "new"])), (10 * n + 2, " ".join([w[0], *w[2:-1], w[1], w[-1]]))]
        v = [f"n{n}v{i}" for i in range(n)]
        rows += [(10 * n + 4, " ".join(v)), (10 * n + 5, " ".join(v[: n // 2] + v[n // 2 + 1 :]))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == dedup_plain(rows)
    assert sum(r["n_removed"] for r in got) == 20  # the line of 8 words with one left out is too short for the near comparison


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, doubles, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lines_send_texts_once(spark, tmp_path):
    """Whole texts are sent for the rebuilding only; of lines with a shared part only themselves, though every text has one of them."""
    noise = random.Random(9)

    def fresh(n):
        return " ".join(f"{noise.getrandbits(48):x}" for _ in range(n))

    pool = [fresh(12) for _ in range(40)]
    rows = [(i, "\n".join([fresh(400), edited(pool[i % 40], 1), fresh(400)])) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    frame.repartition(4, "doc_id").write.format("noop").mode("overwrite").save()
    once = shuffled(spark) - before
    try:
        got = line_dedup.dedup_lines(frame).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    sent = shuffled(spark) - before - once
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got} == dedup_plain(rows)
    assert once > 2_000_000 and sent < 1.5 * once


def test_thin(spark, monkeypatch):
    """No key that is held is lost, however full the filter is; with room for it, few others pass."""
    rows = spark.range(40_000).selectExpr("id", "CAST(id % 7 AS INT) AS other", "'x' AS words", "1 AS block")
    held = spark.range(0, 40_000, 20).selectExpr("id", "CAST(id % 7 AS INT) AS other")
    want = {(i, i % 7) for i in range(0, 40_000, 20)}
    for most in (thin.MAX_BLOCKS, 8, 1):
        monkeypatch.setattr(thin, "MAX_BLOCKS", most)
        out = thin.thin(rows, ["id", "other"], held, 2000)
        assert out.columns == rows.columns
        got = [(r["id"], r["other"]) for r in out.collect()]
        assert len(got) == len(set(got)) and want <= set(got)
        if most > 8:
            assert len(got) < len(want) + 0.05 * 38_000
    assert thin.thin(rows, ["id"], held.limit(0), 0).count() == 0


def covered(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for i, b in data:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(i, t) for i, t in DOCS if t is None or len(t) < 3000] + [(900, "ab" * 700), (901, "ab" * 150), (902, "é" * 230), (903, DOCS[0][1]), (904, prose(40) + "x" * 260 + prose(20))]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int").repartition(3)
    got = suffix_dedup.remove_repeats(frame, 60).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=repr) == covered(rows, 60)
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    data = np.frombuffer(prose(600).encode(), np.uint8)
    whole = suffix_dedup.records_of(data, np.array([0, len(data)]), 60)
    assert whole["windows"].sum() == len(data) - 59
    parts = [(skip, suffix_dedup.records_of(own, at, 60)) for _, skip, own, at in suffix_dedup._pieces(data, np.array([0, len(data)]), 60)]
    assert sum(r["windows"].sum() for _, r in parts) == len(data) - 59
    assert {(s, b) for s, b in zip(whole["start"] + whole["anchor"], whole["bucket"])} == {(skip + s, b) for skip, r in parts for s, b in zip(r["start"] + r["anchor"], r["bucket"])}


def test_suffix_sort():
    gen = np.random.default_rng(1)
    data = gen.integers(97, 99, 4000).astype(np.uint8)
    at = np.sort(gen.integers(0, 3900, 300))
    size, group = gen.integers(1, 90, 300), np.sort(gen.integers(0, 9, 300))
    order = suffix_dedup.Suffixes(data, at, size, group).sort()
    want = sorted(range(300), key=lambda i: (group[i], bytes(data[at[i] : at[i] + size[i]]), i))
    assert order.tolist() == want


def test_paragraphs(spark):
    frame = spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, key int").repartition(4)
    got = paragraph_dedup.repeated_paragraphs(frame).collect()
    assert all(r["doc_id"] != r["kept_in"] or DOCS[r["doc_id"]][1].startswith("der ") for r in got)
    shared = {}
    for i, t in DOCS:
        w = (t or "").lower().split()
        for p in range(len(w) - 50):
            shared.setdefault(tuple(w[p : p + 51]), set()).add(i)
    gone = {r["doc_id"] for r in got}
    assert all(len(g - gone) <= 1 for g in shared.values())
    texts = {i: (t or "").encode() for i, t in DOCS}
    sets = {}
    for i, t in DOCS:
        for n in (texts[i],):
            w = n.decode().lower().split()
            sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)}
    for r in got:
        own = shingles(texts[r["doc_id"]][r["start"] : r["start"] + r["size"]].decode())
        assert any(len(own & sets[i]) >= 0.6 * len(own) for i in sets if i != r["doc_id"]) or r["doc_id"] == r["kept_in"]
    assert paragraph_dedup.repeated_paragraphs(frame.limit(0)).count() == 0


def places_plain(rows):
    """(doc_id, start, size, words) of every paragraph, by the operator's own cut."""
    out = []
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        for cut in (paragraph_dedup.paragraphs, paragraph_dedup.units):
            found = cut(data, np.array([0, len(data)])) if len(data) else {}
            out += [(i, int(a), int(n), (cut.__name__, tuple(bytes(data[a : a + n]).decode().lower().split()))) for a, n in zip(found.get("start", []), found.get("size", []))]
    return out


def repeated_plain(rows, least):
    places = places_plain(rows)
    by_words = {}
    for p in places:
        by_words.setdefault(p[3], []).append(p)
    words = list(by_words)
    sets = [frozenset(tuple(w[1][k : k + 5]) for k in range(len(w[1]) - 4)) for w in words]
    apart = lambda x, y: x[0] != y[0] or x[1] + x[2] <= y[1] or y[1] + y[2] <= x[1]
    alike = lambda a, b: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and any(apart(x, y) for x in by_words[words[a]] for y in by_words[words[b]])
    of = components(range(len(words)), alike)
    groups = {}
    for n, w in enumerate(words):
        groups.setdefault(of[n], []).extend(by_words[w])
    out = set()
    for group in groups.values():
        keep = min(group)
        out |= {(p[0], p[1], p[2], keep[0]) for p in group if p[0] != keep[0] or p[1] >= keep[1] + keep[2]}
    return out


def test_paragraphs_against_all_pairs(spark):
    """Components and keepers over the same cut, near copies within one text among them."""
    r = random.Random(21)
    unique = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n in (20, 26, 33, 47, 60, 90):
        x = unique(n)
        near = [*x[:-2], "other", x[-1]]
        rows += [(len(rows), " ".join(x)), (len(rows) + 1, " ".join(unique(12) + x + unique(30))), (len(rows) + 2, "\n".join([" ".join(near), " ".join(unique(22)), " ".join(x)]))]
    rows += [(100, "a b " * 60), (101, None), (102, ""), (103, " ".join(unique(19)))]
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(g["doc_id"], g["start"], g["size"], g["kept_in"]) for g in got} == repeated_plain(rows, 0.8)
    assert any(g["doc_id"] == g["kept_in"] for g in got)


def test_paragraph_odd_rows(spark):
    """Null ids come last, a repeated row is one document, and clashing columns don't matter."""
    r = random.Random(22)
    x = " ".join(f"u{r.randrange(10**9)}" for _ in range(30))
    rows = [(None, x, 1, "a"), (4, x, 1, "a"), (4, x, 1, "a"), (9, x + " end", 1, "a"), (4, "other " + x, 1, "a")]
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string, d int, wh string")).collect()
    assert {(g["doc_id"], g["kept_in"]) for g in got} >= {(None, 4), (9, 4)} and all(g["kept_in"] == 4 for g in got)
    assert (paragraph_dedup.BANDS, paragraph_dedup.UNIT_BANDS) == (2, 4)


def test_paragraph_recall(spark):
    """Verbatim paragraphs of 26 to 50 words on lines of their own, in two documents with different surroundings."""
    r = random.Random(23)
    unique = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    rows = []
    for k in range(200):
        x = unique(26 + k % 25)
        rows += [(2 * k, unique(20) + "\n" + x + "\n" + unique(20)), (2 * k + 1, unique(31) + "\n\n" + x + "\n\n" + unique(9))]
    got = {g["doc_id"] for g in paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {2 * k + 1 for k in range(200)}


def test_short_paragraphs(spark):
    """Equal lines, blank-line paragraphs and whole texts of 25 to 45 words, and near ones."""
    r = random.Random(12)
    unique = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    rows, want = [], set()
    for n in (25, 26, 30, 35, 40, 45) * 3:
        x = unique(n)
        wrapped = x.replace(" ", "\n", 9)
        for copy in (unique(30) + "\n" + x + "\n" + unique(40), unique(20) + "\n\n" + wrapped + "\n \n" + unique(30), x, x.rsplit(" ", 1)[0] + "\n\n" + unique(30)):
            rows.append((len(rows), copy))
        want |= {len(rows) - 3, len(rows) - 2, len(rows) - 1}
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {g["doc_id"] for g in got} == want and all(g["kept_in"] == g["doc_id"] // 4 * 4 for g in got)


def hits_plain(docs, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = []
    wins = [(str(i) if i is not None else "", {tuple(w[p : p + window]) for p in range(max(1, len(w) - window + 1))}) for i, t in items if (w := split(t))]
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for name, own in wins:
            for win in own:
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        names.add(name)
        found.append((i, len(w), len(hit), sorted(names)))
    return found


@pytest.mark.parametrize("most", [200_000, 3])
def test_contamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", most)
    long, mid = prose(40), prose(14)
    items = [(1, long), (2, mid), (10, mid + " Tail"), (3, "Ab cd"), (4, "solo!"), (5, ""), (6, None), (7, "..."), (8, prose(10)), (8, prose(10)), (None, prose(11)), (11, "the the the the the the the the the the the the")]
    texts = [None, "", "AB--cd ef", "xx solo", long.upper().replace("É", "é"), "q " + long[: len(long) // 2], prose(200), mid + ", " + mid, "the " * 25, " ".join([prose(5), items[8][1], prose(3), items[10][1]]), "ab cd " * 4000]
    docs = list(enumerate(texts)) + [(1, "ab cd"), (None, "solo")]
    frame = spark.createDataFrame([(i, t, 0, "w") for i, t in docs], "doc_id long, text string, key int, words string").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, win string")
    got = decontaminate.find_contamination(frame, bench).collect()
    assert sorted((repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got)) == sorted(repr(x) for x in hits_plain(docs, items, 10))
    assert decontaminate.find_contamination(frame.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_contamination(frame, bench.limit(0)).collect()} == {0}


def test_kernels_agree_with_python():
    texts = [t for _, t in DOCS]
    import pyarrow as pa

    data, offsets = kernels.text_bytes(pa.array(texts)[3:])
    _, at = kernels.shingle_sets(data, offsets)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts[3:]]


def test_similar_pairs_lose_no_link():
    gen = np.random.default_rng(3)
    common = gen.integers(0, 2**63, 9)
    sets = []
    for _ in range(30):
        base = np.unique(np.concatenate([common, gen.integers(0, 2**63, 12)]))
        sets += [base, np.unique(np.concatenate([base[:-1], gen.integers(0, 2**63, 1)])), np.unique(np.concatenate([base[3:], gen.integers(0, 2**63, 3)]))]
    near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    want = components(range(len(sets)), near)
    found = set(paragraph_dedup.similar_pairs(sets, 0.8))
    assert components(range(len(sets)), lambda a, b: (b, a) in found) == want
