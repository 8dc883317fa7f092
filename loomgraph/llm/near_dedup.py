"""Near-duplicate groups by a MinHash LSH forest.

1. Every text becomes its set of five-word shingles, a MinHash signature and a
   128-bit hash of the set. Texts with equal sets form a class; one node stands for it.
2. The signature is cut into ``TREES`` sequences. In each, nodes are sorted by their
   sequence; nodes that share the first ``ROOT`` values stand in one region. A region
   of up to ``LEAF`` nodes proposes all its pairs. A larger one proposes for each node
   its next ones in order, which share the longest prefixes with it, and is split by one
   value more, and so on as deep as it is dense: the parts propose for each node their
   leader, the node whose sketch agrees with most others', as an original's does with its
   copies', and all their pairs once they have ``SMALL`` nodes.
3. Proposed pairs whose sketches can't reach the threshold fall out. The others are
   verified on full sets, each pair once, by units of up to ``UNIT`` nodes, so that a
   set travels once a unit and not once a pair.
4. Components of the verified links.
5. Regions that were too large for all their pairs and hold several components are searched
   exactly: each node outside the region's largest component is held against all others by the
   rarest shingles of both, of which two texts at the threshold must share one, and what meets
   is compared on full sets. A pair is compared in the first of the regions that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import kernels as K
from loomgraph.llm.components import connected_components
from loomgraph.llm.store import Scratch

#: A pair at similarity 0.85 shares no root in any tree with probability (1 - 0.85^3)^14 = 2e-6.
TREES, DEPTH, ROOT = 14, 8, 3
LEAF, SMALL, UNIT, NEXT = 24, 8, 256, 3
#: Rows of one region held at a time.
HELD = 1 << 16
#: Step 5 holds so many nodes at a time, and runs so many others of a region by them in one task.
LEFT, RIGHT = 1024, 8192
#: Two bits of each signature value go into the sketch: 112 values in 28 bytes.
SKETCH = TREES * DEPTH // 4
NO_ID = (1 << 63) - 1

_SIGNED = "doc_id long, th long, n_shingles long, s1 long, s2 long, sketch binary, trees binary"
#: How many of the four 2-bit fields of a byte are zero.
_ZERO_FIELDS = np.array([sum((b >> s) & 3 == 0 for s in (0, 2, 4, 6)) for b in range(256)], np.int16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(2))
        for lo, hi in K.groups(offsets):
            hashes, at = K.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sig = K.signatures(hashes, at, TREES * DEPTH)
            sums = []
            for salt in K.random_words(2, 41):
                total = np.concatenate([np.zeros(1, K.U64), np.cumsum(K.mix(hashes ^ salt))])
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            low = (sig & 3).astype(np.uint8).reshape(hi - lo, SKETCH, 4)
            sketch = low[:, :, 0] | low[:, :, 1] << 2 | low[:, :, 2] << 4 | low[:, :, 3] << 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at)), *map(pa.array, sums), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.astype(">u4").tobytes() for x in sig], pa.binary())],
                ["doc_id", "th", "n_shingles", "s1", "s2", "sketch", "trees"],
            )


class _Region:
    """Nodes of one tree that share the first ROOT values, sorted by the rest of their sequence."""

    def __init__(self, tree: int, root: bytes, node: np.ndarray, n: np.ndarray, rest: np.ndarray, sketch: np.ndarray, least: float) -> None:
        self.tree, self.root, self.node, self.n, self.rest, self.sketch, self.least = tree, root, node, n, rest, sketch, least
        self.leader = 0
        self.found: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.units = 0

    def propose(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of one unit that the sketches and sizes allow."""
        small, big = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (small >= self.least * big - 1e-9) & (self.node[i] != self.node[j])
        i, j = i[ok], j[ok]
        if len(i):
            ok = possible(self.sketch[i], self.sketch[j], self.least)
            if ok.any():
                self.found.append((i[ok], j[ok], self.units))
        self.units += 1

    def split(self) -> None:
        size = len(self.node)
        if size <= LEAF:
            self.propose(*np.triu_indices(size, 1))
            return
        for at in range(0, size, UNIT - NEXT):  # the next ones in order share the longest prefixes
            own = np.arange(at, min(size, at + UNIT - NEXT))
            near = [own[own + step < size] for step in range(1, NEXT + 1)]
            self.propose(np.concatenate(near), np.concatenate([x + step for step, x in enumerate(near, 1)]))
        self.leader = medoid(self.sketch)
        stack = [(0, size, 0, -1)]
        while stack:
            lo, hi, depth, known = stack.pop()
            if hi - lo <= SMALL:
                i, j = np.triu_indices(hi - lo, 1)
                self.propose(lo + i, lo + j)
                continue
            leader = lo + medoid(self.sketch[lo:hi]) if depth else self.leader
            if leader != known:
                others = np.delete(np.arange(lo, hi), leader - lo)
                for at in range(0, len(others), UNIT - 1):
                    own = others[at : at + UNIT - 1]
                    self.propose(np.full(len(own), leader), own)
            if depth < DEPTH - ROOT:
                cuts = np.flatnonzero(np.diff(self.rest[lo:hi, depth].astype(np.int64))) + 1
                for a, b in zip([0, *cuts], [*cuts, hi - lo], strict=True):
                    if b - a > 1:
                        stack.append((lo + a, lo + b, depth + 1, leader))


def medoid(sketch: np.ndarray) -> int:
    """The first of the rows that agree in most fields with the most frequent value of each field."""
    counts = np.stack([[((sketch >> s) & 3 == v).sum(axis=0) for v in range(4)] for s in (0, 2, 4, 6)])
    usual = counts.argmax(axis=1).astype(np.uint8)
    return int(_ZERO_FIELDS[sketch ^ (usual[0] | usual[1] << 2 | usual[2] << 4 | usual[3] << 6)].sum(axis=1).argmax())


def possible(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether 2-bit sketches leave a similarity of ``least`` possible: five standard deviations below it are refused."""
    values = 4 * x.shape[1]
    p = least + (1 - least) / 4
    return _ZERO_FIELDS[x ^ y].sum(axis=1) >= values * p - 5 * (values * p * (1 - p)) ** 0.5


def _proposer(least: float):
    """What turns sorted rows of regions into pairs (a, b, unit); a node of a large region is also paired with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held, leader = None, [], 0, None

        def flush() -> pa.RecordBatch | None:
            nonlocal leader
            node, n, rest, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
            region = _Region(key[0], key[1], node, n, rest, sketch, least)
            region.split()
            leader = tuple(x[region.leader : region.leader + 1] for x in (node, n, rest, sketch))
            if len(node) > LEAF or held_no:
                region.found.append((np.arange(len(node)), np.arange(len(node)), 0))
            if not region.found:
                return None
            i, j = (np.concatenate([f[k] for f in region.found]) for k in (0, 1))
            # In order of trees, so that the least unit of a pair is in its first tree.
            start = int.from_bytes(key[1][:8], "big") ^ held_no
            ids = K.mix(np.array([start & (2**64 - 1)], K.U64) + K.mix(np.array([f[2] for f in region.found], K.U64))) >> K.U64(8)
            unit = (np.repeat(ids, [len(f[0]) for f in region.found]) | K.U64(key[0] << 56)).view(np.int64)
            a, b = node[i], node[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(unit)], ["a", "b", "unit"])

        held_no = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, root = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            node, n = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            rest = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(len(tree), -1)
            sketch = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(tree), -1)
            cuts = [0, *(i for i in range(1, len(root)) if root[i] != root[i - 1] or tree[i] != tree[i - 1]), len(root)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                new = (int(tree[lo]), root[lo])
                if new != key or held > HELD:
                    if parts and (out := flush()):
                        yield out
                    held_no = held_no + 1 if new == key else 0
                    # The leader of a region that is cut goes on to its next part.
                    parts = [leader] if new == key else []
                    key, held = new, 0
                parts.append((node[lo:hi], n[lo:hi], rest[lo:hi], sketch[lo:hi]))
                held += hi - lo
        if parts and (out := flush()):
            yield out

    return run


def _verifier(percent: int):
    """What turns rows (unit, node, text, others) sorted by unit into verified links (a, b): a spanning set of each unit's links."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate([x, y])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= percent * (len(both) - shared) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts, pairs = None, {}, []

        def flush() -> pa.RecordBatch:
            own = [(x, t) for x, ts in texts.items() for t in ts]
            sets: dict[int, list[np.ndarray]] = {x: [] for x in texts}
            for (x, _), found in zip(own, K.sets_of([t for _, t in own]), strict=True):
                sets[x].append(found)
            up = {x: x for x in texts}

            def top(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            out = []
            for a, b in pairs:
                if top(a) != top(b) and any(linked(x, y) for x in sets[a] for y in sets[b]):
                    up[top(a)] = top(b)
                    out.append((a, b))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

        for batch in batches:
            for unit, node, text, others in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if unit != key:
                    if pairs:
                        yield flush()
                    key, texts, pairs = unit, {}, []
                texts.setdefault(node, []).append(text or b"")
                pairs += [(node, o) for o in others]
        if pairs:
            yield flush()

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs`` (a, b, unit), on the full sets of ``texts`` (node, text)."""
    sent = (
        pairs.select("unit", F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("unit", F.col("b").alias("node"), F.lit(None).cast("long").alias("other")))
        .groupBy("unit", "node").agg(F.collect_list("other").alias("others"))
    )  # fmt: skip  # a unit has UNIT nodes at most
    return texts.hint("merge").join(sent, "node").select("unit", "node", "text", "others").repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(_verifier(percent), "a long, b long")


def _proposed(regions: DataFrame, least: float) -> DataFrame:
    return regions.repartition("tree", "root").sortWithinPartitions("tree", "root", "rest", "node").mapInArrow(_proposer(least), "a long, b long, unit long")


def _once(proposed: DataFrame) -> DataFrame:
    return proposed.filter("a <> b").groupBy("a", "b").agg(F.min("unit").alias("unit"))


class _Left:
    """Nodes outside the largest component of a region; ``meet`` links them with the others that pass by."""

    def __init__(self, tree: int, node: list[int], component: list[int], roots: list[np.ndarray], sets: list[np.ndarray], percent: int) -> None:
        self.tree, self.percent = tree, percent
        self.node, self.component, self.roots = np.array(node), np.array(component), np.array(roots)
        self.now: dict[int, int] = {}
        self.n = np.array([len(x) for x in sets])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.values), np.int64)
        self.rank[np.lexsort((self.values, counts))] = np.arange(len(self.values))
        self.ranks = self.rank[inverse]
        parts = [np.sort(self.ranks[a:b])[: self.rare(b - a)] for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        token, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        order = np.argsort(token, kind="stable")
        self.owner, self.first = owner[order], np.searchsorted(token[order], np.arange(len(self.values) + 1))

    def rare(self, n: int) -> int:
        """Of two sets at the threshold, so many of the rarest of either hold one of the other's."""
        return int(n) - -(-self.percent * int(n) // 100) + 1

    def meet(self, node: int, component: int, roots: np.ndarray, own: np.ndarray, below: bool) -> list[int]:
        """Nodes of other components that ``own`` is linked with; with ``below``, of smaller ids only."""
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        known = np.sort(self.rank[at[self.values[at] == own]])
        rare = known[: max(0, self.rare(len(own)) - (len(own) - len(known)))]
        met = [self.owner[self.first[t] : self.first[t + 1]] for t in rare]
        if not met:
            return []
        while component in self.now:
            component = self.now[component]
        c = np.unique(np.concatenate(met))
        c = c[(self.component[c] != component) & (100 * np.minimum(self.n[c], len(own)) >= self.percent * np.maximum(self.n[c], len(own)))]
        if below:
            c = c[self.node[c] < node]
        c = c[~(self.roots[c, : self.tree] == roots[: self.tree]).any(axis=1)]
        if not len(c):
            return []
        mark = np.zeros(len(self.values), bool)
        mark[known] = True
        size = self.n[c]
        start = np.cumsum(size) - size
        every = np.repeat(self.at[c] - start, size) + np.arange(size.sum())
        shared = np.add.reduceat(mark[self.ranks[every]].astype(np.int64), start)
        out = []
        for i in c[100 * shared >= self.percent * (size + len(own) - shared)]:
            if self.component[i] != component:
                out.append(int(self.node[i]))
                self.now[int(self.component[i])] = component
                self.component[self.component == self.component[i]] = component
        return out


def _searcher(percent: int):
    """What turns rows (tree, root, part, slice, other, below, node, component, roots, text), the held nodes of each key first, into links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, left = None, [], None
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "root", "part", "slice")), strict=True))
            other, below, node, component = (batch.column(c).to_pylist() for c in ("other", "below", "node", "component"))
            roots = np.array(batch.column("roots").to_pylist(), np.int64).reshape(len(keys), -1)
            a, b = [], []
            for lo, hi in K.groups(offsets):
                hashes, at = K.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i in range(lo, hi):
                    own = hashes[at[i - lo] : at[i - lo + 1]]
                    if keys[i] != key:
                        key, held, left = keys[i], [], None
                    if not len(own):
                        continue
                    if not other[i]:
                        held.append((node[i], component[i], roots[i], own.copy()))
                        continue
                    if left is None and held:
                        left = _Left(key[0], *map(list, zip(*held, strict=True)), percent)
                    for x in left.meet(node[i], component[i], roots[i], own, below[i]) if left else ():
                        a.append(min(x, node[i]))
                        b.append(max(x, node[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _rest(scratch: Scratch, nodes: DataFrame, dense: DataFrame, known: DataFrame, texts: DataFrame, values, percent: int) -> DataFrame | None:
    """Links between different components of regions with more than LEAF nodes, or None where no region has several."""
    roots = F.array(*[F.xxhash64(values(F.lit(t), 0, ROOT)) for t in range(TREES)]).alias("roots")
    inside = nodes.join(dense, "node", "left_semi").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "trees", roots)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = scratch.keep(inside.select(tree, "*").select("tree", values(F.col("tree"), 0, ROOT).alias("root"), "node", "component", "roots"), "inside")
    sizes = rows.groupBy("tree", "root", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("tree", "root").agg(F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts"))
    open_ = scratch.keep(sizes.filter((F.col("size") > LEAF) & (F.col("parts") > 1)).select("tree", "root", "main", F.ceil((F.col("size") - F.col("most")) / LEFT).cast("int").alias("n_part"), F.ceil(F.col("size") / RIGHT).cast("int").alias("n_slice")), "open")
    if open_.isEmpty():
        return None
    rows = rows.join(open_, ["tree", "root"]).withColumn("outside", F.col("component") != F.col("main"))
    mine = F.pmod(F.xxhash64("node"), F.col("n_part")).cast("int")
    at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_slice")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = rows.filter("outside").select("tree", "root", mine.alias("part"), every(F.col("n_slice")).alias("slice"), F.lit(False).alias("other"), F.lit(False).alias("below"), "node", "component", "roots")
    # Two nodes outside meet once: the one of the later part passes by, or of one part the one with the larger id.
    last = F.when(F.col("outside"), mine).otherwise(F.col("n_part") - 1)
    passing = rows.withColumn("mine", mine).withColumn("slice", at).select("tree", "root", every(last + 1).alias("part"), "slice", F.lit(True).alias("other"), "outside", "mine", "node", "component", "roots")
    passing = passing.select("tree", "root", "part", "slice", "other", (F.col("outside") & (F.col("mine") == F.col("part"))).alias("below"), "node", "component", "roots")
    sent = texts.hint("merge").join(held.union(passing), "node").select("tree", "root", "part", "slice", "other", "below", "node", "component", "roots", "text")
    dealt = sent.repartition("tree", "root", "part", "slice").sortWithinPartitions("tree", "root", "part", "slice", "other", "node")
    return scratch.keep(dealt.mapInArrow(_searcher(percent), "a long, b long").distinct(), "rest")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Words are runs of other than blank characters, with A-Z lower-cased; a set holds the
    distinct five-word shingles, or the whole sequence of fewer words. Returns per row of
    ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept
    (doc_id = component_id). A text that is null, empty or without words has an empty set
    and is linked with nothing. Rows that repeat a doc_id are judged each by its own text; if
    their sets are alike or linked, they share a component. A null doc_id comes last in the
    order of ids, and is kept only where no other id is in reach. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    signed = scratch.keep(rows.mapInArrow(_sign, _SIGNED), "signed")
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min_by("th", "doc_id").alias("th"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"), F.max("trees").alias("trees"))
    # Nodes have numbers of their own: a doc_id may stand in several classes. They are written with them, so they stay the same.
    nodes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def values(tree: Column, lo: int, hi: int) -> Column:
        return F.substring(F.col("trees"), tree * (4 * DEPTH) + 4 * lo + 1, F.lit(4 * (hi - lo)))

    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    regions = nodes.select(tree, "*").select("tree", values(F.col("tree"), 0, ROOT).alias("root"), values(F.col("tree"), ROOT, DEPTH).alias("rest"), "node", F.col("n_shingles").cast("int"), "sketch")
    proposed = scratch.keep(_proposed(regions, percent / 100), "proposed")
    # Texts of the nodes that any pair needs are sorted out once, and by a shuffle at any size.
    asked = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = nodes.select("node", F.col("least").alias("doc_id"), "th").join(asked, "node", "left_semi")
    texts = scratch.keep(rows.hint("merge").join(asked, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("node", "text"), "texts")
    scratch.release()
    links = scratch.keep(_verified(_once(proposed), texts, percent), "links")
    known = connected_components(links, scratch, "first")
    dense = proposed.filter("a = b").select(F.col("a").alias("node")).distinct()
    if not dense.isEmpty():
        rest = _rest(scratch, nodes, dense, known, texts, values, percent)
        if rest is not None and not rest.isEmpty():
            known = connected_components(links.union(rest), scratch, "second")
    for done in (proposed, texts):
        scratch.drop(done)
    # The smallest doc_id of every component of more than one node.
    members = scratch.keep(known.union(known.select("component", "component")).distinct().join(nodes.select("node", "least"), "node"), "members")
    smallest = scratch.keep(members.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = members.join(smallest, "component").select("node", "component_id")
    of_class = nodes.select("s1", "s2", "node", "least").join(named, "node", "left").select("s1", "s2", F.coalesce("component_id", "least").alias("component"))
    out = signed.join(of_class, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS key, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT key, array_to_string(w[p + 1 : p + 5], ' ') AS shingle FROM d, unnest(range(0, greatest(len(w) - 4, 1))) AS x(p) WHERE len(w) > 0
), n AS (SELECT key, count(*) AS n FROM s GROUP BY key),
pairs AS (SELECT a.key AS a, b.key AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.key < b.key GROUP BY ALL),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.key = p.a JOIN n y ON y.key = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
hops AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(key, other) AS (SELECT key, key FROM d UNION SELECT r.key, h.b FROM reach r JOIN hops h ON r.other = h.a),
c AS (SELECT r.key, min(o.doc_id) AS component_id FROM reach r JOIN d o ON o.key = r.other GROUP BY r.key)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (key) LEFT JOIN n USING (key)
"""
