"""Quality classifier: kernel ridge regression on document statistics.

Random Fourier features stand for a Gaussian kernel over standardized statistics of
a text's bytes, words and lines. Ridge scores solve normal equations that are summed
by partition, apart for each of ``FOLDS`` folds of the labelled rows. The sums alone
give the held-out error of each penalty. Scores of every fold by the model of the
others are then calibrated by isotonic regression over a fixed grid of scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import kernels as K
from loomgraph.llm.store import Scratch

WAVES, FOLDS, GRID = 256, 4, 2000
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0)
#: Standardized statistics end here.
MOST = 4.0

#: Bytes by class: lower, upper, digit, space, line end, stop, comma and the like, brackets and quotes, bar, other symbols, lead and trail bytes of other characters.
_CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "comma", "quote", "bar", "symbol", "lead", "trail"]


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), np.int64)
    for name, own in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t"), ("line", b"\n\r\x0b\x0c"), ("stop", b".?"), ("comma", b",;:-"), ("quote", b"()[]{}'\""), ("bar", b"|"), ("lead", range(192, 256)), ("trail", range(128, 192))):
        table[list(own)] = _CLASSES.index(name)
    return table


_CLASS = _class_table()
_LINE_END = K.byte_class("\n")
STATISTICS = [
    "log_bytes", "upper", "digit", "space", "line", "stop", "comma", "quote", "bar", "symbol", "foreign",
    "word_length", "word_spread", "longest_word", "distinct_words", "top_word", "repeated_next", "shouted_words", "symbol_words",
    "log_lines", "line_words", "distinct_lines", "distinct_shingles", "class_entropy",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; zeros for an empty one."""
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = _CLASS[data]
    count = np.bincount(doc * len(_CLASSES) + kinds, minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    of = dict(zip(_CLASSES, count.T, strict=True))
    chars = np.maximum(1, count.sum(axis=1) - of["trail"])
    starts, ends, first = K.word_ranges(data, offsets)
    prefix = K.prefix_hashes(data)
    hashes, length, words = K.range_hashes(prefix, starts, ends), (ends - starts).astype(float), np.diff(first)
    owner = np.repeat(np.arange(n), words)
    many = np.maximum(1, words)
    letters = np.concatenate([[0], np.cumsum(kinds == _CLASSES.index("lower"))])
    raised = np.concatenate([[0], np.cumsum(kinds == _CLASSES.index("upper"))])
    shouted = (raised[ends] - raised[starts] >= 2) & (letters[ends] == letters[starts])
    marked = kinds[ends - 1] == _CLASSES.index("symbol") if len(ends) else np.zeros(0, bool)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    sums = lambda x: np.bincount(owner, weights=x, minlength=n)
    mean = sums(length) / many
    shingles, at = K.shingle_hashes(hashes, first)
    line_start, line_end, line_first = K.word_ranges(data, offsets, _LINE_END)
    lines = K.range_hashes(prefix, line_start, line_end)
    distinct, top, lone, plain = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        if words[i]:
            own = np.sort(hashes[first[i] : first[i + 1]])
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[i], top[i] = len(cuts) - 1, np.diff(cuts).max()
            own = np.sort(shingles[at[i] : at[i + 1]])
            lone[i] = 1 + (own[1:] != own[:-1]).sum()
            plain[i] = len(np.unique(lines[line_first[i] : line_first[i + 1]]))
    line_n = np.maximum(1, np.diff(line_first))
    share = count / np.maximum(1, size)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    out = np.stack([
        np.log1p(size), *(of[c] / chars for c in ("upper", "digit", "space", "line", "stop", "comma", "quote", "bar", "symbol", "lead")),
        mean, np.sqrt(np.maximum(0, sums(length**2) / many - mean**2)), np.log1p(longest), distinct / many**0.9, top / many, sums(again) / many, sums(shouted) / many, sums(marked) / many,
        np.log1p(np.diff(line_first)), np.log1p(words / line_n), plain / line_n, lone / np.maximum(1, np.diff(at)), entropy,
    ], axis=1)
    out[words == 0] = 0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(1))
        for lo, hi in K.groups(offsets):
            found = statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            values = pa.FixedSizeListArray.from_arrays(pa.array(found.astype(np.float32).ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), values], ["doc_id", "stats"])


class Model(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # a column for each fold left out, then one for all rows
    knots: np.ndarray
    heights: np.ndarray

    def waves(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.center) / self.scale, -MOST, MOST)
        random = np.random.default_rng(20)
        turn = random.normal(size=(z.shape[1], WAVES)) / math.sqrt(z.shape[1])
        shift = random.uniform(0, 2 * math.pi, WAVES)
        return np.concatenate([math.sqrt(2 / WAVES) * np.cos(z @ turn + shift), np.ones((len(z), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.waves(stats) @ self.weights[:, -1], self.knots, self.heights), 0, 1)


_SUMS = "fold int, part int, sums binary"


def _stats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(STATISTICS))


def _summer(model: Model):
    """One row for each fold of a partition: X'X, X'y and y'y of its rows, and the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = _stats(batch, "stats"), batch.column("label").to_numpy().astype(float), batch.column("fold").to_numpy()
            x = np.concatenate([model.waves(x), y[:, None]], axis=1)
            for k in np.unique(fold):
                own = x[fold == k]
                sums[int(k)] = sums.get(int(k), 0) + own.T @ own
        if sums:
            yield _sum_rows(sums, TaskContext.get().partitionId())

    return run


def _sum_rows(sums: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["fold", "part", "sums"])


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's rows of ``_summer`` added up, one for each fold."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for fold, own in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            sums[fold] = sums.get(fold, 0) + np.frombuffer(own.as_buffer())
    if sums:
        yield _sum_rows(sums, TaskContext.get().partitionId())


def _added(parts: DataFrame, n: int) -> DataFrame:
    """A row for each fold: those of ``n`` partitions are added in groups of about the root of n, then the groups' sums by fold."""
    groups = max(1, math.isqrt(n))
    some = parts.repartition(FOLDS * groups, "fold", F.pmod("part", F.lit(groups))).mapInArrow(_adder, _SUMS)
    return some.repartition(FOLDS, "fold").mapInArrow(_adder, _SUMS)


def _grid_scores(model: Model):
    """Grid cell of each labelled row's score by the model without its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = model.waves(_stats(batch, "stats")) @ model.weights
            own = every[np.arange(len(every)), batch.column("fold").to_numpy()]
            cell = np.round(np.clip(own, -0.5, 1.5) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("label").cast(pa.float64())], ["cell", "label"])

    return run


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators. Knots at the blocks' mean x, so that scores between blocks still differ.

    A block's height is drawn towards the mean of all by one row's weight, so none is surely 0 or 1.
    """
    base = total.sum() / weight.sum()
    blocks: list[list[float]] = []
    for at, s, w in zip(x, total, weight, strict=True):
        blocks.append([at * w, s, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate([(b[1] + base) / (b[2] + 1) for b in blocks])


def _fit(labelled: DataFrame, scratch: Scratch) -> Model:
    """labelled: stats, label and fold; every row of it counts. What reaches the driver has a fixed size."""
    none = Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros((WAVES + 1, FOLDS + 1)), np.zeros(0), np.zeros(0))
    column = [F.col("stats")[i].cast("double") for i in range(len(STATISTICS))]
    moments = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(column)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(column)]).first()
    if not moments["n"]:
        return none
    scale = np.array([moments[f"s{i}"] for i in range(len(STATISTICS))])
    model = none._replace(center=np.array([moments[f"m{i}"] for i in range(len(STATISTICS))]), scale=np.where(scale > 1e-9, scale, 1))
    size = WAVES + 2
    parts = [np.zeros((size, size)) for _ in range(FOLDS)]
    summed = scratch.keep(labelled.mapInArrow(_summer(model), _SUMS), "sums")
    last = summed.agg(F.max("part")).first()[0]  # one row
    for row in _added(summed, 1 + last).collect():  # FOLDS rows of fixed size
        parts[row["fold"]] += np.frombuffer(row["sums"]).reshape(size, size)
    scratch.drop(summed)
    whole = sum(parts)

    def solve(sums: np.ndarray, penalty: float) -> np.ndarray:
        ridge = np.diag([penalty] * WAVES + [1e-9])
        return np.linalg.solve(sums[:-1, :-1] + ridge, sums[:-1, -1])

    def error(sums: np.ndarray, w: np.ndarray) -> float:
        return float(sums[-1, -1] - 2 * w @ sums[:-1, -1] + w @ sums[:-1, :-1] @ w)

    used = [k for k in range(FOLDS) if parts[k][-2, -2] > 0]
    best = min(PENALTIES, key=lambda p: sum(error(parts[k], solve(whole - parts[k], p)) for k in used)) if len(used) > 1 else 1.0
    without = [solve(whole - parts[k], best) if len(used) > 1 else solve(whole, best) for k in range(FOLDS)]
    model = model._replace(weights=np.stack([*without, solve(whole, best)], axis=1))
    cells = labelled.mapInArrow(_grid_scores(model), "cell int, label double").groupBy("cell").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # 2 * GRID + 1 at most
    knots, heights = isotonic(np.array([r["cell"] / GRID for r in cells]), np.array([r["s"] for r in cells]), np.array([float(r["n"]) for r in cells]))
    return model._replace(knots=knots, heights=heights)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stats(batch, "stats")))], ["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document stay unseen: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """Probability that a document's label is 1, learnt from ``labels`` (doc_id and the label, 0 or 1).

    Returns per row of ``docs``: doc_id, held_out, score and predicted (score >= threshold).
    Only labels of documents that aren't held out are learnt from, and only the text is an
    input of the score. All labelled rows are used: each row of labels that is neither null
    nor other than 0 and 1 counts once for each row of its document. Null and empty texts
    have statistics of zero and are scored like any other. Without any label to learn from
    every score is 0.5. Repeated rows get the same score; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.keep(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_measure, "doc_id long, stats array<float>"), "statistics")
    known = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("double").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("doc_id")))
    fold = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) - 1).cast("int")
    labelled = scratch.keep(measured.join(known, "doc_id").select("stats", "label", fold.alias("fold")), "labelled")
    model = _fit(labelled, scratch)
    scratch.drop(labelled)
    scored = measured.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, labels)
