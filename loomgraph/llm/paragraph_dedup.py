"""Substring dedup: repeated paragraphs by MinHash banding.

Prose without reliable line ends has no paragraphs to compare, so they are cut by
content: of every ``WINDOW`` consecutive words the one with the least hash starts a
paragraph of ``WORDS`` words. A passage of ``WINDOW + WORDS`` words or more that stands
in two texts holds a paragraph that is cut alike in both, wherever it stands.

Beside these pieces, lines, paragraphs between blank lines and whole short texts of
``LEAST`` words or more are units of their own.

1. Paragraphs of equal words are one wording, known by a hash of the words; of each
   wording the first and the last place are kept.
2. Each wording has bands of one MinHash value over its five-word shingles, as many as the
   wanted recall at similarity 0.8 asks for (``bands_for``): two bands for pieces, of which
   a passage of 60 words holds three or four, and four for units.
3. Wordings that share a band and have two places apart are verified by exact Jaccard
   similarity, once a bucket, on the bytes of one place each.
4. Components of the verified links keep their earliest paragraph.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import kernels as K
from loomgraph.llm.components import connected_components
from loomgraph.llm.store import Scratch

WORDS, WINDOW = 25, 26
#: A unit that is alike at 0.8 to one of WORDS words has LEAST or more.
LEAST = 20
SIMILARITY, PIECE_RECALL, UNIT_RECALL = 0.8, 0.95, 0.995


def bands_for(similarity: float, recall: float) -> int:
    """Bands of one MinHash value of which two sets at ``similarity`` share one with probability ``recall`` or more."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity) - 1e-9))


BANDS, UNIT_BANDS = bands_for(SIMILARITY, PIECE_RECALL), bands_for(SIMILARITY, UNIT_RECALL)
#: A bucket of so many wordings is compared pair by pair, a larger one by its rarest shingles.
FEW = 8
_LOW = (1 << 24) - 1
_NAMES = [f"m{k}" for k in range(max(BANDS, UNIT_BANDS))]


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Text number, first byte, bytes, hash of the words and MinHash values of every paragraph."""
    low = K.ASCII_LOWER[data]
    starts, ends, first = K.word_ranges(low, offsets)
    n = len(starts) - WINDOW + 1
    if n < 1:
        return {}
    words = K.range_hashes(K.prefix_hashes(low), starts, ends)
    least = (K.mix(words ^ K.U64(K.BASE)) & ~K.U64(_LOW)) | (K.U64(_LOW) - np.arange(len(words), dtype=K.U64))
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOW:
        least = np.minimum(least[: -(WINDOW - span)], least[WINDOW - span :])
    text = np.searchsorted(first, np.arange(n), "right") - 1
    inside = np.arange(n) + WINDOW <= first[text + 1]
    cut = np.unique(_LOW - (least[inside] & K.U64(_LOW)).astype(np.int64))
    text = np.searchsorted(first, cut, "right") - 1
    fits = cut + WORDS <= first[text + 1]
    cut, text = cut[fits], text[fits]
    if not len(cut):
        return {}
    factors = K.random_words(WORDS, 53) | K.U64(1)
    own = words[cut[:, None] + np.arange(WORDS)]
    shingles = np.zeros((len(cut), WORDS - K.SHINGLE + 1), K.U64)
    for j in range(K.SHINGLE):
        shingles += own[:, j : j + shingles.shape[1]] * factors[j]
    shingles = K.mix(shingles)
    turns = K.random_words(BANDS, 59) | K.U64(1)
    out = {"text": text, "start": starts[cut] - offsets[text], "size": ends[cut + WORDS - 1] - starts[cut], "wh": K.mix((own * factors).sum(axis=1, dtype=K.U64)).view(np.int64)}
    return out | {f"m{b}": K.mix((shingles * turns[b]).min(axis=1) + K.U64(b)).view(np.int64) for b in range(BANDS)}


def units(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The same of every line, paragraph between blank lines and whole text too short to be sure of a piece."""
    low = K.ASCII_LOWER[data]
    starts, ends, first = K.word_ranges(low, offsets)
    if not len(starts):
        return {}
    line = np.searchsorted(np.flatnonzero(low == 10), starts)
    text = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    gap, other = np.diff(line), np.diff(text) > 0
    at = [np.concatenate([[0], np.flatnonzero(other | (gap >= n)) + 1, [len(starts)]]) for n in (1, 2)]
    short = np.flatnonzero(np.diff(first) < WINDOW + WORDS)
    ranges = np.concatenate([np.stack([x[:-1], x[1:]], 1) for x in at] + [np.stack([first[short], first[short + 1]], 1)])
    ranges = np.unique(ranges[ranges[:, 1] - ranges[:, 0] >= LEAST], axis=0)
    if not len(ranges):
        return {}
    a, b = ranges[:, 0], ranges[:, 1]
    words = K.range_hashes(K.prefix_hashes(low), starts, ends)
    prefix = np.concatenate([np.zeros(1, K.U64), np.cumsum(words * K.powers(K.BASE, len(words)))])
    factors = K.random_words(WORDS, 53) | K.U64(1)
    n = len(words) - K.SHINGLE + 1
    shingles = np.zeros(n, K.U64)
    for j in range(K.SHINGLE):
        shingles += words[j : j + n] * factors[j]
    shingles = np.append(K.mix(shingles), K.U64(0))
    cuts = np.stack([a, b - K.SHINGLE + 1], 1).ravel()
    turns = K.random_words(UNIT_BANDS, 59) | K.U64(1)
    out = {"text": text[a], "start": starts[a] - offsets[text[a]], "size": ends[b - 1] - starts[a], "wh": K.mix(K.range_hashes(prefix, a, b) + (b - a).astype(K.U64)).view(np.int64)}
    return out | {f"m{k}": K.mix(np.minimum.reduceat(shingles * turns[k], cuts)[::2] + K.U64(k)).view(np.int64) for k in range(UNIT_BANDS)}


def _cutter(bands: bool):
    """Texts, the last column, to their paragraphs: the columns before, start, size, wh and, if asked for, the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in K.groups(offsets):
                own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                for found in (paragraphs(*own), units(*own)):
                    if found:
                        text = pa.array(found["text"] + lo)
                        columns = {batch.schema.names[i]: batch.column(i).take(text) for i in range(batch.num_columns - 1)}
                        columns |= {"start": pa.array(found["start"].astype(np.int32)), "size": pa.array(found["size"].astype(np.int32)), "wh": pa.array(found["wh"])}
                        if bands:
                            columns |= {m: pa.array(found[m]) if m in found else pa.nulls(len(text), pa.int64()) for m in _NAMES}
                        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def similar_pairs(sets: list[np.ndarray], least: float, apart: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that join the sets into their components at a Jaccard similarity of ``least``; with ``apart``, of pairs that it accepts.

    Of two sets that are alike each holds one of the other's rarest hashes, as many as the
    bound lets them differ in and one more. Rarity is within the bucket, so what all of its
    sets share, like a common line in different surroundings, brings none of them together.
    """
    up = list(range(len(sets)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate([x, y])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return shared >= least * (len(both) - shared) - 1e-9

    if len(sets) <= FEW:
        near = [range(i) for i in range(len(sets))]
    else:
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, counts))] = np.arange(len(values))
        near, index, at = [], {}, 0
        for i, own in enumerate(sets):
            rare = np.sort(rank[inverse[at : at + len(own)]])[: len(own) - math.ceil(least * len(own) - 1e-9) + 1].tolist()
            at += len(own)
            near.append(sorted({j for t in rare for j in index.get(t, ())}))
            for t in rare:
                index.setdefault(t, []).append(i)
    out = []
    for i, others in enumerate(near):
        for j in others:
            if top(j) != top(i) and (apart is None or apart(i, j)) and alike(sets[i], sets[j]):
                up[top(i)] = top(j)
                out.append((j, i))
    return out


def _verifier(least: float):
    """What turns rows (key, wh, bytes, d, start, size, last_d, last_start) sorted by key into links (a, b) of wordings that are alike and have two places apart."""

    def links(rows: list[tuple], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        def apart(i: int, j: int) -> bool:
            """Unless all places of both stand in one text and overlap."""
            _, d, start, size, last_d, last = rows[i]
            _, e, other, extent, last_e, far = rows[j]
            return not d == last_d == e == last_e or start + size <= far or other + extent <= last

        return [(min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in similar_pairs(sets, least, apart)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        held: list[tuple] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("bytes"))
            keys = batch.column("key").to_pylist()
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("wh", "d", "start", "size", "last_d", "last_start")), strict=True))
            out: list[tuple[int, int]] = []
            for lo, hi in K.groups(offsets):
                hashes, at = K.shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i in range(lo, hi):
                    if keys[i] != key:
                        out += links(held, sets)
                        key, held, sets = keys[i], [], []
                    held.append(rows[i])
                    sets.append(hashes[at[i - lo] : at[i - lo + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = links(held, sets)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def repeated_paragraphs(docs: DataFrame, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs that repeat an earlier one, in this or another document.

    Words are runs of other than blank characters with A-Z lower-cased. A paragraph is 25 of
    them, cut by content, in a text of 26 or more, or a line, a run of lines between blank
    ones or a whole text of up to 50 words, of 20 words or more; so rows of one text may
    overlap. Paragraphs are linked if their words are equal, or if their sets of five-word
    shingles have a Jaccard similarity of ``least`` or more and two of their places don't
    overlap, in one text or two. Of each component of linked paragraphs the earliest, by
    doc_id and place, stays, with those that overlap it. Returns a row for each other one:
    doc_id, start and size (UTF-8 bytes), component (an id of the component) and kept_in,
    the doc_id of the one that stays. Null and empty texts and texts of fewer than 20 words
    have no paragraphs. A null doc_id comes last. Rows that repeat a doc_id and its text are
    one document; with other texts they come in the order of their hashes. Other columns
    aren't looked at.
    """
    scratch = Scratch(docs.sparkSession, "paragraph-dedup")
    no_id = (1 << 63) - 1
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(no_id)).alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text")).filter("text IS NOT NULL")
    of_text = rows.select(F.xxhash64("doc_id", "th").alias("d"), "text")
    cut = of_text.mapInArrow(_cutter(True), "d long, start int, size int, wh long, " + ", ".join(f"{m} long" for m in _NAMES))
    place = F.struct("d", "start", "size")
    worded = cut.groupBy("wh").agg(F.min(place).alias("at"), F.max(place).alias("last"), *[F.max(m).alias(m) for m in _NAMES])
    again = F.col("at") != F.col("last")
    wordings = scratch.keep(worded.select("wh", "at.*", F.when(again, F.col("last.d")).alias("last_d"), F.when(again, F.col("last.start")).alias("last_start"), *_NAMES), "wordings")
    scratch.release()
    equal = scratch.keep(wordings.filter("last_start IS NOT NULL").select("wh"), "equal")
    met = _met(scratch, wordings)
    asked = scratch.keep(wordings.drop(*_NAMES).join(met, "wh"), "asked")
    for done in (wordings, met):
        scratch.drop(done)
    scratch.release()
    # A text is sent once for all its paragraphs; rows that repeat it bring the same ones.
    wanted = asked.groupBy("d").agg(F.collect_list(F.struct("wh", "start", "size", F.coalesce("last_d", "d").alias("last_d"), F.coalesce("last_start", "start").alias("last_start"), *_NAMES)).alias("wanted"))
    sent = of_text.hint("merge").join(wanted, "d").dropDuplicates(["d"]).select("d", F.expr("cast(text as binary)").alias("data"), F.explode("wanted").alias("w"))
    sent = scratch.keep(sent.select("d", "w.*", F.expr("substring(data, w.start + 1, w.size)").alias("bytes")), "sent")
    scratch.drop(asked)
    scratch.release()
    linked = []
    for m in _NAMES:  # one after the other, so that one shuffle of bytes is on disk at a time
        dealt = sent.filter(F.col(m).isNotNull()).select(F.col(m).alias("key"), "wh", "d", "start", "size", "last_d", "last_start", "bytes").repartition("key").sortWithinPartitions("key", "wh")
        linked.append(scratch.keep(dealt.mapInArrow(_verifier(least), "a long, b long").distinct(), f"links-{m}"))
        scratch.release()
    scratch.drop(sent)
    links = reduce(DataFrame.union, linked)
    known = connected_components(links, scratch).withColumnRenamed("node", "wh")
    ends = known.select("wh", "component").union(known.select(F.col("component").alias("wh"), "component")).distinct()
    nodes = scratch.keep(equal.join(ends, "wh", "full").select("wh", F.coalesce("component", "wh").alias("component")), "nodes")
    scratch.release()
    # Cutting once more takes less than holding all paragraphs till here.
    placed = rows.select("doc_id", "th", "text").mapInArrow(_cutter(False), "doc_id long, th long, start int, size int, wh long")
    found = scratch.keep(placed.join(nodes, "wh").drop("wh"), "repeats")
    scratch.drop(nodes)
    scratch.release()
    keeper = scratch.keep(found.groupBy("component").agg(F.min(F.struct("doc_id", "th", "start", "size")).alias("keep")), "keeper")
    scratch.release()
    # Two cuts may be a word or two apart; a paragraph that overlaps the one that stays is part of it.
    same_text = (F.col("doc_id") == F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th"))
    apart = F.col("start") >= F.col("keep.start") + F.col("keep.size")
    gone = found.join(keeper, "component").filter(~same_text | apart)
    real = lambda c: F.when(c != no_id, c)
    return gone.select(real(F.col("doc_id")).alias("doc_id"), "start", "size", "component", real(F.col("keep.doc_id")).alias("kept_in"))


def _met(scratch: Scratch, wordings: DataFrame) -> DataFrame:
    """Wordings with those of their bands that another one shares, if two places of the bucket are apart."""
    found = []
    for m in _NAMES:  # one after the other, as above
        each = wordings.filter(F.col(m).isNotNull()).select(F.col(m).alias("key"), "wh", "d", F.coalesce("last_d", "d").alias("last_d"), (F.col("start") + F.col("size")).alias("end"), F.coalesce("last_start", "start").alias("last_start"))
        of_key = each.groupBy("key").agg(F.min("wh").alias("u"), F.max("wh").alias("v"), F.min("d").alias("x"), F.max("last_d").alias("y"), F.min("end").alias("end"), F.max("last_start").alias("last"))
        shared = scratch.keep(of_key.filter("u <> v AND (x <> y OR end <= last)").select("key"), f"shared-{m}")
        scratch.release()
        met = each.select("key", "wh").join(shared, "key").select("wh", *[F.col("key").alias(o) if o == m else F.lit(None).cast("long").alias(o) for o in _NAMES])
        found.append(scratch.keep(met, f"met-{m}"))
        scratch.drop(shared)
        scratch.release()
    every = scratch.keep(reduce(DataFrame.union, found).groupBy("wh").agg(*[F.max(m).alias(m) for m in _NAMES]), "met")
    for done in found:
        scratch.drop(done)
    scratch.release()
    return every


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents: one that repeats paragraphs, and the one where their first copy stays."""
    found = repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.groupBy("doc_id", "kept_in").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum("size").alias("n_bytes"), F.min("start").alias("first_start"), F.max(F.col("start") + F.col("size")).alias("last_end"))
