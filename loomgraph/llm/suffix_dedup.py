"""Substring dedup: every byte that a repeated string of ``length`` bytes covers.

A suffix array of the whole corpus is not needed to find strings of a given length.
Every window of ``length`` bytes picks the least hash among its k-byte strings as its
anchor, so equal windows pick equal anchors at equal offsets, and suffixes that share
``length`` bytes meet in one bucket. Runs of windows with one anchor make a record:

1. Records of one bucket with equal regions (the bytes of all their windows) are copies.
2. Other records of a shared bucket are sorted by their suffix from the anchor on, in a
   mergesort whose comparisons find the common extension of two suffixes by binary search
   over prefix polynomial hashes, then look at one byte. Neighbours' extensions give the
   common extension of any two; they are held against the bytes themselves, and on a
   collision of hashes the bucket is sorted by bytes. Windows at one offset that share
   enough to the right and hash alike to the left are equal.
3. Buckets with more than ``HOT`` such records compare window hashes instead, summed
   before they are sent, so that no task gets a whole bucket.

Texts that are copies of one another as a whole are known by their hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import kernels as K
from loomgraph.llm.store import Scratch

HOT, HELD = 20_000, 20_000
#: Texts longer than this are cut into overlapping pieces; positions in a piece take 24 bits.
PIECE = 1 << 22
#: Texts of which a task remembers that it has had them; a copy makes no records again.
REMEMBERED = 1 << 19
_LOW = (1 << 24) - 1


def anchor_bytes(length: int) -> int:
    return max(1, length // 4 - 2)


def records_of(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Records of the texts: text number, bucket, region hash, first window, number of windows, and anchor's distance from the first window."""
    k = anchor_bytes(length)
    w, n = length - k + 1, len(data) - length + 1
    if n < 1:
        return {}
    prefix = K.prefix_hashes(data)
    grams = K.mix((prefix[k:] - prefix[:-k]) * K.powers(K.INVERSE, len(prefix))[: len(data) - k + 1])
    least = (grams & ~K.U64(_LOW)) | (K.U64(_LOW) - np.arange(len(grams), dtype=K.U64))  # of equal hashes the last
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: -(w - span)], least[w - span :])
    anchor = _LOW - (least & K.U64(_LOW)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        if hi - lo >= length:
            inside[lo] += 1
            inside[hi - length + 1] -= 1
    first = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(first):
        return {}
    at = anchor[first]
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(first)]]) - 1
    start, end = first[lo], first[hi] + length
    return {"text": np.searchsorted(offsets, start, "right") - 1, "bucket": grams[at[lo]].view(np.int64), "region": K.range_hashes(prefix, start, end).view(np.int64), "start": start, "windows": end - start - length + 1, "anchor": at[lo] - start}


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, its bytes left out before, bytes, offsets): groups of texts, and long texts in pieces that share length - 1 bytes."""
    for lo, hi in K.groups(offsets):
        if offsets[hi] - offsets[lo] <= PIECE:
            yield lo, 0, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            continue
        for i in range(lo, hi):
            for skip in range(0, max(1, offsets[i + 1] - offsets[i] - length + 1), PIECE):
                own = data[offsets[i] + skip : min(offsets[i + 1], offsets[i] + skip + PIECE + length - 1)]
                yield i, skip, own, np.array([0, len(own)])


_RECORD = "doc_id long, th long, bucket long, region long, start int, windows int, anchor int"


def _recorder(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = []
            for i, key in enumerate(keys):
                if key not in seen:
                    new.append(i)
                    if len(seen) < REMEMBERED:
                        seen.add(key)
            batch = batch.take(pa.array(new, pa.int64()))
            ids, th = batch.column(0), batch.column(1)
            data, offsets = K.text_bytes(batch.column(3))
            for first, skip, own, at in _pieces(data, offsets, length):
                if r := records_of(own, at, length):
                    text = pa.array(r["text"] + first)
                    start = (r["start"] - at[r["text"]] + skip).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(text), th.take(text), pa.array(r["bucket"]), pa.array(r["region"]), pa.array(start), pa.array(r["windows"].astype(np.int32)), pa.array(r["anchor"].astype(np.int32))], ["doc_id", "th", "bucket", "region", "start", "windows", "anchor"])

    return run


class Suffixes:
    """Suffixes of byte strings: row i's begins at ``at[i]`` and has ``size[i]`` bytes. Rows of a group are adjacent."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> None:
        self.data, self.at, self.size, self.group = data, at, size, group
        self.prefix = K.prefix_hashes(data)
        self.inverse = K.powers(K.INVERSE, len(self.prefix))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension: binary search over equal hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.at[i], self.at[j]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.prefix[a + mid] - self.prefix[a]) * self.inverse[a] == (self.prefix[b + mid] - self.prefix[b]) * self.inverse[b]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; of two that are equal as far as they go the shorter, then the smaller number."""
        n = self.common(i, j)
        ended = n >= np.minimum(self.size[i], self.size[j])
        top = len(self.data) - 1
        x, y = self.data[np.minimum(self.at[i] + n, top)], self.data[np.minimum(self.at[j] + n, top)]
        return np.where(ended, (self.size[i] < self.size[j]) | ((self.size[i] == self.size[j]) & (i < j)), x < y)

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort within every group at once: each row's place among the other half is found by binary search."""
        n = len(self.at)
        order = np.arange(n)
        start = np.searchsorted(self.group, self.group)
        stop = np.searchsorted(self.group, self.group, "right")
        width, widest = 1, int((stop - start).max()) if n else 0
        while width < widest:
            place = np.arange(n) - start
            block = place // width
            low = start + (block ^ 1) * width
            lo, hi = np.minimum(low, stop), np.minimum(low + width, stop)
            first = lo.copy()
            while (active := lo < hi).any():
                q = np.flatnonzero(active)
                mid = (lo[q] + hi[q]) // 2
                less = self.before(order[mid], order[q])
                lo[q], hi[q] = np.where(less, mid + 1, lo[q]), np.where(less, hi[q], mid)
            to = start + (block // 2) * 2 * width + (place - block * width) + (lo - first)
            new = np.empty_like(order)
            new[to] = order
            order, width = new, 2 * width
        return order


def equal_windows(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Rows by offsets: whether the window that begins so many bytes before the anchor equals one of another row of its group at the same offset."""
    n, k = len(anchor), anchor_bytes(length)
    at = offsets[:-1] + anchor
    size = np.minimum(offsets[1:] - at, length)
    s = Suffixes(data, at, size, group)
    order = s.sort()
    here, there = order[1:], order[:-1]
    near = np.where(group[here] == group[there], s.common(there, here), 0)
    bytes_ = np.where(np.arange(length) < size[:, None], data[np.minimum(at[:, None] + np.arange(length), len(data) - 1)].astype(np.int16), -1)
    differs = (bytes_[here] != bytes_[there]) | (bytes_[here] < 0)
    true = np.where(group[here] == group[there], np.where(differs.any(axis=1), differs.argmax(axis=1), length), 0)
    if (true != near).any():  # hashes collided
        order = np.lexsort((*bytes_.T[::-1], group))
        here, there = order[1:], order[:-1]
        differs = (bytes_[here] != bytes_[there]) | (bytes_[here] < 0)
        near = np.where(group[here] == group[there], np.where(differs.any(axis=1), differs.argmax(axis=1), length), 0)
    out = np.zeros((n, length - k + 1), bool)
    shared = np.concatenate([[0], near])
    at, anchor, windows = at[order], anchor[order], windows[order]
    for back in range(out.shape[1]):
        run = np.cumsum(shared < length - back)
        own = np.flatnonzero((back <= anchor) & (back > anchor - windows))
        if len(own) < 2:
            continue
        begin = at[own] - back
        left = (s.prefix[at[own]] - s.prefix[begin]) * s.inverse[begin]
        key = K.mix(left ^ (run[own].astype(K.U64) * K.U64(K.BASE)))
        sort = np.argsort(key, kind="stable")
        same = key[sort][1:] == key[sort][:-1]
        hit = np.zeros(len(own), bool)
        hit[sort[1:][same]] = True
        hit[sort[:-1][same]] = True
        out[order[own[hit]], back] = True
    return out


def _span_batch(ids: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(th, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "th", "start", "end"])


def _sorter(length: int):
    """Rows of records with their bytes, sorted by bucket, to the spans of their windows that another row of the bucket equals."""

    def work(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        data, offsets = K.text_bytes(table.column("bytes"))
        ids, th, start, windows, anchor, bucket = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "th", "start", "windows", "anchor", "bucket"))
        hit = equal_windows(data, offsets, anchor, windows, np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])), length)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, near = np.nonzero(edge == 1)
        _, far = np.nonzero(edge == -1)
        zero = start[row] + anchor[row]
        return _span_batch(ids[row], th[row], zero - (far - 1), zero - near + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:  # all whole buckets so far
                table = pa.Table.from_batches(held).combine_chunks()
                bucket = table.column("bucket").to_numpy()
                cut = int(np.argmax(bucket == bucket[-1]))
                if cut:
                    yield work(table.slice(0, cut).to_batches())
                    held = table.slice(cut).to_batches()
        if held:
            yield work(held)

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("bytes"))
            prefix, windows = K.prefix_hashes(data), batch.column("windows").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(windows)), windows)
            step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = offsets[row] + step
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("th").take(own), pa.array((batch.column("start").to_numpy()[row] + step).astype(np.int32)), pa.array(K.range_hashes(prefix, begin, begin + length).view(np.int64))], ["doc_id", "th", "start", "hash"])

    return run


def _cutter(length: int):
    """Texts with their spans to merged spans and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, merged, sizes = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, copies, found in zip(texts, batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                spans: list[list[int]] = [[0, len(text)]] if copies > 1 and len(text) >= length else []
                if not spans:
                    for s in sorted(found or [], key=lambda s: s["start"]):
                        if spans and s["start"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], s["end"])
                        else:
                            spans.append([s["start"], s["end"]])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                merged.append([{"start": a, "end": b} for a, b in spans])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes; strings end where their text ends; the same text counts as
    elsewhere, overlaps count, and strings are judged on the input. Returns per row of
    ``docs``: doc_id, n_bytes, spans (merged, array<struct<start, end>>, end exclusive) and
    kept, the bytes that stay, which may cut a character in two. Null and empty texts have
    no bytes. Rows with equal texts are copies, whether their ids differ or not: of
    ``length`` bytes or more, they go as a whole. Other columns aren't looked at; an empty
    table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("th"), F.xxhash64(F.lit(1), docs[text]).alias("th2"))
    copies = scratch.keep(rows.groupBy("th", "th2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    numbered = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), "th", "th2", "text")
    records = scratch.keep(numbered.filter(F.octet_length("text") >= length).mapInArrow(_recorder(length), _RECORD), "records")
    place = F.xxhash64("th", "start").alias("place")
    # What is aggregated is written before it is joined, so that a bucket with very many records can be split.
    shared = scratch.keep(records.select("bucket", place).groupBy("bucket").agg(F.min("place").alias("x"), F.max("place").alias("y")).filter("x <> y").select("bucket"), "buckets")
    scratch.release()
    some = scratch.keep(records.join(shared, "bucket"), "shared")
    scratch.drop(records)
    scratch.drop(shared)
    scratch.release()
    regions = some.groupBy("bucket", "region").agg(F.min(F.struct("doc_id", "th", "start", "windows", "anchor")).alias("r"), F.min(F.xxhash64("th", "start")).alias("x"), F.max(F.xxhash64("th", "start")).alias("y"))
    regions = scratch.keep(regions.select("bucket", "region", "r.*", (F.col("x") != F.col("y")).alias("copied")), "regions")
    whole = some.join(regions.filter("copied").select("bucket", "region"), ["bucket", "region"], "left_semi").select("doc_id", "th", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("end"))
    mixed = scratch.keep(regions.groupBy("bucket").agg(F.min("region").alias("x"), F.max("region").alias("y"), F.count(F.lit(1)).alias("size")).filter("x <> y").select("bucket", "size"), "mixed")
    wanted = regions.join(mixed, "bucket").select("bucket", "size", "doc_id", "th", "start", "windows", "anchor")
    cut = F.expr(f"substring(cast(text as binary), start + 1, windows + {length - 1})").alias("bytes")
    texts = numbered.select("doc_id", "th", "text").hint("merge")
    # Repeated rows of a document bring the same bytes; one of each is needed.
    pieces = texts.join(wanted, ["doc_id", "th"]).select("bucket", "size", "doc_id", "th", "start", "windows", "anchor", cut)
    pieces = scratch.keep(pieces, "pieces")
    scratch.release()
    calm = pieces.filter(F.col("size") <= HOT).dropDuplicates(["bucket", "doc_id", "th", "start"]).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "th", "start")
    spans = whole.union(calm.mapInArrow(_sorter(length), "doc_id long, th long, start int, end int"))
    hashes = pieces.filter(F.col("size") > HOT).mapInArrow(_window_hashes(length), "doc_id long, th long, start int, hash long")
    twice = hashes.groupBy("hash").agg(F.min(F.xxhash64("th", "start")).alias("x"), F.max(F.xxhash64("th", "start")).alias("y")).filter("x <> y").select("hash")
    spans = spans.union(hashes.join(twice, "hash", "left_semi").select("doc_id", "th", "start", (F.col("start") + length).alias("end")))
    of_text = scratch.keep(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    scratch.release()
    known = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).hint("merge").join(of_text.withColumnRenamed("doc_id", "id"), ["id", "th"], "left").join(copies, ["th", "th2"], "left")
    return known.select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans").mapInArrow(_cutter(length), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS key, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT key, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM d, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS x(p)),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
g AS (SELECT key, p, lag(p) OVER (PARTITION BY key ORDER BY p) AS q FROM w JOIN c USING (m)),
r AS (SELECT key, p, sum((q IS NULL OR p > q + 200)::INT) OVER (PARTITION BY key ORDER BY p) AS run FROM g),
s AS (SELECT key, min(p) AS a, max(p) + 200 AS b FROM r GROUP BY key, run),
t AS (SELECT key, a, b, coalesce(lag(b) OVER (PARTITION BY key ORDER BY a), 0) AS prev FROM s),
k AS (
  SELECT key, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS kept
  FROM t JOIN d USING (key) GROUP BY key
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (key)
"""
