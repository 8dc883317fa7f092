"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words; a shorter item is
one window. A window's tokens are its three-word shingles, ordered by how often they
occur in all documents. Since a document must hold the whole window, one necessary
token is enough to find it by: the rarest. Documents' shingles are joined on those
tokens alone; a match is placed by the token's offset in its window, must leave room for
the window on both sides, and is then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.store import Scratch

TOKEN = 3
#: So many windows (about 200 bytes each) are broadcast at a time; more take more passes over the documents' words.
PASS_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for null. Only texts with other than ASCII characters need the slow lower-casing."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def _token(own: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(own, at + j) for j in range(size)])


def _occurrences(docs: DataFrame, size: int) -> DataFrame:
    """A row for each place of a document: key, n_words, words (not copied), at, token."""
    places = docs.select("key", "n_words", "words", F.posexplode("words").alias("at", "__word"))
    return places.select("key", "n_words", "words", "at", _token(F.col("words"), F.col("at"), size).alias("token"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of documents that any window of a benchmark item covers.

    Returns per row of ``docs``: doc_id, n_words, n_hit (words inside any occurrence of a
    window), n_items (items with occurring windows) and items (their ids as strings,
    sorted). Null and empty texts have no words and no windows. Items that share a window
    are all named; rows that repeat an item count once; a null item_id is named by the
    empty string. Repeated rows of documents are judged each; empty tables on either side
    give no hits. Other columns aren't looked at.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = docs.select(docs[doc_id].alias("doc_id"), words(docs[text]).alias("words"))
    held = scratch.keep(own.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.size("words").cast("long").alias("n_words"), "words"), "words")
    items = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("")).alias("item"), words(benchmark[item_text]).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("start")
    cut = items.select("item", "w", starts).select("item", F.slice("w", F.col("start") + 1, F.lit(window)).alias("w"))
    of_items = scratch.keep(cut.select("item", F.array_join("w", " ").alias("win")).distinct(), "items")
    windows = scratch.keep(cut.select(F.array_join("w", " ").alias("win"), "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(TOKEN)).alias("size")).dropDuplicates(["win"]), "windows")
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # TOKEN rows at most
    found = None
    for size, n in sorted(sizes.items()):
        passes = -(-n // PASS_WINDOWS)
        for turn in range(passes):
            part = windows.filter((F.col("size") == size) & (F.pmod(F.xxhash64("win"), F.lit(passes)) == turn))
            matches = _matches(scratch, held, part, size, f"{size}-{turn}")
            found = matches if found is None else found.union(matches)
    counts = held.select("key", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    if found is None:
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items"))
    found = scratch.keep(found, "found")
    before = W.partitionBy("key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hit = found.select("key", "start", "end").distinct().withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = found.select("key", "win").distinct().join(of_items, "win").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = counts.join(hit, "key", "left").join(named, "key", "left")
    items_of = F.coalesce("items", none)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"))


def _matches(scratch: Scratch, held: DataFrame, windows: DataFrame, size: int, name: str) -> DataFrame:
    """(key, start, end, win) of every occurrence of the windows, at most PASS_WINDOWS of them."""
    at = F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("offset")
    tokens = windows.select("win", "w", "len", at).select("win", "len", "offset", _token(F.col("w"), F.col("offset"), size).alias("token"))
    vocabulary = tokens.select("token").distinct()
    seen = _occurrences(held, size).select("token").join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = tokens.join(seen, "token").groupBy("win", "len").agg(F.min(F.struct("n", "offset", "token")).alias("t"), F.count(F.lit(1)).alias("known"))
    # A window with a token that no document holds occurs nowhere.
    needed = scratch.keep(rarest.filter(F.col("known") == F.col("len") - size + 1).select("win", "len", F.col("t.offset").alias("offset"), F.col("t.token").alias("token")), f"needed-{name}")
    start = F.col("at") - F.col("offset")
    joined = _occurrences(held, size).join(F.broadcast(needed), "token")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ") == F.col("win")
    return joined.filter(fits & same).select("key", start.alias("start"), (start + F.col("len")).alias("end"), "win")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find_contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS key, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), cut AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + 10], ' ') AS win
  FROM i, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS x(s) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM cut),
places AS (
  SELECT key, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM d, lens, unnest(range(0, greatest(len(w) - n + 1, 0))) AS x(s)
), hits AS (SELECT DISTINCT p.key, p.s, p.n, c.item FROM places p JOIN cut c ON p.win = c.win AND p.n = c.n),
covered AS (SELECT key, count(DISTINCT pos) AS n_hit FROM hits, unnest(range(s, s + n)) AS x(pos) GROUP BY key),
named AS (SELECT key, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hits GROUP BY key)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (key) LEFT JOIN named USING (key)
"""
