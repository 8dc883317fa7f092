"""Hybrid search over snippet records: cosine, BM25, reciprocal rank fusion, boosts and quotas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.sources.tables import materialize

# Fixed values of the ranking.
K1, B, RRF, TOP_K, MOST_K = 1.2, 0.75, 60, 10, 50
#: So many result ids are broadcast at most.
MOST_RESULTS = 100_000
#: Least score of a model, and of any other.
FLOORS = {"minilm": 0.30, "e5-base": 0.55}
TOKEN = "[^a-z0-9а-яё_]+"
DOC_KINDS = ("doc-section",)


def resolve_floor(user: float | None, model: str | None) -> float:
    return user if user is not None else FLOORS.get(model or "", 0.30)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores with two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9а-яё_]{2,}"), F.lit(0))


def query_tokens(text: str) -> list[str]:
    return [t for t in re.split(TOKEN, text.lower()) if len(t) >= 2]


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where either vector has no length."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = wide(a), wide(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)


def knn(records: DataFrame, query: Sequence[float], k: int = TOP_K, least: float | None = None) -> DataFrame:
    """Exact scan: the query is a literal, every task keeps its k best, and one merges them."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = records.withColumn("score", cosine(F.col("vector"), vector))
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "ord").limit(min(k, MOST_K))


def _bm25_scored(records: DataFrame, query: Sequence[str], text: Column, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, bm25) of all records, 0 where none of the query words is.

    Only query words leave the scan: each record yields its length and its counts of those
    words, so what is shuffled is three sums a word, not the corpus's words. Texts are read
    once: the counts are written, and both the sums and the scores start from them.
    """
    words = sorted(set(query))
    own = records.select(F.col(key).alias("key"), *keep, tokens(F.coalesce(text, F.lit(""))).alias("t"))
    own = own.select("key", *keep, F.size("t").alias("len"), (F.filter("t", lambda x: x.isin(*words)) if words else F.col("t")).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    counted = materialize(own.select("key", *keep, "len", *[count(w).alias(f"tf{i}") for i, w in enumerate(words)]))
    if not words:
        return counted.select("key", *keep, F.lit(0.0).alias("bm25"))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i, w in enumerate(words):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.lit(float(query.count(w))) * F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).otherwise(0.0)
    # One row of sums: its size doesn't grow with the corpus.
    return counted.join(F.broadcast(sums)).select("key", *keep, score.alias("bm25"))


def bm25(records: DataFrame, query: Sequence[str], text: Column, key: str = "ord") -> DataFrame:
    """(key, bm25) of the records that hold a query word. The corpus is the records given; a word that the query repeats counts again."""
    return _bm25_scored(records, query, text, key).filter("bm25 > 0")


def hybrid(
    records: DataFrame, vector: Sequence[float], text: str, *, kinds: Sequence[str] | None = None, exclude: Sequence[str] = (), least: float = 0.30,
    boosts: Mapping[str, float] | None = None, quotas: Mapping[str, int] | None = None, k: int = TOP_K,
) -> DataFrame:
    """Fused ranking of records (node_id, kind, label, path, snippet, vector, ord).

    Candidates are of the kinds given and not excluded, with a cosine of ``least`` or more.
    They have a dense rank by cosine and, where BM25 is above 0, a lexical one; the score
    is the sum of 1 / (60 + rank), times the boost of the kind. Each kind has at most its
    quota of the k results.
    """
    query = F.array(*[F.lit(float(x)) for x in vector])
    own = records.withColumn("cosine", cosine(F.col("vector"), query)).drop("vector")
    if kinds is not None:
        own = own.filter(F.col("kind").isin(*kinds))
    own = own.filter(~F.col("kind").isin(*exclude) & (F.col("cosine") >= least)) if exclude else own.filter(F.col("cosine") >= least)
    # Texts and vectors are read here, and again only for the results; what is ranked are a few narrow columns.
    scored = _bm25_scored(own, query_tokens(text), F.concat_ws(" ", "kind", "label", "path", "snippet"), "ord", ("node_id", "kind", "cosine"))
    # Ranks need a total order. Sorted ranges count their rows, and offsets of ranges are added: no task gets all rows.
    dense = ranked(scored, [F.desc("cosine"), F.col("key")], "dense")
    lex = ranked(dense.filter("bm25 > 0").select("key", "cosine", "bm25"), [F.desc("bm25"), F.desc("cosine"), F.col("key")], "lexical").select("key", "lexical")
    both = dense.join(lex, "key", "left").withColumn("bm25", F.when(F.col("bm25") > 0, F.col("bm25")))
    boost = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(float(b))) for kind, b in (boosts or {}).items()], F.lit(1.0))
    score = (F.lit(1.0) / (RRF + F.col("dense")) + F.coalesce(F.lit(1.0) / (RRF + F.col("lexical")), F.lit(0.0))) * boost
    fused = both.withColumn("score", score)
    order = [F.desc("score"), F.desc("cosine"), F.col("node_id")]
    if quotas:
        nth = F.row_number().over(W.partitionBy("kind").orderBy(*order))
        quota = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(int(q))) for kind, q in quotas.items()], F.lit(MOST_K))
        # No kind has a later row among the results; a fixed limit acts before the shuffle, so a kind isn't sorted whole in one task.
        fused = fused.withColumn("nth", nth).filter((F.col("nth") <= MOST_K) & (F.col("nth") <= quota)).drop("nth")
    best = fused.orderBy(*order).limit(min(k, MOST_K))
    texts = records.drop("node_id", "kind", "vector").join(F.broadcast(best.withColumnRenamed("key", "ord")), "ord")
    return texts.select("node_id", "kind", *[c for c in records.columns if c not in ("node_id", "kind", "vector")], "cosine", "dense", "bm25", "lexical", "score").orderBy(*order)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 1 in a total order, without one task for all of them.

    The sorted rows are written first: sorting again could deal them to other ranges.
    """
    sorted_ = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    # The upper bits of the id number the sorted ranges; within one the lower bits count rows.
    sorted_ = sorted_.withColumn("__range", F.shiftright("__id", 33))
    sizes = sorted_.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A row for each range: as many as shuffle partitions.
    joined = sorted_.join(F.broadcast(before.select("__range", "__before")), "__range")
    return joined.withColumn(name, (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("__id", "__range", "__before")


def code_search(records: DataFrame, vector: Sequence[float], text: str, **options) -> DataFrame:
    return hybrid(records, vector, text, exclude=(*DOC_KINDS, *options.pop("exclude", ())), **options)


def docs_search(records: DataFrame, vector: Sequence[float], text: str, **options) -> DataFrame:
    if options.get("kinds") is not None:
        raise ValueError("the kinds of this bucket are fixed")
    return hybrid(records, vector, text, **(options | {"kinds": DOC_KINDS}))


def ranks_of_first_hit(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank): place of the first result of an expected kind with an expected text in its label, by score, ties by id; null if there is none."""
    ok = F.array_contains("kinds", F.col("kind")) & F.exists("labels", lambda x: F.lower("label").contains(F.lower(x)))
    joined = expected.select("query_id", "kinds", "labels").join(results.select("query_id", "kind", "label", "score", "node_id"), "query_id", "left")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return joined.withColumn("nth", nth).groupBy("query_id").agg(F.min(F.when(ok, F.col("nth"))).alias("rank"))


def with_vectors(results: DataFrame, records: DataFrame) -> DataFrame:
    """Results (node_id, ...) with their records' vectors, looked up for the few results only."""
    wanted = results.select("node_id").distinct()
    vectors = records.select("node_id", "vector").join(F.broadcast(wanted) if wanted.count() <= MOST_RESULTS else wanted, "node_id", "left_semi")
    return results.join(vectors, "node_id", "left")


def hit_rate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Hits of golden queries by project and category, with subtotals.

    results: query_id, kind, label, score; expected: query_id, project, category, kinds, labels, min_score.
    A query is hit if a result reaches the score, is of an expected kind and has an expected text in its label.
    """
    ok = (F.col("score") >= F.col("min_score")) & F.array_contains("kinds", F.col("kind")) & F.exists("labels", lambda x: F.lower("label").contains(F.lower(x)))
    hits = expected.join(results, "query_id", "left").groupBy("query_id", "project", "category").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("hit"))
    return hits.rollup("project", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hit"), F.avg(F.col("hit").cast("int")).alias("rate"))
