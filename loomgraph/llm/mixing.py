"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.store import spare

#: A table of rates of up to so many sources and thresholds (8 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_THRESHOLDS = 10_000, 1 << 20
#: exp(-rate) is a normal double up to here; a larger rate is parted into equal ones, whose counts are added.
MOST_RATE = 700.0


def uniform(seed: int, *cols: Column) -> Column:
    """Uniform double in [0, 1) from 52 bits of the md5 of seed and columns: the same on every run and machine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _thresholds(rate: Column) -> Column:
    """Poisson distribution function at 0, 1, 2, ... as far as it is below 1 in doubles."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.concat(acc["out"], F.array(total)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, source: str = "source", size: float = 1.0, max_rate: float | None = None) -> DataFrame:
    """(source, n, rate): mean repetitions that bring each source to its share of the mixture.

    Shares are in proportion to ``weights`` (a source without one gets none) or, without
    weights, to the source's documents to the power ``power``. The mixture has ``size``
    times as many documents as the input. A null source is a source of its own. With
    ``max_rate``, rates end there: beyond it a source is repeated that often and falls short
    of its share. Without, every source gets its share.
    """
    counts = docs.groupBy(docs[source].alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        share = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0)) if weights else F.lit(0.0)
    shared = counts.withColumn("share", share)
    totals = shared.agg(F.sum("n").alias("all_n"), F.sum("share").alias("all_share"))
    one = totals.first()  # one row
    if not one["all_n"] or not one["all_share"]:
        return counts.withColumn("rate", F.lit(0.0))
    rate = F.lit(float(size) * one["all_n"] / one["all_share"]) * F.col("share") / F.col("n")
    return shared.select("source", "n", (rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5, seed: int = 17, doc_id: str = "doc_id", source: str = "source", size: float = 1.0, max_rate: float | None = None) -> DataFrame:
    """Repeat every document by a Poisson count of its source's rate and shuffle all copies.

    The count inverts the Poisson distribution at a uniform number hashed from seed and
    doc_id, so a document gets the same count wherever it is computed, and repeated rows
    of a document get the same count each. Beyond ``MOST_RATE`` it is a sum of such counts
    of equal parts of the rate, each at a number of its own. A count of 0 leaves the document out: that is
    the sampling that the mixture asks for. Returns the columns of ``docs`` with
    ``copy`` (from 1) and ``shuffle_key``; copies are dealt to partitions by that key and
    sorted by it. Columns of those two names are replaced. Null ids hash as the empty
    string; texts aren't looked at. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    of, n_parts, cdf, n_copies = spare([*names, "copy", "shuffle_key"], "of_source", "n_parts", "cdf", "n_copies")
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")
    rates = source_rates(docs, weights, power, source, size, max_rate).withColumn(n_parts, parts)
    rates = rates.select(F.col("source").alias(of), n_parts, _thresholds(F.col("rate") / F.col(n_parts)).alias(cdf))
    rows = docs.select(*names)
    held = rates.agg(F.count(F.lit(1)).alias("sources"), F.sum(F.size(cdf)).alias("thresholds")).first()  # one row
    small = held["sources"] <= BROADCAST_SOURCES and (held["thresholds"] or 0) <= BROADCAST_THRESHOLDS
    joined = rows.join(F.broadcast(rates) if small else rates, rows[source].eqNullSafe(rates[of]))

    def count(u: Column) -> Column:
        return F.size(F.filter(F.col(cdf), lambda c: c <= u))

    one = count(uniform(seed, F.col(doc_id)))
    others = F.aggregate(F.sequence(F.lit(2), F.col(n_parts)), F.lit(0), lambda n, k: n + count(uniform(seed, F.col(doc_id), F.lit("part"), k)))
    copies = F.when(F.col(n_parts) > 1, one + others).otherwise(one)
    repeated = joined.withColumn(n_copies, copies).filter(F.col(n_copies) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    keyed = repeated.select(*names, "copy", uniform(seed + 1, F.col(doc_id), F.col("copy")).alias("shuffle_key"))
    # The key is uniform, so a hash of it deals evenly; no sample of the texts is read to find ranges.
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return mix_sources(docs)


OP8_SQL = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS share FROM documents GROUP BY source),
t AS (SELECT sum(n) AS all_n, sum(share) AS all_share FROM s),
r AS (SELECT source, (1.0::DOUBLE * all_n / all_share) * share / n AS rate FROM s, t),
c AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
d AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy,
  ('0x' || substr(md5('18:' || coalesce(doc_id::VARCHAR, '') || ':' || k::VARCHAR), 1, 13))::BIGINT / pow(2, 52) AS shuffle_key
FROM m, unnest(range(1, n + 1)) AS x(k)
"""
