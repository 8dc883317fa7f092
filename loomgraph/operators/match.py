"""Recall of extracted sites against an independent truth, and joins that keep multiplicity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def multiset_match(truth: DataFrame, found: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched pairs by key, each row used once, and the rows missed and extra. Keys are null-safe."""
    a, b = numbered(truth, keys, order).alias("a"), numbered(found, keys, order).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "nth"]]
    matched = a.join(b, on, "inner").select("a.*")
    missed = a.join(b, on, "left_anti").drop("nth")
    extra = b.join(a, on, "left_anti").drop("nth")
    return matched.drop("nth"), missed, extra


def multiset_recall(truth: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Truth rows, found rows and matches in each group, and their recall (1 without truth).

    The match of a key is the smaller of its two counts, which is what pairing rows one by
    one comes to; so only counts are joined, and a frequent key is no hot row group.
    """
    a = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth"))
    b = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found"))
    on = [a[k].eqNullSafe(b[k]) for k in keys]
    both = a.join(b, on, "full").select(*[F.coalesce(a[k], b[k]).alias(k) for k in keys], F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("n_found", F.lit(0)).alias("n_found"))
    sums = both.groupBy(*by).agg(F.sum("n_truth").alias("n_truth"), F.sum("n_found").alias("n_found"), F.sum(F.least("n_truth", "n_found")).alias("n_matched"))
    return sums.withColumn("recall", ratio(F.col("n_matched"), F.col("n_truth"), 1.0))


def lookup_match(truth: DataFrame, found: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Each truth row with the last found row of its key, which any number of truth rows may share."""
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*found.columns), order).alias("site"))
    return truth.join(last, keys, "left")


def two_stage(left: DataFrame, right: DataFrame, first: list[str], second: list[str], order: str) -> DataFrame:
    """``left`` with the match by the first keys, else the first in order by the second keys; ``stage`` tells which."""
    pick = lambda keys: right.groupBy(*keys).agg(F.min_by(F.struct(*right.columns), order).alias("m"))
    a, b = pick(first).withColumnRenamed("m", "m1"), pick(second).withColumnRenamed("m", "m2")
    joined = left.join(a, first, "left").join(b, second, "left")
    stage = F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2)
    return joined.withColumn("match", F.coalesce("m1", "m2")).withColumn("stage", stage).drop("m1", "m2")


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def file_recall(truth: DataFrame, found: DataFrame, key: str = "file") -> DataFrame:
    """Counts of each file, its recall as far as counts tell, and the gap."""
    a, b = truth.groupBy(key).agg(F.count(F.lit(1)).alias("n_truth")), found.groupBy(key).agg(F.count(F.lit(1)).alias("n_found"))
    both = a.join(b, key, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return both.withColumn("recall", F.least(F.lit(1.0), F.col("n_found") / F.col("n_truth"))).withColumn("gap", F.greatest(F.lit(0), F.col("n_truth") - F.col("n_found")))


def worst_files(recall: DataFrame, n: int = 20, key: str = "file") -> DataFrame:
    return recall.filter("gap > 0").orderBy(F.desc("gap"), key).limit(n)


def fill_rate(records: DataFrame, kind: str, snippet: str, floor: float = 0.85) -> DataFrame:
    """Share of records of each kind that carry text, and whether it reaches the floor."""
    full = F.count_if(F.length(F.trim(F.coalesce(F.col(snippet), F.lit("")))) > 0)
    out = records.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), full.alias("n_filled"))
    rate = ratio(F.col("n_filled"), F.col("n"), 1.0)
    return out.withColumn("rate", rate).withColumn("ok", rate >= floor)


# Least recall and resolve rate of each domain.
FLOORS = {
    "nats": (0.95, None), "typeorm": (0.95, 0.95), "bullmq": (0.95, 0.95), "cron": (0.90, None), "di": (0.95, 0.95), "http": (0.95, None),
    "imports": (0.80, None), "fe": (0.90, None), "endpoint": (0.95, None), "config": (0.90, None), "entity-fields": (0.95, None), "docs": (1.0, None),
}


@dataclass
class Verdict:
    domain: str
    ok: bool
    reason: str = ""


def strict_gate(reports: dict[str, dict], enabled: set[str]) -> list[Verdict]:
    """Judge recall reports (n_truth, recall, resolve_rate) by domain; an enabled domain without any truth fails."""
    out = []
    for domain in sorted(enabled):
        report = reports.get(domain) or {"n_truth": 0, "recall": 1.0}
        recall, resolve = FLOORS.get(domain, (0.95, None))
        if not report["n_truth"]:
            out.append(Verdict(domain, False, "no ground truth"))
        elif report["recall"] < recall:
            out.append(Verdict(domain, False, f"recall {report['recall']:.4f} < {recall}"))
        elif resolve is not None and report.get("resolve_rate", 1.0) < resolve:
            out.append(Verdict(domain, False, f"resolve rate {report['resolve_rate']:.4f} < {resolve}"))
        else:
            out.append(Verdict(domain, True))
    return out


TIPS = {
    "nats": "name wrapper APIs and decorator aliases in the config", "rmq": "name the handler decorators in the config", "typeorm": "entities need static table names",
    "bullmq": "queue names should be literals or constants", "cron": "pass literal or named cron expressions", "di": "module arrays should be literal arrays",
    "http": "list internal services and env variables", "imports": "add path aliases to the compiler config", "docs": "check include and exclude globs",
}


def tips(verdicts: list[Verdict]) -> dict[str, str]:
    """Advice for the domains that failed."""
    return {v.domain: TIPS.get(v.domain, "look at the files with the largest gap") for v in verdicts if not v.ok}


def association_rules(baskets: DataFrame, basket: str, item: str, support: int = 3, confidence: float = 0.5) -> DataFrame:
    """Ordered pairs of items that stand in one basket: (item, other, n, n_item, confidence).

    Baskets are sets of a few items (decorators of a symbol), so pairs are made within one.
    """
    sets = baskets.select(F.col(basket).alias("b"), F.col(item).alias("item")).distinct()
    # An item that is rarer than the support makes no pair that counts.
    singles = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).filter(F.col("n_item") >= support)
    sets = sets.join(singles.select("item"), "item", "left_semi")
    listed = sets.groupBy("b").agg(F.collect_set("item").alias("own"))
    pairs = listed.select(F.explode("own").alias("item"), "own").select("item", F.explode("own").alias("other")).filter("item <> other")
    counted = pairs.groupBy("item", "other").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    return counted.join(singles, "item").withColumn("confidence", F.col("n") / F.col("n_item")).filter(F.col("confidence") > confidence)


def kind_histogram(sites: DataFrame, kind: str = "subject_kind") -> DataFrame:
    """How many sites have a subject of each kind, the largest first."""
    return sites.groupBy(F.coalesce(F.col(kind), F.lit("unresolved")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def resolve_rate(sites: DataFrame, kind: str = "subject_kind") -> DataFrame:
    """(n, n_resolved, rate): sites whose subject is a literal or a pattern; 0 without sites."""
    done = F.col(kind).isin("literal", "pattern")
    counted = sites.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(done, F.lit(False))).alias("n_resolved"))
    return counted.withColumn("rate", ratio(F.col("n_resolved"), F.col("n"), 0.0))


def resolve_rates(sites: DataFrame) -> DataFrame:
    """(domain, n, rate): how many sites of the domains with a floor name what they mean."""
    domain = F.when(F.col("domain") == "repositories", "typeorm").when(F.col("domain") == "queues", "bullmq").when(F.col("domain") == "di-modules", "di")
    counted = sites.filter("error IS NULL").select(domain.alias("domain"), F.col("subject").isNotNull().alias("done")).filter("domain IS NOT NULL")
    return counted.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("done").cast("int")).alias("rate"))


def placement_shares(rows: DataFrame, kind: str, place: str, least_rows: int = 5, share: float = 0.3) -> DataFrame:
    """Places that hold more than a share of a kind's rows: (kind, place, n, total, share). The totals are sums of the counts, not a second pass."""
    counted = rows.groupBy(F.col(kind).alias("kind"), F.col(place).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    with_total = counted.withColumn("total", F.sum("n").over(W.partitionBy("kind")))
    return with_total.withColumn("share", F.col("n") / F.col("total")).filter((F.col("total") >= least_rows) & (F.col("share") > share))


def suffix_shares(rows: DataFrame, kind: str, name: str, suffixes: list[str], share: float = 0.7) -> DataFrame:
    """Name endings that more than a share of a kind's rows have."""
    counted = rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(name).endswith(s)).alias(f"s{i}") for i, s in enumerate(suffixes)])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("suffix"), F.col(f"s{i}").alias("n")) for i, s in enumerate(suffixes)]))
    return counted.select("kind", "total", each.alias("x")).select("kind", "x.suffix", "x.n", "total", (F.col("x.n") / F.col("total")).alias("share")).filter(F.col("share") > share)
