"""Connected components of a link table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.store import Scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) but the least of its component.

    Alternating stars: every node links its larger neighbours to the least node it
    knows, then its smaller ones. Rounds grow with the logarithm of the longest path.
    A node with very many links is one key of a join whose other side has one row for
    it. That side is written first: with an exchange on either side of the join adaptive
    execution splits the key, which it can't do right above an aggregation. Each round is
    written to the shared folder.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    mark = None
    for turn in range(1, MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least-{turn}")
        large = scratch.keep(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-large-{turn}")
        down = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-down-{turn}")
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        before, now = now, scratch.keep(small, f"{name}-{turn}")
        for done in (before, least, large, down):
            scratch.drop(done)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()  # one row
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
