"""Corpus pipeline: documents to a deduplicated, decontaminated training mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the
stage before it kept. All but the last return the columns of ``documents``. Rows are
told apart by doc_id and their text, so rows that repeat both share one fate; every stage
takes null ids, null and empty texts, and empty tables as its operator does: null and empty
texts are scored, have no lines to lose, are linked with nothing, have no word that could be
hit, and are repeated like any other; a null id is one id, the last in every order; ties go
to the smaller id; further columns are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.decontaminate import find_contamination
from loomgraph.llm.line_dedup import dedup_lines
from loomgraph.llm.mixing import mix_sources
from loomgraph.llm.near_dedup import near_duplicates
from loomgraph.llm.quality import score_quality
from loomgraph.llm.store import Scratch, clean, mark, spare


def _without(docs: DataFrame, bad_ids: DataFrame) -> DataFrame:
    """Documents whose doc_id isn't among ``bad_ids``."""
    (name,) = spare(docs.columns, "bad_id")
    bad = bad_ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts 0 for go. Of rows that repeat an id with other texts, one rejected text rejects the id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return _without(docs, score_quality(docs, labels).filter("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that earlier lines repeat, and n_chars follows. Documents of which nothing but blanks is left go; those that had nothing else before stay."""
    out = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim("text", F.lit(" \t\r\n")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 stays: the one with the smallest id, once if its row is repeated."""
    scratch = Scratch(spark, "near-stage")
    found = scratch.keep(near_duplicates(docs, percent=80), "found")
    unique = docs.dropDuplicates(["doc_id", "text"]) if scratch.keep(found.groupBy("doc_id").count().filter("count > 1"), "repeated").limit(1).count() else docs
    return _without(unique, found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside any benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _without(docs, find_contamination(docs, benchmark).filter("n_hit > 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' weights, in a shuffled order."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontaminate", decontaminate), ("mix", mix)]
#: The classifier can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = mark()
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        clean(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
