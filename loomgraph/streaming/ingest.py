"""Incremental index over a folder of source drops, as a stream.

Each micro-batch keeps the newest row of every node, takes vectors over where the content
hash is known, embeds the others, and writes the merged index as a new version. A batch
that is tried again writes the same version, so none is applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph import schema
from loomgraph.operators.index import build_index
from loomgraph.sources.stores import exists

DROP = "id string, kind string, label string, path string, snippet string, ord long, seen timestamp, deleted boolean"


def version_path(target: str, version: int) -> str:
    return f"{target}/version={version:012d}"


def merge_batch(batch: DataFrame, version: int, target: str, model: str) -> None:
    spark: SparkSession = batch.sparkSession
    newest = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), F.struct("seen", "ord")).alias("r")).select("id", "r.*")
    before = next((version_path(target, v) for v in range(version - 1, -1, -1) if exists(spark, version_path(target, v) + "/_SUCCESS")), None)
    prior = spark.read.schema(schema.RECORDS).parquet(before) if before else spark.createDataFrame([], schema.RECORDS)
    kept = prior.join(newest.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    fresh = build_index(newest.filter("NOT coalesce(deleted, false)").drop("seen", "deleted"), prior, model)
    columns = [c.split(" ")[0] for c in schema.RECORDS.split(", ")]
    kept.select(*columns).unionByName(fresh.select(*columns)).write.mode("overwrite").parquet(version_path(target, version))


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, model: str = "hashing", once: bool = False) -> StreamingQuery:
    """Read JSON drops as they come. The checkpoint keeps which files a batch had, so a restart goes on where it stopped."""
    drops = spark.readStream.schema(DROP).option("maxFilesPerTrigger", 1000).json(source)
    writer = drops.writeStream.foreachBatch(lambda batch, version: merge_batch(batch, version, target, model)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
