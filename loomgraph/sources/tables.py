"""Tables in shared storage: driver tables, and intermediate results that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of this machine only where that is unset and all runs on it, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomgraph-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs and retries start there."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A table that grows: each part is written once and never again, and all parts are read together."""

    def __init__(self, first: DataFrame) -> None:
        self._spark, self._schema = first.sparkSession, first.schema
        self._path = f"{shared_dir(self._spark)}/parts-{uuid.uuid4().hex}"
        self._n = 0
        self.add(first)

    def add(self, part: DataFrame) -> DataFrame:
        """Write a part with the table's columns; returns that part alone, read back."""
        path = f"{self._path}/part={self._n}"
        self._n += 1
        part.select(*self._schema.names).write.parquet(path)
        return self._spark.read.schema(self._schema).parquet(path)

    def all(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*[f"{self._path}/part={i}" for i in range(self._n)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
