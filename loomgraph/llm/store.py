"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one of this machine on a local master, as in tests; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own[app]


def spare(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened where they clash with taken ones in whatever case."""
    have, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


#: Folders of all operator calls, oldest first, until ``clean`` deletes them.
_made: list[str] = []


def mark() -> int:
    """How many operator calls there have been; ``clean`` deletes what came after a mark."""
    return len(_made)


def clean(spark: SparkSession, since: int = 0, but: Iterable[str] = ()) -> None:
    """Delete the tables of the operator calls since a mark. To be called once the operators' results, which read some of them, are written."""
    kept = set(but)
    for base in [b for b in _made[since:] if b not in kept]:
        _delete(spark, base)
    _made[since:] = [b for b in _made[since:] if b in kept]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Scratch:
    """Tables of one operator call. ``keep`` writes and rereads, ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        _made.append(self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        again = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(again)] = path
        return again

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)

    def release(self) -> None:
        """Let Spark delete shuffle files whose frames are gone; it does so only after a collection on the driver."""
        gc.collect()
        self.spark._jvm.System.gc()
