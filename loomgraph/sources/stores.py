"""Graphs, search records and code-intelligence tables at rest: Parquet or JSON lines, with a manifest written last."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.plans.codeintel import CodeIntel
from loomgraph.plans.graph import Graph
from loomgraph.sources.tables import materialize

VERSION = "1.0"
SHARDS = {"symbols": schema.SYMBOLS, "calls": schema.CALLS, "flows": schema.FLOWS, "branches": schema.BRANCHES, "impacts": schema.IMPACTS, "policies": schema.POLICIES}


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """One JSON document of nodes and edges; ``ord`` is a row's place in its list."""
    node, edge = "array<struct<id:string,kind:string,label:string,path:string,anchor:string,meta:string>>", "array<struct<id:string,`from`:string,`to`:string,kind:string,dynamic:boolean,subjectPattern:string,file:string,line:int,meta:string>>"
    doc = spark.read.schema(f"version string, buildAt string, root string, nodes {node}, edges {edge}").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", F.col("ord").cast("long").alias("ord"))
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select("e.id", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind", "e.dynamic", F.col("e.subjectPattern").alias("subject_pattern"), "e.file", "e.line", "e.meta", F.col("ord").cast("long").alias("ord"))
    return Graph(nodes, edges)


def write_graph_json(graph: Graph, path: str, root: str, built_at: str) -> None:
    """The interchange form, one document; for graphs that a reader of it can hold. At rest, use ``write_graph``."""

    def rows(df: DataFrame, names: dict[str, str]) -> list[dict]:
        out = []
        for r in df.orderBy("ord").toLocalIterator():
            own = {names.get(k, k): v for k, v in r.asDict().items() if v is not None and k != "ord"}
            if "meta" in own:
                own["meta"] = json.loads(own["meta"])
            out.append(own)
        return out

    doc = {"version": VERSION, "buildAt": built_at, "root": root, "nodes": rows(graph.nodes, {}), "edges": rows(graph.edges, {"src": "from", "dst": "to", "subject_pattern": "subjectPattern"})}
    atomic_write(path, json.dumps(doc, ensure_ascii=False))


def write_graph(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.schema(schema.NODES).parquet(f"{path}/nodes"), spark.read.schema(schema.EDGES).parquet(f"{path}/edges"))


def foreign_graph(spark: SparkSession, path: str) -> Graph:
    """Node-link JSON of other tools: nodes with id, label or name, type; links with source, target, relation."""
    doc = spark.read.schema("nodes array<struct<id:string,label:string,name:string,type:string,file:string>>, links array<struct<source:string,target:string,relation:string>>").option("multiLine", "true").json(path)
    null = F.lit(None).cast("string")
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.id", F.coalesce("n.type", F.lit("file")).alias("kind"), F.coalesce("n.label", "n.name", "n.id").alias("label"), F.col("n.file").alias("path"), null.alias("anchor"), null.alias("meta"), F.col("ord").cast("long").alias("ord"))
    kind = F.coalesce("l.relation", F.lit("link"))
    edges = doc.select(F.posexplode("links").alias("ord", "l")).select(F.concat(kind, F.lit(":"), "l.source", F.lit("->"), "l.target").alias("id"), F.col("l.source").alias("src"), F.col("l.target").alias("dst"), kind.alias("kind"), F.lit(False).alias("dynamic"), null.alias("subject_pattern"), null.alias("file"), F.lit(None).cast("int").alias("line"), null.alias("meta"), F.col("ord").cast("long").alias("ord"))
    return Graph(nodes, edges)


def read_records(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Search records in JSON lines. A torn line fails the read, and so does a vector of another length; blank lines don't count."""
    rows = spark.read.schema(schema.RECORDS).option("mode", "FAILFAST").json(path)
    checked = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of another length: "), F.coalesce("node_id", F.lit("?")))))
    return rows.withColumn("vector", checked)


def write_records(records: DataFrame, path: str, manifest: dict) -> None:
    """Records first, the manifest last: a reader that finds it finds all of them."""
    records.write.mode("overwrite").json(f"{path}/records")
    write_text(records.sparkSession, f"{path}/manifest.json", json.dumps(manifest | {"node_count": records.count()}))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    target = f"{path}/manifest.json"
    if not exists(spark, target):
        return None
    return json.loads(spark.read.option("wholetext", "true").text(target).first()[0])


def read_code_intel(spark: SparkSession, path: str) -> CodeIntel:
    """Six tables in JSON lines; one that isn't there is empty, a line that can't be read fails with its text."""
    parts = {}
    for name, ddl in SHARDS.items():
        at = f"{path}/{name}.jsonl"
        parts[name] = spark.read.schema(ddl).option("mode", "FAILFAST").json(at) if exists(spark, at) else spark.createDataFrame([], ddl)
    return CodeIntel(**parts)


def write_code_intel(ix: CodeIntel, path: str) -> None:
    spark = ix.symbols.sparkSession
    counts = {}
    for f in fields(ix):
        table = getattr(ix, f.name)
        table.write.mode("overwrite").json(f"{path}/{f.name}.jsonl")
        counts[f.name] = table.count()
    write_text(spark, f"{path}/manifest.json", json.dumps({"version": VERSION, "counts": counts}))


def atomic_write(path: str, text: str, mode: int = 0o644) -> None:
    """A local file that is either the old one or the whole new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    temp = target.with_name(f".{target.name}.{os.getpid()}")
    try:
        temp.write_text(text, encoding="utf-8")
        os.chmod(temp, mode)
        os.replace(temp, target)
    finally:
        temp.unlink(missing_ok=True)


def merge_diagnostics(path: str, semantic: dict) -> None:
    """Replace the key ``semantic`` of a diagnostics file and nothing else; a file that can't be read is an error."""
    found = json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}
    atomic_write(path, json.dumps(found | {"semantic": semantic}, ensure_ascii=False))


@dataclass
class Reloading:
    """A graph that is read again when its file has changed; a torn file leaves the last good one, and is reported once."""

    spark: SparkSession
    path: str
    seen: int | None = None
    good: Graph | None = None
    reported: list[str] = field(default_factory=list)

    def get(self) -> Graph:
        fs, at = _fs(self.spark, self.path)
        now = fs.getFileStatus(at).getModificationTime()
        if now != self.seen:
            try:
                graph = read_graph_json(self.spark, self.path)
                whole = Graph(materialize(graph.nodes), materialize(graph.edges))
            except Exception as e:
                if self.good is None:
                    raise
                self.reported.append(f"{now}: {type(e).__name__}")
            else:
                self.good = whole
            self.seen = now
        return self.good


@dataclass
class Config:
    """Settings of a build, from JSON or YAML."""

    id: str
    root: str
    apps_glob: str
    libs_glob: str | None = None
    exclude: tuple[str, ...] = ()
    internal_services: dict[str, list[str]] = field(default_factory=dict)
    env_services: dict[str, str] = field(default_factory=dict)
    file_edges: bool = False
    chunk_tokens: int = 100
    #: Domains that a strict build doesn't ask any ground truth of: false.
    domains: dict[str, bool] = field(default_factory=dict)


def load_config(text: str) -> Config:
    """Checked settings: id, root and apps_glob are required, and an internal service needs a text to know it by."""
    import yaml

    raw = yaml.safe_load(text) or {}
    missing = [k for k in ("id", "root", "apps_glob") if not raw.get(k)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    empty = [k for k, v in (raw.get("internal_services") or {}).items() if not v]
    if empty:
        raise ValueError(f"internal services without a text: {', '.join(empty)}")
    unknown = set(raw) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**(raw | {"exclude": tuple(raw.get("exclude") or ())}))
