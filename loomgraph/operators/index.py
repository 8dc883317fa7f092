"""The search index: texts to embed, content hashes, incremental builds, staleness."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.search import query_tokens

SCHEMA_VERSION, DIM = 2, 256
#: Texts that an embedder is given at a time, and that are skipped together.
BATCH = 32
#: Node kinds without source text of their own.
VIRTUAL = ("service", "lib", "nats-subject", "rmq-pattern", "queue", "external", "db-table")


def embed_text(nodes: DataFrame) -> Column:
    """Label and kind, then whatever text the node carries."""
    extra = [F.col(c) for c in ("snippet", "strings", "schedule", "api_info") if c in nodes.columns]
    return F.concat_ws("\n", F.concat_ws(" ", "label", "kind"), *[F.when(F.length(c) > 0, c) for c in extra])


def content_hash(kind: Column, label: Column, text: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("|", kind, label, text, F.lit(model)), 256)


def hashing_embedder(dim: int = DIM) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """Offline stand-in for a model: signed word hashes, scaled to length 1. Scores aren't comparable with a model's."""

    def one(text: str | None) -> list[float]:
        out = np.zeros(dim)
        for word in query_tokens(text or ""):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % dim] += 1 if h >> 63 else -1
        norm = float(np.sqrt((out * out).sum()))
        return (out / norm if norm else out).tolist()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(one)

    return run


def _by_batches(embed: Callable, skip: bool) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """The embedder fed with BATCH texts at a time. Where it fails, the batch's vectors are null, or the error is raised; the next batch starts it anew."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        feed: list[pd.Series] = []

        def waiting() -> Iterator[pd.Series]:
            while feed:
                yield feed.pop()

        worker = embed(waiting())
        for texts in batches:
            done = []
            for at in range(0, len(texts), BATCH):
                part = texts.iloc[at : at + BATCH].reset_index(drop=True)
                feed.append(part)
                try:
                    done.append(next(worker))
                except Exception:
                    if not skip:
                        raise
                    feed.clear()
                    done.append(pd.Series([None] * len(part), dtype=object))
                    worker = embed(waiting())
            yield pd.concat(done, ignore_index=True) if done else pd.Series([], dtype=object)

    return run


def split_changes(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Every node_id of either side with its state: reused, recompute or deleted. Both have node_id and content_hash."""
    a, b = current.select("node_id", F.col("content_hash").alias("new")), prior.select("node_id", F.col("content_hash").alias("old"))
    state = F.when(F.col("new").isNull(), "deleted").when(F.col("new").eqNullSafe(F.col("old")), "reused").otherwise("recompute")
    return a.join(b, "node_id", "full").select("node_id", state.alias("state"))


def build_index(nodes: DataFrame, prior: DataFrame | None, model: str, embed: Callable | None = None, on_error: str = "skip") -> DataFrame:
    """Records of all nodes: vectors of unchanged ones are taken over, others embedded in Arrow batches.

    Nodes of a batch that the embedder fails on have no record, so the next build tries them again; ``on_error="raise"`` ends the job instead.
    """
    own = nodes.withColumn("embed_text", embed_text(nodes))
    own = own.withColumn("content_hash", content_hash(F.col("kind"), F.col("label"), F.col("embed_text"), model))
    # Not deterministic as far as Spark may know: the filter below must not embed a second time.
    run = F.pandas_udf(_by_batches(embed or hashing_embedder(), on_error == "skip"), "array<float>").asNondeterministic()
    snippet = F.col("snippet") if "snippet" in nodes.columns else F.lit("")
    columns = [F.col("id").alias("node_id"), "kind", "label", "path", snippet.alias("snippet"), "content_hash"]

    def embedded(rows: DataFrame) -> DataFrame:
        return rows.select(*columns, run("embed_text").alias("vector"), "ord").filter("vector IS NOT NULL")

    if prior is None:
        return embedded(own)
    old = prior.select(F.col("node_id").alias("id"), "content_hash", F.col("vector").alias("known"))
    kept = own.join(old, ["id", "content_hash"], "inner").select(*columns, F.col("known").alias("vector"), "ord")
    return kept.unionByName(embedded(own.join(old.select("id", "content_hash"), ["id", "content_hash"], "left_anti")))


def snippet_expected(kind: Column, path: Column) -> Column:
    return ~kind.isin(*VIRTUAL) & ~((kind == "module") & path.isNull())


def graph_hash(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def check_manifest(manifest: dict | None, model: str | None = None, dim: int | None = None, current_hash: str | None = None) -> tuple[str | None, list[str]]:
    """(error, warnings): version, model and dimension must fit; another graph is only a warning."""
    if manifest is None:
        return "missing", []
    if manifest.get("schema_version") != SCHEMA_VERSION:
        return "corrupt: schema version", []
    if model is not None and manifest.get("model") != model:
        return f"corrupt: built with {manifest.get('model')}", []
    if dim is not None and manifest.get("dim") != dim:
        return "corrupt: dimension", []
    stale = current_hash is not None and manifest.get("graph_hash") != current_hash
    return None, ["the graph has changed since the index was built"] if stale else []
