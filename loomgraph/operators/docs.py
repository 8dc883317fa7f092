"""Markdown: frontmatter, sections by heading, slugs, and chunks of a token budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.names import base_slug

BUDGET = 100
SECTIONS = (
    "file string, heading_chain array<string>, heading_level int, start_line int, end_line int, char_count int, token_count int, "
    "was_split boolean, chunk_index int, chunk_of int, text string, error string"
)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")


def count_tokens(text: str) -> int:
    """Words and single marks; a stand-in for a model's tokenizer."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def frontmatter(text: str) -> tuple[dict, str, int, str | None]:
    """(fields, body, lines before the body, error). A bad header is an error, and the body stays."""
    lines = text.split("\n")
    if not lines or lines[0].rstrip() != "---":
        return {}, text, 0, None
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() in ("---", "...")), None)
    if end is None:
        return {}, text, 0, None
    body = "\n".join(lines[end + 1 :])
    try:
        found = yaml.safe_load("\n".join(lines[1:end])) or {}
        return (found if isinstance(found, dict) else {}), body, end + 1, None if isinstance(found, dict) else "not a mapping"
    except yaml.YAMLError as e:
        return {}, body, end + 1, str(e).split("\n")[0]


def sections(body: str, first_line: int = 1) -> list[dict]:
    """Sections in order: heading chain, level, first and last line, text. Headings in fences are text; text before any heading has level 0."""
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    now = {"chain": [], "level": 0, "start": first_line, "lines": []}
    fence: str | None = None

    def close(end: int) -> None:
        if now["level"] or any(x.strip() for x in now["lines"]):
            out.append({"chain": now["chain"], "level": now["level"], "start": now["start"], "end": end, "text": "\n".join(now["lines"])})

    def open_(level: int, title: str, start: int) -> None:
        nonlocal now
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        now = {"chain": [t for _, t in stack], "level": level, "start": start, "lines": []}

    lines = body.split("\n")
    for n, line in enumerate(lines, first_line):
        mark = _FENCE.match(line)
        if fence is not None:
            now["lines"].append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
            continue
        if mark:
            fence = mark[1]
            now["lines"].append(line)
            continue
        under = re.match(r"^ {0,3}(=+|-+)[ \t]*$", line)
        if under and now["lines"] and now["lines"][-1].strip() and not re.match(r"^\s*([-*+>|]|\d+\.)", now["lines"][-1]):
            title = now["lines"].pop().strip()
            close(n - 2)
            open_(1 if under[1][0] == "=" else 2, title, n - 1)
            continue
        head = _ATX.match(line)
        if head:
            close(n - 1)
            open_(len(head[1]), (head[2] or "").strip(), n)
            continue
        now["lines"].append(line)
    close(first_line + len(lines) - 1)
    return out


def pack(text: str, budget: int = BUDGET) -> list[str]:
    """Paragraphs in order, as many to a chunk as fit the budget; one that is too long is a chunk of its own."""
    chunks: list[list[str]] = []
    used = 0
    for part in (p for p in re.split(r"\n[ \t]*\n", text) if p.strip()):
        n = count_tokens(part)
        if chunks and used + n <= budget:
            chunks[-1].append(part)
            used += n
        else:
            chunks.append([part])
            used = n
    return ["\n\n".join(c) for c in chunks]


def _split_file(file: str, text: str, budget: int) -> Iterator[tuple]:
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    _, body, skipped, error = frontmatter(text)
    for s in sections(body, skipped + 1):
        chunks = pack(s["text"], budget) or [""]
        for i, chunk in enumerate(chunks):
            yield (file, s["chain"], s["level"], s["start"], s["end"], len(chunk), count_tokens(chunk), len(chunks) > 1, i, len(chunks), chunk, error)


def split_markdown(files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Sections and chunks of (file, text). Each file is split by itself, in Arrow batches."""
    names = [f.strip().split(" ")[0] for f in SECTIONS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for f, t in zip(batch["file"], batch["text"], strict=True) for r in _split_file(f, t or "", budget)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file", "text").mapInPandas(run, SECTIONS)


def number_slugs(rows: DataFrame, group: str, heading: str, order: str) -> DataFrame:
    """``slug``: the heading's base slug, with -1, -2, ... for later ones of a group in order."""
    based = rows.withColumn("__base", base_slug(F.col(heading)))
    nth = F.row_number().over(W.partitionBy(group, "__base").orderBy(order)) - 1
    return based.withColumn("__n", nth).withColumn("slug", F.when(F.col("__n") == 0, F.col("__base")).otherwise(F.concat_ws("-", "__base", F.col("__n").cast("string")))).drop("__base", "__n")


def pack_documents(docs: DataFrame, key: str, text: str, budget: int = BUDGET) -> DataFrame:
    """(file, chunk_index, token_count, char_count) of each text's chunks, its lines taken as paragraphs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, i, count_tokens(c), len(c)) for f, t in zip(batch["file"], batch["text"], strict=True) for i, c in enumerate(pack((t or "").replace("\n", "\n\n"), budget))]
            yield pd.DataFrame(rows, columns=["file", "chunk_index", "token_count", "char_count"])

    return docs.select(F.col(key).alias("file"), F.col(text).alias("text")).mapInPandas(run, "file string, chunk_index int, token_count int, char_count int")


def coverage(found: DataFrame, skipped: DataFrame, included: DataFrame) -> DataFrame:
    """Recall of a scan: distinct files with sections and files skipped for a reason, of those included."""
    n = included.select("file").distinct().agg(F.count(F.lit(1)).alias("n_truth"))
    done = found.select("file").union(skipped.select("file")).distinct().agg(F.count(F.lit(1)).alias("n_matched"))
    return n.join(F.broadcast(done)).withColumn("recall", F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("n_matched") / F.col("n_truth")))
