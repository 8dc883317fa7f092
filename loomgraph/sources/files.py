"""Scans of source trees. Files are listed and read by Spark's own reader, so any store it knows will do."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = ("node_modules", "dist", ".git", "worktrees", "coverage", "build")
TESTS = r"\.(spec|test|e2e-spec)\.[jt]sx?$"
MOST_MARKDOWN = 1 << 20


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file, path, length, modified, content) below a folder; ``file`` is relative to it."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")
    file = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(base) + "/", "")
    return read.select(file.alias("file"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def _kept(files: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    inside = F.concat(F.lit("/"), "file")
    out = files
    for name in IGNORED:
        out = out.filter(~inside.contains(f"/{name}/"))
    for part in exclude:
        out = out.filter(~F.col("file").contains(part))
    return out


def scan_sources(spark: SparkSession, root: str, folders: tuple[str, ...] = ("apps", "libs"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(file, text) of the .ts and .tsx files to extract from: no tests, no declarations; ``exclude`` holds parts of paths."""
    files = _kept(tree(spark, root, "*.{ts,tsx}"), exclude)
    files = files.filter(~F.col("file").rlike(TESTS) & ~F.col("file").endswith(".d.ts"))
    if folders:
        files = files.filter(F.split("file", "/")[0].isin(*folders))
    return files.select("file", F.decode("content", "UTF-8").alias("text"))


def scan_truth(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) for the independent truth: .ts files only, tests left out as well."""
    files = _kept(tree(spark, root, "*.ts"), ())
    return files.filter(~F.col("file").rlike(TESTS)).select("file", F.decode("content", "UTF-8").alias("text"))


def scan_markdown(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), tracked: DataFrame | None = None, most: int = MOST_MARKDOWN) -> DataFrame:
    """(file, text, skipped): text without byte order mark and with plain line ends, or the reason it was skipped for."""
    files = _kept(tree(spark, root, "*.{md,mdx}"), ())
    outside = F.lit(False)
    for part in exclude:
        outside = outside | F.col("file").contains(part)
    if tracked is not None:
        files = files.join(tracked.select("file", F.lit(True).alias("tracked")), "file", "left")
    else:
        files = files.withColumn("tracked", F.lit(True))
    valid = F.expr("is_valid_utf8(cast(content as string))")
    raw = F.when(valid, F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(raw, "^\ufeff", ""), "\r\n", "\n")
    reason = F.when(outside, "excluded").when(F.col("tracked").isNull(), "not tracked").when(F.col("length") > most, "too large").when(~valid, "not UTF-8").when(~text.rlike(r"\S"), "empty")
    return files.select("file", F.when(reason.isNull(), text).alias("text"), reason.alias("skipped"))


def discover_owners(files: DataFrame) -> DataFrame:
    """(kind, id, root_dir) from (file): folders below apps are services, folders with a package file in libs are libs."""
    apps = files.select(F.regexp_extract("file", r"^(?:.*/)?apps/([^/]+)/", 1).alias("id"), F.regexp_extract("file", r"^((?:.*/)?apps/[^/]+)/", 1).alias("root_dir")).filter("id <> ''").distinct()
    marker = r"^((?:.*/)?libs/(.+))/(package\.json|project\.json|tsconfig\.lib\.json|src/index\.ts)$"
    libs = files.select(F.regexp_extract("file", marker, 2).alias("id"), F.regexp_extract("file", marker, 1).alias("root_dir")).filter("id <> ''").distinct()
    return apps.select(F.lit("service").alias("kind"), "id", "root_dir").unionByName(libs.select(F.lit("lib").alias("kind"), "id", "root_dir"))


def tolerant_json(text: str) -> dict:
    """JSON with comments and trailing commas."""
    from loomgraph.operators.extract import strip_comments

    return json.loads(re.sub(r",(\s*[}\]])", r"\1", strip_comments(text.removeprefix("\ufeff"))))


def alias_rows(text: str) -> list[tuple[str, str, int]]:
    """(key, target, rank) of a compiler config's path aliases; longer keys first, targets in order."""
    paths = (tolerant_json(text).get("compilerOptions") or {}).get("paths") or {}
    base = (tolerant_json(text).get("compilerOptions") or {}).get("baseUrl", ".")
    out = []
    for key in sorted(paths, key=lambda k: (-len(k), k)):
        for target in paths[key]:
            out.append((key, re.sub(r"^(\./)+", "", f"{base}/{target}").removeprefix("./"), len(out)))
    return out


PROBES = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def resolve_imports(sites: DataFrame, files: DataFrame, aliases: list[tuple[str, str, int]]) -> DataFrame:
    """Import sites (file, subject, pattern, line, ord) with resolution_kind and target_file.

    A specifier's candidate paths, in order, are joined with the files that there are; the
    first that exists counts. Nothing found: broken-relative or broken-alias; a specifier
    that is neither relative nor an alias is external; computed ones are dynamic-non-literal.
    """
    spec = F.col("subject")
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    relative = spec.startswith(".")

    def tidy(path):
        parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
        step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
        return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")

    stems = [F.when(relative, tidy(F.concat_ws("/", folder, spec)))]
    is_alias = F.lit(False)
    for key, target, _ in aliases:
        head = key.rstrip("*")
        fits = spec.startswith(head) if key.endswith("*") else spec == key
        is_alias = is_alias | fits
        stems.append(F.when(fits & ~relative, tidy(F.concat(F.lit(target.rstrip("*")), F.substring(spec, len(head) + 1, 10_000))) if key.endswith("*") else tidy(F.lit(target))))
    candidates = F.array(*[F.concat(s, F.lit(p)) for s in stems for p in PROBES])
    listed = sites.withColumn("__id", F.concat_ws(":", "file", "ord")).select("__id", "file", "subject", F.posexplode(candidates).alias("rank", "target_file")).filter("target_file IS NOT NULL AND target_file <> file")
    hits = listed.join(files.select(F.col("file").alias("target_file")).distinct(), "target_file").groupBy("__id").agg(F.min_by("target_file", "rank").alias("target_file"))
    out = sites.withColumn("__id", F.concat_ws(":", "file", "ord")).join(hits, "__id", "left").drop("__id")
    computed = F.col("pattern").endswith("non-literal")
    kind = F.when(computed, "dynamic-non-literal").when(F.col("target_file").isNotNull(), "resolved").when(relative, "broken-relative").when(is_alias, "broken-alias").otherwise("external")
    return out.withColumn("resolution_kind", kind)


def operations(files: DataFrame) -> DataFrame:
    """(operation_id, method, path, summary, error) of API descriptions in YAML or JSON, from (file, text)."""
    methods = ("get", "post", "put", "patch", "delete", "head", "options")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                try:
                    found = (yaml.safe_load(text or "") or {}).get("paths") or {}
                    rows += [(file, op.get("operationId"), m.upper(), path, op.get("summary"), None) for path, ops in found.items() for m, op in (ops or {}).items() if m in methods and isinstance(op, dict)]
                except (yaml.YAMLError, AttributeError) as e:
                    rows.append((file, None, None, None, None, str(e).split("\n")[0]))
            yield pd.DataFrame(rows, columns=["file", "operation_id", "method", "path", "summary", "error"])

    return files.select("file", "text").mapInPandas(run, "file string, operation_id string, method string, path string, summary string, error string")


LOCALES = ("ru", "en")


def messages(files: DataFrame) -> DataFrame:
    """(lang, key, value) of locale files (file, text): string leaves by dotted key.

    A language's file, or the files of its folder with their names as namespaces; Russian
    comes before English, others after by name, and the first language that has any is used alone.
    """
    pattern = r"(?:^|/)(?:messages|locales|i18n)/([a-z]{2}(?:-[A-Z]{2})?)(?:/([^/]+))?\.json$"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def leaves(prefix: str, value) -> Iterator[tuple[str, str]]:
            if isinstance(value, str):
                yield prefix, value
            elif isinstance(value, dict):
                for k, v in value.items():
                    yield from leaves(f"{prefix}.{k}" if prefix else k, v)

        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                m = re.search(pattern, file)
                try:
                    rows += [(m[1], k, v) for k, v in leaves("" if m[2] in (None, "translation") else m[2], json.loads(text or "{}"))]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["lang", "key", "value"])

    found = files.filter(F.col("file").rlike(pattern)).select("file", "text").mapInPandas(run, "lang string, key string, value string")
    rank = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(LOCALES)], F.lit(len(LOCALES)))
    best = found.agg(F.min(F.struct(rank.alias("r"), "lang")).alias("b")).select(F.col("b.lang").alias("lang"))
    return found.join(F.broadcast(best), "lang").groupBy("lang", "key").agg(F.min("value").alias("value"))


def resolve_strings(sites: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct texts of each file's localised keys: of a key's candidates (``placeholders``) the first that has a text."""
    listed = sites.select("file", "ord", F.posexplode("placeholders").alias("rank", "key"))
    hits = listed.join(texts.select("key", "value"), "key").groupBy("file", "ord").agg(F.min_by("value", "rank").alias("value"))
    return hits.groupBy("file").agg(F.array_sort(F.collect_set("value")).alias("strings"))
