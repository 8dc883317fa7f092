"""From source trees to a graph: scan, extract, map, assemble, judge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.names import page_route
from loomgraph.operators import docs, extract, mapping, match, truth
from loomgraph.plans.graph import Graph, assemble
from loomgraph.plans.paths import cycles
from loomgraph.schema import PART_ORDER
from loomgraph.sources import files as scans
from loomgraph.sources.stores import Config
from loomgraph.sources.tables import materialize


def site_tables(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """All sites of all domains, extracted once and written; each mapper then reads its own rows."""
    known = materialize(extract.constant_index(sources))
    return materialize(extract.extract(sources, list(extract.DOMAINS), known))


def map_all(sites: DataFrame, sources: DataFrame, owners: DataFrame, config: Config, aliases: list[tuple[str, str, int]]) -> dict[str, mapping.Parts]:
    """(nodes, edges, diagnostics) of every domain."""
    of = lambda d: sites.filter((F.col("domain") == d) & F.col("error").isNull())
    entity = of("entities").filter("subject IS NOT NULL").groupBy("subject").agg(F.min_by("pattern", "file").alias("table"))
    lookup = lambda df, c, name: df.join(entity.select(F.col("subject").alias(c), F.col("table").alias(name)), c, "left")
    access = lookup(of("repositories").withColumnRenamed("subject", "entity_class"), "entity_class", "table")
    related = of("relations").select("role", "subject", "detail", "enclosing_class", "flag", "pattern", "file", "line", "ord").withColumnsRenamed({"role": "decorator", "subject": "target_class", "enclosing_class": "owner_class", "detail": "property", "flag": "has_join_column", "pattern": "join_table"})
    related = lookup(lookup(related, "owner_class", "owner_table"), "target_class", "target_table")
    queues = of("queues").select("role", F.col("subject").alias("queue"), F.when(F.col("role") == "fails-into", F.col("detail")).alias("other"), F.when(F.col("role") == "listen", F.col("pattern")).alias("event"), F.col("number").alias("concurrency"), *[F.regexp_extract(F.coalesce("detail", F.lit("")), rf"\b{k}=(\d+)", 1).try_cast("int").alias(k) for k in ("delay", "attempts")], F.coalesce("flag", F.lit(False)).alias("repeat"), F.lit(False).alias("fail_over"), F.when(F.col("role") == "repeat", F.col("pattern")).alias("cron"), "file", "line", "ord")
    schedules = of("schedules").select(F.col("role").alias("category"), F.col("subject").alias("expression"), F.col("detail").alias("name"), F.col("pattern").alias("label"), F.coalesce("flag", F.lit(False)).alias("dynamic"), "file", "line", "ord")
    refs = of("di-modules").select(F.col("enclosing_class").alias("module"), F.col("role").alias("field"), F.col("method").alias("ref_kind"), F.col("subject").alias("ref_name"), "file", "line", "ord")
    uses = of("di-uses").select(F.col("enclosing_class").alias("class"), F.col("subject").alias("provider"), "file", "line", "ord")
    chain = of("di-chain").select(F.col("role").alias("kind"), F.col("pattern").alias("attached_to"), F.col("subject").alias("provider"), "file", "line", "ord")
    resolved = materialize(scans.resolve_imports(of("imports"), sources, aliases))
    imports = resolved.select("file", F.col("subject").alias("specifier"), "resolution_kind", "target_file", F.regexp_extract("pattern", "^[a-z]+", 0).alias("shape"), "line", "ord")
    front = of("front")
    named = lambda role: front.filter(F.col("role") == role).select("file", F.col("subject").alias("name"), "line", "ord")
    pages = sources.select("file", F.regexp_extract("file", r"^(.*?/?(?:src/)?(?:pages|app))/", 1).alias("root")).filter("root <> '' AND file RLIKE '[.](tsx|jsx)$'")
    pages = pages.withColumn("route", page_route(F.col("file"), F.col("root"))).filter("route IS NOT NULL").join(named("component").groupBy("file").agg(F.min_by("name", "ord").alias("name")), "file", "left")
    pages = pages.select("file", F.coalesce("name", F.initcap(F.regexp_extract("file", r"([^/]+)\.[a-z]+$", 1))).alias("name"), "route", F.lit(1).alias("line"), F.lit(0).cast("long").alias("ord"))
    renders = front.filter("role = 'renders'").select("file", F.col("detail").alias("component"), F.col("subject").alias("target"), "line", "ord")
    columns = lookup(of("columns").withColumnRenamed("enclosing_class", "entity_class"), "entity_class", "table").select("table", F.col("detail").alias("field"), F.col("pattern").alias("type"), F.col("flag").alias("nullable"), "file", "line", "ord")
    front_imports = imports.filter("specifier LIKE '.%' OR specifier LIKE '@%'")
    return {
        "nats": mapping.map_subjects(of("nats"), owners), "rmq": mapping.map_rmq(of("rmq"), owners), "typeorm": mapping.map_tables(access, related, owners), "bullmq": mapping.map_queues(queues, owners), "cron": mapping.map_schedules(schedules, owners),
        "di": mapping.map_modules(refs, uses, chain), "http": mapping.map_http(of("http"), owners, config.internal_services, config.env_services), "imports": mapping.map_imports(imports, owners, config.file_edges),
        "fe": mapping.map_front(named("component"), named("hook"), pages, renders, front_imports), "endpoint": mapping.map_endpoints(of("endpoint"), owners), "config": mapping.map_config(of("config"), owners), "entity-fields": mapping.map_fields(columns),
    }


def join_parts(parts: dict[str, mapping.Parts]) -> tuple[Graph, DataFrame]:
    """The graph of all parts in their fixed order, and all diagnostics."""
    numbered = [(n, parts[d]) for n, d in enumerate(PART_ORDER) if d in parts]
    with_part = lambda i: reduce(DataFrame.unionByName, [p[i].withColumn("part", F.lit(n)) for n, p in numbered])
    return assemble(with_part(0), with_part(1)), reduce(DataFrame.unionByName, [p[2] for _, p in numbered])


def build(spark: SparkSession, config: Config, aliases: list[tuple[str, str, int]] = ()) -> dict:
    """Graph, diagnostics, recall by domain, cycles and sites of a source tree.

    A cycle search that is given up leaves an empty list and an error; everything else stands.
    """
    sources = materialize(scans.scan_sources(spark, config.root, exclude=config.exclude))
    owners = materialize(scans.discover_owners(scans.tree(spark, config.root).select("file")))
    sites = site_tables(spark, sources)
    graph, notes = join_parts(map_all(sites, sources, owners, config, list(aliases)))
    markdown = scans.scan_markdown(spark, config.root, config.exclude)
    chunks = docs.split_markdown(markdown.filter("skipped IS NULL"), config.chunk_tokens)
    heading = F.coalesce(F.try_element_at("heading_chain", F.lit(-1)), F.lit("top"))
    slugged = docs.number_slugs(chunks.withColumn("heading", heading).withColumn("ord", F.col("start_line") * 1000 + F.col("chunk_index")), "file", "heading", "ord")
    doc_nodes = mapping.map_docs(slugged)
    graph = Graph(materialize(graph.nodes.unionByName(doc_nodes, allowMissingColumns=True)), materialize(graph.edges))
    found, error = cycles(graph.edges)
    report = match.multiset_recall(truth.truth(sources), truth.sites_by_role(sites), ["domain", "role", "file", "line"], ["domain", "role"])
    errors = sites.filter("error IS NOT NULL").select("domain", "file", "error")
    return {"graph": graph, "diagnostics": notes, "recall": report, "cycles": found, "cycle_error": error, "sites": sites, "skipped": errors, "docs_coverage": docs.coverage(chunks, markdown.filter("skipped IS NOT NULL").select("file"), markdown.select("file"))}
