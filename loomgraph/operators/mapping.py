"""Site tables to nodes and edges, a function a domain.

Every function returns (nodes, edges, diagnostics). Sites have ``file``, ``line`` and
``ord``; owners are (kind, id, root_dir). Sites that give no edge are counted by reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.names import host_of

Parts = tuple[DataFrame, DataFrame, DataFrame]


def find_owner(rows: DataFrame, owners: DataFrame, path: str = "file") -> DataFrame:
    """Adds owner_kind and owner_id: the owner whose root is the path or a folder above it, services before libs, deepest first.

    Each folder above a path is a key of an equal join, so the owners are looked up and not
    compared one by one; paths are looked up once however many rows they have.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = rows.select(path).filter(F.col(path).isNotNull()).distinct().select(path, F.explode(above).alias("root_dir"))
    best = F.min_by(F.struct("kind", "id"), F.struct((F.col("kind") == "lib").alias("lib"), (-F.length("root_dir")).alias("size")))
    found = keys.join(owners.select("kind", "id", "root_dir"), "root_dir").groupBy(path).agg(best.alias("__o"))
    return rows.join(found, path, "left").withColumn("owner_kind", F.col("__o.kind")).withColumn("owner_id", F.col("__o.id")).drop("__o")


def owner_node(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def _nodes(df: DataFrame, kind: Column | str, node_id: Column, label: Column, path: Column | None = None, meta: Column | None = None) -> DataFrame:
    """One node for each id, from its first row."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None).cast("string")
    rows = df.select(node_id.alias("id"), kind.alias("kind"), label.alias("label"), (none if path is None else path).alias("path"), none.alias("anchor"), (none if meta is None else meta).alias("meta"), F.col("ord").cast("long").alias("ord"))
    return rows.filter("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("kind", "label", "path", "anchor", "meta", "ord"), "ord").alias("r")).select("id", "r.*")


def _owners(df: DataFrame) -> DataFrame:
    return _nodes(df.filter("owner_id IS NOT NULL"), F.col("owner_kind"), owner_node(F.col("owner_kind"), F.col("owner_id")), F.col("owner_id"))


def _edges(df: DataFrame, kind: Column | str, src: Column, dst: Column, by: Column | None = None, meta: Column | None = None, dynamic: Column | None = None, pattern: Column | None = None) -> DataFrame:
    """Edges with the id kind:src->dst and, if given, what else tells them apart; the first of an id stays."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None).cast("string")
    edge_id = F.concat(kind, F.lit(":"), src, F.lit("->"), dst)
    edge_id = edge_id if by is None else F.concat_ws(":", edge_id, by)
    rows = df.select(edge_id.alias("id"), src.alias("src"), dst.alias("dst"), kind.alias("kind"), (F.lit(False) if dynamic is None else dynamic).alias("dynamic"), (none if pattern is None else pattern).alias("subject_pattern"), "file", F.col("line").cast("int").alias("line"), (none if meta is None else meta).alias("meta"), F.col("ord").cast("long").alias("ord"))
    rows = rows.filter("src IS NOT NULL AND dst IS NOT NULL")
    return rows.groupBy("id").agg(F.min_by(F.struct("src", "dst", "kind", "dynamic", "subject_pattern", "file", "line", "meta", "ord"), "ord").alias("r")).select("id", "r.*")


def _diagnostics(df: DataFrame, domain: str, reason: Column) -> DataFrame:
    """Counts by reason, with up to five examples."""
    rows = df.withColumn("__reason", reason).filter("__reason IS NOT NULL")
    rows = rows.select(F.col("__reason").alias("reason"), "file", "line")
    counts = rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    # The limit by group works before the shuffle, so a frequent reason isn't gathered in one task.
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("reason").orderBy("file", "line"))).filter("nth <= 5")
    examples = first.groupBy("reason").agg(F.array_sort(F.collect_set(F.concat_ws(":", "file", F.col("line").cast("string")))).alias("examples"))
    return counts.join(examples, "reason").select(F.lit(domain).alias("domain"), "reason", "n", "examples")


def _own() -> Column:
    return F.when(F.col("owner_id").isNotNull(), owner_node(F.col("owner_kind"), F.col("owner_id")))


def map_subjects(sites: DataFrame, owners: DataFrame, prefix: str = "nats", kind: str = "nats-subject") -> Parts:
    """Senders point to the subject, receivers are pointed to by it: one edge a call site. Services without sites are nodes too."""
    own = find_owner(sites, owners)
    ok = own.filter(F.col("owner_id").isNotNull() & F.col("subject_kind").isin("literal", "pattern"))
    subject = F.concat(F.lit(f"{prefix}:"), "subject")
    sends = F.col("edge_kind").isin("nats-publish", "nats-request")
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    pattern = F.when(F.col("subject_kind") == "pattern", F.col("subject"))
    edges = _edges(ok, F.col("edge_kind"), F.when(sends, _own()).otherwise(subject), F.when(sends, subject).otherwise(_own()), by=place, pattern=pattern, dynamic=F.col("subject_kind") == "pattern")
    services = _nodes(owners.filter("kind = 'service'").withColumn("ord", F.lit(-1)), "service", owner_node(F.col("kind"), F.col("id")), F.col("id"), F.col("root_dir"))
    nodes = services.unionByName(_owners(ok)).unionByName(_nodes(ok, kind, subject, F.col("subject")))
    reason = F.when(F.col("owner_id").isNull(), "unowned").when(~F.col("subject_kind").isin("literal", "pattern"), F.col("subject_kind"))
    return nodes, edges, _diagnostics(own, prefix, reason)


def map_rmq(sites: DataFrame, owners: DataFrame) -> Parts:
    full = sites.withColumn("edge_kind", F.lit("rmq-subscribe")).withColumn("subject_kind", F.when(F.col("subject").isNull(), "unresolved").otherwise("literal"))
    return map_subjects(full, owners, "rmq", "rmq-pattern")


def map_tables(sites: DataFrame, relations: DataFrame, owners: DataFrame) -> Parts:
    """sites: entity_class, table; relations: decorator, owner_table, target_table, property, join_table, has_join_column."""
    own = find_owner(sites, owners)
    ok = own.filter("owner_id IS NOT NULL AND `table` IS NOT NULL")
    of = lambda c: F.concat(F.lit("db-table:"), F.col(c))
    access = _edges(ok, "db-access", _own(), of("table"))
    # The side that holds the key points to the other one.
    owns = (F.col("decorator") == "ManyToOne") | ((F.col("decorator") == "OneToOne") & F.col("has_join_column")) | ((F.col("decorator") == "ManyToMany") & F.col("join_table").isNotNull())
    rel = relations.filter(owns & F.col("target_table").isNotNull())
    related = _edges(rel, "db-relation", of("owner_table"), of("target_table"), by=F.col("property"), meta=F.to_json(F.struct("decorator", "property", "join_table")))
    nodes = [_owners(ok), _nodes(ok, "db-table", of("table"), F.col("table"))] + [_nodes(rel, "db-table", of(c), F.col(c)) for c in ("owner_table", "target_table", "join_table")]
    reason = F.when(F.col("owner_id").isNull(), "unowned").when(F.col("table").isNull(), "unknown entity")
    missed = _diagnostics(relations, "typeorm", F.when(F.col("target_table").isNull(), "unresolved relation"))
    return reduce(DataFrame.unionByName, nodes), access.unionByName(related), _diagnostics(own, "typeorm", reason).unionByName(missed)


def map_queues(sites: DataFrame, owners: DataFrame) -> Parts:
    """sites: role (produce, consume, register, listen, repeat, fails-into), queue, other, event, concurrency, delay, attempts, repeat, cron, fail_over.

    Settings of a queue merge over its registrations: flags by or, numbers by the first one
    given; a queue that is consumed without a set concurrency has 1. Listening on one's
    own queue is no edge.
    """
    own = find_owner(sites, owners)
    ok = own.filter("owner_id IS NOT NULL AND queue IS NOT NULL")
    queue = F.concat(F.lit("queue:"), "queue")
    role = F.col("role")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    place = F.struct("ord", F.concat_ws(":", "file", F.col("line").cast("string")).alias("at"))
    settings = ok.groupBy("queue").agg(*map(first, ("concurrency", "delay", "attempts")), F.bool_or("repeat").alias("repeat"), F.bool_or("fail_over").alias("fail_over"), F.array_sort(F.collect_set(F.when(role == "register", place))).alias("__at"), F.bool_or(role == "consume").alias("__used"), F.min("ord").alias("ord"))
    settings = settings.withColumn("concurrency", F.coalesce("concurrency", F.when(F.col("__used"), 1))).withColumn("declared_at", F.transform("__at", lambda x: x["at"]))
    meta = F.to_json(F.struct("concurrency", "delay", "attempts", "repeat", "fail_over", "declared_at"))
    nodes = _owners(ok).unionByName(_nodes(settings, "queue", queue, F.col("queue"), meta=meta))
    other = F.concat(F.lit("queue:"), "other")
    nodes = nodes.unionByName(_nodes(ok.filter("other IS NOT NULL"), "queue", other, F.col("other")))
    edges = [
        _edges(ok.filter(role == "produce"), "queue-produce", _own(), queue),
        _edges(ok.filter(role == "consume"), "queue-consume", queue, _own()),
        _edges(ok.filter((role == "listen") & ~F.coalesce(_own() == queue, F.lit(False))), "queue-event-listener", _own(), queue, by=F.col("event")),
        _edges(ok.filter((role == "fails-into") & (F.col("other") != F.col("queue"))), "queue-fails-into", queue, other),
        _edges(ok.filter((role == "repeat") & F.col("cron").isNotNull()), "queue-repeat", queue, F.concat(F.lit("cron-schedule:queue:"), "cron", F.lit(":"), "file", F.lit(":"), F.col("line").cast("string"))),
    ]
    reason = F.when(F.col("owner_id").isNull(), "unowned").when(F.col("queue").isNull(), "unresolved queue")
    return nodes, reduce(DataFrame.unionByName, edges), _diagnostics(own, "bullmq", reason)


def map_schedules(sites: DataFrame, owners: DataFrame) -> Parts:
    """sites: category, expression, name, label, dynamic. A schedule without a fixed owner of its expression has the owner in its id."""
    own = find_owner(sites, owners)
    ok = own.filter("owner_id IS NOT NULL AND expression IS NOT NULL")
    node = F.when(F.col("dynamic"), F.concat_ws(":", F.lit("cron-schedule"), "category", "owner_id", "expression")).otherwise(F.concat_ws(":", F.lit("cron-schedule"), "category", "expression"))
    nodes = _owners(ok).unionByName(_nodes(ok, "cron-schedule", node, F.coalesce("label", "expression"), meta=F.to_json(F.struct("category", "expression", "name"))))
    reason = F.when(F.col("owner_id").isNull(), "unowned").when(F.col("expression").isNull(), "unresolved expression")
    return nodes, _edges(ok, "cron-triggers", node, _own()), _diagnostics(own, "cron", reason)


def map_modules(refs: DataFrame, uses: DataFrame, chain: DataFrame) -> Parts:
    """refs: module, field, ref_kind, ref_name; uses: class, provider; chain: kind (guard ...), attached_to, provider.

    Guards, interceptors and pipes give an edge only if both ends are there already.
    """
    module, ref = F.concat(F.lit("module:"), "module"), F.col("ref_name")
    is_module = F.col("field") == "imports"
    target = F.when(is_module, F.concat(F.lit("module:"), ref)).otherwise(F.concat(F.lit("provider:"), ref))
    ok = refs.filter("ref_kind <> 'unresolved' AND ref_name IS NOT NULL")
    kind = F.coalesce(*[F.when(F.col("field") == f, F.lit(k)) for f, k in (("imports", "di-import"), ("providers", "di-provides"), ("exports", "di-exports"), ("controllers", "di-controller"))])
    edges = _edges(ok, kind, module, target, dynamic=F.col("ref_kind") == "dynamic")
    nodes = _nodes(refs, "module", module, F.col("module"), F.col("file")).unionByName(_nodes(ok, F.when(is_module, "module").otherwise("provider"), target, ref))
    provider = lambda c: F.concat(F.lit("provider:"), F.col(c))
    known = nodes.filter("kind = 'provider'").select("id").distinct()
    there = lambda df, c: df.withColumn("__id", provider(c)).join(known.withColumnRenamed("id", "__id"), "__id", "left_semi").drop("__id")
    used = there(there(uses, "class"), "provider")
    edges = edges.unionByName(_edges(used, "di-uses", provider("class"), provider("provider")))
    both = there(there(chain.withColumn("class", F.substring_index("attached_to", ".", 1)), "class"), "provider")
    edges = edges.unionByName(_edges(both, F.concat(F.lit("di-"), "kind"), provider("class"), provider("provider"), by=F.col("attached_to")))
    missed = chain.withColumn("__id", provider("provider")).join(known.withColumnRenamed("id", "__id"), "__id", "left_anti")
    notes = _diagnostics(refs.filter("field <> 'module'"), "di", F.when((F.col("ref_kind") == "unresolved") | F.col("ref_name").isNull(), "unresolved")).unionByName(_diagnostics(missed, "di", F.lit("unknown provider")))
    return nodes, edges, notes


def classify_url(url: Column, internal: dict[str, list[str]]) -> tuple[Column, Column]:
    """Target of a url: ``internal:<service>`` by the first service one of whose texts it holds, else external by host, else unresolved."""
    inside = [F.when(reduce(lambda a, b: a | b, [url.contains(t) for t in texts]), F.lit(f"internal:{name}")) for name, texts in internal.items() if texts]
    host = host_of(url)
    target = F.coalesce(*inside, F.when(host.isNotNull(), F.lit("external")), F.lit("unresolved"))
    return target, F.when(target == "external", host)


def map_http(sites: DataFrame, owners: DataFrame, internal: dict[str, list[str]], env_services: dict[str, str]) -> Parts:
    """sites: url_kind (literal, env-ref, pattern, unresolved), url, env_var, method."""
    own = find_owner(sites, owners)
    target, host = classify_url(F.col("url"), internal)
    by_env = F.coalesce(*[F.when(F.col("env_var") == k, F.lit(f"internal:{v}")) for k, v in env_services.items()], F.lit("unresolved"))
    own = own.withColumn("__target", F.when(F.col("url_kind") == "env-ref", by_env).when(F.col("url_kind").isin("literal", "pattern"), target).otherwise("unresolved")).withColumn("__host", F.when(F.col("url_kind") != "env-ref", host))
    ok = own.filter("owner_id IS NOT NULL AND __target <> 'unresolved'")
    inside = F.col("__target").startswith("internal:")
    node = F.when(inside, F.concat(F.lit("service:"), F.substring("__target", 10, 1000))).otherwise(F.concat(F.lit("external:"), "__host"))
    edges = _edges(ok, F.when(inside, "http-call").otherwise("http-external"), _own(), node, meta=F.to_json(F.struct("method", "url")))
    nodes = _owners(ok).unionByName(_nodes(ok, F.when(inside, "service").otherwise("external"), node, F.substring_index(node, ":", -1)))
    reason = F.when(F.col("owner_id").isNull(), "unowned").when(F.col("__target") == "unresolved", F.concat_ws(" ", F.lit("unresolved"), "url_kind"))
    return nodes, edges, _diagnostics(own, "http", reason)


def map_imports(sites: DataFrame, owners: DataFrame, file_edges: bool = False) -> Parts:
    """sites: file, specifier, resolution_kind, target_file, type_only, shape. Owner pairs are counted; a service, or any lib, that uses a service is an antipattern."""
    source = find_owner(sites, owners).withColumnRenamed("owner_kind", "a_kind").withColumnRenamed("owner_id", "a_id")
    both = find_owner(source, owners, "target_file").withColumnRenamed("owner_kind", "b_kind").withColumnRenamed("owner_id", "b_id")
    across = both.filter("a_id IS NOT NULL AND b_id IS NOT NULL AND (a_kind <> b_kind OR a_id <> b_id)")
    pairs = across.groupBy("a_kind", "a_id", "b_kind", "b_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("file", "line", "ord"), "ord").alias("at")).select("*", "at.*").drop("at")
    end = lambda x: owner_node(F.col(f"{x}_kind"), F.col(f"{x}_id"))
    edges = _edges(pairs, "lib-usage", end("a"), end("b"), meta=F.to_json(F.struct(F.col("n").alias("importCount"), (F.col("b_kind") == "service").alias("antipattern"))))
    nodes = _nodes(pairs, F.col("a_kind"), end("a"), F.col("a_id")).unionByName(_nodes(pairs, F.col("b_kind"), end("b"), F.col("b_id")))
    if file_edges:
        inside = both.filter("target_file IS NOT NULL")
        of = lambda c: F.concat(F.lit("file:"), F.col(c))
        flags = inside.groupBy("file", "target_file").agg(F.bool_or(F.col("shape") == "dynamic").alias("dynamic"), F.bool_or(F.col("shape") == "require").alias("cjsRequire"), F.min("line").alias("line"), F.min("ord").alias("ord"))
        edges = edges.unionByName(_edges(flags, "ts-import", of("file"), of("target_file"), meta=F.to_json(F.struct("dynamic", "cjsRequire"))))
        nodes = nodes.unionByName(_nodes(flags, "file", of("file"), F.col("file"), F.col("file"))).unionByName(_nodes(flags, "file", of("target_file"), F.col("target_file"), F.col("target_file")))
    reason = F.when(F.col("resolution_kind").startswith("broken"), F.col("resolution_kind")).when(F.col("a_id").isNull(), "unowned")
    return nodes, edges, _diagnostics(both, "imports", reason)


def map_front(components: DataFrame, hooks: DataFrame, pages: DataFrame, renders: DataFrame, imports: DataFrame) -> Parts:
    """components, hooks: file, name; pages: file, name, route; renders: file, component, target; imports: file, target_file."""
    node = lambda kind, name="name": F.concat(F.lit(f"{kind}:"), "file", F.lit("#"), name)
    route = F.concat(F.lit("fe-route:"), "route")
    nodes = [_nodes(components, "fe-component", node("fe-component"), F.col("name"), F.col("file")), _nodes(hooks, "fe-hook", node("fe-hook"), F.col("name"), F.col("file")), _nodes(pages, "fe-page", node("fe-page"), F.col("name"), F.col("file")), _nodes(pages, "fe-route", route, F.col("route"))]
    everything = reduce(DataFrame.unionByName, nodes)
    known = components.select(F.col("name").alias("target"), node("fe-component").alias("id"), F.col("file").alias("in_file"), F.col("ord").alias("at"))
    same = known.groupBy("target", "in_file").agg(F.min_by("id", "at").alias("same"))
    anywhere = known.groupBy("target").agg(F.min_by("id", "at").alias("other"))
    drawn = renders.join(same.withColumnRenamed("in_file", "file"), ["target", "file"], "left").join(anywhere, "target", "left").withColumn("to", F.coalesce("same", "other"))
    edges = [_edges(drawn.filter("to IS NOT NULL"), "fe-renders", node("fe-component", "component"), F.col("to")), _edges(pages, "fe-routes-to", route, node("fe-page"))]
    in_file = everything.filter("path IS NOT NULL").select("id", F.col("path"))
    links = imports.filter("target_file IS NOT NULL").join(in_file.select(F.col("id").alias("a"), F.col("path").alias("file")), "file").join(in_file.select(F.col("id").alias("b"), F.col("path").alias("target_file")), "target_file").filter("a <> b")
    edges.append(_edges(links, "fe-imports", F.col("a"), F.col("b")))
    return everything, reduce(DataFrame.unionByName, edges), _diagnostics(drawn, "fe", F.when(F.col("to").isNull(), "unknown component"))


def map_endpoints(sites: DataFrame, owners: DataFrame) -> Parts:
    """sites: method, pattern, controller, handler, version, status."""
    own = find_owner(sites, owners)
    ok = own.filter("owner_id IS NOT NULL")
    node = F.concat(F.lit("endpoint:"), "method", F.lit(" "), "pattern")
    meta = F.to_json(F.struct("method", "pattern", "controller", "handler", "version", "status"))
    nodes = _owners(ok).unionByName(_nodes(ok, "endpoint", node, F.concat_ws(" ", "method", "pattern"), F.col("file"), meta))
    return nodes, _edges(ok, "endpoint-of", node, _own()), _diagnostics(own, "endpoint", F.when(F.col("owner_id").isNull(), "unowned"))


def map_config(sites: DataFrame, owners: DataFrame) -> Parts:
    """sites: key, source."""
    own = find_owner(sites, owners)
    ok = own.filter("owner_id IS NOT NULL AND key IS NOT NULL")
    node = F.concat(F.lit("config-field:"), "key")
    reason = F.when(F.col("key").isNull(), "key is no literal").when(F.col("owner_id").isNull(), "unowned")
    return _owners(ok).unionByName(_nodes(ok, "config-field", node, F.col("key"), meta=F.to_json(F.struct("source")))), _edges(ok, "config-read-by", node, _own()), _diagnostics(own, "config", reason)


def map_fields(sites: DataFrame) -> Parts:
    """sites: table, field, type, nullable. The first of a table's fields of one name stays, the others are reported."""
    table, node = F.concat(F.lit("db-table:"), "table"), F.concat(F.lit("db-entity-field:"), "table", F.lit("/"), "field")
    ok = sites.filter("`table` IS NOT NULL")
    nodes = _nodes(ok, "db-table", table, F.col("table")).unionByName(_nodes(ok, "db-entity-field", node, F.col("field"), meta=F.to_json(F.struct("type", "nullable"))))
    nth = ok.withColumn("__nth", F.row_number().over(W.partitionBy("table", "field").orderBy("ord")))
    return nodes, _edges(ok, "entity-has-field", table, node), _diagnostics(nth, "entity-fields", F.when(F.col("__nth") > 1, "repeated field"))


def map_docs(sections: DataFrame) -> DataFrame:
    """sections: file, slug, heading_chain, heading_level, start_line, ord. Nodes only."""
    node = F.concat(F.lit("doc-section:"), "file", F.lit("#"), "slug")
    return _nodes(sections, "doc-section", node, F.coalesce(F.try_element_at("heading_chain", F.lit(-1)), F.col("file")), F.col("file"), F.to_json(F.struct("heading_chain", "heading_level", "start_line")))


def enrich_endpoints(endpoints: DataFrame, operations: DataFrame) -> DataFrame:
    """Endpoints (id, method, pattern, handler) with the API operation that names the handler, else that has the method and path.

    Path parameters are compared by place, ``:id`` and ``{id}`` alike. ``matched_by`` tells how; ``ambiguous`` whether several operations fit.
    """
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r":[^/]+|\{[^}/]+\}", ":_"), "/+$", "")
    ops = operations.select("operation_id", "summary", F.upper("method").alias("om"), shape(F.col("path")).alias("op"))
    pick = lambda keys: ops.groupBy(*keys).agg(F.min_by(F.struct("operation_id", "summary"), "operation_id").alias("o"), F.count(F.lit(1)).alias("n"))
    by_id = pick(["operation_id"]).select(F.col("operation_id").alias("handler"), F.col("o").alias("o1"), F.col("n").alias("n1"))
    by_path = pick(["om", "op"]).select("om", "op", F.col("o").alias("o2"), F.col("n").alias("n2"))
    out = endpoints.withColumn("om", F.upper("method")).withColumn("op", shape(F.col("pattern"))).join(by_id, "handler", "left").join(by_path, ["om", "op"], "left")
    how = F.when(F.col("o1").isNotNull(), "operation id").when(F.col("o2").isNotNull(), "path")
    return out.withColumn("operation", F.coalesce("o1", "o2")).withColumn("matched_by", how).withColumn("ambiguous", F.coalesce(F.when(F.col("o1").isNotNull(), F.col("n1")).otherwise(F.col("n2")) > 1, F.lit(False))).drop("om", "op", "o1", "o2", "n1", "n2")


def enrich_jobs(queues: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queue nodes (id) with the distinct job data types of (queue, type)."""
    types = jobs.groupBy(F.concat(F.lit("queue:"), "queue").alias("id")).agg(F.array_sort(F.collect_set("type")).alias("job_types"))
    return queues.join(types, "id", "left")
