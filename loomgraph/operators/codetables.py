"""Code-intelligence tables from extracted sites: joins and aggregations, no parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators import match
from loomgraph.plans.codeintel import CodeIntel
from loomgraph.sources.tables import materialize

KINDS = ("dto", "db-entity", "class", "interface", "type")
SUFFIXES = ["Controller", "Service", "Module", "Dto", "Entity", "Processor", "Guard"]
SINKS = {"db": "repo|repository|entityManager|dataSource", "message": "client|nats|publisher", "http": "http|axios|fetch", "job": "queue|mail", "log": "logger|console"}


def fit(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a table in order, null where there is none."""
    names = [(c.rsplit(" ", 1)[0].strip(), c.rsplit(" ", 1)[1]) for c in ddl.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])


def symbol_table(sites: DataFrame) -> DataFrame:
    """Symbols with their parents, types and what they extend."""
    rows = sites.filter("domain = 'symbols' AND error IS NULL AND subject IS NOT NULL")
    symbol_id = F.concat(F.lit("symbol:"), "file", F.lit("#"), "subject", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
    is_type = F.col("role").isin("class", "dto", "db-entity")
    typed = F.regexp_extract("detail", r":\s*([\w$.<>\[\]| ]+?)\s*;?\s*$", 1)
    out = rows.select(
        symbol_id.alias("id"), F.col("role").alias("kind"), F.element_at(F.split("subject", r"\."), -1).alias("name"), F.col("subject").alias("fqn"), "file", "line", "column", F.col("number").alias("end_line"), F.col("pattern").alias("owner_name"),
        F.when(~is_type, F.col("detail")).alias("signature"), F.when((F.col("role") == "field") & (typed != ""), typed).alias("type"), F.col("flag").alias("is_async"), F.when(is_type, F.col("detail")).alias("extends_class"),
    )
    parents = out.filter(F.col("kind").isin("class", "dto", "db-entity")).groupBy(F.col("file"), F.col("name").alias("owner_name")).agg(F.min_by("id", "line").alias("parent_id"))
    out = out.join(parents, ["file", "owner_name"], "left")
    # What is documented by its type, short and not private says more.
    size = F.col("end_line") - F.col("line")
    quality = F.round((F.when(F.col("signature").contains(":"), 0.4).otherwise(0.1) + F.when(size.between(1, 60), 0.4).otherwise(0.2) + F.when(F.col("name").startswith("_"), 0.0).otherwise(0.2)), 4)
    return out.withColumn("quality_score", quality)


def with_heritage(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """inherits_from and override_kind of members that a base class has too.

    A member whose only call is ``super`` of the same name delegates; one with other calls
    beside it augments; one without it replaces. The nearest base that has the member counts;
    bases are found by name, those of the same file first, and followed for eight levels.
    """
    types = symbols.filter(F.col("kind").isin("class", "dto", "db-entity"))
    bases = types.select(F.col("name").alias("extends_class"), F.col("id").alias("base"), F.col("file").alias("base_file"), F.col("extends_class").alias("further"))
    level = types.filter("extends_class IS NOT NULL").select(F.col("id").alias("own"), "file", "extends_class")
    found = []
    for depth in range(1, 9):
        joined = level.join(bases, "extends_class")
        nearest = joined.groupBy("own", "file").agg(F.min_by(F.struct("base", "further"), F.struct((F.col("base_file") != F.col("file")).alias("far"), "base_file")).alias("b"))
        level = materialize(nearest.select("own", "file", F.col("b.base").alias("base"), F.col("b.further").alias("extends_class")).filter("own <> base"))
        found.append(level.select("own", "base", F.lit(depth).alias("depth")))
        level = level.filter("extends_class IS NOT NULL").select("own", "file", "extends_class")
        if level.isEmpty():
            break
    chain = reduce(DataFrame.unionByName, found)
    members = symbols.filter("kind IN ('method', 'field') AND parent_id IS NOT NULL")
    theirs = members.select(F.col("parent_id").alias("base"), "name", F.col("id").alias("base_id"))
    over = members.select(F.col("parent_id").alias("own"), "name", "id").join(chain, "own").join(theirs, ["base", "name"]).groupBy("id").agg(F.min_by("base_id", "depth").alias("inherits_from"))
    made = calls.groupBy(F.col("caller_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("kind") == "super-call")).alias("n_super"))
    kind = F.when(F.coalesce("n_super", F.lit(0)) == 0, "replaced").when(F.col("n") == F.col("n_super"), "delegation").otherwise("augmented")
    marked = over.join(made, "id", "left").select("id", "inherits_from", kind.alias("override_kind"))
    return symbols.join(marked, "id", "left")


def call_table(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with their targets: of ``this``, of fields and constructor parameters by type, of names in the file, then of unique names."""
    rows = sites.filter("domain = 'calls' AND error IS NULL")
    by_name = symbols.filter("kind IN ('method', 'function')")
    callers = by_name.groupBy("file", F.col("fqn").alias("detail")).agg(F.min_by(F.struct("id", "owner_name"), "line").alias("c"))
    rows = rows.join(callers, ["file", "detail"], "left")
    parts = F.split("subject", r"\.")
    first, last = parts[0], F.element_at(parts, -1)
    # Fields by declaration and by constructor parameters: (file, class, field) to a type.
    fields = symbols.filter("kind = 'field' AND type IS NOT NULL").select("file", F.col("owner_name").alias("cls"), F.col("name").alias("field"), F.col("type").alias("of"))
    built = symbols.filter("kind = 'method' AND name = 'constructor'").select("file", F.col("owner_name").alias("cls"), F.explode(F.regexp_extract_all("signature", F.lit(r"(?:private|public|protected|readonly)\s+(?:readonly\s+)?[\w$]+\s*\??\s*:\s*[\w$]+"), F.lit(0))).alias("p"))
    built = built.select("file", "cls", F.regexp_extract("p", r"([\w$]+)\s*\??\s*:", 1).alias("field"), F.regexp_extract("p", r":\s*([\w$]+)", 1).alias("of"))
    known = fields.unionByName(built).groupBy("file", "cls", "field").agg(F.min("of").alias("of"))
    own = rows.withColumn("cls", F.col("c.owner_name")).withColumn("field", F.when((first == "this") & (F.size(parts) > 2), parts[1]))
    own = own.join(known, ["file", "cls", "field"], "left")
    target = F.when((first == "this") & (F.size(parts) == 2), F.concat_ws(".", "cls", last)).when(F.col("of").isNotNull(), F.concat_ws(".", F.regexp_extract("of", r"^[\w$]+", 0), last)).when(F.size(parts) == 1, first).when(first == "super", F.lit(None)).otherwise(F.col("subject"))
    named = own.withColumn("fqn", target).withColumn("__id", F.concat(F.lit("call:"), "file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string")))
    there = by_name.select("fqn", F.col("id").alias("to"), F.col("file").alias("to_file"), "quality_score")
    ranked = named.select("__id", "file", "fqn").join(there, "fqn").groupBy("__id").agg(F.min_by("to", F.struct((F.col("to_file") != F.col("file")).alias("far"), (-F.col("quality_score")).alias("q"), "to")).alias("callee_id"), F.count(F.lit(1)).alias("choices"))
    out = named.join(ranked, "__id", "left")
    kind = F.when(F.col("role") == "super-call", "super-call").when(F.col("callee_id").isNotNull(), "internal").otherwise("external")
    args = F.split(F.regexp_replace(F.regexp_replace("pattern", r"^\(|\)$", ""), r"\s+", " "), ", ")
    return out.select(
        F.col("__id").alias("id"), F.col("c.id").alias("caller_id"), F.col("detail").alias("caller"), F.coalesce("fqn", "subject").alias("callee"), "callee_id", kind.alias("kind"), F.col("number").alias("order"), F.concat("subject", "pattern").alias("expression"),
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ".")).alias("receiver"), F.filter(args, lambda a: a != "").alias("args"), F.col("placeholders").alias("conditions"), "file", "line", "column",
    )


def branch_table(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    rows = sites.filter("domain = 'branches' AND error IS NULL")
    owners = symbols.filter("kind IN ('method', 'function')").groupBy("file", F.col("fqn").alias("detail")).agg(F.min("id").alias("function_id"))
    branch_id = F.concat(F.lit("branch:"), "file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
    return rows.join(owners, ["file", "detail"], "left").select(branch_id.alias("id"), "function_id", F.col("detail").alias("function_name"), F.col("subject").alias("condition"), F.col("pattern").alias("then_text"), "file", "line", "column")


def flow_table(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Parameters of a function that go on as arguments of its calls, with the parameter they become and the kind of sink."""
    params = symbols.filter("kind IN ('method', 'function') AND signature IS NOT NULL").select(F.col("id").alias("caller_id"), F.explode(F.regexp_extract_all("signature", F.lit(r"[(,]\s*(?:(?:private|public|protected|readonly)\s+)*([\w$]+)\s*\??\s*[:,)]"), F.lit(1))).alias("param")).distinct()
    inside = F.regexp_like(F.col("arg"), F.concat(F.lit(r"(^|[^\w$.])"), "param", F.lit(r"($|[^\w$])")))
    used = calls.select("*", F.posexplode("args").alias("position", "arg")).join(params, "caller_id").filter(inside)
    theirs = symbols.select(F.col("id").alias("callee_id"), F.regexp_extract_all("signature", F.lit(r"[(,]\s*(?:(?:private|public|protected|readonly)\s+)*([\w$]+)\s*\??\s*[:,)]"), F.lit(1)).alias("names"))
    to = used.join(theirs, "callee_id", "left")
    sink = F.coalesce(*[F.when(F.lower(F.coalesce("receiver", "callee")).rlike(p), F.lit(k)) for k, p in SINKS.items()], F.lit("call"))
    flow_id = F.concat(F.lit("flow:"), F.col("id"), F.lit(":"), F.col("param"), F.lit(":"), F.col("position").cast("string"))
    return to.select(flow_id.alias("id"), F.col("caller_id").alias("target_id"), F.col("caller").alias("target"), "param", F.lit("param").alias("source_kind"), F.col("param").alias("source"), F.col("expression").alias("via"), F.col("callee").alias("to"), F.get("names", F.col("position")).alias("to_param"), sink.alias("sink_kind"), F.array("param", "callee").alias("path"), "file", "line", "column")


def impact_table(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Uses of types in signatures, and of their fields in expressions; of one line's uses of a symbol the weightiest stays."""
    types = symbols.filter(F.col("kind").isin(*KINDS)).groupBy(F.col("name").alias("word")).agg(F.min(F.struct("id", "fqn", "kind")).alias("t"))
    words = symbols.filter("signature IS NOT NULL").select("file", "line", "column", F.col("fqn").alias("by"), F.explode(F.array_distinct(F.regexp_extract_all("signature", F.lit(r"[A-Z][\w$]*"), F.lit(0)))).alias("word"))
    uses = words.join(types, "word").select(F.col("t.id").alias("symbol_id"), F.col("t.fqn").alias("symbol"), F.lit(None).cast("string").alias("field"), F.lit("type").alias("kind"), F.col("by").alias("detail"), F.when(F.col("t.kind").isin("dto", "db-entity"), "high").otherwise("medium").alias("risk"), "file", "line", "column", F.lit(2).alias("weight"))
    fields = symbols.filter("kind = 'field'").select(F.col("name").alias("word"), F.col("owner_name").alias("owner")).join(types.select(F.col("word").alias("owner"), "t"), "owner")
    reads = calls.select("file", "line", "column", F.col("caller").alias("by"), F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"\.([a-z][\w$]*)\b(?!\s*\()"), F.lit(1)))).alias("word"))
    touched = reads.join(fields, "word").select(F.col("t.id").alias("symbol_id"), F.col("t.fqn").alias("symbol"), F.col("word").alias("field"), F.lit("field").alias("kind"), F.col("by").alias("detail"), F.lit("high").alias("risk"), "file", "line", "column", F.lit(1).alias("weight"))
    both = uses.unionByName(touched)
    best = both.groupBy("symbol_id", "file", "line").agg(F.min_by(F.struct("symbol", "field", "kind", "detail", "risk", "column"), F.struct("weight", "column", "detail")).alias("r"))
    return best.select(F.concat(F.lit("impact:"), "symbol_id", F.lit("@"), "file", F.lit(":"), F.col("line").cast("string")).alias("id"), "symbol_id", "r.*", "file", "line")


def policy_table(symbols: DataFrame, decorated: DataFrame | None = None) -> DataFrame:
    """Where kinds are placed, how their names end, and which decorators go together."""
    types = symbols.filter(F.col("kind").isin("class", "dto", "db-entity"))
    suffix = F.coalesce(*[F.when(F.col("name").endswith(s), F.lit(s)) for s in SUFFIXES], F.lit("class"))
    placed = types.select(F.lower(suffix).alias("kind"), F.regexp_replace(F.regexp_replace("file", "/[^/]*$", ""), "^(apps|libs)/[^/]+", "$1/*").alias("place"))
    rows = [match.placement_shares(placed, "kind", "place").select(F.lit("placement").alias("kind"), F.concat_ws(":", "kind", "place").alias("rule"), F.concat_ws(" ", F.lit("most"), "kind", F.lit("symbols are in"), "place").alias("description"), F.col("share").alias("confidence"), F.col("n").alias("count"), "total")]
    endings = match.suffix_shares(types, "kind", "name", SUFFIXES)
    rows.append(endings.select(F.lit("naming").alias("kind"), F.concat_ws(":", "kind", "suffix").alias("rule"), F.concat_ws(" ", F.lit("names of"), "kind", F.lit("symbols end in"), "suffix").alias("description"), F.col("share").alias("confidence"), F.col("n").alias("count"), "total"))
    if decorated is not None:
        pairs = match.association_rules(decorated, "symbol", "decorator")
        rows.append(pairs.select(F.lit("decorators").alias("kind"), F.concat_ws("+", "item", "other").alias("rule"), F.concat_ws(" ", "item", F.lit("comes with"), "other").alias("description"), "confidence", F.col("n").alias("count"), F.col("n_item").alias("total")))
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("id", F.concat_ws(":", F.lit("policy"), "kind", "rule"))


def code_intel(sites: DataFrame) -> CodeIntel:
    """All six tables, each written once."""
    symbols = materialize(fit(symbol_table(sites), schema.SYMBOLS))
    calls = materialize(fit(call_table(sites, symbols), schema.CALLS))
    symbols = materialize(fit(with_heritage(symbols.drop("inherits_from", "override_kind"), calls), schema.SYMBOLS))
    decorated = sites.filter("domain IN ('endpoint', 'di-chain') AND error IS NULL").select(F.concat_ws("#", "file", F.coalesce("handler", "pattern")).alias("symbol"), F.coalesce("method", "role").alias("decorator"))
    return CodeIntel(symbols, calls, materialize(fit(flow_table(calls, symbols), schema.FLOWS)), materialize(fit(branch_table(sites, symbols), schema.BRANCHES)), materialize(fit(impact_table(symbols, calls), schema.IMPACTS)), materialize(fit(policy_table(symbols, decorated), schema.POLICIES)))


SNIPPET, LONG_SNIPPET = 400, 800


def snippets(nodes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes with the text that stands for them: of a component, hook, page or module the symbol's lines, of an endpoint its handler's, of a section its chunk, else their label and settings.

    Texts are cut by code points at 400, of sections and files at 800; a class's name and
    field names lead its snippet and take a quarter of it at most.
    """
    body = F.expr("array_join(slice(split(text, '\\n'), line, greatest(1, end_line - line + 1)), '\\n')")
    fields = symbols.filter("kind IN ('field', 'method')").groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("members"))
    spans = symbols.join(fields, "id", "left").join(files.select("file", "text"), "file").select(F.col("file").alias("path"), F.col("name").alias("label"), "line", F.substring(F.concat_ws("\n", F.substring(F.concat_ws(" ", "name", "members"), 1, SNIPPET // 4), body), 1, SNIPPET).alias("snippet"))
    first = spans.groupBy("path", "label").agg(F.min_by("snippet", "line").alias("code"))
    key: Column = F.when(F.col("kind") == "endpoint", F.get_json_object("meta", "$.handler")).otherwise(F.col("label"))
    own = nodes.withColumn("__key", key).join(first.withColumnsRenamed({"path": "__path", "label": "__label"}), (F.col("path") == F.col("__path")) & (F.col("__key") == F.col("__label")), "left")
    text = F.coalesce("code", F.substring(F.concat_ws(" ", "label", "meta"), 1, SNIPPET))
    return own.withColumn("snippet", text).drop("__key", "__path", "__label", "code")


def job_types(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(queue, type) of consumers: the type argument of the job parameter of their methods, or of their base class's."""
    consumers = sites.filter("domain = 'queues' AND role = 'consume' AND subject IS NOT NULL").select("file", F.col("subject").alias("queue"))
    methods = symbols.filter("kind = 'method'").select("file", F.regexp_extract("signature", r"\bJob<\s*([\w$]+|\{[^}]*\})", 1).alias("type"), "owner_name")
    inline = F.when(F.col("type").startswith("{"), F.lit("<inline>")).otherwise(F.col("type"))
    direct = consumers.join(methods, "file").filter("type NOT IN ('', 'any', 'unknown')").select("queue", inline.alias("type"), "file")
    bases = symbols.filter("kind = 'class' AND extends_class IS NOT NULL").select("file", F.col("extends_class").alias("owner_name"))
    further = consumers.join(direct.select("file").distinct(), "file", "left_anti").join(bases, "file").join(methods.select("owner_name", "type"), "owner_name").filter("type NOT IN ('', 'any', 'unknown')").select("queue", inline.alias("type"), "file")
    return direct.unionByName(further).select("queue", "type").distinct()
