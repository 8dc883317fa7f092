"""Questions over the code-intelligence tables: symbols, calls, flows, branches, impacts, policies."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.graph import Graph
from loomgraph.schema import RECEIVERS, SENDERS
from loomgraph.sources.tables import materialize

# How kinds are ordered in answers, and how many rows and steps answers have.
SYMBOL_RANK = {"method": 0, "function": 0, "class": 1, "interface": 1, "type": 1, "dto": 1, "db-entity": 1, "field": 2, "param": 3}
SINK_RANK = {"db": 0, "message": 1, "http": 2, "job": 3, "log": 4}
IMPACT_RANK = {"field": 1, "type": 2, "call": 3, "import": 4, "delegation": 5}
RISK_RANK = {"low": 0, "medium": 1, "high": 2}
MOST_CALLS, DEPTH, MOST_DEPTH, EXCEPTION_DEPTH, NEAR_LINES = 40, 5, 20, 10, 2
AUDIT_FIELDS = ("id", "createdAt", "updatedAt", "deletedAt", "createdBy", "updatedBy")
GENERATED = r"(^|/)(generated|__generated__|dist)/|\.generated\.|\.pb\.ts$"


@dataclass(frozen=True)
class CodeIntel:
    symbols: DataFrame
    calls: DataFrame
    flows: DataFrame
    branches: DataFrame
    impacts: DataFrame
    policies: DataFrame


def rank_of(column: Column, order: Mapping[str, int], default: int) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in order.items()], F.lit(default))


def name_matches(column: Column, name: str) -> Column:
    """Equal, the last parts, or anywhere inside."""
    return (column == name) | column.endswith(f".{name}") | column.contains(name)


def file_matches(column: Column, file: str) -> Column:
    return (column == file) | column.endswith(f"/{file}")


def collision_groups(rows: DataFrame) -> DataFrame:
    """Names (fqn) of several rows, by what kind of collision they are. rows: fqn, owner, noise."""
    grouped = rows.groupBy("fqn").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("owners"), F.bool_and("noise").alias("noise"))
    kind = F.when(F.col("noise"), "structural-noise").when(F.col("owners") > 1, "cross-service").otherwise("intra-service")
    return grouped.filter("n > 1").select("fqn", "n", "owners", kind.alias("class"))


def self_check(ix: CodeIntel) -> tuple[str, DataFrame]:
    """Status and the collisions of symbol names.

    Audit fields, generated files and constructors are structural noise; names whose
    members only delegate are harmless; the rest is across services, within one, or of
    classes. Status is ``ok`` without the latter three, ``degraded`` with any across
    services or of classes that something refers to, else ``warning``.
    """
    prefix = F.regexp_extract("file", r"((?:apps|libs)/[^/]+)", 1)
    noise = F.col("name").isin(*AUDIT_FIELDS, "constructor") | F.col("file").rlike(GENERATED) | F.col("kind").isin("param")
    used = ix.calls.select(F.col("callee_id").alias("id")).union(ix.impacts.select(F.col("symbol_id").alias("id"))).distinct().withColumn("used", F.lit(True))
    own = ix.symbols.join(used, "id", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    # A class counts as used if one of its members is.
    by_child = own.filter("used AND parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("by_child", F.lit(True))
    own = own.join(by_child, "id", "left").withColumn("used", F.col("used") | F.coalesce("by_child", F.lit(False)))
    grouped = own.groupBy("fqn").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(prefix).alias("owners"), F.bool_and(noise).alias("noise"), F.bool_and(F.coalesce(F.col("override_kind") == "delegation", F.lit(False))).alias("delegates"),
        F.bool_or(F.col("kind").isin("class", "dto", "db-entity")).alias("classes"), F.bool_or("used").alias("used"), F.array_sort(F.collect_set("file")).alias("files"),
    ).filter("n > 1")
    kind = F.when(F.col("noise"), "structural-noise").when(F.col("delegates"), "delegation-only").when(F.col("classes"), "class-level").when(F.col("owners") > 1, "cross-service").otherwise("intra-service")
    out = materialize(grouped.select("fqn", "n", "owners", "used", kind.alias("class"), F.slice("files", 1, 5).alias("files")))
    worst = out.agg(F.bool_or((F.col("used")) & F.col("class").isin("cross-service", "class-level")).alias("bad"), F.bool_or(F.col("class").isin("cross-service", "class-level", "intra-service")).alias("some")).first()
    return "degraded" if worst["bad"] else "warning" if worst["some"] else "ok", out


def orientation(ix: CodeIntel) -> dict:
    """How many apps and libs there are, and the three policies that are surest."""
    owner = ix.symbols.select(F.regexp_extract("file", r"(apps|libs)/([^/]+)", 1).alias("kind"), F.regexp_extract("file", r"(apps|libs)/([^/]+)", 2).alias("name")).filter("kind <> ''")
    counts = {r["kind"]: r["n"] for r in owner.groupBy("kind").agg(F.countDistinct("name").alias("n")).collect()}  # two rows at most
    top = [r.asDict() for r in ix.policies.orderBy(F.desc("confidence"), "id").limit(3).collect()]
    return {"apps": counts.get("apps", 0), "libs": counts.get("libs", 0), "policies": top}


def resolve_symbol(ix: CodeIntel, name: str, limit: int = 10) -> DataFrame:
    hits = ix.symbols.filter(name_matches(F.col("fqn"), name) | name_matches(F.col("name"), name))
    delegates = F.coalesce(F.col("override_kind") == "delegation", F.lit(False))
    return hits.orderBy(delegates, rank_of(F.col("kind"), SYMBOL_RANK, 4), F.length("fqn"), "fqn", "file", "line").limit(limit)


def file_outline(ix: CodeIntel, file: str) -> DataFrame:
    return ix.symbols.filter(file_matches(F.col("file"), file) & ~F.col("kind").isin("param")).orderBy("line", "column").select("kind", "name", "fqn", "line", "end_line", "signature", "parent_id")


def type_definition(ix: CodeIntel, name: str, most: int = 50) -> tuple[DataFrame, bool]:
    """Members of a type with those it inherits, the nearest definition of each; and whether the chain of bases breaks off.

    The chain is walked a base at a time: a short list of ids, each step a filter of the symbols.
    """
    kinds = ("class", "interface", "type", "dto", "db-entity")
    start = resolve_symbol(CodeIntel(ix.symbols.filter(F.col("kind").isin(*kinds)), *[None] * 5), name, 1).first()
    chain, cut = ([], False) if start is None else ([start], False)
    while chain and chain[-1]["extends_class"] and len(chain) < most:
        base = chain[-1]["extends_class"]
        found = ix.symbols.filter(F.col("kind").isin(*kinds) & ((F.col("id") == base) | (F.col("name") == base))).orderBy(F.col("file") != chain[-1]["file"], "file", "line").first()
        if found is None or found["id"] in {c["id"] for c in chain}:
            cut = True
            break
        chain.append(found)
    spark = ix.symbols.sparkSession
    levels = spark.createDataFrame([(c["id"], n, c["name"]) for n, c in enumerate(chain)], "parent_id string, depth int, defined_in string")
    members = ix.symbols.join(F.broadcast(levels), "parent_id")  # a row for each base
    nth = F.row_number().over(W.partitionBy("name").orderBy("depth", "line"))
    nearest = members.withColumn("nth", nth).filter("nth = 1").select("name", "kind", "type", "return_type", "signature", "defined_in", "depth", "file", "line")
    return nearest.orderBy("depth", "line", "name"), cut


def references(ix: CodeIntel, name: str, limit: int = 50) -> DataFrame:
    """Calls, members that delegate to it, impacts and flows, by file and line."""
    calls = ix.calls.filter(name_matches(F.col("callee"), name)).select(F.lit("call").alias("kind"), F.col("caller").alias("by"), F.col("expression").alias("detail"), "file", "line")
    base = ix.symbols.filter(name_matches(F.col("fqn"), name)).select(F.col("id").alias("inherits_from"))
    wrap = ix.symbols.filter("override_kind = 'delegation'").join(base, "inherits_from", "left_semi").select(F.lit("delegation").alias("kind"), F.col("fqn").alias("by"), F.col("signature").alias("detail"), "file", "line")
    impacts = ix.impacts.filter(name_matches(F.col("symbol"), name)).select(F.concat(F.lit("impact:"), "kind").alias("kind"), F.col("symbol").alias("by"), "detail", "file", "line")
    flows = ix.flows.filter(name_matches(F.col("target"), name)).select(F.lit("flow").alias("kind"), F.col("source").alias("by"), F.col("via").alias("detail"), "file", "line")
    return calls.unionByName(wrap).unionByName(impacts).unionByName(flows).orderBy("file", "line", "kind", "by").limit(limit)


def data_flow(ix: CodeIntel, target: str, param: str | None = None, limit: int = 10) -> DataFrame:
    hits = ix.flows.filter(name_matches(F.col("target"), target))
    hits = hits.filter(F.col("param") == param) if param else hits
    return hits.orderBy(rank_of(F.col("sink_kind"), SINK_RANK, 5), "line", "id").limit(limit)


def branch_at(ix: CodeIntel, file: str, line: int) -> DataFrame:
    near = F.abs(F.col("line") - line)
    return ix.branches.filter(file_matches(F.col("file"), file) & (near <= NEAR_LINES)).orderBy(near, "line", "column")


def _entries(ix: CodeIntel, entry: str) -> list[str]:
    found = resolve_symbol(CodeIntel(ix.symbols.filter(F.col("kind").isin("method", "function")), *[None] * 5), entry, 1).first()
    if found is None:
        text = F.concat_ws(" ", "signature", F.array_join("decorators", " "))
        found = ix.symbols.filter(F.col("kind").isin("method", "function") & text.contains(entry)).orderBy("file", "line").first()
    return [found["id"]] if found else []


def _walkable(ix: CodeIntel, entry: str, depth: int) -> tuple[str | None, dict[str, list]]:
    """Entry and the calls of what it reaches within ``depth``, MOST_CALLS a caller: more of one caller's calls can't be shown."""
    start = _entries(ix, entry)
    if not start:
        return None, {}
    inside = ix.calls.filter("kind IS NULL OR kind IN ('internal', 'super-call')")
    nth = F.row_number().over(W.partitionBy("caller_id").orderBy("order", "id"))
    by_caller: dict[str, list] = {}
    front = start
    for _ in range(depth):
        front = [x for x in front if x not in by_caller][: MOST_CALLS * MOST_CALLS]
        if not front:
            break
        rows = inside.filter(F.col("caller_id").isin(front)).withColumn("nth", nth).filter(F.col("nth") <= MOST_CALLS).orderBy("caller_id", "nth").toLocalIterator()
        for x in front:
            by_caller[x] = []
        for r in rows:
            by_caller[r["caller_id"]].append(r)
        front = list(dict.fromkeys(r["callee_id"] for x in front for r in by_caller[x] if r["callee_id"]))
    return start[0], by_caller


def trace(ix: CodeIntel, entry: str, max_depth: int = DEPTH) -> list[dict]:
    """Calls in the order they are made, MOST_CALLS in all, with the conditions on the way; a function isn't entered again on its own path."""
    depth = min(max_depth, MOST_DEPTH)
    start, by_caller = _walkable(ix, entry, depth)
    out: list[dict] = []

    def walk(node: str, left: int, on_path: frozenset[str], conditions: tuple[str, ...]) -> None:
        for r in by_caller.get(node, []):
            if len(out) >= MOST_CALLS:
                return
            own = (*conditions, *(r["conditions"] or []))
            out.append({"depth": depth - left + 1, "caller": r["caller"], "callee": r["callee"], "expression": r["expression"], "conditions": list(own), "file": r["file"], "line": r["line"]})
            to = r["callee_id"]
            if to and left > 1 and to not in on_path:
                walk(to, left - 1, on_path | {to}, own)

    if start:
        walk(start, depth, frozenset([start]), ())
    return out


def exceptions(ix: CodeIntel, entry: str) -> DataFrame:
    """``throw`` and ``return`` exits of all that an entry reaches, told apart by exit_kind."""
    start, by_caller = _walkable(ix, entry, EXCEPTION_DEPTH)
    ids = list(by_caller) or [start or ""]
    reached = ix.branches.filter(F.col("function_id").isin(ids))
    text = F.trim("then_text")
    kind = F.when(text.startswith("throw"), "throw").when(text.startswith("return"), "return")
    return reached.withColumn("exit_kind", kind).filter("exit_kind IS NOT NULL").select("exit_kind", "function_name", "condition", "then_text", "file", "line").orderBy("file", "line")


def message_flow(ix: CodeIntel, graph: Graph, pattern: str) -> list[dict]:
    """Who sends a subject, who handles it, and the calls of each handler."""
    name = F.regexp_replace("subject", "^(nats|rmq|queue):", "")
    sends, hears = F.col("kind").isin(*SENDERS), F.col("kind").isin(*RECEIVERS, "rmq-subscribe")
    edges = graph.edges.filter(sends | hears).withColumn("subject", F.when(sends, F.col("dst")).otherwise(F.col("src")))
    hits = edges.filter(name.contains(pattern) | F.lit(pattern).contains(name)).orderBy("ord").limit(MOST_CALLS)
    out = []
    for r in hits.select("*", F.get_json_object("meta", "$.method").alias("m"), F.get_json_object("meta", "$.handlerName").alias("h"), F.get_json_object("meta", "$.enclosingClass").alias("c")).collect():
        sender = r["kind"] in SENDERS
        who = r["m"] or r["h"] or r["c"] or (r["src"] if sender else r["dst"])
        out.append({"role": "publisher" if sender else "handler", "subject": r["subject"], "owner": r["src"] if sender else r["dst"], "method": who, "file": r["file"], "line": r["line"], "calls": [] if sender else trace(ix, who)})
    return out


def contract_impact(ix: CodeIntel, symbol: str, field: str | None = None, limit: int = 50) -> DataFrame:
    """Uses of a type or field by kind, file and line, and those that reach it through members that delegate."""
    own = ix.impacts.filter(name_matches(F.col("symbol"), symbol))
    own = own.filter(F.col("field").isNull() | (F.col("field") == field)) if field else own
    rows = own.select("symbol", "field", "kind", "detail", "risk", "file", "line", F.lit("direct").alias("reason"))
    base = ix.symbols.filter(name_matches(F.col("fqn"), symbol)).select(F.col("id").alias("inherits_from"))
    wraps = ix.symbols.filter("override_kind = 'delegation'").join(base, "inherits_from", "left_semi")
    through = wraps.select(F.col("fqn").alias("symbol"), F.lit(None).cast("string").alias("field"), F.lit("delegation").alias("kind"), F.col("signature").alias("detail"), F.lit("medium").alias("risk"), "file", "line", F.lit("delegates").alias("reason"))
    rank = rank_of(F.col("kind"), ({"field": 0} if field else {}) | {k: v for k, v in IMPACT_RANK.items() if not (field and k == "field")}, 6)
    return rows.unionByName(through).orderBy(rank, "file", "line").limit(limit)


def policies(ix: CodeIntel) -> DataFrame:
    return ix.policies.orderBy("kind", F.desc("confidence"), "id")


def blueprint(ix: CodeIntel, kind: str, limit: int = 3) -> DataFrame:
    """The best examples of a kind, with how many members and decorators they have."""
    members = ix.symbols.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    best = ix.symbols.filter(F.col("kind") == kind).orderBy(F.desc("quality_score"), "file", "line").limit(limit)
    return best.join(members, "id", "left").select("fqn", "file", "line", "quality_score", "decorators", F.coalesce("members", F.lit(0)).alias("members")).orderBy(F.desc("quality_score"), "file", "line")


def suggest_placement(ix: CodeIntel, name: str, kind: str) -> list[dict]:
    rows = ix.policies.filter((F.col("kind") == "placement") & F.col("rule").startswith(f"{kind}:")).orderBy(F.desc("confidence"), "id").limit(3).collect()
    return [{"folder": r["rule"].split(":", 1)[1], "name": name, "confidence": r["confidence"]} for r in rows]


def validate_proposal(kind: str, imports: list[str]) -> list[str]:
    """A controller should not import a repository."""
    if kind != "controller":
        return []
    return [f"a controller imports the repository {x}; go through a service" for x in imports if "repository" in x.lower()]


def diagnostics(ix: CodeIntel, top: int = 10) -> tuple[float, DataFrame]:
    """Share of calls that are resolved, to 4 decimals, and the largest groups of the others with five examples and the greatest risk."""
    done = F.col("callee_id").isNotNull()
    n = ix.calls.agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done")).first()
    share = round(n["done"] / n["n"], 4) if n["n"] else 0.0
    open_ = ix.calls.filter(~done).withColumn("receiver", F.coalesce("receiver", F.lit("(none)")))
    risk = ix.impacts.groupBy("file").agg(F.max(rank_of(F.col("risk"), RISK_RANK, 0)).alias("risk"))
    # Summed by file before the risks are looked up, and cut to the largest groups before any example is.
    by_file = open_.groupBy("receiver", "file").agg(F.count(F.lit(1)).alias("n"))
    grouped = by_file.join(risk, "file", "left").groupBy("receiver").agg(F.sum("n").alias("n"), F.coalesce(F.max("risk"), F.lit(0)).alias("risk"))
    largest = grouped.orderBy(F.desc("n"), "receiver").limit(top)
    nth = F.row_number().over(W.partitionBy("receiver").orderBy("file", "line"))
    first = open_.select("receiver", "file", "line").join(largest.select("receiver"), "receiver", "left_semi").withColumn("nth", nth).filter("nth <= 5")
    examples = first.groupBy("receiver").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(":", "file", F.col("line").cast("string")).alias("at")))), lambda x: x["at"]).alias("examples"))
    return share, largest.join(examples, "receiver").select("receiver", "n", "examples", "risk").orderBy(F.desc("n"), "receiver")
