"""The graph operators' inputs, as projections of the driver's tables.

Ordinals come from primary keys, so what was seen first is the same on every run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.operators.codetables import fit
from loomgraph.operators.search import tokens
from loomgraph.plans.codeintel import CodeIntel
from loomgraph.plans.graph import Graph, first_by
from loomgraph.sources.tables import table

LISTENED = ("view", "click")


def _node(kind: str, node_id: Column, label: Column, order: Column, path: Column | None = None) -> list[Column]:
    nothing = F.lit(None).cast("string")
    return [node_id.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), (nothing if path is None else path).alias("path"), nothing.alias("anchor"), nothing.alias("meta"), order.cast("long").alias("ord")]


def _edge(kind: Column | str, src: Column, dst: Column, order: Column, file: Column | None = None, line: Column | None = None) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    nothing = F.lit(None).cast("string")
    return [
        F.concat(kind, F.lit(":"), src, F.lit("->"), dst, F.lit(":"), order.cast("string")).alias("id"), src.alias("src"), dst.alias("dst"), kind.alias("kind"), F.lit(False).alias("dynamic"), nothing.alias("subject_pattern"),
        (nothing if file is None else file).alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"), nothing.alias("meta"), order.cast("long").alias("ord"),
    ]


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users publish to and listen on the subject events.<type>.<user mod 10>; one edge for each event."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    subject = F.concat_ws(".", F.lit("nats:events"), "event_type", F.pmod("user_id", F.lit(10)).cast("string"))
    listens = F.col("event_type").isin(*LISTENED)
    user = key("service", "user_id")
    nodes = events.select(subject.alias("id"), F.col("event_id")).groupBy("id").agg(F.min("event_id").alias("n")).select(*_node("nats-subject", F.col("id"), F.substring("id", 6, 1000), F.col("n")))
    users = events.groupBy("user_id").agg(F.min("event_id").alias("n")).select(*_node("service", user, F.col("user_id").cast("string"), F.col("n")))
    kind = F.when(listens, "nats-subscribe").otherwise("nats-publish")
    edges = events.select(*_edge(kind, F.when(listens, subject).otherwise(user), F.when(listens, user).otherwise(subject), F.col("event_id"), F.col("event_type"), F.pmod("event_id", F.lit(1000))))
    return Graph(nodes.unionByName(users), edges)


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations and regions with their foreign keys; order lines once a pair, the first seen."""
    t = lambda name: table(spark, sf_dir, name)
    kinds = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("order", "o_orderkey", None)]
    names = {"order": "orders"}
    nodes = [t(names.get(k, k)).select(*_node(k, key(k, i), F.col(label) if label else F.col(i).cast("string"), F.col(i))) for k, i, label in kinds]
    links = [
        ("nation", "of-region", key("nation", "n_nationkey"), key("region", "n_regionkey"), F.col("n_nationkey"), 0),
        ("customer", "of-nation", key("customer", "c_custkey"), key("nation", "c_nationkey"), F.col("c_custkey"), 1),
        ("supplier", "of-nation", key("supplier", "s_suppkey"), key("nation", "s_nationkey"), F.col("s_suppkey"), 2),
        ("orders", "places", key("customer", "o_custkey"), key("order", "o_orderkey"), F.col("o_orderkey"), 3),
    ]
    big = 1 << 40
    edges = [t(name).select(*_edge(kind, src, dst, at.cast("long") + F.lit(n * big))) for name, kind, src, dst, at, n in links]
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    for n, (kind, a, b) in enumerate((("holds", ("order", "l_orderkey"), ("part", "l_partkey")), ("made-by", ("part", "l_partkey"), ("supplier", "l_suppkey"))), 4):
        pairs = t("lineitem").groupBy(a[1], b[1]).agg(F.min(place).alias("at"))
        edges.append(pairs.select(*_edge(kind, key(*a), key(*b), F.col("at") + F.lit(n * big))))
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers produce parts, one edge a pair with the first line's place; suppliers access the parts' brand tables."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    pairs = first_by(lines.withColumn("at", place), ["l_suppkey", "l_partkey"], F.col("at"))
    produce = pairs.select(*_edge("queue-produce", key("service", "l_suppkey"), key("queue", "l_partkey"), F.col("at"), F.col("l_orderkey").cast("string"), F.col("l_linenumber")))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brand = F.concat(F.lit("db-table:"), "p_brand")
    access = pairs.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.min("at").alias("at"))
    access = access.select(*_edge("db-access", key("service", "l_suppkey"), brand, F.col("at"), F.col("p_brand"), F.col("at") % 8))
    relation = parts.select(*_edge("db-relation", key("db-table", "p_partkey"), brand, F.col("p_partkey"), F.lit("part"), F.lit(0)))
    nodes = [
        table(spark, sf_dir, "supplier").select(*_node("service", key("service", "s_suppkey"), F.col("s_name"), F.col("s_suppkey"))),
        parts.select(*_node("queue", key("queue", "p_partkey"), F.col("p_partkey").cast("string"), F.col("p_partkey"))),
        parts.groupBy("p_brand").agg(F.min("p_partkey").alias("n")).select(*_node("db-table", brand, F.col("p_brand"), F.col("n"))),
    ]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, [produce, access, relation]))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search records: documents with the embedding of the same number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return docs.join(vectors, "doc_id").select(F.col("doc_id").cast("string").alias("node_id"), F.col("lang").alias("kind"), F.col("source").alias("label"), F.lit("").alias("path"), F.col("text").alias("snippet"), "vector", F.col("doc_id").alias("ord"))


def token_rows(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))


def code_tables(spark: SparkSession, sf_dir: str) -> CodeIntel:
    """Parts as symbols in files of their brand and type, order lines as calls from parts to suppliers."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    number = F.col("p_partkey").cast("string")
    kind = F.when(F.col("p_size") <= 10, "method").when(F.col("p_size") <= 30, "class").otherwise("field")
    file = F.concat(F.when(F.col("p_partkey") % 2 == 0, "apps/").otherwise("libs/"), "p_brand", F.lit("/src/"), F.lower("p_type"), F.lit(".ts"))
    symbols = part.select(F.concat(F.lit("symbol:"), number).alias("id"), kind.alias("kind"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("fqn"), file.alias("file"), F.col("p_partkey").alias("line"), F.round(F.col("p_retailprice") / 10000, 6).alias("quality_score"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    supplier, own = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    calls = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("id"), F.concat(F.lit("symbol:"), own).alias("caller_id"), F.concat(F.lit("f"), own).alias("caller"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("symbol:"), supplier)).alias("callee_id"),
        F.concat(F.lit("Supplier"), supplier).alias("callee"), F.lit("internal").alias("kind"), F.col("l_orderkey").alias("order"), F.col("l_linestatus").alias("receiver"), F.concat(F.lit("apps/o"), (F.col("l_orderkey") % 100).cast("string"), F.lit(".ts")).alias("file"), F.col("l_linenumber").alias("line"),
    )
    none = lambda ddl: spark.createDataFrame([], ddl)
    return CodeIntel(fit(symbols, schema.SYMBOLS), fit(calls, schema.CALLS), none(schema.FLOWS), none(schema.BRANCHES), none(schema.IMPACTS), none(schema.POLICIES))
