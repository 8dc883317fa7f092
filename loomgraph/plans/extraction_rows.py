"""Driver queries of the extraction: a source file a part, whose sites are known by the way it is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import extract, match, truth
from loomgraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The file of part {p}; up to four lines of comments stand before it.
SOURCE = """import { A, B } from './dep{p}';
import axios from 'axios';
@Controller('shop/{p}')
export class Shop{p}Controller {
  constructor(private readonly shop: Shop{p}Service, @InjectRepository(Item{p}) private readonly items: Repository<Item{p}>, @InjectQueue('mail-{p}') private readonly mail: Queue, private readonly client: ClientProxy) {}
  @Get('list/:id')
  @HttpCode(204)
  async list(id: string) {
    const base = process.env.BASE_{p};
    return axios.get('https://host{p}.example.com/a');
  }
  @MessagePattern('orders.{p}.made')
  async made(data: Made{p}) {
    if (data.ok) {
      this.client.emit('orders.{p}.done', data);
    }
    throw new Error('no {p}');
  }
  @RabbitSubscribe({ exchange: 'ex', routingKey: 'rk.{p}' })
  onRk() {}
  @Cron('0 {p} * * *')
  nightly() {}
}
@Entity('items_{p}')
export class Item{p} {
  @PrimaryGeneratedColumn()
  id: number;
  @Column({ type: 'text', nullable: true })
  name{p}: string;
  @ManyToOne(() => Owner{p}, (o) => o.items)
  owner: Owner{p};
}
@Processor('mail-{p}')
export class Mail{p}Processor {}
@Module({ imports: [Dep{p}Module], providers: [Shop{p}Service], controllers: [Shop{p}Controller] })
export class Shop{p}Module {}
"""
LEAD = "// @Cron('no') client.emit('no')\n"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a part. The parts are few bytes in few partitions and the texts are long to scan, so parts are dealt to all cores before they become texts."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    text = F.concat(F.repeat(F.lit(LEAD), (F.col("p_size") % 5).cast("int")), F.replace(F.lit(SOURCE), F.lit("{p}"), F.col("p_partkey").cast("string")))
    return part.select(F.format_string("apps/a/p%d.ts", "p_partkey").alias("file"), text.alias("text"))


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def expected_sql(columns: str, values: list[tuple]) -> str:
    """The rows of every file: the line of the first value is counted after the comments, and {p} is the part."""
    names = columns.split()
    text = lambda i: any(isinstance(v[i], str) for v in values)
    shown = ", ".join(f"replace({c}, '{{p}}', p_partkey::VARCHAR) AS {c}" if text(i + 1) else c for i, c in enumerate(names))
    return f"SELECT 'apps/a/p' || p_partkey || '.ts' AS file, (p_size % 5 + at_)::INTEGER AS line, {shown} FROM part, (VALUES {', '.join('(' + ', '.join(map(_literal, v)) + ')' for v in values)}) v(at_, {', '.join(names)})"


def sites(domain: str, columns: str, *values: tuple):
    """Register the sites of a domain with what stands in the file by line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract.extract(source_files(spark, sf_dir), [domain])
        return found.select("file", "line", *columns.split())

    QUERIES[name := f"extract_{domain.replace('-', '_')}"] = run
    ORACLE_SQL[name] = expected_sql(columns, list(values))


sites("nats", "role edge_kind subject_kind subject via enclosing_class", (12, "receiver", "nats-reply", "literal", "orders.{p}.made", "MessagePattern", "Shop{p}Controller"), (15, "sender", "nats-publish", "literal", "orders.{p}.done", "this.client.emit", "Shop{p}Controller"))
sites("rmq", "role subject via enclosing_class detail", (19, "receiver", "rk.{p}", "RabbitSubscribe", "Shop{p}Controller", "onRk"))
sites("endpoint", "method pattern controller handler status", (6, "GET", "/shop/{p}/list/:id", "Shop{p}Controller", "list", 204))
sites("config", "key source enclosing_class", (9, "BASE_{p}", "env", "Shop{p}Controller"))
sites("http", "method api url_kind url", (10, "GET", "axios.get", "literal", "https://host{p}.example.com/a"))
sites("imports", "subject pattern flag", (1, "./dep{p}", "static", False), (2, "axios", "static", False))
sites("di-modules", "role subject method enclosing_class", (35, "module", None, "module", "Shop{p}Module"), (35, "imports", "Dep{p}Module", "class", "Shop{p}Module"), (35, "providers", "Shop{p}Service", "class", "Shop{p}Module"), (35, "controllers", "Shop{p}Controller", "class", "Shop{p}Module"))
sites("di-uses", "subject enclosing_class", *[(5, x, "Shop{p}Controller") for x in ("Shop{p}Service", "Repository", "Queue", "ClientProxy")])
sites("entities", "subject pattern", (24, "Item{p}", "items_{p}"))
sites("repositories", "subject enclosing_class detail", (5, "Item{p}", "Shop{p}Controller", "items"))
sites("relations", "role subject enclosing_class detail flag", (30, "ManyToOne", "Owner{p}", "Item{p}", "owner", False))
sites("columns", "enclosing_class pattern detail flag", (26, "Item{p}", "int", "id", False), (28, "Item{p}", "text", "name{p}", True))
sites("queues", "role subject", (5, "produce", "mail-{p}"), (33, "consume", "mail-{p}"))
sites("schedules", "role subject enclosing_class detail", (21, "cron", "0 {p} * * *", "Shop{p}Controller", "nightly"))
_OWN = "Shop{p}Controller"
sites(
    "symbols", "role subject number",
    (4, "class", _OWN, 23), (5, "method", _OWN + ".constructor", 5), (8, "method", _OWN + ".list", 11), (13, "method", _OWN + ".made", 18), (20, "method", _OWN + ".onRk", 20), (22, "method", _OWN + ".nightly", 22),
    (25, "db-entity", "Item{p}", 32), (27, "field", "Item{p}.id", 27), (29, "field", "Item{p}.name{p}", 29), (31, "field", "Item{p}.owner", 31), (34, "class", "Mail{p}Processor", 34), (36, "class", "Shop{p}Module", 36),
)
# The last line of a symbol is counted after the comments too.
ORACLE_SQL["extract_symbols"] = ORACLE_SQL["extract_symbols"].replace(", number FROM", ", (number + p_size % 5)::INTEGER AS number FROM")
sites("calls", "subject detail pattern number", (10, "axios.get", _OWN + ".list", "('https://host{p}.example.com/a')", 1), (15, "this.client.emit", _OWN + ".made", "('orders.{p}.done', data)", 1), (17, "Error", _OWN + ".made", "('no {p}')", 2))
sites("branches", "role subject detail pattern", (10, "return", "", _OWN + ".list", "return axios.get('https://host{p}.example.com/a')"), (14, "if", "data.ok", _OWN + ".made", "this.client.emit('orders.{p}.done', data)"), (17, "throw", "", _OWN + ".made", "throw new Error('no {p}')"))

TRUTH = [
    (12, "nats", "receiver", "@MessagePattern("), (15, "nats", "sender", "client.emit("), (19, "rmq", "receiver", "@RabbitSubscribe("), (5, "typeorm", "access", "@InjectRepository("), (24, "typeorm", "entity", "@Entity("), (5, "bullmq", "produce", "@InjectQueue("), (33, "bullmq", "consume", "@Processor("),
    (21, "cron", "cron", "@Cron("), (35, "di", "module", "@Module("), (10, "http", "call", "axios.get("), (1, "imports", "static", "from './dep{p}'"), (2, "imports", "static", "from 'axios'"), (6, "endpoint", "handler", "@Get("), (9, "config", "read", "process.env.BASE_{p}"),
    (26, "entity-fields", "column", "@PrimaryGeneratedColumn("), (28, "entity-fields", "column", "@Column("),
]


def _truth(domain: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return truth.truth(source_files(spark, sf_dir), [domain]).select("file", "line", "role", "matched_text")

    QUERIES[name := f"truth_{domain.replace('-', '_')}"] = run
    ORACLE_SQL[name] = expected_sql("role matched_text", [(at, role, text) for at, d, role, text in TRUTH if d == domain])


for _domain in dict.fromkeys(d for _, d, _, _ in TRUTH):
    _truth(_domain)


def domain_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of every domain's sites against the truth by file and line."""
    files = source_files(spark, sf_dir)
    domains = ["nats", "rmq", "endpoint", "config", "http", "imports", "di-modules", "entities", "repositories", "columns", "queues", "schedules"]
    return match.multiset_recall(truth.truth(files, sorted({d for _, d, _, _ in TRUTH})), truth.sites_by_role(extract.extract(files, domains)), ["domain", "role", "file", "line"], ["domain", "role"])


QUERIES["domain_recall"] = domain_recall
ORACLE_SQL["domain_recall"] = f"""WITH v(domain, role) AS (VALUES {', '.join(f"('{d}', '{r}')" for _, d, r, _ in TRUTH)}), n AS (SELECT count(*) AS files FROM part)
SELECT domain, role, count(*) * any_value(files) AS n_truth, count(*) * any_value(files) AS n_found, count(*) * any_value(files) AS n_matched, 1.0::DOUBLE AS recall FROM v, n GROUP BY domain, role"""
