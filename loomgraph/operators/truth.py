"""Independent truth by regular expressions, line by line, for recall of the scanners."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a line must show to count, by domain and role. They don't share code with the scanners.
PATTERNS = {
    ("nats", "receiver"): r"@(?:MessagePattern|EventPattern)\s*\(",
    ("nats", "sender"): r"\b(?:\w*[cC]lient\w*|nats\w*)\.(?:send|emit|publish|request)\s*[(<]",
    ("rmq", "receiver"): r"@(?:RabbitSubscribe|RabbitRPC|RmqHandler)\s*\(",
    ("typeorm", "access"): r"@InjectRepository\s*\(",
    ("typeorm", "entity"): r"@Entity\s*\(",
    ("bullmq", "produce"): r"@InjectQueue\s*\(",
    ("bullmq", "consume"): r"@Processor\s*\(",
    ("bullmq", "register"): r"\bBullModule\.registerQueue(?:Async)?\s*\(",
    ("cron", "cron"): r"@Cron\s*\(",
    ("cron", "interval"): r"@Interval\s*\(",
    ("cron", "timeout"): r"@Timeout\s*\(",
    ("di", "module"): r"@Module\s*\(",
    ("http", "call"): r"\b(?:axios|fetch|httpService)\s*(?:\.\w+)?\s*[(<]",
    ("imports", "static"): r"\bfrom\s+['\"][^'\"]+['\"]",
    ("endpoint", "handler"): r"@(?:Get|Post|Put|Patch|Delete|All|Options|Head|Sse)\s*\(",
    ("config", "read"): r"\bprocess\.env(?:\.[A-Za-z_]\w*|\[['\"])|\b\w*[cC]onfig\w*\.get(?:OrThrow)?\s*[(<]",
    ("entity-fields", "column"): r"@(?:Column|PrimaryColumn|PrimaryGeneratedColumn|CreateDateColumn|UpdateDateColumn|DeleteDateColumn)\s*\(",
    ("fe", "component"): r"\b(?:function|const)\s+[A-Z]\w*\s*(?:[(=:<])",
    ("fe", "hook"): r"\b(?:function|const)\s+use[A-Z]\w*\s*[(=]",
}

#: A match of each pattern holds one of these.
WORDS = {
    ("nats", "receiver"): ("@MessagePattern", "@EventPattern"),
    ("nats", "sender"): (".send", ".emit", ".publish", ".request"),
    ("rmq", "receiver"): ("@RabbitSubscribe", "@RabbitRPC", "@RmqHandler"),
    ("typeorm", "access"): ("@InjectRepository",),
    ("typeorm", "entity"): ("@Entity",),
    ("bullmq", "produce"): ("@InjectQueue",),
    ("bullmq", "consume"): ("@Processor",),
    ("bullmq", "register"): ("BullModule.registerQueue",),
    ("cron", "cron"): ("@Cron",),
    ("cron", "interval"): ("@Interval",),
    ("cron", "timeout"): ("@Timeout",),
    ("di", "module"): ("@Module",),
    ("http", "call"): ("axios", "fetch", "httpService"),
    ("imports", "static"): ("from",),
    ("endpoint", "handler"): ("@Get", "@Post", "@Put", "@Patch", "@Delete", "@All", "@Options", "@Head", "@Sse"),
    ("config", "read"): ("process.env", "onfig"),
    ("entity-fields", "column"): ("Column",),
    ("fe", "component"): ("function", "const"),
    ("fe", "hook"): ("function", "const"),
}


def truth(files: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """(domain, role, file, line, matched_text) of (file, text), comments left out; a match that repeats on a line counts each time."""
    # Block comments keep their line ends, so that lines stay numbered as they are.
    kept = F.when(F.col("text").contains("/*"), F.expr(r"array_join(transform(split(text, '(?=/[*])|(?<=[*]/)'), p -> if(p like '/*%', regexp_replace(p, '[^\\n]', ' '), p)), '')")).otherwise(F.col("text"))
    bare = F.regexp_replace(kept, r"(?m)(^|[^:'\"`])//[^\n]*", "$1")
    lines = files.select("file", F.posexplode(F.split(bare, "\n")).alias("n", "content"))
    wanted = {k: p for k, p in PATTERNS.items() if domains is None or k[0] in domains}
    # Few lines hold a pattern's fixed words; only those are matched.
    hits = lambda key, p: F.when(reduce(or_, [F.col("content").contains(w) for w in WORDS[key]]), F.regexp_extract_all("content", F.lit(p), F.lit(0)))
    each = F.explode(F.array(*[F.struct(F.lit(k[0]).alias("domain"), F.lit(k[1]).alias("role"), hits(k, p).alias("hits")) for k, p in wanted.items()]))
    found = lines.select("file", (F.col("n") + 1).alias("line"), each.alias("x")).filter(F.size("x.hits") > 0)
    return found.select("x.domain", "x.role", "file", "line", F.explode("x.hits").alias("matched_text"))


def sites_by_role(sites: DataFrame) -> DataFrame:
    """(domain, role, file, line, ord) of extracted sites, in the truth's terms."""
    d, r = F.col("domain"), F.col("role")
    domain = F.when(d.isin("entities", "repositories"), "typeorm").when(d == "columns", "entity-fields").when(d == "queues", "bullmq").when(d == "schedules", "cron").when(d == "di-modules", "di").when(d == "front", "fe").otherwise(d)
    role = (
        F.when(d == "entities", "entity").when(d == "repositories", "access").when(d == "columns", "column").when(d == "di-modules", "module").when(d == "http", "call").when(d == "imports", F.col("pattern"))
        .when(d == "endpoint", "handler").when(d == "config", "read").otherwise(r)
    )
    out = sites.filter("error IS NULL").select(domain.alias("domain"), role.alias("role"), "file", "line", "ord")
    # A module gives a row a reference; its truth is one a decorator. All in one pass: a union of the two kinds would scan every file twice.
    other = F.col("domain") != "di"
    counted = out.groupBy("domain", "role", "file", "line", F.when(other, F.col("ord")).alias("each")).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    return counted.select("domain", "role", "file", "line", F.explode(F.array_repeat("ord", F.when(other, F.col("n")).otherwise(1).cast("int"))).alias("ord"))
