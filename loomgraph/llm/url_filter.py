"""URL filters by Bloom filter cascades.

A rule list is held as a cascade: level 1 encodes the listed keys, level 2 the
keys of the corpus that level 1 takes for listed though they aren't, level 3 the
listed keys that level 2 takes for false ones, and so on until a level lets no
wrong key through. Over the universe that the cascade was built on (every key
that any url of the corpus can ask for) the answer is exact, and asking needs no
join: the levels are arrays of 64-bit words inside the expression.

A list whose words would pass ``MAX_WORDS`` is held as a table and joined on the
key instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.store import spare

BITS_PER_KEY = 10
HASHES = 5
#: 2 MB of filter words go into a plan at most, all levels of a list together.
MAX_WORDS = 1 << 18
MAX_LEVELS = 40


def _position(key: Column, seed: int, probe: int, bits: int) -> Column:
    """Bit of a probe: double hashing by two seeded 64-bit hashes. bits is a power of two."""
    low = F.lit(bits - 1).cast("long")
    h1, h2 = F.xxhash64(F.lit(seed), key).bitwiseAND(low), F.xxhash64(key, F.lit(~seed)).bitwiseAND(low)
    return (h1 + F.lit(probe).cast("long") * h2.bitwiseOR(F.lit(1).cast("long"))).bitwiseAND(low)


class TooLarge(ValueError):
    """The list doesn't fit into a plan."""


class Level:
    """One Bloom filter: ``words`` 64-bit words, asked by an expression."""

    def __init__(self, words: list[int], seed: int) -> None:
        self.words, self.seed, self.bits = words, seed, 64 * len(words)

    def has(self, key: Column) -> Column:
        words = F.from_json(F.lit(str(self.words)), "array<bigint>")  # folded into a constant

        def one(probe: int) -> Column:
            at = _position(key, self.seed, probe, self.bits)
            word = F.get(words, F.shiftrightunsigned(at, 6).cast("int"))
            bit = F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int"))
            return bit.bitwiseAND(F.lit(1).cast("long")) == 1

        return reduce(lambda a, b: a & b, (one(p) for p in range(HASHES)))


def build_level(keys: DataFrame, n: int, seed: int) -> Level:
    """Bloom filter of the column ``key``: bits are or-ed by word before anything reaches the driver."""
    n_words = 1 << max(0, (max(1, n) * BITS_PER_KEY - 1) // 64).bit_length()
    bits = 64 * n_words
    at = F.explode(F.array(*[_position(F.col("key"), seed, p, bits) for p in range(HASHES)]))
    found = (
        keys.select(at.alias("at"))
        .groupBy(F.shiftrightunsigned("at", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("v"))
        .collect()  # n_words rows at most
    )
    words = [0] * n_words
    for row in found:
        words[row["w"]] = row["v"]
    return Level(words, seed)


class Cascade:
    """Exact membership over a universe of keys."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def has(self, key: Column) -> Column:
        """The first level that refuses decides: an odd one says not listed, an even one listed; the last level is exact."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            answer = F.when(~self.levels[depth - 1].has(key), F.lit(depth % 2 == 0)).otherwise(answer)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade of ``listed.key`` that is exact over ``universe.key`` and the listed keys.

    Only keys that pass the first level meet the list itself, in one anti join;
    they are about one in a hundred of the universe. The passing keys shrink by
    that rate at each level.
    """
    listed = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    n = listed.count()
    if n == 0:
        return Cascade([])
    if n * BITS_PER_KEY > 64 * MAX_WORDS:
        raise TooLarge(f"{n} keys need more than {MAX_WORDS} words")
    levels = [build_level(listed, n, 1)]
    wrong = universe.select("key").filter(levels[0].has(F.col("key"))).distinct().join(listed, "key", "left_anti")
    right = listed
    for depth in range(2, MAX_LEVELS):
        m = wrong.count()
        if m == 0:
            return Cascade(levels)
        levels.append(build_level(wrong, m, depth))
        if sum(len(x.words) for x in levels) > MAX_WORDS:
            raise TooLarge(f"the cascade needs more than {MAX_WORDS} words")
        right, wrong = wrong, right.filter(levels[-1].has(F.col("key")))
    raise TooLarge("the cascade doesn't end")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: see ``judge_urls``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url by the longest rule that fits it.

    ``rules`` holds pairs of ``block`` or ``allow`` and ``host/path``. A rule fits
    its host and all subdomains of it, if the url's path starts with the rule's
    path. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. The longest
    fitting rule wins; one listed as both blocks. Urls that no cascade holds a key
    of get ``default``.

    Returns the columns of ``pages`` that don't clash, and host, path, rule and
    verdict. A null url or one without ``://`` has an empty host and path and fits
    no rule. Repeated rows are judged each; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    listed = [(kind, rule if "/" in rule else rule + "/") for kind, rule in rules]
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    whole, keys = spare([*names, "host", "path", "rule", "verdict"], "whole_url", "keys")
    host, path = split_url(F.col(whole))
    parts = pages.select(*[pages[c] for c in names], pages[url].alias(whole)).withColumn("host", host).withColumn("path", path).drop(whole)
    # Keys that a url can ask for: its last k labels for each count k of labels in
    # the list, by the first n characters of its path for each length n in the list.
    shapes = sorted({(rule.split("/", 1)[0].count(".") + 1, len(rule.split("/", 1)[1]) + 1) for _, rule in listed})
    asked = [F.when(F.length("path") >= n, F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k, n in shapes]
    asked = F.array_compact(F.array_distinct(F.array(*asked))) if asked else F.array().cast("array<string>")
    keyed = parts.withColumn(keys, F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(asked))
    universe = keyed.select(F.explode(keys).alias("key"))

    def held(kind: str) -> DataFrame:
        return spark.createDataFrame([(rule,) for k, rule in listed if k == kind], "key string")

    try:
        block, allow = (build_cascade(held(kind), universe) for kind in ("block", "allow"))
    except TooLarge:
        return _judge_by_join(keyed, keys, held("block"), held("allow"), default)
    hits = F.filter(keys, lambda k: block.has(k) | allow.has(k))
    ruled = keyed.withColumn("rule", _longest(hits)).drop(keys)
    return ruled.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default)).when(block.has(F.col("rule")), F.lit("block")).otherwise(F.lit("allow")))


def _longest(keys: Column) -> Column:
    return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]


def _judge_by_join(keyed: DataFrame, keys: str, block: DataFrame, allow: DataFrame, default: str) -> DataFrame:
    """The same for lists of any size. Keys are joined once each, then their verdicts once for each distinct set of keys."""
    verdicts = block.select("key", F.lit("block").alias("v")).union(allow.select("key", F.lit("allow").alias("v"))).groupBy("key").agg(F.max("v").alias("v"))
    ks, best = spare([*keyed.columns, "rule", "verdict"], "ks", "best")
    sets = keyed.select(F.col(keys).alias(ks)).distinct()
    found = sets.select(ks, F.explode(ks).alias("key")).join(verdicts, "key").groupBy(ks).agg(F.max(F.struct(F.length("key").alias("n"), "key", "v")).alias(best))
    out = keyed.join(found, keyed[keys] == found[ks], "left")
    return out.withColumn("rule", F.col(f"{best}.key")).withColumn("verdict", F.coalesce(f"{best}.v", F.lit(default))).drop(keys, ks, best)


#: The rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS k
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM h LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON h.page_id = f.page_id AND h.host = f.host AND h.path = f.path
"""
