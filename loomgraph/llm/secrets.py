"""Secret scans: fixed patterns, and windows of high entropy.

All of it is column expressions. Positions of matches come from the gaps between
them: splitting a text at a pattern and extracting the pattern's matches walk the
text in the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.store import spare

#: The kinds in their order, with pattern, group whose length counts, and least length.
#: A run of ``assign`` that is too short still consumes what it covers, so its length is tested after the match;
#: in the other two a shorter run can hold no longer one, so the length stands in the pattern.
KINDS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}+", 0, 18),
    ("hex", r"[0-9a-f]{16,}+", 0, 16),
]
#: Candidate strings of the entropy scan, maximal runs, and the size of the window that slides over them.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}+", 20
#: c * log2(c) in millionths, for whole-number sums that don't depend on their order. A count is one more than
#: the window's size between a character's coming and another's going.
NLOG = [0] + [round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 2)]
#: Least entropy of a window in bits, by the classes of its characters: hexadecimal digits only; letters of one case and digits; anything else.
LEAST_BITS = {"hex": 3.0, "one_case": 3.5, "mixed": 3.9}
#: Candidates that are no secrets: uuids, paths of words, words joined by - or _, runs of letters of one case, digits alone, placeholders.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?[A-Za-z]+[0-9]{0,4}([-_/=+][A-Za-z]*[0-9]{0,4})*$",
    r"^[0-9_/=+-]+$",
    r"(?i)example|placeholder|changeme|xxxxxx|abcdefgh|01234567|12345678",
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _spans(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """array<struct<start, rank, end>> of the leftmost non-overlapping matches whose group has ``least`` characters."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("g"), hits.alias("h"), counted.alias("c"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["h"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["c"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("out"))
    # Most texts hold no match and are walked once.
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(parts, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def _entropy_runs(candidate: Column) -> Column:
    """Merged runs (start, end) of the windows of a candidate string that reach the least entropy of their class.

    One pass over the characters: counts of the window's characters change by the one
    that enters and the one that leaves, and so does the sum of c*log2(c), from which
    the entropy follows as log2(n) - sum/n.
    """
    chars = F.split(candidate, "")
    nlog = F.array(*[F.lit(x) for x in NLOG])
    alphabet = {c: i for i, c in enumerate(ALPHABET)}

    def code(c: Column) -> Column:
        return F.instr(F.lit(ALPHABET), c) - 1

    codes = F.transform(chars, code)
    least = {k: round((math.log2(WINDOW) - bits) * WINDOW * 1e6) for k, bits in LEAST_BITS.items()}
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0).alias("sum"),
        F.lit(0).alias("upper"), F.lit(0).alias("lower"), F.lit(0).alias("past_f"), F.lit(0).alias("other"), F.lit(0).alias("digit"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        new, old, i = x["new"], x["old"], x["i"]
        n_new = F.get(acc["n"], new)
        sum_in = acc["sum"] + F.get(nlog, n_new + 1) - F.get(nlog, n_new)
        n_old = F.when(old == new, n_new + 1).otherwise(F.get(acc["n"], old))
        total = F.when(old.isNull(), sum_in).otherwise(sum_in + F.get(nlog, n_old - 1) - F.get(nlog, n_old))
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(old.isNotNull() & (k == old), 1).otherwise(0))

        def moved(name: str, test) -> Column:
            return acc[name] + F.when(test(new), 1).otherwise(0) - F.when(old.isNotNull() & test(old), 1).otherwise(0)

        upper, lower = moved("upper", lambda c: c < 26), moved("lower", lambda c: (c >= 26) & (c < 52))
        past_f = moved("past_f", lambda c: ((c >= 6) & (c < 26)) | ((c >= 32) & (c < 52)))
        digit, other = moved("digit", lambda c: (c >= 52) & (c < 62)), moved("other", lambda c: c >= 62)
        one_case = (other == 0) & ((upper == 0) | (lower == 0))
        most = F.when(one_case & (past_f == 0), least["hex"]).when(one_case, least["one_case"]).otherwise(least["mixed"])
        # A secret mixes classes: digits stand among its letters.
        hit = (i >= WINDOW - 1) & (total <= most) & (digit > 0) & (upper + lower > 0)
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        begin, end = i - (WINDOW - 1), i + 1
        grown = F.when(last.isNotNull() & (begin <= last["end"]), F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))).otherwise(
            F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        )
        return F.struct(counts.alias("n"), total.alias("sum"), upper.alias("upper"), lower.alias("lower"), past_f.alias("past_f"), other.alias("other"), digit.alias("digit"), F.when(hit, grown).otherwise(acc["out"]).alias("out"))

    walk = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).alias("old"), i.alias("i")))
    return F.aggregate(walk, start, step, lambda acc: acc["out"])


def _entropy_spans(text: Column) -> Column:
    """Spans of rank 3 in the text: runs of high entropy in candidates that no allow-list pattern fits."""
    found = _spans(text, CANDIDATE, 0, WINDOW, 3)

    def refine(s: Column) -> Column:
        candidate = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | F.regexp_like(candidate, F.lit(pattern))
        runs = F.transform(_entropy_runs(candidate), lambda r: F.struct((s["start"] + r["start"]).alias("start"), F.lit(3).alias("rank"), (s["start"] + r["end"]).alias("end")))
        return F.when(allowed, F.array().cast("array<struct<start:int,rank:int,end:int>>")).otherwise(runs)

    return F.flatten(F.transform(found, refine))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Spans of secrets in every whole text.

    Adds ``spans`` array<struct<kind, start, end>>, by start and kind: code points,
    end exclusive. Kinds are those of ``KINDS`` and ``entropy``; a base span stays
    whatever the entropy scan finds. A null text counts as empty and has no spans;
    a column named ``spans`` is replaced.
    """
    text_col = F.coalesce(docs[text], F.lit(""))
    names = [c for c in docs.columns if c != "spans"]
    (whole,) = spare([*names, "spans"], "whole")
    arrays = [_spans(F.col(whole), p, g, least, i) for i, (_, p, g, least) in enumerate(KINDS)]
    every = F.array_sort(F.concat(*arrays, _entropy_spans(F.col(whole))))
    kinds = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("entropy"))
    named = F.transform(every, lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return docs.select(*[docs[c] for c in names], text_col.alias(whole)).withColumn("spans", named).drop(whole)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "spans")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k) for k, *_ in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    base = "\nUNION ALL ".join(
        f"SELECT key, {rank} AS rank, '{kind}' AS kind, regexp_split_to_array(t, {_quoted(p)}) AS g, regexp_extract_all(t, {_quoted(p)}, 0) AS h, regexp_extract_all(t, {_quoted(p)}, {group}) AS c, {least} AS least FROM d WHERE regexp_matches(t, {_quoted(p)})"
        for rank, (kind, p, group, least) in enumerate([(k, p.replace("}+", "}"), g, n) for k, p, g, n in [*KINDS, ("candidate", CANDIDATE, 0, WINDOW)]])
    )
    allowed = " OR ".join(f"regexp_matches(s, {_quoted(p)})" for p in ALLOWED)
    most = {k: round((math.log2(WINDOW) - bits) * WINDOW * 1e6) for k, bits in LEAST_BITS.items()}
    return f"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({base}),
p AS (SELECT key, rank, kind, h[i] AS s, length(c[i]) >= least AS ok, coalesce(list_sum([length(x) FOR x IN g[1 : i]]), 0) + coalesce(list_sum([length(x) FOR x IN h[1 : i - 1]]), 0) AS a FROM m, unnest(range(1, len(h) + 1)) AS x(i)),
b AS (SELECT key, rank, kind, a::BIGINT AS a, (a + length(s))::BIGINT AS b FROM p WHERE ok AND rank < 3),
w AS (SELECT key, a, i, substr(s, i + 1, {WINDOW}) AS v FROM p, unnest(range(0, length(s) - {WINDOW} + 1)) AS x(i) WHERE ok AND rank = 3 AND NOT ({allowed})),
n AS (SELECT key, a, i, v, sum(round(c * log2(c) * 1e6)) AS total FROM (SELECT key, a, i, v, ch, count(*) AS c FROM w, unnest(string_split(v, '')) AS x(ch) GROUP BY ALL) GROUP BY ALL),
e AS (
  SELECT key, a + i AS i, lag(a + i) OVER (PARTITION BY key, a ORDER BY i) AS before, a FROM n
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND total <= CASE
    WHEN regexp_matches(v, '[+/_=-]') OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')) THEN {most["mixed"]} WHEN regexp_matches(v, '[g-zG-Z]') THEN {most["one_case"]} ELSE {most["hex"]} END
), r AS (SELECT *, sum((before IS NULL OR before + {WINDOW} < i)::INT) OVER (PARTITION BY key, a ORDER BY i) AS run FROM e),
s AS (SELECT * FROM b UNION ALL SELECT key, 3, 'entropy', min(i), max(i) + {WINDOW} FROM r GROUP BY key, a, run),
o AS (SELECT key, count(*) FILTER (WHERE rank = 0) AS n0, count(*) FILTER (WHERE rank = 1) AS n1, count(*) FILTER (WHERE rank = 2) AS n2,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans FROM s GROUP BY key)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (key)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP3_SQL = _oracle()
