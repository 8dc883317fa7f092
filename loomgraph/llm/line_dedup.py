"""Line dedup: of lines that are alike or nearly so, the earliest stays.

1. Lines are hashed; of equal ones the earliest is known by a minimum, summed before
   it is sent.
2. Deletion neighbourhood: a distinct line emits a hashed key for itself and for every
   variant with one word deleted; lines with an equal key are within the bound. A line
   needs its variants only if one of three parts of it stands in another line as well: a
   word deleted in each leaves at least one part without a deletion. If that is the middle
   one and the words are deleted on either side of it, it stands one word further on in
   one of the lines. Parts are hashed with the line, so that only the lines with a shared
   part are split into variants.
3. The deleted words are compared away: what is left of the line and of the earliest
   line with that key must be equal.

Most parts, lines and variants have no partner; a filter of bounded size keeps them out of
the joins' exchanges (``thin``), and whole texts are sent for the rebuilding only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.store import Scratch, spare
from loomgraph.llm.thin import thin

#: Lines of fewer words always stay; lines of fewer than NEAR_WORDS words are compared exactly only.
LEAST_WORDS, NEAR_WORDS = 3, 8
NO_ID = (1 << 63) - 1


def _line_words(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(" \t\r")), " ")


def _parts(w: Column) -> Column:
    """Hashed keys. Two lines of which deleting at most one word from each makes them equal share one of them."""
    n = F.size(w)
    j = F.floor(n / 3).cast("int")
    # Of lines of n - 1 and n words one word apart, the first or the last j of either are alike; the longer one's j may be larger by one.
    step = n % 3 == 0

    def first(k: Column) -> Column:
        return F.xxhash64(F.lit("first"), F.slice(w, 1, k))

    def last(k: Column) -> Column:
        return F.xxhash64(F.lit("last"), F.slice(w, n - k + 1, k))

    def middle(back: int) -> Column:
        return F.xxhash64(F.lit("middle"), n, F.slice(w, F.greatest(j + 1 - back, F.lit(1)), n - 2 * j))

    return F.array(first(j), last(j), middle(0), middle(1), F.when(step, first(j - 1)), F.when(step, last(j - 1)))


#: Number of keys of ``_parts``.
PARTS = 6


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """Texts without the lines that an earlier line repeats.

    Lines end at line feeds, are trimmed, and have words parted by single spaces. A line
    of ``least_words`` or more words is removed if an earlier line is equal, or, if both have
    ``near_words`` or more, if deleting at most one word from each makes them equal: one
    word put in, left out, replaced or moved. Earlier is by doc_id, then line number,
    whether or not the earlier line stays itself. Returns the columns of ``docs``, ``text``
    without its removed lines, and n_lines and n_removed, which replace columns of those
    names. A null text stays null with 0 lines; an empty one has one line, which stays.
    A null doc_id comes last. Rows that repeat a doc_id come in the order of their texts'
    hashes; if the text is repeated too, they are one document and get the same lines.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text")).filter("text IS NOT NULL")
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    with_words = lines.withColumn("w", _line_words(F.col("line"))).filter(F.size("w") >= least_words)
    near = F.size("w") >= near_words
    hashed = with_words.select("id", "th", "line_no", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), F.when(near, _parts(F.col("w"))).alias("k"))
    hashed = hashed.select("id", "th", "line_no", "h1", "h2", *[F.col("k")[i].alias(f"k{i}") for i in range(PARTS)])
    first = hashed.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "line_no")).alias("at"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(PARTS)])
    first = scratch.keep(first.select("at.*", "h1", *[f"k{i}" for i in range(PARTS)]), "first")
    scratch.release()
    later = _near(scratch, rows, first)
    stay = scratch.keep(first.join(later, ["id", "th", "line_no"], "left_anti").groupBy("id", "th").agg(F.collect_list("line_no").alias("stay")), "stay")
    scratch.drop(first)
    scratch.drop(later)
    scratch.release()
    # Rebuild the texts.
    id_, th, stay_, own, gone_ = spare(names, "id", "th", "stay", "lines", "gone")
    keyed = docs.select(*[docs[c] for c in names], F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias(id_), F.xxhash64(docs[text]).alias(th))
    joined = keyed.join(stay.toDF(id_, th, stay_), [id_, th], "left").withColumn(own, F.split(F.col(text), "\n"))
    every = F.sequence(F.lit(0), F.size(own) - 1)
    judged = F.filter(every, lambda i: F.size(_line_words(F.get(own, i))) >= least_words)
    gone = F.array_except(judged, F.coalesce(stay_, F.array().cast("array<int>")))
    out = joined.withColumn(gone_, F.when(F.col(own).isNotNull(), gone))
    n_gone = F.coalesce(F.size(gone_), F.lit(0))
    kept = F.transform(F.array_except(every, F.col(gone_)), lambda i: F.get(own, i))
    new = F.when(n_gone > 0, F.array_join(kept, "\n")).otherwise(F.col(text))
    counts = [F.when(F.col(own).isNull(), 0).otherwise(F.size(own)).cast("long").alias("n_lines"), F.greatest(n_gone, F.lit(0)).cast("long").alias("n_removed")]
    return out.select(*[new.alias(c) if c == text else F.col(c) for c in names], *counts)


def _near(scratch: Scratch, rows: DataFrame, first: DataFrame) -> DataFrame:
    """(id, th, line_no) of distinct lines that a variant ties to an earlier one."""
    parts = first.filter("k0 IS NOT NULL").select("id", "th", "line_no", "h1", F.explode(F.array_compact(F.array(*[f"k{i}" for i in range(PARTS)]))).alias("k"))
    shared = scratch.keep(parts.groupBy("k").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y").select("k"), "shared")
    scratch.release()
    # Range partitions are in order, and so are these numbers.
    some = scratch.keep(thin(parts, ["k"], shared, shared.count()).join(shared, "k", "left_semi").select("id", "th", "line_no").distinct(), "some")
    scratch.drop(shared)
    scratch.release()
    refs = scratch.keep(some.orderBy("id", "th", "line_no").withColumn("rank", F.monotonically_increasing_id()), "refs")
    scratch.drop(some)
    # Only the lines asked for are sent, not their texts; rows that repeat a text bring the same ones.
    place = ["id", "th", "line_no"]
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = thin(lines, place, refs, refs.count()).dropDuplicates(place)
    ranked = scratch.keep(lines.join(refs, place).select("rank", _line_words(F.col("line")).alias("w")), "ranked")
    scratch.release()
    # A variant's key is an exclusive or over the words left of a hash of the word and its place
    # there, so all variants of a line come from running ones, in time linear in the line.
    word = ranked.repartition("rank").select("rank", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    word = word.select("rank", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("left"))
    line = W.partitionBy("rank")
    order = line.orderBy("i")
    before = F.coalesce(F.bit_xor("here").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    after = F.bit_xor("left").over(line).bitwiseXOR(F.bit_xor("left").over(order.rowsBetween(W.unboundedPreceding, 0)))
    variants = word.select("rank", "i", F.xxhash64(F.col("n") - 1, before.bitwiseXOR(after)).alias("k"))
    whole = word.groupBy("rank").agg(F.first("n").alias("n"), F.bit_xor("here").alias("x")).select("rank", F.lit(-1).alias("i"), F.xxhash64("n", "x").alias("k"))
    every = scratch.keep(variants.union(whole), "variants")
    scratch.release()
    least = every.groupBy("k").agg(F.min("rank").alias("to"), F.max("rank").alias("most"), F.min_by("i", "rank").alias("to_i")).filter("`to` < most").select("k", "to", "to_i")
    least = scratch.keep(least, "least")
    scratch.release()
    ties = scratch.keep(thin(every, ["k"], least, least.count()).join(least, "k").filter(F.col("rank") > F.col("to")).groupBy("rank", "to").agg(F.min(F.struct("i", "to_i")).alias("at")), "ties")
    scratch.drop(every)
    scratch.drop(least)
    scratch.release()
    tied = thin(ranked, ["rank"], ties.select("rank").union(ties.select("to")), 2 * ties.count())
    other = tied.select(F.col("rank").alias("to"), F.col("w").alias("to_w"))

    def left(w: Column, i: Column) -> Column:
        return F.when(i < 0, w).otherwise(F.concat(F.slice(w, 1, F.greatest(i, F.lit(0))), F.slice(w, i + 2, F.size(w))))

    same = left(F.col("w"), F.col("at.i")) == left(F.col("to_w"), F.col("at.to_i"))
    found = scratch.keep(ties.join(tied, "rank").join(other, "to").filter(same).select("rank").distinct().join(refs, "rank").select("id", "th", "line_no"), "later")
    for done in (ties, ranked, refs):
        scratch.drop(done)
    scratch.release()
    return found


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, no - 1 AS line_no, lines[no] AS line, string_split(trim(lines[no], E' \t\r'), ' ') AS w
  FROM (SELECT doc_id, string_split(text, E'\n') AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS x(no)
), e AS (SELECT *, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= 3),
f AS (SELECT s, min((doc_id, line_no)) AS place, any_value(w) AS w FROM e GROUP BY s),
v AS (
  SELECT s, place, s AS k FROM f WHERE len(w) >= 8
  UNION ALL SELECT s, place, array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' ') AS k FROM f, unnest(range(1, len(w) + 1)) AS x(i) WHERE len(w) >= 8
), m AS (SELECT k, min(place) AS least FROM v GROUP BY k),
gone AS (SELECT DISTINCT v.place FROM v JOIN m ON v.k = m.k WHERE m.least < v.place),
stays AS (SELECT place FROM f EXCEPT SELECT place FROM gone),
j AS (
  SELECT l.doc_id, l.line_no, l.line, len(l.w) < 3 OR s.place IS NOT NULL AS ok FROM l LEFT JOIN stays s ON (l.doc_id, l.line_no) = s.place
), r AS (
  SELECT doc_id, count(*) AS n_lines, sum((NOT ok)::INT) AS n_removed, coalesce(string_agg(line, E'\n' ORDER BY line_no) FILTER (WHERE ok), '') AS text FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(r.text, '')) AS text_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
