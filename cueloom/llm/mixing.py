"""Mixing sources to target weights by Pareto order sampling (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.operators.ordering import numbered, running_sum
from cueloom.storage import materialize, table

#: Rank buckets of a source: only one of them is ever ordered row by row.
BUCKETS = 1024
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: A document of so many words has half the inclusion odds of a very long one.
HALF = 64


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the key."""
    hexed = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Per source_key: source_size and target; written, so that readers know its size.

    Sources in code point order, null last, get the weights in turn; a target stops at ``most``
    times its source's size, and the excess is shared again by weight until none is above: a level
    per unit of weight rises while sources reach their cap. Only sums over sources come to the driver.
    """
    per = numbered(sized.groupBy("source_key").agg(F.sum("size").alias("source_size")), "source_key", name="n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ranked = materialize(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)), "sources")
    level, full = 0.0, -1
    while True:
        capped = F.lit(False) if full < 0 else F.col("cap") <= F.col("weight") * F.lit(level)
        sums = (F.count_if(capped), F.sum("source_size"), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))))
        count, size, used, free = (x or 0 for x in ranked.agg(*sums).first())
        if count == full or not free:
            break
        full, level = count, (size * budget - used) / free
    target = F.least("cap", F.col("weight") * F.lit(level)) if free else F.col("cap")
    return materialize(ranked.select("source_key", "source_size", target.alias("target")), "targets")


def frontiers(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source_key: source_size, target, whole copies, and the rank bucket in which the sample ends, with the words before it; written.

    Buckets before it are taken, those after it are not. Words are summed by (source, bucket), so a
    hot source is spread over all tasks until it has at most BUCKETS rows.
    """
    per_bucket = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = per_bucket.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.greatest("source_size", F.lit(1))).otherwise(0.0)
    shares = targets.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    reached = summed.join(shares, "source_key").filter(F.col("offset") < F.col("rest"))
    last = reached.groupBy("source_key").agg(F.max(F.struct("bucket", "offset")).alias("last"))
    ends = shares.join(last, "source_key", "left")
    return materialize(ends.select("source_key", "source_size", "target", "whole", "rest", F.coalesce("last.bucket", F.lit(-1)).alias("open"), F.coalesce("last.offset", F.lit(0)).alias("offset")), "frontiers")


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", seed: int = 17, **sharing) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with size, source_size, target, copies and taken.

    A source with target t and size s takes floor(t / s) whole copies of every document. The rest is
    a Pareto sample without replacement, of a fixed size in words: a document's inclusion odds are
    in proportion to w / (w + HALF), w being its words, so fragments are taken less often than long
    texts; documents are ranked by (u / (1 - u)) over these odds, u being uniform by the key's
    digest, and the prefix of the ranking whose words come nearest the rest is taken once more. (What
    makes the odds of a source add up to the rest is one factor for all its documents and leaves
    their order as it is.) So a source misses its target by half a document at most, and no document
    exceeds the cap.

    Rows are written once with size and rank. Sums by rank bucket tell the one bucket of a source in
    which the sample ends; all other rows are taken or left where they are, and only that bucket is
    ordered, in parts. Ties in rank go by key, then size, then place in the input.
    Null source is a source of its own, last in order; null keys share one u; documents without
    words get the whole copies only; repeated rows are ranked one by one; other columns stay inside
    ``row``; an empty table gives an empty result.
    """
    source_key = F.when(F.col(f"row.{source}").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(f"row.{source}")))  # "=" < "~"
    u = uniform(F.col(f"row.{key}"), seed)
    inclusion = F.when(F.col("size") > 0, F.col("size") / (F.col("size") + F.lit(float(HALF)))).otherwise(1.0)
    odds = F.col("u") / (1 - F.col("u")) / inclusion
    ranked = docs.select(F.struct(*docs.columns).alias("row"), size.alias("size")).withColumn("u", u)
    ranked = ranked.select("row", "size", source_key.alias("source_key"), F.col(f"row.{key}").alias("rank_key"), odds.alias("odds"))
    bucket = F.floor(F.col("odds") / (1 + F.col("odds")) * BUCKETS)
    held = materialize(ranked.withColumn("bucket", bucket).withColumn("place", F.monotonically_increasing_id()), "ranked")
    sized = held.select("source_key", "bucket", "size")
    ends = frontiers(sized, source_targets(sized, **sharing))
    placed = held.join(ends, "source_key")
    sure = placed.filter(F.col("bucket") != F.col("open")).withColumn("again", F.col("bucket") < F.col("open"))
    summed = running_sum(placed.filter(F.col("bucket") == F.col("open")), "size", "odds", "rank_key", "size", "place", by="source_key")
    near = F.col("offset") + F.col("run") - F.col("size") / 2 <= F.col("rest")
    rows = sure.unionByName(summed.withColumn("again", near).drop("run"))
    copies = F.col("whole") + (F.col("again") & (F.col("size") > 0)).cast("long")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with the columns of ``docs``.

    Texts that are null or without words are taken only where their source takes whole copies;
    repeated rows, null keys and sources, other columns and empty tables are as in ``mix``.
    """
    taken = mix(docs, words(F.col("text")), **params).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("words"))
    return mix(sized, F.col("words")).select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


QUERIES = {"op6_pareto_mixing": op6_pareto_mixing}
ORACLES = {
    "op6_pareto_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS k,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT k, sum(size)::DOUBLE AS ss, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY k),
l AS (SELECT *, 2 * ss AS cap, 2 * ss / w AS room,
        (1.5 * sum(ss) OVER () - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * ss / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s),
f AS (SELECT arg_min(level, room) AS free FROM l WHERE level <= room),
t AS (SELECT k, ss, least(cap, coalesce(free * w, cap)) AS target FROM l, f),
q AS (SELECT d.*, ss, target, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole FROM d JOIN t USING (k)),
o AS (SELECT *, u / (1 - u) / CASE WHEN size > 0 THEN size / (size + 64.0::DOUBLE) ELSE 1 END AS odds FROM q),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY odds, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST((whole + CASE WHEN size > 0 AND bef + size / 2.0::DOUBLE <= target - whole * ss THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM b"""
}
