"""Tables and SQL that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators import cues as C
from cueloom.storage import table

#: Common table expressions for DuckDB: cues (video_id, idx, text, dur, start_ms, end_ms).
CUES = r"""
l_ AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\s]')) AS a FROM documents),
r_ AS (SELECT doc_id AS video_id, unnest(range(1, len(a) + 1)) AS idx, unnest(a) AS text FROM l_),
d_ AS (SELECT *, greatest(500, 60 * length(text)) AS dur FROM r_),
s_ AS (SELECT *, CAST(coalesce(sum(dur) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM d_),
cues AS (SELECT *, start_ms + dur AS end_ms FROM s_)"""

TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"

#: A text as the end of an answer for one cue: the quotes around such an answer are taken off, and with them those that end the text.
UNQUOTED = """regexp_replace(text, '"+$', '')"""

#: After CUES: words (video_id, idx, k, n, tok, pos, start, end).
WORDS = rf"""
t_ AS (SELECT video_id, idx, start_ms, end_ms, {TOKENS} AS w FROM cues),
u_ AS (SELECT video_id, idx, start_ms, end_ms, len(w) AS n, unnest(range(0, len(w))) AS k, unnest(w) AS tok FROM t_),
words AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx, k) - 1 AS pos,
  (start_ms + (end_ms - start_ms) / n * k) / 1000 AS w_start, (start_ms + (end_ms - start_ms) / n * (k + 1)) / 1000 AS w_end FROM u_)"""

#: After CUES: scored (cues with the score of their document: 90, 40, or -1 without a label).
SCORED = """
scored AS (SELECT c.*, CAST(CASE l.quality WHEN 1 THEN 90 WHEN 0 THEN 40 ELSE -1 END AS DOUBLE) AS score FROM cues c LEFT JOIN labels l ON l.doc_id = c.video_id)"""


def cues(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Cues of all documents, with these columns of theirs."""
    return C.cues_of_texts(table(spark, sf_dir, "documents"), keep=keep)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.words_of_cues(cues(spark, sf_dir))


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, score) of labelled documents."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id"), F.when(F.col("quality") == 1, 90.0).otherwise(40.0).alias("score"))


def scored(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return cues(spark, sf_dir, *keep).join(label_scores(spark, sf_dir), "video_id", "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))
