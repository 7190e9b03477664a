"""Evaluation of subtitles against reference subtitles: both sides brought to the same cues, and all metrics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import quality as Q
from cueloom.operators.subtitle_edits import subtitle_edit_rate
from cueloom.storage import materialize


def paired(hypothesis: DataFrame, reference: DataFrame) -> DataFrame:
    """(video_id, idx, hypothesis, reference): cues of both sides with the same place; what one side lacks is empty. Rows without a key or place are left out."""
    side = lambda df, name: df.filter("video_id is not null and idx is not null").select("video_id", "idx", F.coalesce("text", F.lit("")).alias(name))
    both = side(hypothesis, "hypothesis").join(side(reference, "reference"), ["video_id", "idx"], "full")
    return both.fillna("", ["hypothesis", "reference"])


def retimed(hypothesis: DataFrame, reference: DataFrame) -> DataFrame:
    """(video_id, idx, hypothesis, reference): the words of the hypothesis dealt to the reference cues by time.

    The words of a cue are spread evenly over its time; each goes to the last reference cue that has begun in its middle, or to the
    first if none has. Reference cues that get no word stand against nothing; words of videos without a reference
    stand, with a null idx, against nothing. Rows without a key or times are left out, null texts are empty. Words and begins of cues
    are put in one order of time, so the work grows with both, not with their product.
    """
    timed = "video_id is not null and idx is not null and start_ms is not null"
    spoken = hypothesis.filter(f"{timed} and end_ms is not null").select("video_id", "idx", "start_ms", "end_ms", X.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    each = spoken.select("video_id", "idx", "start_ms", "end_ms", F.size("w").alias("n"), F.posexplode("w").alias("k", "word"))
    middle = 2 * F.col("n") * F.col("start_ms") + (F.col("end_ms") - F.col("start_ms")) * (2 * F.col("k") + 1)  # times 2 n, so that it stays whole
    at = F.floor(middle / (2 * F.col("n")))
    words = each.select("video_id", at.alias("at"), F.lit(1).alias("kind"), F.col("idx").alias("h_idx"), "k", "word", F.lit(None).cast(reference.schema["idx"].dataType).alias("cue"))
    begins = reference.filter(timed).select("video_id", F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.col("idx").cast(hypothesis.schema["idx"].dataType).alias("h_idx"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("word"), F.col("idx").alias("cue"))
    order = Window.partitionBy("video_id").orderBy("at", "kind", "h_idx", "k")
    before = F.last("cue", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    earliest = F.first("cue", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = begins.unionByName(words).withColumn("idx", F.coalesce(before, earliest)).filter("kind = 1")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h_idx", "k", "word"))), lambda x: x["word"]), " ")
    dealt = placed.groupBy("video_id", "idx").agg(said.alias("hypothesis")).withColumnsRenamed({"video_id": "v", "idx": "i"})
    wanted = reference.filter(timed).select("video_id", "idx", F.coalesce("text", F.lit("")).alias("reference"))
    both = wanted.join(dealt, (F.col("video_id") == F.col("v")) & (F.col("idx") == F.col("i")), "full")
    return both.select(F.coalesce("video_id", "v").alias("video_id"), "idx", F.coalesce("hypothesis", F.lit("")).alias("hypothesis"), F.coalesce("reference", F.lit("")).alias("reference"))


def evaluate(hypothesis: DataFrame, reference: DataFrame, language: str | None = None, by_time: bool = False) -> DataFrame:
    """One row: suber, wer, ter (edits over the reference's words), bleu, chrf (0 to 100) over all videos.

    Both sides: video_id, idx, start_ms, end_ms, text. Cues are paired by place, or the words by time (``by_time``) where the
    sides were cut into different cues; for zh, ja and ko characters count as words.
    """
    spoken = None if language is None else F.lit(language)
    pairs = retimed(hypothesis, reference) if by_time else paired(hypothesis, reference)
    pairs = materialize(pairs.select(F.lit(0).alias("all"), "hypothesis", "reference"), "pairs")
    edits = subtitle_edit_rate(hypothesis, reference, spoken)
    suber = edits.agg(F.round(F.coalesce(F.sum(F.col("edits") + F.col("shifts")), F.lit(0)) / F.greatest(F.coalesce(F.sum("ref_tokens"), F.lit(0)), F.lit(1)), 6).alias("suber"))
    rates = Q.wer(pairs, "all", spoken).select("all", "wer").join(Q.ter(pairs, "all", language=spoken).select("all", "ter"), "all")
    # Four tables of one row each.
    whole = suber.select(F.lit(0).alias("all"), "suber").join(rates, "all", "left")
    for metric in (Q.bleu(pairs, spoken).select(F.lit(0).alias("all"), "bleu"), Q.chrf(pairs).select(F.lit(0).alias("all"), "chrf")):
        whole = whole.join(metric, "all")
    return whole.drop("all").fillna(0.0, ["wer", "ter"])
