"""Jobs that call models over prompt tables; each has an offline stand-in that needs no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import answers as A
from cueloom.operators import cues as C
from cueloom.operators import memory as M
from cueloom.operators import quality as Q
from cueloom.storage import materialize

ATTEMPTS = 3
TERMS = 30


def with_retries(call: Callable, transient: Callable[[Exception], bool], attempts: int = ATTEMPTS, sleep: Callable = time.sleep):
    """The call's result; after transient failure n it waits min(16, 2 ** (n - 1)) s, up to ``attempts`` calls."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if n == attempts or not transient(e):
                raise
            sleep(min(16, 2 ** (n - 1)))
    return None


def run_model(prompts: DataFrame, client: Callable[[], Callable[[str], str]], transient: Callable[[Exception], bool] = lambda e: isinstance(e, OSError), tasks: int | None = None) -> DataFrame:
    """``prompts`` (with column prompt) with raw, and error where the call failed in the end: then raw is null.

    One client per task; prompts are dealt out over ``tasks`` tasks (the shuffle partitions, unless given),
    as each row waits for a service.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*prompts.schema, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for part in parts:
            raw, errors = [], []
            for p in part["prompt"]:
                try:
                    answer, error = with_retries(lambda p=p: ask(p), transient), None
                except Exception as e:  # the row says so; the others go on
                    answer, error = None, f"{type(e).__name__}: {e}"
                raw.append(answer), errors.append(error)
            yield part.assign(raw=raw, error=errors)

    tasks = tasks or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prompts.repartition(tasks).mapInPandas(run, schema)


def score_prompts(pairs: DataFrame, size: int = C.SCORE_BATCH) -> DataFrame:
    """(video_id, batch_id, prompt): pairs (video_id, idx, text, target) of a batch as a JSON list of i, src, tgt."""
    record = F.struct(F.col("idx").alias("i"), F.col("text").alias("src"), F.col("target").alias("tgt"))
    listed = F.to_json(F.array_sort(F.collect_list(record)))
    return pairs.withColumn("batch_id", C.batch_of(F.col("idx"), size)).groupBy("video_id", "batch_id").agg(listed.alias("prompt"))


def scored_pairs(pairs: DataFrame, answers: DataFrame, size: int = C.SCORE_BATCH) -> DataFrame:
    """(video_id, idx, score, failed) of pairs, given the raw answers (video_id, batch_id, raw) to their prompts.

    A batch whose answer can't be read, or that has none, fails as a whole; a pair that a readable
    answer leaves out has a null score and has not failed. Scores for cues outside the batch are ignored.
    """
    read = A.score_answers(answers).select("video_id", "batch_id", "scores")
    each = read.select("video_id", "batch_id", F.inline("scores")).select("video_id", "batch_id", (F.col("idx") + 1).alias("idx"), "score")
    first = each.groupBy("video_id", "batch_id", "idx").agg(F.first("score").alias("score"))
    placed = pairs.select("video_id", "idx").withColumn("batch_id", C.batch_of(F.col("idx"), size))
    spread = Q.spread_failures(placed, read.select("video_id", "batch_id", F.col("scores").isNotNull().alias("ok")))
    return spread.join(first, ["video_id", "batch_id", "idx"], "left").select("video_id", "idx", "score", "failed")


def in_index_order(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores (video_id, idx, score), and failures (video_id, idx), each by video and index."""
    known = scored.filter("score is not null").select("video_id", "idx", "score").orderBy("video_id", "idx")
    return known, scored.filter("failed").select("video_id", "idx").orderBy("video_id", "idx")


def record(number: Column, dur_ms: Column, text: Column) -> Column:
    """A cue as part of a prompt: i, duration, max_chars, text."""
    duration = F.format_string("%.1fs", dur_ms / 1000)
    return F.struct(number.alias("i"), duration.alias("duration"), X.max_chars(dur_ms, F.lit("")).alias("max_chars"), text.alias("text"))


def prompt_records(cues: DataFrame, size: int = C.BATCH) -> DataFrame:
    """(video_id, batch_id, prompt): cues of a batch as a JSON list of i, duration, max_chars, text."""
    listed = F.to_json(F.array_sort(F.collect_list(record(F.col("idx"), F.col("dur_ms"), F.col("text")))))
    asked = F.concat(F.lit("\n\nAnswer with a JSON array that holds "), F.count("*").cast("string"), F.lit(" strings and nothing else."))
    batches = cues.withColumn("batch_id", C.batch_of(F.col("idx"), size)).groupBy("video_id", "batch_id")
    return batches.agg(F.concat(listed, asked).alias("prompt"))


def translate_offline(cues: DataFrame, memory: DataFrame) -> DataFrame:
    """cues with target: that of the memory row with the same source, else the source text."""
    first = memory.groupBy("source").agg(F.max_by("target", "seq").alias("known"))
    return cues.join(first, cues["text"] == first["source"], "left").withColumn("target", F.coalesce("known", "text")).drop("known", "source")


def refine_offline(drafts: DataFrame, matches: DataFrame) -> DataFrame:
    """Low-scored drafts (video_id, idx, target, score) replaced by the best match (video_id, idx, improved), where there is one that is not empty."""
    found = drafts.join(matches, ["video_id", "idx"], "left")
    better = F.when(Q.low(F.col("score")), F.nullif("improved", F.lit("")))
    return found.withColumn("target", F.coalesce(better, "target")).drop("improved")


def suggest_merges(cues: DataFrame) -> DataFrame:
    """(video_id, a, b): neighbours in a chunk of which the first ends badly.

    Chunks overlap in one cue and a video's rows follow each other, so each two neighbours share a
    chunk: one window finds all pairs.
    """
    after = F.lead("idx").over(C.in_order())
    pairs = cues.select("video_id", "idx", "text").withColumn("b", after).filter(C.ends_badly(F.col("text")) & (F.col("b") == F.col("idx") + 1))
    return pairs.select("video_id", F.col("idx").alias("a"), "b")


def merge_suggested(cues: DataFrame) -> DataFrame:
    """Cues merged by the pairs of ``suggest_merges``, marked in place: one shuffle by video."""
    before = F.lag(F.struct("idx", C.ends_badly(F.col("text")).alias("badly"))).over(C.in_order())
    return C.merge_marked(cues.withColumn("joins", (before["idx"] == F.col("idx") - 1) & before["badly"]))


def merge_task(max_chars: int) -> str:
    return (
        "Each item below is a subtitle cue. Which neighbours were cut in the middle of a phrase and should be one cue, "
        f"of {int(max_chars * 1.5)} characters at most?\nAnswer with a JSON array of pairs [i, i + 1] alone; [] if there are none."
    )


def merge_prompts(cues: DataFrame, max_chars: int = 42) -> DataFrame:
    """(video_id, chunk, prompt): overlapping chunks of cues as a JSON list of i, text; chunks of one cue are left out."""
    placed = C.overlapping_chunks(cues).join(cues.select("video_id", "idx", "text"), ["video_id", "idx"])
    listed = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = placed.groupBy("video_id", "chunk").agg(listed.alias("items")).filter(F.size("items") > 1)
    return grouped.select("video_id", "chunk", F.concat(F.lit(merge_task(max_chars) + "\n\n"), F.to_json("items")).alias("prompt"))


def merge_by_model(cues: DataFrame, client: Callable[[], Callable[[str], str]], max_chars: int = 42, tasks: int | None = None) -> DataFrame:
    """Cues (video_id, idx, start_ms, end_ms, text) merged by the pairs of neighbours that a model names; a chunk whose call fails, or whose answer can't be read, merges none."""
    answers = materialize(run_model(merge_prompts(cues, max_chars), client, tasks=tasks).select("video_id", "raw"), "merges")
    pairs = answers.select("video_id", F.explode(C.neighbour_pairs(F.coalesce("raw", F.lit("")))).alias("p"))
    return C.merge_cues(cues, pairs.select("video_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b")))


def translate_each(cues: DataFrame, client: Callable[[], Callable[[str], str]], transient: Callable[[Exception], bool] = lambda e: isinstance(e, OSError), tasks: int | None = None) -> DataFrame:
    """cues with target and error, by a service that takes one text at a time: each distinct text is asked for once.

    Where the call fails in the end, target is null and error says why; blank texts are not asked for and stay as they are.
    """
    asked = cues.select(F.col("text").alias("prompt")).filter(F.col("prompt").rlike(r"(?U)\S")).distinct()
    answers = materialize(run_model(asked, client, transient, tasks), "answers").withColumnRenamed("raw", "target")
    found = cues.drop("target", "error").join(answers, F.col("text") == F.col("prompt"), "left").drop("prompt")
    return found.withColumn("target", F.coalesce("target", F.when(F.col("error").isNull(), F.coalesce("text", F.lit("")))))


def extract_terms(cues: DataFrame, most: int = TERMS) -> DataFrame:
    """Terms to keep: code-like identifiers, by the number of videos that hold them, the ``most`` commonest."""
    code = r"\b([A-Za-z]+[_.][A-Za-z_.]*[A-Za-z]|[a-z]+[A-Z][A-Za-z]*|[A-Za-z]+[0-9]+[A-Za-z0-9]*)\b"
    each = cues.select("video_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(code), F.lit(1)))).alias("term")).distinct()
    return each.groupBy("term").agg(F.count("*").alias("videos")).orderBy(F.col("videos").desc(), "term").limit(most).withColumn("action", F.lit("keep"))


def best_matches(memory: DataFrame, cues: DataFrame) -> DataFrame:
    """(video_id, idx, improved): target of the most similar memory row of each cue."""
    asked = cues.select(F.struct("video_id", "idx").alias("batch"), F.lit(0).alias("pos"), "text")
    return M.retrieve(memory, asked, per_text=1).select("batch.video_id", "batch.idx", F.col("target").alias("improved"))
