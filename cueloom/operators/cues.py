"""Cues: building, segmentation, merging, batches and context windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as X

BATCH, SCORE_BATCH = 7, 10
CHUNK, OVERLAP = 20, 1
CONTEXT = 5
SEQUENTIAL_BATCHES = 3
MAX_WORDS = 12


def in_order(*order) -> Window:
    return Window.partitionBy("video_id").orderBy(*(order or ("idx",)))


def cues_of_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cues of plain texts: their non-blank lines, 60 ms a character and 500 ms at least, one after the other.

    ``keep`` names columns of the texts that their cues carry.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"(?U)\S"))
    lasting = lambda line: F.greatest(F.lit(500), F.length(line) * 60).cast("long")
    listed = docs.select(F.col(key).alias("video_id"), lines.alias("lines"), *keep)
    rows = listed.select("video_id", *keep, F.posexplode("lines").alias("pos", "text"))
    timed = rows.select("video_id", (F.col("pos") + 1).alias("idx"), "text", lasting(F.col("text")).alias("dur_ms"), *keep)
    before = F.coalesce(F.sum("dur_ms").over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = timed.withColumn("start_ms", before).withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))
    return placed.select("video_id", "idx", "text", "start_ms", "end_ms", *keep)


def words_of_cues(cues: DataFrame) -> DataFrame:
    """Words of cues with times spread evenly; pos counts through the video, each word has a leading space."""
    listed = cues.select("video_id", "idx", "start_ms", "end_ms", X.tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    before = F.coalesce(F.sum("n").over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = listed.withColumn("before", before).select("video_id", "start_ms", "end_ms", "n", "before", F.posexplode("w").alias("k", "token"))
    step = (F.col("end_ms") - F.col("start_ms")) / F.col("n")
    second = lambda k: (F.col("start_ms") + step * k) / 1000
    return each.select(
        "video_id",
        (F.col("before") + F.col("k")).cast("int").alias("pos"),
        F.concat(F.lit(" "), "token").alias("word"),
        second(F.col("k")).alias("start"),
        second(F.col("k") + 1).alias("end"),
    )


def duration_ms(start: Column, end: Column) -> Column:
    """Of a cue to translate: 100 at least, 2000 where it has no times."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(100), end - start)).otherwise(2000).cast("long")


def renumber(cues: DataFrame) -> DataFrame:
    return cues.withColumn("idx", F.row_number().over(in_order()))


def drop_blank(cues: DataFrame) -> DataFrame:
    return cues.filter(F.col("text").rlike(r"(?U)\S"))


def rule_segments(words: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Cues that end after a word with . ! ? or after ``max_words`` words; blank ones are dropped.

    Words are sorted once along their video; a task cuts them as they come and holds one cue.
    """
    ends = F.coalesce(X.rtrim(F.col("word")).rlike("[.!?]$"), F.lit(False))
    placed = words.select("video_id", "pos", "word", "start", "end", ends.alias("ends"), F.row_number().over(in_order("pos")).alias("row"))  # brings a video together
    types = words.schema
    schema = T.StructType([types["video_id"], *[T.StructField(n, types[c].dataType) for n, c in (("first_word", "pos"), ("start", "start"), ("end", "end"))], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, video, n, open_, said, begin, until = None, None, 0, False, [], None, None

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow, strict=True)], schema.names)

        for batch in batches:
            arrow, done = arrow or [*(batch.column(k).type for k in (0, 1, 3, 4)), pa.string()], []
            for v, pos, word, start, end, last in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if open_ and v == video and n < max_words:
                    n += 1
                else:
                    if n:
                        done.append((video, *begin, until, "".join(said)))
                    video, n, begin, said = v, 1, (pos, start), []
                said.append(word or "")
                until, open_ = end, not last
            if done:
                yield rows(done)
        if n:
            yield rows([(video, *begin, until, "".join(said))])

    cues = placed.sortWithinPartitions("video_id", "pos").mapInArrow(cut, schema)
    return cues.withColumn("text", X.trim(F.col("text"))).filter("text <> ''")


def neighbour_pairs(raw: Column) -> Column:
    """Of a JSON list of pairs those of neighbours: [a, a + 1]. The whole answer, else what lies between its first [ and its last ]."""
    parsed = lambda s: F.when(s.rlike(X.PAIRS), F.from_json(s, "array<array<int>>"))
    inner = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    return F.filter(F.coalesce(parsed(X.trim(raw)), parsed(inner), F.array().cast("array<array<int>>")), lambda x: (F.size(x) == 2) & (x[1] == x[0] + 1))


def merge_cues(cues: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each cue that is second in a pair (video_id, a, b) joins the one before; renumbered from 1."""
    targets = pairs.select("video_id", F.col("b").alias("idx"), F.lit(True).alias("joins")).distinct()
    return merge_marked(cues.join(targets, ["video_id", "idx"], "left"))


def merge_marked(cues: DataFrame) -> DataFrame:
    """Each cue that ``joins`` is joined to the one before, the first of a video to none; renumbered from 1."""
    opens = F.when(F.row_number().over(in_order()) == 1, 1).otherwise(1 - F.coalesce("joins", F.lit(False)).cast("int"))
    grouped = cues.withColumn("opens", opens).withColumn("grp", F.sum("opens").over(in_order())).groupBy("video_id", "grp")
    items = grouped.agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", "text"))).alias("i"))
    first, last = F.element_at("i", 1), F.element_at("i", -1)
    between = F.transform(F.slice("i", 2, F.greatest(F.size("i") - 2, F.lit(0))), lambda x: X.trim(x["text"]))
    joined = F.concat_ws(" ", X.rtrim(first["text"]), between, X.ltrim(last["text"]))
    text = F.when(F.size("i") > 1, joined).otherwise(first["text"])
    return items.select("video_id", F.col("grp").cast("int").alias("idx"), first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), text.alias("text"))


def overlapping_chunks(cues: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(video_id, chunk, idx): chunks of ``size`` cues, neighbours share ``overlap``."""
    step = size - overlap
    n = F.count("*").over(Window.partitionBy("video_id"))
    row = (F.row_number().over(in_order()) - 1).alias("row")
    placed = cues.select("video_id", "idx", n.alias("n"), row)
    last = F.greatest(F.lit(1), F.ceil((F.col("n") - overlap) / step)) - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("row") - size + 1) / step))
    chunk = F.explode(F.sequence(first, F.least(last, F.floor(F.col("row") / step))).cast("array<int>"))
    return placed.select("video_id", chunk.alias("chunk"), "idx")


def batch_of(row: Column, size: int = BATCH) -> Column:
    return F.floor((row - 1) / size).cast("int")


def wave_of(batch: Column, chained: bool, threads: int) -> Column:
    """Batches of a wave run together: each alone when chained, else the first three alone and then ``threads`` at a time."""
    if chained:
        return batch
    return F.when(batch < SEQUENTIAL_BATCHES, batch).otherwise(SEQUENTIAL_BATCHES + F.floor((batch - SEQUENTIAL_BATCHES) / threads)).cast("int")


def wave_contexts(done: DataFrame, chained: bool = True, threads: int = 4) -> DataFrame:
    """(video_id, batch, wave, context): the last 5 non-empty pairs translated before the batch's wave.

    ``done``: video_id, idx, text, target. A wave keeps its last five pairs, pairs are counted along
    the waves of a video, and a frame over the count holds the waves that the last five come from. So
    there is a row of five pairs for each wave, not for each cue, and one shuffle serves all windows.
    """
    waved = done.withColumn("batch", batch_of(F.col("idx"))).withColumn("wave", wave_of(F.col("batch"), chained, threads))
    pair = F.when(F.coalesce(F.col("target") != "", F.lit(False)), F.struct("idx", "text", "target"))
    newest = lambda pairs: F.slice(F.sort_array(pairs, False), 1, CONTEXT)
    waves = waved.groupBy("video_id", "wave").agg(F.collect_set("batch").alias("batches"), F.count(pair).alias("n"), newest(F.collect_list(pair)).alias("last"))
    along = Window.partitionBy("video_id").orderBy("wave")
    counted = waves.withColumn("n_pairs", F.sum("n").over(along)).withColumn("last", F.when(F.col("n") > 0, F.col("last")))
    five = Window.partitionBy("video_id").orderBy("n_pairs").rangeBetween(1 - CONTEXT, Window.currentRow)
    held = counted.withColumn("held", newest(F.flatten(F.collect_list("last").over(five)))).drop("last")
    context = F.coalesce(F.array_sort(F.lag("held").over(along)), F.array().cast(held.schema["held"].dataType))
    return held.withColumn("context", context).select("video_id", F.explode("batches").alias("batch"), "wave", "context")


def word_offsets(words: DataFrame) -> DataFrame:
    """words with ``off``: characters of the video's text before each."""
    before = in_order("pos").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("off", F.coalesce(F.sum(F.length("word")).over(before), F.lit(0)))


def word_ranges(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(video_id, seg, first_word, last_word) of segments given as texts in order.

    A segment spans its characters in the words' joined text; the first word may begin 2
    characters earlier. Words and the two ends of segments are put in one order of offsets: a
    segment's first word is the next one from its begin, its last the one before its end. So the
    work grows with words and segments, not with their product.
    """
    start = F.coalesce(F.sum(F.length("text")).over(in_order("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = segments.withColumn("from_off", start).withColumn("to_off", F.col("from_off") + F.length("text"))
    ends = F.inline(F.array(*[F.struct(F.lit(name).alias("end"), off.alias("off")) for name, off in (("first", F.col("from_off") - 2), ("last", F.col("to_off")))]))
    marks = spans.select("video_id", "seg", ends).withColumn("pos", F.lit(None).cast("long"))
    no_segment, no_end = F.lit(None).cast(segments.schema["seg"].dataType), F.lit(None).cast("string")
    placed = word_offsets(words).select("video_id", no_segment.alias("seg"), no_end.alias("end"), "off", F.col("pos").cast("long").alias("pos"))
    line = marks.unionByName(placed)
    in_video = Window.partitionBy("video_id")
    earlier = in_video.orderBy("off", F.col("pos").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    later = in_video.orderBy(F.col("off").desc(), F.col("pos").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("before", F.last("pos", True).over(earlier)).withColumn("after", F.last("pos", True).over(later))
    at = lambda end, word: F.max(F.when(F.col("end") == end, F.col(word))).alias(f"{end}_word")
    found = seen.filter("seg is not null").groupBy("video_id", "seg").agg(at("first", "after"), at("last", "before"))
    ranges = found.filter("first_word <= last_word")
    after = F.max("last_word").over(in_order("seg").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("first_word", F.greatest("first_word", F.coalesce(after + 1, F.lit(0)))).filter("first_word <= last_word")


def ends_badly(s: Column) -> Column:
    last = F.lower(F.element_at(F.concat(F.array(F.lit("")), X.tokens(F.regexp_replace(X.trim(s), "[,.;:!?\"']+$", ""))), -1))
    return last.isin(*X.BAD_ENDINGS)


def repair_boundaries(segments: DataFrame, max_chars: int) -> DataFrame:
    """Segments (video_id, idx, text, start_ms, end_ms) that end badly take in the next while that stays within 1.5 max_chars.

    A merge never crosses a segment that ends well, so these bound islands; the greedy fold runs
    over one island's array at a time.
    """
    opens = F.coalesce(F.lag(~ends_badly(F.col("text"))).over(in_order()), F.lit(True)).cast("int")
    islands = segments.withColumn("opens", opens).withColumn("island", F.sum("opens").over(in_order()))
    items = islands.groupBy("video_id", "island").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", "text"))).alias("i"))
    kind = "array<struct<idx:int,start_ms:bigint,end_ms:bigint,text:string>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & ends_badly(last["text"]) & (F.length(last["text"]) + 1 + F.length(x["text"]) <= max_chars * 1.5)
        merged = F.struct(last["idx"].alias("idx"), last["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.concat(X.rtrim(last["text"]), F.lit(" "), X.ltrim(x["text"])).alias("text"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(merged))
        return F.when(fits, grown).otherwise(F.concat(done, F.array(x))).cast(kind)

    folded = F.aggregate(F.col("i").cast(kind), F.array().cast(kind), step)
    return items.select("video_id", F.inline(folded))


def in_stride(row: Column, total: Column, n: int) -> Column:
    """Whether a row (from 0) of ``total``, which are more than n, is one of the n rows floor(i * total / n)."""
    i = F.ceil(row * n / total)
    return (i < n) & (F.floor(i * total / n) == row)


def stride_sample(rows: DataFrame, n: int = 50) -> DataFrame:
    """Of each video's rows n in even strides, or all if there are no more: row floor(i * len / n)."""
    total = F.count("*").over(Window.partitionBy("video_id"))
    placed = rows.withColumn("n_rows", total).withColumn("row", F.row_number().over(in_order()) - 1)
    return placed.filter((F.col("n_rows") <= n) | in_stride(F.col("row"), F.col("n_rows"), n)).drop("n_rows", "row")


def sample_language(words: DataFrame, first: int = 100) -> DataFrame:
    """(video_id, language) by the scripts of the first words."""
    listed = words.filter(F.col("pos") < first).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("i"))
    return listed.select("video_id", X.script_language(F.array_join(F.col("i.word"), "")).alias("language"))


@lru_cache(1 << 16)
def _letters(s: str) -> str:
    return "".join(c for c in s if c.isalpha()).lower()


def realign(words: DataFrame, texts: DataFrame, ahead: int = 3) -> DataFrame:
    """Words with the spelling of a punctuated text (video_id, text).

    Each word looks up to ``ahead`` tokens ahead for one with the same letters; a match moves the
    cursor and keeps the word's leading space. The cursor depends on all earlier words: a fold
    over one video's words, which meet its text, held once, in a cogroup. Words of videos without
    a text stay as they are.
    """
    def fold(own: pa.Table, text: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        spelled = ((text["text"][0].as_py() if len(text) else None) or "").split()
        bare = [_letters(s) for s in spelled]
        at, out = 0, []
        for word in own["word"].to_pylist():
            wanted = _letters(word)
            hit = next((k for k in range(at, min(at + ahead, len(spelled))) if bare[k] == wanted), None) if wanted else None
            if hit is not None:
                word, at = (" " if word.startswith(" ") else "") + spelled[hit], hit + 1
            out.append(word)
        return own.set_column(own.schema.get_field_index("word"), "word", pa.array(out, pa.string()))

    return words.groupBy("video_id").cogroup(texts.select("video_id", "text").groupBy("video_id")).applyInArrow(fold, words.schema)
