"""Translation memory and glossary: admission, upserts, similarity retrieval."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as X

MEMORY_CAP, GLOSSARY_CAP = 5000, 2000
LEAST_WORDS = 3
PER_TEXT, PER_BATCH = 2, 5
LEAST_SHARE = 0.3


def admit(rows: DataFrame, scoring: bool = True, unscored: float = 80.0) -> DataFrame:
    """Rows (source, target, score) that may enter a memory: three words or more, a translation, and a score.

    A negative score is unknown: with scoring off it counts as ``unscored``, else the row is left out.
    """
    score = F.when(F.col("score") >= 0, F.col("score"))
    score = score if scoring else F.coalesce(score, F.lit(unscored))
    kept = rows.filter((F.size(X.tokens(F.col("source"))) >= LEAST_WORDS) & (X.trim(F.col("target")) != ""))
    return kept.withColumn("score", score).filter("score is not null")


def newest(rows: DataFrame, cap: int, order: str = "first_seq") -> DataFrame:
    """The ``cap`` rows with the largest order."""
    return rows.orderBy(F.col(order).desc()).limit(cap)


def upsert_memory(rows: DataFrame, cap: int | None = MEMORY_CAP) -> DataFrame:
    """Memory after an upsert of rows (seq, origin existing/new, source, target, score).

    Per source: the newest target, the greatest of the last existing score and all new ones, the
    place of the first row. Partial aggregates, so a hot source is no burden.
    """
    existing = F.col("origin") == "existing"
    merged = rows.groupBy("source").agg(
        F.max_by("target", "seq").alias("target"),
        F.greatest(F.max_by(F.when(existing, F.col("score")), F.when(existing, F.col("seq"))), F.max(F.when(~existing, F.col("score")))).alias("score"),
        F.min("seq").alias("first_seq"),
    )
    return merged if cap is None else newest(merged, cap)


#: Rows that a task holds while it merges those of equal keys.
MERGED_ROWS = 1 << 20


def _merged(key: str, order: str, newest: bool):
    """Rows to one of each key in about MERGED_ROWS of them: that of the largest or least order, with the least ``first_seq``."""

    def reduced(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        code = rows[key].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        place = rows[order].to_numpy()
        by_key = np.lexsort((place if newest else -place, code))
        starts = np.flatnonzero(np.r_[True, np.diff(code[by_key]) != 0])
        first = np.minimum.reduceat(rows["first_seq"].to_numpy()[by_key], starts)
        kept = rows.take(pa.array(by_key[np.r_[starts[1:], len(by_key)] - 1]))
        return kept.set_column(kept.schema.get_field_index("first_seq"), "first_seq", pa.array(first)).combine_chunks().to_batches()[0]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            known = batch.filter(pc.is_valid(batch[order]))
            if known.num_rows < batch.num_rows:
                yield batch.filter(pc.is_null(batch[order]))
            if known.num_rows:
                held, n = [*held, known], n + known.num_rows
            if n >= MERGED_ROWS:
                held = [reduced(held)]
                n = held[0].num_rows
                if n >= MERGED_ROWS // 2:
                    yield held[0]
                    held, n = [], 0
        if held:
            yield reduced(held)

    return merge


def one_of_each(rows: DataFrame, key: str, order: str = "seq", newest: bool = False) -> DataFrame:
    """Of each key the row of the least order, or of the largest (``newest``), and its least order as ``first_seq``; order is a long.

    A task merges the rows of equal keys as they come, so what is sorted and shuffled is the keys of a task and not all rows.
    """
    marked = rows.withColumn(order, F.col(order).cast("long")).withColumn("first_seq", F.col(order).cast("long"))
    others = F.struct(*[c for c in rows.columns if c != key])
    picked = F.max_by(others, order) if newest else F.min_by(others, order)
    return marked.mapInArrow(_merged(key, order, newest), marked.schema).groupBy(key).agg(picked.alias("p"), F.min("first_seq").alias("first_seq")).select(key, "p.*", "first_seq")


def upsert_glossary(rows: DataFrame, cap: int | None = GLOSSARY_CAP) -> DataFrame:
    """Glossary after an upsert of rows (seq, term, action, target, context): the newest row of a term, at its first place."""
    merged = one_of_each(rows.select("seq", "term", "action", "target", "context"), "term", newest=True).select("term", "action", "target", "context", "first_seq")
    return merged if cap is None else newest(merged, cap)


def add_terms(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing terms, and of the found ones the first row of each term that is not there yet; case counts."""
    first = one_of_each(found.select(existing.columns), "term")
    return existing.unionByName(first.join(existing, "term", "left_anti").select(existing.columns))


#: Rows of a memory that a task holds at once.
MEMORY_BLOCK = 4096


class _Block:
    """Rows of a memory by their words, to measure texts against."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, pa.StringArray]] = []
        self.seqs, self.rows_of = None, {}

    def add(self, seqs: np.ndarray, words: pa.StringArray) -> None:
        self.parts.append((seqs, words))

    def close(self) -> None:
        self.seqs = np.concatenate([s for s, _ in self.parts])
        words = pc.split_pattern(pa.concat_arrays([w for _, w in self.parts]), " ")
        named = words.flatten().dictionary_encode()
        place, word = pc.list_parent_indices(words).to_numpy().astype(np.intp), named.indices.to_numpy()
        order = np.argsort(word, kind="stable")
        cuts = np.flatnonzero(np.diff(word[order])) + 1
        self.rows_of = dict(zip((named.dictionary[int(w)].as_py() for w in word[order[np.r_[0, cuts]]]), np.split(place[order], cuts), strict=True)) if len(word) else {}

    def best(self, words: list[str], most: int) -> list[tuple[int, float]]:
        """(seq, share) of the ``most`` rows that hold the largest share of a text's words, repeats counted; ties go by seq."""
        found = [rows for w in words if (rows := self.rows_of.get(w)) is not None]
        if not found:
            return []
        held = np.bincount(np.concatenate(found))
        near = np.flatnonzero(held >= max(1, int(LEAST_SHARE * len(words))))
        if not len(near):
            return []
        share = held[near] / len(words)
        near, share = near[share > LEAST_SHARE], share[share > LEAST_SHARE]
        first = np.lexsort((self.seqs[near], -share))[:most]
        return list(zip(self.seqs[near[first]].tolist(), share[first].tolist(), strict=True))


def _measured(per_text: int):
    """Rows (part, block, kind, batch, pos, seq, words), sorted by the first three, to (batch, pos, seq, share): a block's memory, then the texts that meet it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, open_ = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            part, number, kind = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
                rows, here = batch.slice(begin, end - begin), (part[begin], number[begin])
                if here != at:
                    at, block, open_ = here, _Block(), True
                if kind[begin] == 0:
                    block.add(rows.column(5).to_numpy(), rows.column(6))
                    continue
                if not block.parts:
                    continue
                if open_:
                    block.close()
                    open_ = False
                known, place, seqs, shares = {}, [], [], []
                for k, text in enumerate(rows.column(6).to_pylist()):
                    if text not in known:
                        known[text] = block.best(text.split(" "), per_text)
                    for seq, share in known[text]:
                        place.append(k), seqs.append(seq), shares.append(share)
                taken = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(3).take(taken), rows.column(4).take(taken), pa.array(seqs, pa.int64()), pa.array(shares, pa.float64())], ["batch", "pos", "seq", "share"])

    return measure


def retrieve(memory: DataFrame, texts: DataFrame, per_text: int = PER_TEXT, per_batch: int = PER_BATCH) -> DataFrame:
    """Similar memory rows for each batch: batch, place, source, target.

    memory: seq, source, target. texts: batch, pos, text. Similarity is the share of a text's
    words, repeats counted, that occur in a source; it must exceed LEAST_SHARE, and the text must
    have three words. Of each text the best ``per_text``, then per batch the first of each source,
    ``per_batch`` at most. Ties go by seq. Exact: texts are dealt over tasks, the memory goes to all of
    them in blocks of about MEMORY_BLOCK rows, and a task adds up the rows of a text's words; no pair of
    a text and a row, and no word, is shuffled. Each block gets a copy of the texts; a memory of MEMORY_CAP rows has two.
    """
    spark = texts.sparkSession
    blocks = max(1, -(-memory.count() // MEMORY_BLOCK))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batch, pos = texts.schema["batch"].dataType, texts.schema["pos"].dataType
    words, held = X.tokens(F.col("text")), F.array_distinct(X.tokens(F.coalesce("source", F.lit(""))))
    joined = lambda listed: F.array_join(listed, " ").alias("words")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = texts.filter(F.size(words) >= LEAST_WORDS).select(F.pmod(F.xxhash64("batch", "pos"), F.lit(tasks)).cast("int").alias("part"), each(blocks).alias("block"), F.lit(1).alias("kind"), "batch", "pos", F.lit(None).cast("long").alias("seq"), joined(words))
    kept = memory.select(each(tasks).alias("part"), F.pmod(F.xxhash64("seq"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.lit(None).cast(batch).alias("batch"), F.lit(None).cast(pos).alias("pos"), F.col("seq").cast("long").alias("seq"), joined(held))
    dealt = kept.unionByName(asked).repartition(tasks, "part", "block").sortWithinPartitions("part", "block", "kind")
    schema = T.StructType([T.StructField("batch", batch), T.StructField("pos", pos), T.StructField("seq", T.LongType()), T.StructField("share", T.DoubleType())])
    similar = dealt.mapInArrow(_measured(per_text), schema)
    best = similar.withColumn("rank", F.row_number().over(Window.partitionBy("batch", "pos").orderBy(F.col("share").desc(), "seq"))).filter(F.col("rank") <= per_text)
    named = memory.select("seq", F.min("seq").over(Window.partitionBy("source")).alias("name"))  # a number for a source, so that texts join only what is left
    first = best.join(named, "seq").withColumn("again", F.row_number().over(Window.partitionBy("batch", "name").orderBy("pos", "rank"))).filter("again = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("pos", "rank"))).filter(F.col("place") <= per_batch)
    return placed.join(memory.select("seq", "source", "target"), "seq").select("batch", "place", "source", "target")


#: First lines of the parts of a prompt.
GLOSSARY_HEAD = "Terminology (use flexibly based on context):"
MEMORY_HEAD = "Reference translations from memory:"
CONTEXT_HEAD = "Recent translations for context continuity:"


def pair_line(source: Column, target: Column) -> Column:
    return F.concat(F.lit('- "'), source, F.lit('" → "'), target, F.lit('"'))


def memory_lines(found: DataFrame) -> DataFrame:
    """Retrieved rows of a batch as part of a prompt."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", pair_line(F.col("source"), F.col("target")).alias("line")))), lambda x: x["line"])
    return found.groupBy("batch").agg(F.concat_ws("\n", F.lit(MEMORY_HEAD), listed).alias("lines"))


def context_lines(context: Column) -> Column:
    """A context (array of text, target) as part of a prompt; empty without any."""
    lines = F.transform(context, lambda x: pair_line(x["text"], x["target"]))
    return F.when(F.size(context) > 0, F.concat_ws("\n", F.lit(CONTEXT_HEAD), lines)).otherwise("")


def glossary_line(term: Column, action: Column, target: Column) -> Column:
    """Fixed format of a term's line."""
    told = F.when(action == "keep", "keep as-is").when(action == "translate", F.concat(F.lit('"'), target, F.lit('"'))).otherwise("decide by context")
    return F.concat(F.lit('- "'), term, F.lit('" → '), told)


def glossary_lines(rows: DataFrame, order: str = "first_seq") -> DataFrame:
    """One row ``lines``: the newest GLOSSARY_CAP terms of a glossary as part of a prompt."""
    line = F.struct(order, glossary_line(F.col("term"), F.col("action"), F.col("target")).alias("line"))
    return newest(rows, GLOSSARY_CAP, order).agg(F.concat_ws("\n", F.lit(GLOSSARY_HEAD), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])).alias("lines"))
