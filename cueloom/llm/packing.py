"""Packing of token ids into sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.tokens import encoder, slices, tokenizer_path, whole_ids
from cueloom.storage import table

LENGTH = 4096
#: Id after each document.
END = 2
#: Costs, in tokens of padding: a sequence, a cut between sentences, a cut inside one.
OPEN, SENTENCE, INSIDE = 48.0, 4.0, 20.0
#: In a sentence of more than LONG tokens, cuts are offered every STRIDE tokens too.
LONG, STRIDE = 512, 128
#: Tokens that are planned at a time.
PLAN = 1 << 19
#: Sequences of one input partition are numbered from partition * 2**SHIFT.
SHIFT = 40
#: Characters that end sentences, and those that may follow them.
ENDS, AFTER = ".!?。！？…", "\"')]}»”’"


class Cuts(NamedTuple):
    """Places where sequences may be cut, in order from 0 to the last, and the cost of each."""

    at: np.ndarray
    cost: np.ndarray


def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether it ends a sentence: a piece of final marks that ends a word."""
    own = encoder(path)
    vocabulary = own.library.get_vocab(with_added_tokens=True)
    found = np.zeros(max(vocabulary.values()) + 1, bool)
    suffix = own.config["model"].get("end_of_word_suffix") or ""
    for piece, i in vocabulary.items():
        core = piece.removesuffix(suffix).rstrip(AFTER)
        found[i] = piece.endswith(suffix) and bool(core) and all(c in ENDS for c in core)
    return found


def offered_cuts(ids: np.ndarray, document_ends: np.ndarray, ends: np.ndarray, long: int = LONG, stride: int = STRIDE) -> Cuts:
    """Cuts after documents (free) and after sentences; in sentences of more than ``long`` tokens also every ``stride`` ones."""
    cost = np.full(len(ids) + 1, np.inf)
    cost[1:][ends[np.minimum(ids, len(ends) - 1)]] = SENTENCE
    cost[document_ends] = 0.0
    cost[[0, len(ids)]] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    for k in np.flatnonzero(np.diff(at) > long).tolist():
        cost[at[k] + stride : at[k + 1] : stride] = INSIDE
    at = np.flatnonzero(np.isfinite(cost))
    return Cuts(at, cost[at])


def plan(cuts: Cuts, length: int = LENGTH, last: bool = True) -> list[int]:
    """Ends of the sequences that cost least, over all ways to cut in order.

    A sequence costs OPEN, its padding to ``length`` (none at a power of two), and the cost of
    the cut at its end. The best way to a cut at p comes from an earlier cut at q, not more than
    ``length`` before: least best(q) + q over that window, kept in a monotone queue, for padded
    ones; one look each for the powers of two. Unless ``last``, padding of the sequence that
    reaches the end is not counted: it will go on.
    """
    where = np.full(int(cuts.at[-1]) + 1, -1)
    where[cuts.at] = np.arange(len(cuts.at))
    exact: list[list[int]] = [[] for _ in cuts.at]  # earlier cuts at a power of two
    for size in (1 << k for k in range(length.bit_length()) if 1 << k <= length):
        able = np.flatnonzero(cuts.at >= size)
        sources = where[cuts.at[able] - size]
        for i, j in zip(able[sources >= 0].tolist(), sources[sources >= 0].tolist(), strict=True):
            exact[i].append(j)
    at, cost = cuts.at.tolist(), cuts.cost.tolist()
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    final = at[-1]
    for i in range(1, len(at)):
        p = at[i]
        while at[queue[0]] < p - length:
            queue.popleft()
        q = queue[0]
        value = best[q] + at[q] + length - p
        if p == final and not last:
            value, q = min((best[k], k) for k in range(bisect_left(at, p - length), i))
        for j in exact[i]:
            if best[j] < value:
                value, q = best[j], j
        best[i], back[i] = value + OPEN + cost[i], q
        key = best[i] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
    found, i = [], len(at) - 1
    while i:
        found.append(at[i])
        i = back[i]
    return found[::-1]


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Packer:
    """Packs the documents of one partition in their order; holds about PLAN tokens."""

    def __init__(self, ends: np.ndarray, first_sequence: int, length: int = LENGTH):
        self.ends, self.sequence, self.length = ends, first_sequence, length
        self.waiting: list[tuple[object, int, int, np.ndarray]] = []  # key, start, doc_tokens, ids
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.waiting.append((key, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= PLAN:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        """Pieces of the sequences planned over all waiting ids; unless last, the one at the end waits on."""
        if not self.held:
            return
        ids = np.concatenate([x[3] for x in self.waiting])
        stops = np.cumsum([len(x[3]) for x in self.waiting])
        found = plan(offered_cuts(ids, stops, self.ends, min(LONG, self.length), min(STRIDE, self.length)), self.length, last)
        done = found if last else found[:-1]
        at, k, begin = 0, 0, 0
        for stop in done:
            offset = 0
            while at < stop:
                key, start, total, _ = self.waiting[k]
                n = min(int(stops[k]), stop) - at
                yield key, start + at - begin, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), total, self.sequence, offset
                offset, at = offset + n, at + n
                if at == stops[k]:
                    k, begin = k + 1, at
            self.sequence += 1
        rest = self.waiting[k:]
        if rest and at > begin:
            key, start, total, own = rest[0]
            rest[0] = (key, start + at - begin, total, own[at - begin :])
        self.waiting, self.held = rest, len(ids) - at


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, then ``end``. The documents of an input
    partition are packed in their order, each id into one piece; pieces of a sequence follow
    each other without gaps. Sequences are padded to ``length`` except at a power of two, so the
    last ids of a partition end in sequences of such lengths. Each input partition is read as a
    stream and about PLAN tokens are held at a time, so there is no shuffle, and neither a hot
    source nor a huge document makes a task larger than its split. Null texts are empty and give
    their end id; keys may be null or repeat: each row is packed; an empty table gives no rows.
    """
    path = path or tokenizer_path()
    schema = T.StructType([docs.schema[key], *PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(sentence_ends(path), TaskContext.get().partitionId() << SHIFT, length)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], schema.names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, rows, k = batch.column(0).to_pylist(), [], 0
            for texts in slices(batch.column(1)):
                flat, offsets = whole_ids(texts, path)
                for a, b in pairwise(offsets.tolist()):
                    rows += packer.add(keys[k], np.append(flat[a:b], np.uint32(end)))
                    k += 1
            yield batch_of(rows)
        if key_type is not None:
            yield batch_of(list(packer.flush()))

    return docs.select(key, text).mapInArrow(run, schema)


def op3_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_sequence_packing": op3_sequence_packing}
ORACLES: dict[str, str] = {}


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Tokens and padding of all sequences."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return per.agg(F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(length - F.col("n"))).alias("padding"), F.count("*").alias("sequences"))
