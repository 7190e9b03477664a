"""Incremental ingest and translation of subtitle files, and streaming memory upserts."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.operators.memory import MEMORY_CAP, admit, newest, upsert_memory
from cueloom.operators.ordering import numbered
from cueloom.operators.translation import Client, Settings, translate
from cueloom.sources.subtitles import decode_subtitles, parse_srt
from cueloom.storage import Versions, is_written, materialize, new_path, scratch, slice_of, slices, write


def subtitle_stream(spark: SparkSession, folder: str, glob: str = "*.srt") -> DataFrame:
    """(video_id, text) of the files of a folder, each once; video_id is the path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)
    return files.select(F.col("path").alias("video_id"), "content")


def ingest_subtitles(stream: DataFrame, out: str, checkpoint: str):
    """A query that parses SRT texts it has not seen yet into the Parquet table ``out``; it ends when none is left.

    stream: video_id, and text or the file's content. A batch that runs again replaces itself.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        texts = decode_subtitles(batch) if "content" in batch.columns else batch
        parse_srt(texts.select("video_id", "text")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MemoryTable:
    """A memory in versions (``storage.Versions``): each upsert writes the next one, readers take the last.

    All state is in the folder, so a new process, or a query that starts again, goes on from the
    last whole version. A version is labelled with its stream and batch: a batch that runs again
    after its version was written changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int | None = MEMORY_CAP):
        self.spark, self.cap, self.versions = spark, cap, Versions(spark, path)

    def read(self) -> DataFrame:
        last = self.versions.last()
        if last is None:
            return self.spark.createDataFrame([], "source string, target string, score double, first_seq long")
        return self.spark.read.parquet(last.path)

    def has(self, batch_id: int, stream: str) -> bool:
        """Whether a batch of a stream is there already."""
        return any(v.label == self._label(batch_id, stream) for v in self.versions.whole())

    @staticmethod
    def _label(batch_id: int, stream: str) -> str:
        return f"{hashlib.sha256(stream.encode()).hexdigest()[:16]}-{batch_id}"

    def upsert(self, batch: DataFrame, batch_id: int, stream: str = "batch", first: int | None = None) -> None:
        """Merge rows (seq, source, target, score); new rows come after all old ones, in the batch by their ``seq``, whose least is ``first``, unless it is to be looked up."""
        if self.has(batch_id, stream):
            return
        old = self.read().select(F.col("first_seq").alias("seq"), F.lit("existing").alias("origin"), "source", "target", "score")
        last = old.agg(F.max("seq")).first()[0] or 0
        least = first or batch.agg(F.min("seq")).first()[0] or 0
        new = batch.select((F.col("seq") - least + last + 1).alias("seq"), F.lit("new").alias("origin"), "source", "target", "score")
        merged = upsert_memory(old.unionByName(new), self.cap).select("source", "target", "score", "first_seq")
        write(merged, self.versions.next_path(self._label(batch_id, stream)), "overwrite")
        self.versions.trim()

    def held(self, rows: DataFrame) -> DataFrame:
        """(seq, source, target, score) of rows (video_id, idx, source, target, score), a written table, numbered along video and index: those of all sources that are in the memory after them.

        Only digests of sources are numbered and shuffled, and of a table with a cap only rows of sources that it has or will take; the others change nothing.
        """
        digest = F.unhex(F.md5("source")).alias("digest")
        keys = materialize(numbered(rows.select("video_id", "idx", digest), "video_id", "idx"), "keys")
        texts = rows.select("video_id", "idx", "source", "target", "score")
        if self.cap is not None:  # twice as many digests at most are broadcast
            old = self.read().select(digest).distinct()
            fresh = newest(keys.join(F.broadcast(old), "digest", "left_anti").groupBy("digest").agg(F.min("seq").alias("first_seq")), self.cap)
            taken = materialize(old.unionByName(fresh.select("digest")), "taken")
            keys = keys.join(F.broadcast(taken), "digest", "left_semi")
            texts = texts.withColumn("digest", digest).join(F.broadcast(taken), "digest", "left_semi").drop("digest")
        return texts.join(keys.drop("digest"), ["video_id", "idx"]).select("seq", "source", "target", "score")


def stream_memory(rows: DataFrame, memory: MemoryTable, checkpoint: str):
    """A query that upserts each micro-batch of a stream (seq, source, target, score); the checkpoint names the stream."""
    add = lambda batch, batch_id: memory.upsert(batch, batch_id, checkpoint)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def translate_subtitles(stream: DataFrame, client: Client, out: str, checkpoint: str, memory: MemoryTable, settings: Settings = Settings(), sleep: Callable = time.sleep):
    """A query that translates SRT texts it has not seen yet (video_id, and text or the file's content) with a memory that grows batch by batch.

    Cues go to the Parquet table ``out`` with their batch, then the memory takes what it admits. A batch that runs again after its cues were
    written translates nothing: it goes on with those, so neither table changes and no model is asked twice. A batch goes by slices of its videos, and
    what it wrote on the way goes with them.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{out}/batch={batch_id}"
        if not is_written(spark, path):
            with scratch(spark):
                decoded = decode_subtitles(batch) if "content" in batch.columns else batch
                at = new_path(spark, "texts")
                texts = materialize(decoded.select("video_id", "text"), path=at)
                known = memory.read().withColumnRenamed("first_seq", "seq") if memory.versions.last() else None
                n = slices(spark, at)
                for k in range(n):
                    with scratch(spark):
                        done = translate(parse_srt(slice_of(texts, "video_id", k, n)), client, known, settings=settings, sleep=sleep)
                        write(done.cues, path, "append" if k else "overwrite", k == n - 1)
        if not memory.has(batch_id, checkpoint):
            with scratch(spark):
                cues = spark.read.parquet(path).select("video_id", "idx", F.col("text").alias("source"), "target", "score")
                memory.upsert(memory.held(admit(cues, settings.scoring)), batch_id, checkpoint, 1)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
