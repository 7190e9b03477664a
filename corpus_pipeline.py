"""From raw documents to packed training sequences, in five stages.

Each stage gets the rows that its predecessor kept, as a written table, and returns the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm import minhash, mixing, packing, secrets, toxicity
from cueloom.storage import materialize, new_path, remove, scratch, table

#: Bytes of rows that a Python worker gets at a time, or one row that is larger.
BATCH = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session that hands rows to Python by BATCH bytes, from then on.

    Spark's own limit is 64 MB; a batch is in the executor and in its worker at once, with what is
    made of it, and workers go from stage to stage with the memory that they once took.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)  # looked at when a plan runs
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the model learns from the labels of the documents given.

    Null and empty texts, and rows with a null or repeated key, are scored like any other by their
    text; an empty table, or one without labels, loses nothing.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Rows with a null doc_id, and null or blank texts, stay; of rows that share a doc_id the first by
    text stays; an empty table stays empty.
    """
    return minhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the name of their kind.

    Every row stays, repeated ones and those with null columns too; null texts stay null.
    """
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it.

    Null is a source of its own; texts that are null or without words go with their source's whole
    copies only; repeated rows are ranked one by one; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    Each row is packed, whatever its key; a null or empty text is its end token alone; an empty table
    gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("near_duplicates", in_small_batches(drop_near_duplicates)),
    ("secrets", in_small_batches(redact_secrets)),
    ("mixing", in_small_batches(mix_sources)),
    ("packing", in_small_batches(pack_sequences)),
]

#: Token ids, shingle signatures and segment scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written before the next reads it.

    What a stage writes for itself goes when its result is written, and a result when the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), path=path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
