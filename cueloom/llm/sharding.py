"""Jump consistent hashing of keys to shards, with gapless places inside each shard (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.storage import materialize, table

#: Rows of one shard are numbered in this many parts, so that no task sorts a whole shard.
PARTS = 1024


def jump_shard(key: Column, shards: int) -> Column:
    """The jump consistent hash of ``key`` for ``shards`` shards.

    The key seeds a sequence of uniform numbers r1, r2, ...; from shard b the next jump goes to
    floor((b + 1) / r), and the last jump below ``shards`` is the answer. The sequence does not
    depend on ``shards``: one more shard takes rows only into itself, about one in shards + 1.
    There is no ring table. At most ``shards`` jumps are made, since each moves up. A null key
    has a sequence of its own, so all null keys share a shard.
    """
    bits = lambda step: F.shiftrightunsigned(F.xxhash64(key, step), 33)
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def jump(state: Column, step: Column) -> Column:
        target = F.floor((state["next"] + 1) * F.lit(float(1 << 31)) / (bits(step) + 1))
        moved = F.struct(state["next"].alias("at"), target.cast("long").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, jump, lambda state: state["at"].cast("int"))


def shard_rows(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", parts: int = PARTS) -> DataFrame:
    """Shard, slot and digest of every row: key, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length plus 1; a null text counts as empty. Slots run from 0 without gaps
    in each shard: rows are numbered inside (shard, part) and moved by the rows of the parts
    before, a table of at most ``shards * parts`` rows, hence small enough to broadcast. The part
    also depends on the text and on the input split, so neither one key nor repeated rows meet
    in one task. So slots, unlike shards, differ where the same rows are split otherwise. Only narrow
    columns are shuffled. Repeated rows get one slot each; null keys share a shard; an empty
    table gives an empty result; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("split"),
    ).withColumn("part", F.pmod(F.xxhash64(key, "text_crc32", "split"), F.lit(parts)).cast("int"))
    placed = materialize(narrow, "shards")
    filled = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy(key, "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "part"])
        .select(
            key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("offset") + F.col("place") - 1).alias("slot"), "grown_shard",
        )
    )


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jump_sharding": op4_jump_sharding}
ORACLES: dict[str, str] = {}
