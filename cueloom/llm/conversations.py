"""Prefix tries of conversations: sorted shards of paths, and a skeleton of what crosses their splitters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.storage import materialize, table

#: Bytes of a turn in a path.
TURN = 16
#: Turns of a shard, on average, at most.
SHARD = 1 << 19
#: Ids joined in one piece of the list of a node that crosses a splitter.
PIECE = 512
EMPTY = hashlib.sha256().hexdigest()

STEPS = "array<struct<digest:string,words:bigint>>"
PARTIAL = (
    "part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, turn_digest string, at int, above int, ends array<string>"
)
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_digest")


def turn_digest(role: Column, text: Column) -> Column:
    """32 hexadecimal digits that stand for a turn; the length of the role keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * TURN)


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, steps): a row per conversation with the digest and the words of its turns, in order.

    Turns are ordered by number, null first, those that share one by digest; a repeated row is a turn
    of its own. A null role or text is empty. Rows without a key belong to no conversation; other
    columns are ignored. Texts are read once and not shuffled; a turn is 24 bytes of its conversation's row.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    words = F.regexp_count(text_, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.col(turn).isNotNull().alias("numbered"), F.col(turn).alias("number"), turn_digest(role_, text_).alias("digest"), words.alias("words"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("numbered", "number", "digest", "words"))).alias("steps"))
    return listed.select("conv_id", F.transform("steps", lambda s: F.struct(s["digest"].alias("digest"), s["words"].alias("words"))).alias("steps"))


def branched(convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations rebuilt as branches: (conv_id, steps).

    A conversation c starts with the first h turns of conversation c - c % every (all if it has
    fewer, none if there is none), h being crc32 of the decimal c modulo ``most + 1``; its own turns
    follow after its first h. At most ``every`` conversations share a start, so no key is hot.
    """
    heads = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, most).alias("head"))
    own = convs.select("conv_id", "steps", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int").alias("h"))
    start = F.slice(F.coalesce("head", F.lit(None).cast(STEPS), F.array().cast(STEPS)), F.lit(1), F.col("h"))
    rest = F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(start, rest).alias("steps"))


def common(a: bytes, b: bytes) -> int:
    """Turns with which two paths both begin."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = (np.frombuffer(p, np.uint8, n) for p in (a, b))
    return int((x != y).argmax()) // TURN


class Skeleton(NamedTuple):
    """The trie of the splitter paths, as common depths of neighbours among the first and last paths of all shards.

    before[s]: of the last path of the shard before s and the first of s (-1 for the first shard);
    inside[s]: of the first and the last path of s. parts: the numbers of the shards, in order.
    """

    parts: np.ndarray
    before: np.ndarray
    inside: np.ndarray

    def begins(self, shard: int) -> np.ndarray:
        """The shard in which the node of each depth begins that crosses the splitter before ``shard``."""
        deepest = max(int(self.before[shard]), 0)
        found, s = np.zeros(deepest + 1, np.int64), max(shard - 1, 0)
        for d in range(deepest, -1, -1):
            while s > 0 and min(self.before[s], self.inside[s]) >= d:
                s -= 1
            found[d] = s
        return found


def shard_nodes(shard: int, skeleton: Skeleton, ids: list[int], paths: list[bytes], words: list[list[int]]) -> dict[str, list]:
    """All nodes of a sorted shard, as columns of PARTIAL; where a node crosses a splitter, the share of this shard.

    Nodes are opened and closed along the paths, so that the nodes below one follow it: sums over a
    subtree are differences of running sums. A node that crosses counts as a child, and its words as
    saved once, in its first shard; whether it is childless is seen in its last.
    """
    n = len(ids)
    shared = [-1, *(common(a, b) for a, b in zip(paths, paths[1:], strict=False))]
    size = [len(p) // TURN for p in paths]
    first, depth, parent, stop, after, stack = [], [], [], [], [], []
    for i in range(n):
        while len(stack) > shared[i] + 1:
            k = stack.pop()
            stop[k], after[k] = i, len(first)
        for d in range(shared[i] + 1, size[i] + 1):
            first.append(i), depth.append(d), parent.append(stack[-1] if stack else -1), stop.append(n), after.append(0)
            stack.append(len(first) - 1)
    for k in stack:
        after[k] = len(first)
    first, depth, parent, stop, after = (np.array(x, np.int64) for x in (first, depth, parent, stop, after))
    came, goes = int(skeleton.before[shard]), int(skeleton.before[shard + 1]) if shard + 1 < len(skeleton.before) else -1
    continued, continues = (first == 0) & (depth <= came), (stop == n) & (depth <= goes)
    crosses = continued | continues
    nodes = np.arange(len(first))
    w = np.array([words[i][d - 1] if d else 0 for i, d in zip(first.tolist(), depth.tolist(), strict=True)], np.int64)
    below = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[after] - s[nodes]
    children = np.bincount(parent[(parent >= 0) & ~continued], minlength=len(first))
    least = np.minimum.reduceat(np.array([*ids, 0], np.int64), np.stack([first, stop], axis=1).ravel())[::2]
    begins = np.where(continued, skeleton.begins(shard)[np.minimum(depth, max(came, 0))], shard)
    up = np.maximum(parent, 0)
    ended = [0] * (n + 1)  # rows from each on that have its path
    for i in range(n - 1, -1, -1):
        ended[i] = 1 + (ended[i + 1] if i + 1 < n and shared[i + 1] == size[i] == size[i + 1] else 0)
    digests, pieces = [], []
    for k, (i, d) in enumerate(zip(first.tolist(), depth.tolist(), strict=True)):
        here = ids[i : i + ended[i]] if size[i] == d else []
        digests.append(None if crosses[k] else hashlib.sha256(",".join(map(str, here)).encode()).hexdigest() if here else EMPTY)
        pieces.append([",".join(map(str, here[j : j + PIECE])) for j in range(0, len(here), PIECE)] if crosses[k] else None)
    null = lambda x, where: [None if out else v for v, out in zip(x.tolist(), where.tolist(), strict=True)]
    return {
        "part": [shard] * len(first), "conv_id": least.tolist(), "depth": depth.tolist(), "parent_conv_id": null(least[up], crosses[up] | (parent < 0)),
        "n_convs": (stop - first).tolist(), "n_children": children.tolist(), "n_leaves": below((after == nodes + 1) & ~continues).tolist(),
        "saved_tokens": below((stop - first - ~continued) * w).tolist(), "ends_sha256": digests,
        "turn_digest": [paths[i][(d - 1) * TURN : d * TURN].hex() if d else None for i, d in zip(first.tolist(), depth.tolist(), strict=True)],
        "at": null(begins, ~crosses), "above": null(begins[up], ~crosses[up] | (parent < 0)), "ends": pieces,
    }


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each (at, depth); the rows of one follow each other in order."""
    this, state = None, None
    schema = pa.schema([("at", pa.int32()), ("depth", pa.int64()), ("sha", pa.string())])
    done = lambda: pa.RecordBatch.from_pylist([{"at": this[0], "depth": this[1], "sha": state.hexdigest()}], schema)
    for batch in batches:
        for at, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("at", "depth", "piece")), strict=True):
            if (at, depth) == this:
                state.update(b",")
            else:
                if this is not None:
                    yield done()
                this, state = (at, depth), hashlib.sha256()
            state.update(piece.encode())
    if this is not None:
        yield done()


def prefix_trie(convs: DataFrame) -> DataFrame:
    """Every node of the trie of conversations (conv_id, steps): NODE.

    A node is a distinct sequence of the first d turns of some conversation, its members; the root has
    d = 0. conv_id is the smallest member, parent_conv_id that of the node above (root: null); n_convs,
    n_children, and n_leaves (childless nodes of its subtree, itself included) are counts; saved_tokens
    sums (members - 1) * words of the last turn over the subtree; ends_sha256 is the digest of the
    decimal ids of the members that end there, ascending, with commas between; turn_digest is that of the
    last turn.

    Paths are dealt by range into shards, the id breaking ties, so that many equal paths fill several
    shards. The trie of the splitter paths is broadcast, as two common depths a shard: it says
    which nodes cross a splitter. A sorted shard finishes all its other nodes; shares of the nodes that
    cross are summed. Repeated ids count as conversations of their own; without conversations there is no node.
    """
    spark = convs.sparkSession
    path = F.unhex(F.array_join(F.transform("steps", lambda s: s["digest"]), ""))
    paths = materialize(convs.select("conv_id", path.alias("path"), F.transform("steps", lambda s: s["words"]).alias("words")), "paths")
    turns = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD))
    dealt = materialize(paths.repartitionByRange(shards, "path", "conv_id").withColumn("part", F.spark_partition_id()), "shards")
    # Parts are numbered anew, as some may have no rows.
    ends = dealt.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))

    def splitters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            parts, lows, highs = (batch.column(c).to_pylist() for c in ("part", "low", "high"))
            before = [-1 if a is None else common(a, b) for a, b in zip([last, *highs], lows, strict=False)]
            last = highs[-1] if highs else last
            inside = [common(a, b) for a, b in zip(lows, highs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(before, pa.int64()), pa.array(inside, pa.int64())], ["part", "before", "inside"])

    # A row a shard, in order, in one task.
    found = ends.repartition(1).sortWithinPartitions("part").mapInArrow(splitters, "part int, before long, inside long").toArrow().sort_by("part")
    shared = spark.sparkContext.broadcast(Skeleton(*(found[c].to_numpy() for c in found.column_names)))
    kinds = _arrow(PARTIAL)

    def grow(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["path"].to_pylist(), group["conv_id"].to_pylist(), group["words"].to_pylist(), strict=True))
        shard = int(np.searchsorted(shared.value.parts, group["part"][0].as_py()))
        return pa.table(shard_nodes(shard, shared.value, [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows]), kinds)

    grown = materialize(dealt.groupBy("part").applyInArrow(grow, PARTIAL), "grown")
    shares = grown.filter("at is not null")
    sums = shares.groupBy("at", "depth").agg(F.min("conv_id").alias("conv_id"), F.min("above").alias("above"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min("turn_digest").alias("turn_digest"))
    pieces = shares.select("at", "depth", "part", F.posexplode("ends").alias("n", "piece"))
    hashed = pieces.repartition("at", "depth").sortWithinPartitions("at", "depth", "part", "n").mapInArrow(_hash_pieces, "at int, depth long, sha string")
    crossing = materialize(sums.join(hashed, ["at", "depth"], "left"), "skeleton")
    names = crossing.select(F.col("at").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    top = crossing.join(names, ["above", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))
    # A shard's nodes right below the skeleton look up the ids that its own crossing nodes got, so no node of the skeleton is a hot key.
    own = shares.select("part", "at", "depth").join(crossing.select("at", "depth", F.col("conv_id").alias("found")), ["at", "depth"])
    own = own.select("part", F.col("at").alias("above"), (F.col("depth") + 1).alias("depth"), "found")
    rest = grown.filter("at is null and above is null").select(*NODE)
    hung = grown.filter("at is null and above is not null").join(own, ["part", "above", "depth"], "left").withColumn("parent_conv_id", F.col("found"))
    return rest.union(hung.select(*NODE)).union(top.select(*NODE))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def with_turns(nodes: DataFrame, turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Nodes with the role and text of their last turn (root: null)."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    named = turns.select(turn_digest(role_, text_).alias("turn_digest"), role_.alias("role"), text_.alias("text")).dropDuplicates(["turn_digest"])
    return nodes.join(named, "turn_digest", "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(branched(conversations(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, turn, substr(sha256(length(r) || ':' || r || x), 1, 32) AS digest, CAST(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list({d: digest, w: words} ORDER BY turn NULLS FIRST, digest) AS steps FROM t GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM c),
p AS (
  SELECT h.conv_id, coalesce(list_slice(b.steps, 1, h.h), []) || list_slice(h.steps, h.h + 1, len(h.steps)) AS steps
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
s AS (SELECT conv_id, unnest(range(0, len(steps) + 1)) AS depth, steps FROM p),
m AS (SELECT conv_id, depth, list_transform(list_slice(steps, 1, depth), lambda v: v.d) AS path, CASE WHEN depth > 0 THEN steps[depth].w ELSE 0 END AS w, len(steps) = depth AS ends FROM s),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM m GROUP BY path, depth),
k AS (SELECT a.path, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND list_slice(b.path, 1, a.depth) = a.path GROUP BY a.path),
u AS (SELECT list_slice(n.path, 1, d) AS path, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) n JOIN k ON k.path = n.path GROUP BY ALL)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(n.ids, '')) AS ends_sha256, n.path[n.depth] AS turn_digest
FROM n JOIN k ON k.path = n.path JOIN u ON u.path = n.path LEFT JOIN n q ON q.depth = n.depth - 1 AND q.path = list_slice(n.path, 1, n.depth - 1)"""
}
