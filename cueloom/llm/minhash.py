"""Near-duplicate documents by min-max hashing of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.components import connected_components
from cueloom.llm.hashing import shingle_sets
from cueloom.storage import materialize, new_path, scratch, table

#: Permutations; each gives its minimum and its maximum.
HASHES = 180
#: Values of a band, all minima or all maxima. 60 bands of 6: a pair at similarity 0.75 is missed
#: once in 130,000 times, one at 0.3 meets in a band once in 24 times.
ROWS = 6
BANDS = 2 * HASHES // ROWS
#: A bucket's number modulo this is its band; a power of two.
BAND_SLOTS = 64
#: Pairs whose signatures agree in fewer of the 360 values are not checked: at similarity 0.75
#: that is 6.5 standard deviations below the mean.
AGREE = 216
#: Members of a bucket that are compared with each other at a time.
CHUNK = 256

_rng = np.random.default_rng(7)
_TIMES = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_CHUNK_ROWS = 512


def signature(shingles: np.ndarray) -> bytes:
    """One byte of the minimum under each permutation of the shingles, then of each maximum.

    A permutation is x * a + b modulo 2**32 with odd a; it is evaluated once for both extremes.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(HASHES, 0xFFFFFFFF, np.uint32), np.zeros(HASHES, np.uint32)
    for i in range(0, len(x), _CHUNK_ROWS):
        y = np.multiply.outer(x[i : i + _CHUNK_ROWS], _TIMES)
        y += _PLUS
        np.minimum(low, y.min(axis=0), out=low)
        np.maximum(high, y.max(axis=0), out=high)
    both = np.concatenate([low, high]) * np.uint32(0x9E3779B1)
    return (both >> np.uint32(24)).astype(np.uint8).tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        counts, digests, signatures = [], [], []
        for shingles in shingle_sets(batch.column(1)):
            counts.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            signatures.append(signature(shingles) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["id", "n_shingles", "digest", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
        values = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["node", "shingles"])


class _Side:
    """Members of one chunk of a bucket."""

    def __init__(self, items: pa.StructArray):
        self.node = items.field("node")
        self.component = items.field("component").to_numpy(zero_copy_only=False)
        self.n = items.field("n").to_numpy()
        self.signature = np.frombuffer(b"".join(items.field("signature").to_pylist()), np.uint8).reshape(len(items), -1)
        self.items = items

    def shingles(self, k: int) -> np.ndarray:
        return self.items.field("shingles")[k].values.to_numpy()


def _close(x: _Side, y: _Side, band: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of x those of y in other components that may be similar enough.

    Sizes must allow it, signatures must agree in AGREE values, and this must be the first band
    in which they agree, so that a pair is met in one bucket only. Members of the commonest
    component are compared with the others alone.
    """
    names, number = np.unique(np.concatenate([x.component, y.component]), return_counts=True)
    common = names[number.argmax()]
    few, every = np.flatnonzero(y.component != common), np.arange(len(y.n))
    for i in range(len(x.n)):
        js = few if x.component[i] == common else every
        js = js[(y.component[js] != x.component[i]) & (4 * np.minimum(y.n[js], x.n[i]) >= 3 * np.maximum(y.n[js], x.n[i]))]
        if len(js):
            same = y.signature[js] == x.signature[i]
            js, same = js[same.sum(axis=1) >= AGREE], same[same.sum(axis=1) >= AGREE]
        if len(js):
            met = same.reshape(len(js), BANDS, ROWS).all(axis=2)
            js = js[met.argmax(axis=1) == band]
        if len(js):
            yield i, js


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, _Side, _Side]]:
    for row in range(batch.num_rows):
        yield batch.column("bucket")[row].as_py(), *(_Side(batch.column(c)[row].values) for c in ("items", "others"))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets that have somebody close in another component: bucket, node, component."""
    for batch in batches:
        buckets, nodes, components = [], [], []
        for bucket, x, y in _chunks(batch):
            left, right = set(), set()
            for i, js in _close(x, y, bucket % BAND_SLOTS):
                left.add(i), right.update(js.tolist())
            for side, found in ((x, sorted(left)), (y, sorted(right))):
                nodes += side.node.take(pa.array(found, pa.int32())).to_pylist()
                components += side.items.field("component").take(pa.array(found, pa.int32())).to_pylist()
            buckets += [bucket] * (len(left) + len(right))
        kind = batch.schema.field("items").type.value_type.field("node").type
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(nodes, kind), pa.array(components, kind)], ["bucket", "node", "component"])


def _confirm(similarity: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the members of two chunks whose full sets are similar enough; those that join nothing new are left out."""
    up, down = similarity
    for batch in batches:
        a, b = [], []
        for bucket, x, y in _chunks(batch):
            parent: dict = {}

            def root(c, parent=parent):
                while c in parent:
                    c = parent[c]
                return c

            for i, js in _close(x, y, bucket % BAND_SLOTS):
                own = x.shingles(i)
                for j in js.tolist():
                    r, q = root(x.component[i]), root(y.component[j])
                    if r == q:
                        continue
                    common = len(np.intersect1d(own, y.shingles(j), assume_unique=True))
                    if down * common >= up * (x.n[i] + y.n[j] - common):
                        parent[r] = q
                        a.append(x.node[i].as_py()), b.append(y.node[j].as_py())
        kind = batch.schema.field("items").type.value_type.field("node").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def _dealt_anew(sums: DataFrame, other: str | Column) -> DataFrame:
    """Sums by bucket, dealt by bucket and another column: a join by bucket then shuffles both its sides, so a hot bucket can be split over tasks."""
    return sums.repartition("bucket", other)


class NearDuplicates:
    """The steps of the search, each a table in the shared folder.

    ``id`` names documents: rows that share an id count as one document and are linked. Rows with
    a null id, and texts that are null or without words, are linked with nothing.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = (3, 4)):
        self.docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        self.kind = self.docs.schema["id"].dataType
        self.similarity = similarity
        out = T.StructType([T.StructField("id", self.kind), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())])
        self.prints = materialize(self.docs.mapInArrow(_prints, out), "prints")

    def classes(self) -> DataFrame:
        """Classes of equal shingle sets, by their smallest id: node, n, digest, signature."""
        able = self.prints.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
        return able.groupBy("digest").agg(F.min("id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature"))

    def members(self, nodes: DataFrame) -> DataFrame:
        """(bucket, node, least) for all buckets that hold several nodes; least: the smallest node there."""
        band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
        value = F.xxhash64("band", F.expr(f"substring(signature, band * {ROWS} + 1, {ROWS})"))
        rows = nodes.select("node", "signature", band.alias("band")).select(value.bitwiseAND(F.lit(-BAND_SLOTS)).bitwiseOR(F.col("band")).alias("bucket"), "node")
        several = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least != most")
        return rows.join(_dealt_anew(several.select("bucket", "least"), "least"), "bucket")

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        up, down = self.similarity
        first, second = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        both = pairs.select("a", "b").distinct().join(first, "a").join(second, "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        enough = down * shared >= up * (F.size("set_a") + F.size("set_b") - shared)
        return both.filter(enough).select("a", "b")

    def in_chunks(self, members: DataFrame, size: int) -> DataFrame:
        """(bucket, node, component, chunk, chunks) of buckets whose members lie in several components, in chunks of about ``size``.

        Members come without signatures and sets: what is large is joined to them afterwards, and shuffled once.
        """
        mixed = members.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("rows")).filter("c != d")
        placed = members.join(_dealt_anew(mixed.select("bucket", F.ceil(F.col("rows") / size).alias("chunks")), "chunks"), "bucket")
        return placed.select("bucket", "node", "component", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "chunks")

    def chunk_pairs(self, members: DataFrame, item: list[str]) -> DataFrame:
        """Pairs of chunks of buckets.

        Members are dealt by bucket and chunk before they are packed: each chunk of a large bucket is
        a group of its own, and so is each pair of chunks. Buckets of one chunk and of several are
        disjoint rows, and both sides of the pairs read the same shuffle.
        """
        def packed(which: str) -> DataFrame:
            dealt = members.filter(f"{which} and bucket is not null and chunk is not null").repartition("bucket", "chunk")
            return dealt.groupBy("bucket", "chunk", "chunks").agg(F.collect_list(F.struct(*item)).alias("items"))

        single, several = packed("chunks = 1"), packed("chunks > 1")
        other = several.select("bucket", F.col("chunk").alias("partner"), F.col("items").alias("others"))
        wanted = several.withColumn("partner", F.explode(F.sequence("chunk", F.col("chunks") - 1))).join(other, ["bucket", "partner"])
        return single.select("bucket", "items", F.col("items").alias("others")).union(wanted.select("bucket", "items", "others"))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Nodes, and confirmed links that connect all similar nodes.

        First every member of a bucket is checked against the bucket's smallest node. Where a
        bucket still holds several components, members are compared across components in chunks:
        signatures tell who may be close to somebody, and their full sets decide in the task.
        """
        spark = self.docs.sparkSession
        stays = new_path(spark, "linked")
        nodes = materialize(self.classes(), "nodes")
        with scratch(spark):
            members = materialize(self.members(nodes), "members")
            inside = members.select("node").distinct()
            out = T.StructType([T.StructField("node", self.kind), T.StructField("shingles", T.ArrayType(T.LongType()))])
            sets = self.docs.join(inside, F.col("id") == F.col("node"), "left_semi").dropDuplicates(["id"]).mapInArrow(_sets, out)
            sets = materialize(sets.join(nodes.select("node", "n", "signature"), "node"), "sets")
            stars = members.filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
            links = materialize(self.confirm(stars, sets), "confirmed")
            known = connected_components(links)
            placed = members.join(known, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
            open_members = materialize(self.in_chunks(placed, CHUNK), "open")
            near = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("node", self.kind), T.StructField("component", self.kind)])
            item = ["node", "component", "n", "signature"]
            signed = open_members.join(sets.select("node", "n", "signature"), "node")
            flagged = materialize(self.chunk_pairs(signed, item).mapInArrow(_flag, near).distinct(), "near")
            close = materialize(self.in_chunks(flagged, CHUNK), "close")
            pair = T.StructType([T.StructField("a", self.kind), T.StructField("b", self.kind)])
            more = self.chunk_pairs(close.join(sets, "node"), [*item, "shingles"]).mapInArrow(partial(_confirm, self.similarity), pair)
            return nodes, materialize(links.union(more), path=stays)

    def result(self) -> DataFrame:
        """Per row: id, n_shingles, component_id, kept."""
        nodes, links = self.links()
        of = nodes.join(connected_components(links), "node", "left").select("digest", F.coalesce("component", "node").alias("found"))
        able = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
        linked = self.prints.filter(able).select("id", "n_shingles", "digest").join(of, "digest").select("id", "n_shingles", "found")
        alone = self.prints.filter(~able).select("id", "n_shingles", F.col("id").alias("found"))
        rows = linked.union(alone)
        return rows.select("id", "n_shingles", F.col("found").alias("component_id"), F.coalesce(F.col("id") == F.col("found"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of near-duplicate documents: key, n_shingles, component_id, kept.

    Documents link when their sets of 5-word shingles (lower-cased A-Z, ASCII white space
    between words; all words if fewer than 5) have a Jaccard similarity of 0.75 or more.
    component_id is the smallest key reachable by links; kept marks it. Null and blank texts
    have no shingles and link with nothing; null keys have no component and are kept; equal
    rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    return NearDuplicates(docs, key, text).result().withColumnRenamed("id", key)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, one for each group of near duplicates, that with the smallest key; rows with a null key stay.

    Rows that share a key count as one document: the first by text stays, null texts last. Null and
    blank texts are near nothing and stay; other columns are kept as they are; an empty table gives an
    empty one. The keys to drop are written and joined to the rows, so the texts stay where they are
    while those keys are few enough to broadcast by the planner's size check.
    """
    found = near_duplicates(docs, key, text).filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("found_key"))
    marked = found.agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).filter("not kept or rows > 1")
    marked = materialize(marked, "marked")
    other = marked.select("found_key")
    single = docs.join(other, docs[key] == other["found_key"], "left_anti")
    if marked.filter("kept").isEmpty():
        return single
    repeated = marked.filter("kept").select("found_key")
    named = docs.select(F.struct(*docs.columns).alias("row")).join(repeated, F.col(f"row.{key}") == F.col("found_key"))
    by_text = Window.partitionBy("found_key").orderBy(F.col(f"row.{text}").asc_nulls_last())
    first = named.withColumn("at", F.row_number().over(by_text)).filter("at = 1").select("row.*")
    return single.unionByName(first)


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minmax_dedup": op1_minmax_dedup}
ORACLES = {
    "op1_minmax_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(v) < 5 THEN v ELSE v[i:i + 4] END) AS h
      FROM (SELECT doc_id, v, unnest(range(1, greatest(len(v) - 4, 1) + 1)) AS i FROM w WHERE len(v) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n q ON q.doc_id = a JOIN n r ON r.doc_id = b WHERE 100 * common >= 75 * (q.n + r.n - common)),
c AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.m AS component_id, d.doc_id = g.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(r) AS m FROM c GROUP BY a) g ON g.a = d.doc_id"""
}
