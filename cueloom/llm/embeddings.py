"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.components import connected_components
from cueloom.storage import materialize, table

#: Blocks of a product code and code words of a block: 32**4 filter directions.
CODE_BLOCKS, CODE_WORDS = 4, 32
#: A direction is exceeded at this many standard deviations of a random vector's product with it;
#: a vector that exceeds fewer directions than LEAST takes its LEAST best ones.
CAP = 4.1
LEAST = 20
#: Sums of a half of the blocks that are put in order at first.
HELD = 128
#: Vectors of a bucket that are compared with each other at a time.
CHUNK = 256
#: Buckets of no more vectors are compared together.
SMALL = 32
#: Pairs whose cosines are computed at a time.
PAIRS = 1 << 14
COSINE = 0.98


@lru_cache(maxsize=8)
def product_code(dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation of ``dim`` (padded to whole blocks), and unit code words: [block, word, component]."""
    rng = np.random.default_rng([seed, dim])
    width = max(2, -(-dim // CODE_BLOCKS))
    rotation, _ = np.linalg.qr(rng.standard_normal((CODE_BLOCKS * width,) * 2))
    code = rng.standard_normal((CODE_BLOCKS, CODE_WORDS, width))
    return rotation[:dim], code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(CODE_BLOCKS)


def exceeded(vectors: np.ndarray, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """The filters whose directions each unit vector exceeds, in order, and where each vector's begin; by list decoding.

    A direction is one code word of each block, its product with the vector the sum of the
    blocks' products. Sums over the first and the last half of the blocks are put in falling order; a pair of
    them is looked at only if it can reach the threshold. The LEAST best pairs lie where the
    product of their ranks is at most LEAST. Of each half the ``held`` best sums are ordered, all of
    them for vectors that need more.
    """
    rotation, code = product_code(vectors.shape[1])
    turned = (vectors @ rotation).reshape(len(vectors), CODE_BLOCKS, -1)
    products = np.einsum("nbw,bcw->nbc", turned, code)
    halves = [(products[:, i, :, None] + products[:, i + 1, None, :]).reshape(len(vectors), -1) for i in (0, 2)]
    every = CODE_WORDS**2
    held = min(max(held, LEAST), every)
    best = [np.argpartition(-h, held - 1, axis=1)[:, :held] if held < every else np.argsort(-h, axis=1) for h in halves]
    orders = [np.take_along_axis(b, np.argsort(-np.take_along_axis(h, b, axis=1), axis=1), axis=1) for h, b in zip(halves, best, strict=True)]
    first, last = (np.take_along_axis(h, o, axis=1) for h, o in zip(halves, orders, strict=True))
    rank = np.arange(1, LEAST + 1)
    near = np.nonzero(np.multiply.outer(rank, rank) <= LEAST)
    top = -np.sort(-(first[:, near[0]] + last[:, near[1]]), axis=1)[:, LEAST - 1]
    least = np.minimum(top, CAP / np.sqrt(rotation.shape[1]))
    open_ = (first[:, -1] + last[:, 0] >= least) | (first[:, 0] + last[:, -1] >= least) if held < every else np.zeros(len(vectors), bool)
    vec, i = np.nonzero((first + last[:, :1] >= least[:, None]) & ~open_[:, None])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for j in range(last.shape[1]):  # the j-th best of the last half, for the sums of the first half that reach so far
        reach = first[vec, i] + last[vec, j] >= least[vec]
        vec, i = vec[reach], i[reach]
        if not len(vec):
            break
        found.append((vec, orders[0][vec, i] * every + orders[1][vec, j]))
    if open_.any():
        rest = np.flatnonzero(open_)
        filters, starts = exceeded(vectors[rest], every)
        found.append((np.repeat(rest, np.diff(starts)), filters))
    vec, filters = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((filters, vec))
    return filters[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(vec, minlength=len(vectors)))])


def _floats(data: pa.Array, stored: str) -> np.ndarray:
    """Binary vectors of one length, stored in the precision they came in, as rows of doubles."""
    return np.frombuffer(b"".join(data.to_pylist()), stored).reshape(len(data), -1).astype(np.float64)


def _valid(stored: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, vector as bytes; null where it can't link."""
    for whole in batches:
        for i in range(0, whole.num_rows, 2048):
            batch = whole.slice(i, 2048)
            lengths = pc.list_value_length(batch.column(2)).fill_null(0).to_numpy().astype(np.int64)
            x = batch.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is NaN
            ends = np.concatenate([[0], np.cumsum(lengths)])
            within = lambda flags, ends=ends: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])
            known = pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()).to_numpy(zero_copy_only=False)
            able = known & (within(np.isfinite(x)) == lengths) & (within(x != 0) > 0)
            data = x.astype(stored)
            offsets = (ends * data.itemsize).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            vectors = pc.if_else(pa.array(able), raw, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], ["id", "label", "vector"])


def _filters(stored: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.array([len(v) for v in batch.column("vector").to_pylist()], np.int64)
        for n in np.unique(lengths):
            of_dim = np.flatnonzero(lengths == n)
            for i in range(0, len(of_dim), 512):
                part = batch.take(pa.array(of_dim[i : i + 512]))
                x = _floats(part.column("vector"), stored)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found, starts = exceeded(x)
                filters = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([*part.columns, filters], [*part.schema.names, "filters"])


def chunk_links(x: dict, y: dict, this: int, same: bool, cosine: float, stored: str) -> tuple[list, list, list]:
    """Links between two chunks of the bucket of filter ``this``: nodes, partners, weights.

    A pair counts in the first filter that its vectors share. A weight adds to its node's number of
    links; a partner, which may be the node itself, is in one component with it. For each set of
    linked nodes there is one row per node, not one per pair.
    """
    a, b = _floats(x["vector"], stored), _floats(y["vector"], stored)
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
    near = a @ b.T >= cosine * np.multiply.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    if same:
        near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return [], [], []
    near = near[np.ix_(rows, columns)]

    def earlier(side: dict, kept: np.ndarray, names: dict) -> np.ndarray:
        lists = [side["filters"][int(k)].values.to_numpy() for k in kept]
        has = np.zeros((len(kept), len(names) or 1), np.float32)
        for r, found in enumerate(lists):
            for f in found[found < this]:
                if f in names:
                    has[r, names[f]] = 1
        return has

    seen = {f for k in rows for f in x["filters"][int(k)].values.to_numpy() if f < this}
    names = {f: k for k, f in enumerate(sorted(seen))}
    first = near & (earlier(x, rows, names) @ earlier(y, columns, names).T == 0)
    nodes = [*x["node"].take(pa.array(rows)).to_pylist(), *y["node"].take(pa.array(columns)).to_pylist()]
    xn, yn = x["n"].to_numpy()[rows], y["n"].to_numpy()[columns]
    weights = [*(first @ yn).tolist(), *(xn @ first).tolist()]
    label = np.arange(len(nodes))
    while True:
        top = np.where(near, label[len(rows) :][None, :], len(nodes)).min(axis=1)
        side = np.where(near, label[: len(rows)][:, None], len(nodes)).min(axis=0)
        new = np.minimum(label, np.concatenate([top, side]))
        if (new == label).all():
            break
        label = new
    return nodes, [nodes[k] for k in label], weights


def bucket_links(sizes: np.ndarray, filters: np.ndarray, members: dict, cosine: float, stored: str) -> tuple[list, list, list]:
    """As ``chunk_links``, for many small buckets at once: their sizes and filters, and their members one after the other."""
    starts = np.cumsum(sizes) - sizes
    left, right, this = [], [], []
    for n in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        of = np.flatnonzero(sizes == n)
        left.append((starts[of][:, None] + i).ravel()), right.append((starts[of][:, None] + j).ravel())
        this.append(np.repeat(filters[of], len(i)))
    if not left:
        return [], [], []
    left, right, this = (np.concatenate(x) for x in (left, right, this))
    v = _floats(members["vector"], stored)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    norm, near = np.linalg.norm(v, axis=1), np.zeros(len(left), bool)
    for k in range(0, len(left), PAIRS):
        a, b = left[k : k + PAIRS], right[k : k + PAIRS]
        near[k : k + PAIRS] = np.einsum("ij,ij->i", v[a], v[b]) >= cosine * (norm[a] * norm[b])
    left, right, this = left[near], right[near], this[near]
    # A pair counts here if no filter before this one is shared: its left filters are looked up among its right ones.
    lists = members["filters"]
    ends = lists.offsets.to_numpy().astype(np.int64)
    held = lists.values.to_numpy().astype(np.int64)
    n = ends[left + 1] - ends[left]
    pair = np.repeat(np.arange(len(left)), n)
    own = held[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[left], n)]
    room = CODE_WORDS**CODE_BLOCKS
    keys = np.repeat(np.arange(len(lists)), np.diff(ends)) * room + held[ends[0] : ends[-1]]  # in order, as lists and filters are
    earlier = own < this[pair]
    asked = right[pair[earlier]] * room + own[earlier]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    first = np.bincount(pair[earlier][keys[at] == asked], minlength=len(left)) == 0
    copies = members["n"].to_numpy()
    weight = np.zeros(len(v), np.int64)
    np.add.at(weight, left[first], copies[right[first]])
    np.add.at(weight, right[first], copies[left[first]])
    label = np.arange(len(v))
    while True:
        new = label.copy()
        np.minimum.at(new, right, label[left])
        np.minimum.at(new, left, label[right])
        if (new == label).all():
            break
        label = new
    linked = np.unique(np.concatenate([left, right]))
    nodes = members["node"].take(pa.array(linked)).to_pylist()
    partners = members["node"].take(pa.array(label[linked])).to_pylist()
    return nodes, partners, weight[linked].tolist()


def _compare(cosine: float, stored: str):
    """Links inside chunks (``others`` is null) and between two chunks of a bucket."""
    fields = ("node", "n", "vector", "filters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, others = batch.column("items"), batch.column("others")
            filters = batch.column("filter").to_numpy().astype(np.int64)
            kind = items.type.value_type.field("node").type
            sizes = pc.list_value_length(items).to_numpy()
            small = (sizes <= SMALL) & pc.is_null(others).to_numpy(zero_copy_only=False)
            parts = []
            widths = pc.binary_length(pc.list_element(items, 0).field("vector")).to_numpy()
            for width in np.unique(widths[small]):
                rows = np.flatnonzero(small & (widths == width))
                chosen = items.take(pa.array(rows)).flatten()
                members = {f: pa.concat_arrays([chosen.field(f)]) for f in fields}
                parts.append(bucket_links(sizes[rows], filters[rows], members, cosine, stored))
            for row in np.flatnonzero(~small).tolist():
                same = not others[row].is_valid
                sides = [{f: got.field(f) for f in fields} for got in (items[row].values, items[row].values if same else others[row].values)]
                parts.append(chunk_links(*sides, int(filters[row]), same, cosine, stored))
            nodes, partners, weights = ([x for p in parts for x in p[k]] for k in range(3))
            made = pa.table([pa.array(nodes, kind), pa.array(partners, kind), pa.array(weights, pa.int64())], ["node", "partner", "weight"])
            summed = made.group_by(["node", "partner"]).aggregate([("weight", "sum")])  # two vectors share many filters
            yield from summed.select(["node", "partner", "weight_sum"]).rename_columns(made.schema.names).combine_chunks().to_batches()

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Per row: key, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine, in double precision, is at least
    ``cosine``. n_links counts the other rows linked directly; component_id is the smallest key
    reachable; kept marks it. Null, empty and zero vectors, those with null or non-finite
    components, and those with a null key or label link with nothing; vectors of different
    length do not link. Equal vectors of a label form a class that is searched once. Every
    vector goes to the filters it exceeds; a filter's vectors are compared in chunks, each link
    counted in the first filter both share, so no pair leaves a task. Other columns are ignored;
    an empty table gives an empty result.
    """
    key_type, label_type = vectors.schema[key].dataType, vectors.schema[label].dataType
    element = vectors.schema[embedding].dataType.elementType
    stored = "<f4" if isinstance(element, T.FloatType) else "<f8"
    field = T.StructField
    rows_type = T.StructType([field("id", key_type), field("label", label_type), field("vector", T.BinaryType())])
    rows = materialize(vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(embedding)).mapInArrow(partial(_valid, stored), rows_type), "vectors")
    able = rows.filter("vector is not null")
    classes = able.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    listed_type = T.StructType([field("label", label_type), field("vector", T.BinaryType()), field("node", key_type), field("n", T.LongType()), field("filters", T.ArrayType(T.IntegerType()))])
    listed = classes.mapInArrow(partial(_filters, stored), listed_type).withColumn("class", F.monotonically_increasing_id())
    listed = materialize(listed, "filters")
    # Label, length and filter stay in the key, so two that share a bucket's hash stay apart. Only ids are
    # dealt by bucket; vectors join the members of buckets that hold several.
    group = ["label", "width", "filter"]
    spread = listed.select("class", "label", F.octet_length("vector").alias("width"), F.explode("filters").alias("filter"))
    spread = spread.withColumn("bucket", F.xxhash64(*group))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("rows")).filter("rows > 1")
    chunks = F.ceil(F.col("rows") / CHUNK)
    placed = spread.join(sizes, "bucket").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks")).drop("rows")
    full = placed.join(listed.select("class", "node", "n", "vector", "filters"), "class")
    dealt = full.repartition("bucket", "chunk")
    packed = dealt.groupBy("bucket", *group, "chunks", "chunk").agg(F.collect_list(F.struct("node", "n", "vector", "filters")).alias("items"))
    alone = packed.filter((F.col("chunks") > 1) | (F.size("items") > 1)).withColumn("others", F.lit(None).cast(packed.schema["items"].dataType))
    wanted = packed.filter("chunks > 1").withColumn("partner", F.explode(F.sequence("chunk", F.col("chunks") - 1))).filter("partner > chunk")
    other = packed.filter("chunks > 1").select("bucket", *group, F.col("chunk").alias("partner"), F.col("items").alias("others"))
    several = wanted.join(other, ["bucket", *group, "partner"])
    columns = ["filter", "items", "others"]
    pairs = alone.select(columns).union(several.select(columns))
    found_type = T.StructType([field("node", key_type), field("partner", key_type), field("weight", T.LongType())])
    found = materialize(pairs.mapInArrow(_compare(cosine, stored), found_type), "found")
    links = found.groupBy("node").agg(F.sum("weight").alias("links"))
    parts = connected_components(found, "node", "partner")
    summed = listed.select("label", "vector", "node", "n").join(links, "node", "left").join(parts, "node", "left")
    by_class = summed.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("found"))
    linked = able.join(by_class, ["label", "vector"]).select("id", "links", "found")
    alone = rows.filter("vector is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("found"))
    return linked.union(alone).select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("found").alias("component_id"), F.coalesce(F.col("id") == F.col("found"), F.lit(True)).alias("kept"))


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_cap_filters": op2_cap_filters}
ORACLES = {
    "op2_cap_filters": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
      WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
c AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.r),
g AS (SELECT a, min(r) AS m FROM c GROUP BY a),
n AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT t.vec_id, coalesce(n.k, 0) AS n_links, g.m AS component_id, t.vec_id = g.m AS kept
FROM embeddings t JOIN g ON g.a = t.vec_id LEFT JOIN n ON n.a = t.vec_id"""
}
