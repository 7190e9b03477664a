"""Hard negatives by angular triangle filtering of integer scores."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.operators.ordering import numbered
from cueloom.storage import materialize, new_path, table

#: Reference directions; rows that they are fitted on at most.
REFERENCES, SAMPLE = 16, 2048
#: Rows that follow each other by angle and are scored together.
WINDOW = 256
#: Anchors whose candidates are searched in one pass over all rows.
ANCHORS = 1 << 14
#: One row in so many is scored first, so that tasks report only what can beat its best.
SEEDS = 64
#: Candidates that a task gathers before it keeps the best ones.
GATHERED = 1 << 18
#: Radians by which stored angles may be off, and then some.
SLACK = 1e-5
MOST = (1 << 63) - 1


def directions(vectors: np.ndarray, width: int) -> np.ndarray:
    """REFERENCES unit vectors: means of groups of these vectors by cosine; random ones where a group is empty."""
    made = np.random.default_rng([5, width]).standard_normal((REFERENCES, width))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = (vectors / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]
    made[: len(unit)] = unit[:REFERENCES]
    for _ in range(6):
        made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)
        if not len(unit):
            break
        group = (unit @ made.T).argmax(axis=1)
        sums = np.zeros_like(made)
        np.add.at(sums, group, unit)
        made = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, sums, made)
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)


def _rows_type(label: T.DataType) -> T.StructType:
    field = T.StructField
    return T.StructType([field("id", T.LongType()), field("label", label), field("vector", T.BinaryType()), field("width", T.IntegerType()), field("norm", T.DoubleType()), field("cell", T.IntegerType()), field("angle", T.FloatType()), field("angles", T.BinaryType()), field("anchor", T.BooleanType())])


def _scaled(vectors: pa.Array, scale: float) -> tuple[list[np.ndarray], np.ndarray]:
    """floor(scale * component) of each vector, and which vectors are whole: not null, all components finite."""
    lengths = pc.list_value_length(vectors).fill_null(0).to_numpy().astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))  # a null component is NaN
    ends = np.concatenate([[0], np.cumsum(lengths)])
    finite = np.diff(np.concatenate([[0], np.cumsum(np.isfinite(x))])[ends]) == lengths
    return [x[a:b] for a, b in zip(ends, ends[1:], strict=False)], finite & vectors.is_valid().to_numpy(zero_copy_only=False)


def _norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0)
    return top * np.linalg.norm(x / np.where(top > 0, top, 1)[:, None], axis=1)


def _prepare(scale: float, known: dict[int, np.ndarray]):
    """Rows of ``_rows_type`` without what can't take part: 16-bit components where they fit, else doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors, able = _scaled(batch.column("embedding"), scale)
                widths = np.array([len(v) for v in vectors], np.int64)
                for width in np.unique(widths[able]).tolist():
                    rows = np.flatnonzero(able & (widths == width))
                    x = np.stack([vectors[k] for k in rows])
                    norm, top = _norms(x), np.abs(x).max(axis=1, initial=0)[:, None]
                    reference = known[width] if width in known else directions(np.zeros((0, width)), width)
                    unit = x / np.where(top > 0, top, 1)
                    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
                    angles = np.arccos(np.clip(unit @ reference.T, -1, 1)).astype("<f4")
                    cell = angles.argmin(axis=1).astype(np.int32)
                    small = top[:, 0] < 1 << 15
                    stored = [(v.astype("<i2") if fits else v.astype("<f8")).tobytes() for v, fits in zip(x, small, strict=True)]
                    part = batch.take(pa.array(rows))
                    made = [pa.array(stored, pa.binary()), pa.array(np.full(len(rows), width, np.int32)), pa.array(norm), pa.array(cell), pa.array(angles[np.arange(len(rows)), cell]), pa.array([a.tobytes() for a in angles], pa.binary())]
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), *made, part.column("anchor")], ["id", "label", "vector", "width", "norm", "cell", "angle", "angles", "anchor"])

    return run


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * width else "<f8").astype(np.float64) for v in vectors])


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole numbers; ``bound`` is no less than any. They saturate at the limits of a long."""
    bound *= 1 + 1e-9
    if bound < 1 << 53:  # no sum on the way exceeds the bound, so floats hold it exactly
        kind = np.float32 if bound < 1 << 24 else np.float64
        return np.rint(a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a).dot(whole(b).T), -MOST, MOST).astype(np.int64)


class Wanted(NamedTuple):
    """Anchors of one width, and per slot of each the scores that it looks for."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    low: np.ndarray
    high: np.ndarray


def score_bounds(side: Wanted, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest score that an anchor may have with any row of a window.

    By the triangle inequality an angle is no less than the difference of the two angles to any
    reference and no more than their sum; the cosines, times norms, bound the scores, with room for rounding.
    """
    first, last = angles.min(axis=0), angles.max(axis=0)
    apart = np.maximum(np.maximum(first - side.angles, side.angles - last).max(axis=1, initial=0) - SLACK, 0)
    within = np.minimum(np.minimum(side.angles + last, 2 * np.pi - side.angles - first).min(axis=1, initial=np.pi) + SLACK, np.pi)
    with np.errstate(over="ignore", invalid="ignore"):
        up, down = np.cos(apart), np.cos(within)
        most = side.norms * np.where(up >= 0, norms.max(), norms.min()) * up
        least = side.norms * np.where(down >= 0, norms.min(), norms.max()) * down
        most, least = most + np.abs(most) * 1e-9 + 1, least - np.abs(least) * 1e-9 - 1
    return np.where(np.isfinite(least), least, -np.inf), np.where(np.isfinite(most), most, np.inf)


def _keep(k: int, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each key the k best by score, then id; and their ranks."""
    order = np.lexsort((ids, -score, key))
    key, score, ids = key[order], score[order], ids[order]
    rank = np.arange(len(key)) - np.searchsorted(key, key)
    best = rank < k
    return key[best], score[best], ids[best], rank[best]


def _scan(shared, k: int, same: bool):
    """Rows in order of angle -> the k best of each slot in this task: number, slot, score, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, Wanted] = {w: s._replace(low=s.low.copy()) for w, s in shared.value.items()}
        held = {w: [(np.zeros(0, np.int64),) * 3] for w in sides}

        def settle(w: int) -> None:
            side = sides[w]
            key, score, ids, rank = _keep(k, *(np.concatenate(x) for x in zip(*held[w], strict=True)))
            held[w] = [(key, score, ids)]
            full = rank == k - 1
            np.maximum.at(side.low.reshape(-1), key[full], score[full])

        for batch in batches:
            label, width = batch.column("label"), batch.column("width").to_numpy()
            sort, cell = pc.binary_length(batch.column("vector")).to_numpy(), batch.column("cell").to_numpy()
            ids, norms = batch.column("id").to_numpy(), batch.column("norm").to_numpy()
            names = label.to_pylist()
            turn = [i for i in range(1, len(names)) if names[i] != names[i - 1] or (width[i], cell[i], sort[i]) != (width[i - 1], cell[i - 1], sort[i - 1])]
            for a, b in zip([0, *turn], [*turn, len(names)], strict=True):
                w = int(width[a]) if b > a else None
                if w not in sides:
                    continue
                side, slots = sides[w], sides[w].low.shape[1]
                related = (side.labels == names[a]) == same
                for i in range(a, b, WINDOW):
                    j = min(i + WINDOW, b)
                    angles = np.frombuffer(b"".join(batch.column("angles").slice(i, j - i).to_pylist()), "<f4").reshape(j - i, -1).astype(np.float64)
                    least, most = score_bounds(side, norms[i:j], angles)
                    overlap = ((most[:, None] >= side.low) & (least[:, None] <= side.high) & (side.low <= side.high)).any(axis=1)
                    rows = np.flatnonzero(related & overlap)
                    if not len(rows):
                        continue
                    x = _matrix(batch.column("vector").slice(i, j - i).to_pylist(), w)
                    scores = products(side.vectors[rows], x, side.norms[rows].max() * norms[i:j].max())
                    other = side.ids[rows][:, None] != ids[None, i:j]
                    for s in range(slots):
                        r, c = np.nonzero((scores >= side.low[rows, s, None]) & (scores <= side.high[rows, s, None]) & other)
                        held[w].append((rows[r] * slots + s, scores[r, c], ids[i:j][c]))
                    if sum(len(h[0]) for h in held[w]) > GATHERED:
                        settle(w)
            for w in sides:
                settle(w)
        for w, side in sides.items():
            key, score, ids = held[w][0]
            row, slot = np.divmod(key, side.low.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(side.number[row]), pa.array(slot), pa.array(score), pa.array(ids)], ["number", "slot", "score", "id"])

    return run


def _best(rows: DataFrame, sides: dict[int, Wanted], k: int, same: bool) -> DataFrame:
    """number, slot, score, id, rank of the k best rows of every slot."""
    shared = rows.sparkSession.sparkContext.broadcast(sides)
    found = rows.mapInArrow(_scan(shared, k, same), "number long, slot long, score long, id long")
    order = Window.partitionBy("number", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _raised(rows: DataFrame, sides: dict[int, Wanted], k: int, same: bool) -> dict[int, Wanted]:
    """Sides whose low scores are raised to the k-th best among the seeds."""
    seeds = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SEEDS)) == 0)
    found = _best(seeds, sides, k, same).filter(F.col("rank") == k).toArrow()
    number, slot, score = (found[c].to_numpy() for c in ("number", "slot", "score"))
    raised = {}
    for w, side in sides.items():
        low = side.low.copy()
        place = np.searchsorted(side.number, number)
        inside = (place < len(side.number)) & (side.number[np.minimum(place, len(side.number) - 1)] == number)
        np.maximum.at(low, (place[inside], slot[inside]), score[inside])
        raised[w] = side._replace(low=low)
    return raised


def _sides(anchors: pa.Table) -> dict[int, Wanted]:
    sides, width = {}, anchors["width"].to_numpy()
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        part = anchors.take(pa.array(rows))
        labels = np.empty(len(rows), object)
        labels[:] = part["label"].to_pylist()
        angles = np.frombuffer(b"".join(part["angles"].to_pylist()), "<f4").reshape(len(rows), -1).astype(np.float64)
        sides[w] = Wanted(rows, part["id"].to_numpy(), labels, _matrix(part["vector"].to_pylist(), w), part["norm"].to_numpy(), angles, np.full((len(rows), 1), -MOST), np.full((len(rows), 1), MOST))
    return sides


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, key: str = "vec_id", embedding: str = "embedding",
    positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: float = 256.0,
) -> DataFrame:
    """Per anchor and positive its hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x becomes floor(scale * x); a score is the inner product of two rows, exact, saturating
    at the limits of a long. Higher scores come first, ties by smaller key. An anchor's positives are its first ``positives``
    other rows of the same label; a positive's negatives the first ``negatives`` rows of another label
    whose score is between ``share`` hundredths of the positive's. Rows with a null key or label, or with
    a vector that is null or holds a null or non-finite component, take no part; vectors of different
    length have no score. A row is none of the other rows of its own key; rows that share a key are
    anchors and candidates one by one. Other columns are ignored; an empty table gives no rows.

    Each row stores its angles to the references (fitted on a sample of SAMPLE rows; they decide about
    speed, not results). Rows lie sorted by label, nearest reference and angle, so that a window of
    them has narrow angles; a window meets only anchors whose score bounds overlap what they
    look for. Anchors are numbered and searched ANCHORS at a time, each time over all rows: only those, and their
    best rows, come to the driver and are broadcast. Tasks keep the best rows of each anchor.
    """
    spark = vectors.sparkSession
    label_type = vectors.select(label).schema[0].dataType
    given = vectors.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.col(embedding).alias("embedding"), F.coalesce(anchor, F.lit(False)).alias("anchor")).filter("id is not null and label is not null and embedding is not null")
    sample = given.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    known: dict[int, np.ndarray] = {}
    if len(sample):
        rows, able = _scaled(sample, scale)
        whole = [v for v, a in zip(rows, able, strict=True) if a and np.abs(v).max(initial=0) < 1e100]
        known = {w: directions(np.stack([v for v in whole if len(v) == w]), w) for w in {len(v) for v in whole}}
    order = ["label", "width", "cell", "angle", "id"]
    stored = materialize(given.mapInArrow(_prepare(scale, known), _rows_type(label_type)).repartitionByRange(*order).sortWithinPartitions(*order), "angles")
    listed = materialize(numbered(stored.filter("anchor").drop("anchor"), "id", name="n"), "anchors")
    rounds, path = -(-listed.count() // ANCHORS), new_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not rounds:
        return spark.createDataFrame([], schema)
    for part in range(rounds):
        sides = _sides(listed.filter((F.col("n") > part * ANCHORS) & (F.col("n") <= (part + 1) * ANCHORS)).toArrow())
        near = _best(stored, _raised(stored, sides, positives, True), positives, True).toArrow()
        sides = {w: _ranges(s, near, positives, share) for w, s in sides.items()}
        far = _best(stored, _raised(stored, sides, negatives, False), negatives, False)
        names = pa.table({"n": near["number"], "s": pc.subtract(near["rank"].cast(pa.int64()), 1), "positive_id": near["id"], "positive_score": near["score"]})
        ids = {n: i for side in sides.values() for n, i in zip(side.number.tolist(), side.ids.tolist(), strict=True)}
        names = names.append_column("anchor_id", pa.array([ids[n] for n in names["n"].to_pylist()], pa.int64()))
        pairs = spark.createDataFrame(names)
        joined = far.join(F.broadcast(pairs), (F.col("number") == F.col("n")) & (F.col("slot") == F.col("s")))
        columns = ["anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        joined.select(*columns).write.parquet(f"{path}/{part}")
    return spark.read.schema(schema).parquet(*[f"{path}/{part}" for part in range(rounds)])


def _ranges(side: Wanted, near: pa.Table, slots: int, share: tuple[int, int]) -> Wanted:
    """A slot per positive, with the scores that its negatives may have; none where there is no positive."""
    low, high = np.full((len(side.ids), slots), MOST), np.full((len(side.ids), slots), -MOST)
    place = {n: i for i, n in enumerate(side.number.tolist())}
    for number, rank, score in zip(near["number"].to_pylist(), near["rank"].to_pylist(), near["score"].to_pylist(), strict=True):
        if number in place:
            low[place[number], rank - 1] = -(-share[0] * score // 100)
            high[place[number], rank - 1] = share[1] * score // 100
    return side._replace(low=low, high=high)


def op13_angular_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {"op13_angular_negatives": op13_angular_negatives}
ORACLES = {
    "op13_angular_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT a, b AS p, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 3"""
}
