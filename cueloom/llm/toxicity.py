"""Toxic passages by maximum-scoring segments of token log-odds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.hashing import shingle_sets, word_runs
from cueloom.llm.minhash import signature
from cueloom.storage import materialize, table

#: Labelled rows that a model is fitted on at most: those with the smallest digest of their key.
SAMPLE = 20_000
#: Slots of each kind of token: whole words, and the first bytes of words (they hold stems).
SLOTS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the Dirichlet prior, in texts a token; standard deviations taken off log-odds.
PRIOR, Z = 1.0, 1.96
#: Surer log-odds than this make a token count.
LEAST_ODDS = 1.0
#: Taken from every token's score, so that clean text scores below 0 on average.
DRIFT = 0.5
#: Bands of 4 signature values; labelled rows that share one are copies of each other.
COPY_BANDS = 12
#: Passages are reported up to this expected number in a clean text.
E_VALUE = 0.01
BINS, WIDTH = 400, 0.05


class Model(NamedTuple):
    """scores: by kind and slot; scale, ln_k: of the extreme values of clean text; slope, shift: to a probability."""

    scores: np.ndarray
    scale: float = 1.0
    ln_k: float = 0.0
    slope: float = 0.0
    shift: float = -np.inf


def _slots(words) -> np.ndarray:
    """[kind, word]: slot of every word."""
    return np.stack([h >> np.uint64(64 - 18) for h in (words.hashes, *(words.prefixes[k] for k in PREFIXES))]).astype(np.int32)


def token_scores(words, model: Model) -> np.ndarray:
    """Of each word the log-odds of its most telling kind of token, less the drift."""
    slots = _slots(words)
    kinds = np.arange(len(slots))[:, None]
    found = model.scores[kinds, slots]
    return found[np.abs(found).argmax(axis=0), np.arange(slots.shape[1])].astype(np.float64) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, end) of a sequence, in linear time.

    Only positive scores can begin or end one, so the scan goes from one to the next with the
    running sum; a new one joins the latest candidate that it can extend to a higher sum. Each
    candidate links to the latest earlier one with a lower sum before it: none between is looked at.
    """
    total = np.cumsum(scores)
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, link
    for k in np.flatnonzero(scores > 0).tolist():
        high = float(total[k])
        low, first, end = high - float(scores[k]), k, k + 1
        j = len(kept) - 1
        while j >= 0 and kept[j][0] >= low:
            j = kept[j][4]
        while j >= 0 and kept[j][1] < high:
            low, _, first, _, link = kept[j]
            del kept[j:]
            j = link
        kept.append((low, high, first, end, j))
    return [(high - low, first, end) for low, high, first, end, _ in kept]


def evidence(found: list[float], n: int, scale: float, ln_k: float) -> float:
    """Minus the log of the probability that a clean text of n words has segments as good as these.

    The normalised scores of clean text's best segments follow an extreme-value law; the sum x of
    the best r of them is exceeded with probability exp(-x) x**(r - 1) / (r! (r - 1)!). The r that
    is least probable counts.
    """
    base = np.log(max(n, 1)) + ln_k
    if not found:
        return -float(base)
    x = np.cumsum(np.sort(scale * np.array(found) - base)[::-1])
    r = np.arange(1, len(x) + 1)
    factorials = np.cumsum(np.log(r))
    sums = x - (r - 1) * np.log(np.maximum(x, 1)) + factorials + np.concatenate([[0.0], factorials[:-1]])
    return float(np.max(np.minimum(sums, x)))  # for small x the formula is no probability


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, object, int, int]]:
    """index, words of the run, first and end word of each text."""
    for at, _, words in word_runs(batch.column(column), PREFIXES):
        stops = np.cumsum(words.counts)
        for k, stop in enumerate(stops.tolist()):
            yield at + k, words, stop - int(words.counts[k]), stop


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the min-max signature of each text."""
    for batch in batches:
        made = [signature(s) if len(s) else None for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "signature"])


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """Rows (id, signature, ...) that share no band of 4 values with a row of a smaller id: of near copies one is left."""
    keys = rows.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(COPY_BANDS - 1))).alias("band"))
    keys = keys.select("id", F.xxhash64("band", F.expr("substring(signature, band * 4 + 1, 4)")).alias("key"))
    first = keys.groupBy("key").agg(F.min("id").alias("least"))
    copies = keys.join(first, "key").filter("id != least").select("id").distinct()
    return rows.join(copies, "id", "left_anti")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a token of each slot: place (kind * SLOTS + slot), toxic, n."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for at, _, words in word_runs(batch.column(0), PREFIXES):
            of = np.repeat(np.arange(len(words.counts)), words.counts)
            places = _slots(words) + np.arange(1 + len(PREFIXES), dtype=np.int64)[:, None] * SLOTS
            once = np.unique(of * (SLOTS * len(places)) + places)
            text, place = np.divmod(once, SLOTS * len(places))
            for flag in (False, True):
                found, n = np.unique(place[toxic[at + text] == flag], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), flag)), pa.array(n, pa.int64())], ["place", "toxic", "n"])


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Scores of [class, slot] counts.

    The Dirichlet prior of a class has PRIOR texts a token, shared by the classes' sizes, so a
    token never seen has log-odds 0. The score is the end nearer 0 of the interval of Z standard
    deviations around the log-odds; below LEAST_ODDS it is 0, so that a common word repeated
    without end does not add up.
    """
    size = counts.sum(axis=1, keepdims=True)
    y = counts + PRIOR * size / size.sum()
    odds = np.log(y[1] / size[1]) - np.log(y[0] / size[0])
    deviation = np.sqrt(1 / y[0] + 1 / y[1])
    bound = np.abs(odds) - Z * deviation
    return np.where(bound >= LEAST_ODDS, np.sign(odds) * bound, 0.0).astype(np.float32)


def _scale(histogram: np.ndarray) -> float:
    """The positive root of E[exp(scale * score)] = 1 over the scores of clean tokens."""
    middle = (np.arange(BINS) - BINS // 2) * WIDTH
    p = histogram / max(histogram.sum(), 1)
    if not p[middle > 0].any() or (p * middle).sum() >= 0:
        return 1.0
    low, high = 1e-6, 50.0
    with np.errstate(over="ignore"):
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(np.minimum(mid * middle, 600))).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of 1, by Newton steps with a small ridge."""
    middle, spread = x.mean(), x.std() or 1.0
    design = np.stack([(x - middle) / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 0.02 * w
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.02 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; rows of fold 0 are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows outside fold 0, one of each group of copies.

    Token log-odds come from folds 1 to 3, the scale of extreme values and the probability from
    fold 4. The driver gets one number per slot and class, a histogram, and one number per row of
    fold 4. Without rows of both labels every score is 0. Labels without a key or a value, and rows
    with a null key, teach nothing; of several labels of a key the highest counts; null and blank
    texts, and repeated rows but one, are left out; other columns are ignored.
    """
    spark = docs.sparkSession
    useful = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), (F.col(label) > 0).alias("toxic")).filter(fold(F.col("k")) != 0)
    picked = useful.groupBy("k").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(sample)
    named = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "k").select(F.xxhash64("k", "text").alias("id"), "text", "toxic", fold(F.col("k")).alias("fold"))
    marked = materialize(named.mapInArrow(_signed, "id long, text string, toxic boolean, fold long, signature binary"), "labelled")
    alone = _one_of_copies(marked.filter("signature is not null").dropDuplicates(["id"]))
    rows = materialize(alone.select("text", "toxic", "fold"), "learnt")
    kinds = 1 + len(PREFIXES)
    counted = rows.filter("fold < 4").select("text", "toxic").mapInArrow(_count, "place int, toxic boolean, n long").groupBy("place", "toxic").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, kinds * SLOTS))
    counts[counted["toxic"].to_numpy(zero_copy_only=False).astype(int), counted["place"].to_numpy()] = counted["n"].to_numpy()
    if not counts.sum(axis=1).all():
        return Model(np.zeros((kinds, SLOTS), np.float32))
    model = Model(np.stack([log_odds(counts[:, k * SLOTS : (k + 1) * SLOTS]) for k in range(kinds)]))
    shared = spark.sparkContext.broadcast(model)
    check = rows.filter("fold = 4").select("text", "toxic")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_runs(batch.column(0), PREFIXES):
                place = np.clip(np.rint(token_scores(words, shared.value) / WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int32)
                bins, n = np.unique(place, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(n, pa.int64())], ["bin", "n"])

    clean = np.zeros(BINS)
    for row in check.filter(~F.col("toxic")).mapInArrow(histogram, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        clean[row["bin"]] = row["n"]
    scale = _scale(clean)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for _, words, first, end in _texts(batch, 0):
                scores = token_scores(words._replace(hashes=words.hashes[first:end], prefixes={k: v[first:end] for k, v in words.prefixes.items()}), shared.value)
                sizes.append(end - first)
                found.append([s for s, _, _ in segments(scores)])
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["n", "found", "toxic"])

    seen = check.mapInArrow(best, "n long, found array<double>, toxic boolean").toArrow()
    sizes, found, y = seen["n"].to_numpy(), seen["found"].to_pylist(), seen["toxic"].to_numpy(zero_copy_only=False).astype(float)
    if not 0 < y.sum() < len(y):
        return model
    top = np.array([scale * max(f, default=0.0) - np.log(max(n, 1)) for f, n in zip(found, sizes, strict=True)])
    ln_k = float(top[y == 0].mean()) - 0.5772
    slope, shift = _logistic(np.array([_squash(evidence(f, n, scale, ln_k)) for f, n in zip(found, sizes, strict=True)]), y)
    return model._replace(scale=scale, ln_k=ln_k, slope=slope, shift=shift)


def _squash(x: float) -> float:
    """Evidence beyond what decides counts as its logarithm, so that few strong texts don't set the slope."""
    return x if x < 10 else 9 + float(np.log(x - 9)) + 1


PASSAGE = "array<struct<start:int,end:int,score:double,e_value:double>>"


def _scored(batches: Iterator[pa.RecordBatch], m: Model, place: int, names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (a struct, its text at ``place``) with score, predicted and passages, by runs of about a block of text."""
    for batch in batches:
        rows = batch.column(0)
        bodies = pc.fill_null(rows.field(place), "")
        for at, data, words in word_runs(bodies, PREFIXES):
            all_scores = token_scores(words, m)
            scores, passages, stop = [], [], 0
            for n in words.counts.tolist():
                first, stop = stop, stop + n
                found = segments(all_scores[first:stop])
                x = _squash(evidence([s for s, _, _ in found], n, m.scale, m.ln_k))
                scores.append(0.0 if not np.isfinite(m.shift) else float(1 / (1 + np.exp(-np.clip(m.shift + m.slope * x, -500, 500)))))
                sure = [(s, a, b, float(np.exp(min(m.ln_k + np.log(n) - m.scale * s, 50)))) for s, a, b in found]
                sure = [p for p in sure if p[3] <= E_VALUE] if np.isfinite(m.shift) else []
                if sure:
                    begin = int(_text_start(bodies, at, at + len(passages)))
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    sure = [(int(points[words.starts[first + a]] - points[begin]), int(points[words.ends[first + b - 1]] - points[begin]), s, e) for s, a, b, e in sure]
                passages.append([dict(start=a, end=b, score=s, e_value=e) for a, b, s, e in sure])
            score = np.array(scores, float)
            yield pa.RecordBatch.from_arrays([rows.slice(at, len(score)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(passages, kind)], names)


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with score, predicted and passages.

    score is the probability of the label by all maximal segments; passages are those that a
    clean text of this length would hold less than E_VALUE times, as code points. Null and blank
    texts get the score of no evidence. Rows are scored one by one, without a shuffle; a worker gets
    a text once, in its row, and gives rows back by runs of about a block, so it holds no second copy.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", T._parse_datatype_string(PASSAGE))])
    place = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _scored(batches, shared.value, place, schema.names, to_arrow_schema(schema).field("passages").type)

    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, schema)


def _text_start(texts: pa.Array, first: int, this: int) -> int:
    """Bytes of a run of texts before one of them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :]
    return int(offsets[this] - offsets[first])


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns.

    Null and blank texts stay, repeated rows stay or go together, keys may be null; an empty table
    gives an empty one.
    """
    return score_texts(docs, fit(docs, labels)).filter("predicted = 0").select("row.*")


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", (fold(F.col("row.doc_id")) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


QUERIES = {"op7_toxic_segments": op7_toxic_segments}
ORACLES: dict[str, str] = {}
