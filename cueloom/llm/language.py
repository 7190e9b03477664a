"""Languages of texts by mixtures: expectation-maximisation over words whose likelihoods come from n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.llm.hashing import BLOCK, blocks, hash_block
from cueloom.storage import table

#: Distinct texts that the n-gram counts are learnt from at most, shared evenly by the languages.
SAMPLE = 40_000
#: Languages that are learnt at most, those with the most rows; it bounds the model.
LANGUAGES = 128
#: Longest n-gram in bytes, slots of the n-grams of each length, and weight of the shorter n-gram in the estimate of a longer one.
ORDER, PRIOR = 4, np.float32(4)
SIZES = [256] + [1 << 16] * (ORDER - 1)
#: Rounds of expectation-maximisation at most.
ROUNDS = 25
#: Log-likelihood that a further language must gain, in halves of the logarithm of the number of words.
PENALTY = 3.0
#: Numbers in the largest array of words by languages.
ROOM = 1 << 21
#: Before and after a word.
START, END = 32, 0
UNKNOWN = "und"

#: Letters as they are, A-Z in lower case, other ASCII as space.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


class Model(NamedTuple):
    """names of the languages; counts: for n-grams of 1 to ORDER bytes [slot, language]; totals: bytes of each language."""

    names: list[str]
    counts: list[np.ndarray]
    totals: np.ndarray


class Bags(NamedTuple):
    """Distinct words of texts, one text after the other: text, their bytes (between START and END), ends, and counts."""

    text: np.ndarray
    data: np.ndarray
    ends: np.ndarray
    count: np.ndarray


def _block_bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    data = LETTERS[data]
    words = hash_block(data, offsets)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    order = np.lexsort((words.hashes, text))
    t, h = text[order], words.hashes[order]
    new = np.flatnonzero((np.diff(t, prepend=-1) != 0) | np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    pick = order[new]
    starts, sizes = words.starts[pick], words.ends[pick] - words.starts[pick] + 2
    to = np.cumsum(sizes)
    flat = np.arange(to[-1] if len(to) else 0) - np.repeat(to - sizes, sizes) + np.repeat(starts, sizes) - 1
    chars = data[np.clip(flat, 0, max(len(data) - 1, 0))]
    chars[to - sizes], chars[to - 1] = START, END
    return Bags(t[new], chars, to, np.diff(new, append=len(t)))


def bags(texts: pa.Array) -> Iterator[tuple[int, Bags]]:
    """For runs of texts: index of the first, their words. A long text comes alone, its words gathered block by block."""
    for at, n, data, offsets in blocks(texts):
        if n > 1 or len(data) <= 2 * BLOCK:
            yield at, _block_bags(data, offsets)
            continue
        seen: dict[bytes, int] = {}
        i = 0
        while i < len(data):
            j = min(i + BLOCK, len(data))
            while j < len(data) and LETTERS[data[j]] != START:
                j += 1
            part = _block_bags(data[i:j], np.array([0, j - i]))
            raw = part.data.tobytes()
            for a, b, c in zip([0, *part.ends[:-1].tolist()], part.ends.tolist(), part.count.tolist(), strict=False):
                seen[raw[a:b]] = seen.get(raw[a:b], 0) + c
            i = j
        sizes = np.array([len(w) for w in seen], np.int64)
        yield at, Bags(np.zeros(len(seen), np.int64), np.frombuffer(b"".join(seen), np.uint8), np.cumsum(sizes), np.array([*seen.values()], np.int64))


def portions(found: Bags, most: int) -> Iterator[Bags]:
    """Whole texts that together have about ``most`` distinct words, or one that has more."""
    starts = np.flatnonzero(np.diff(found.text, prepend=-1))
    stops = np.append(starts[1:], len(found.text))[: len(starts)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + most, side="right")))
        a, b = int(starts[i]), int(stops[j - 1])
        begin = int(found.ends[a - 1]) if a else 0
        yield Bags(found.text[a:b], found.data[begin : int(found.ends[b - 1])], found.ends[a:b] - begin, found.count[a:b])
        i = j


def ngrams(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For n-grams of 1 to ORDER bytes the slot of the one that ends at each byte; before a word's START there are only more of them."""
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    within = np.arange(len(data)) - np.repeat(starts, ends - starts)
    slots, code = [data.astype(np.int64)], data.astype(np.uint64)
    for n in range(1, ORDER):
        before = np.full(len(data), START, np.uint64)
        inside = np.flatnonzero(within >= n)
        before[inside] = data[inside - n]
        code = code | before << np.uint64(8 * n)
        slots.append((code if n == 1 else code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64))
    return slots


def likelihoods(found: Bags, model: Model) -> np.ndarray:
    """[word, language]: logarithm of the probability of each word's bytes after START, END included.

    A byte's probability after the bytes before it comes from the count of the n-gram, with PRIOR
    counts of its probability after one byte less; that of a byte alone from its count.
    """
    sizes, made, first = np.diff(found.ends, prepend=0), [], 0
    step = max(1, ROOM // max(len(model.names), 1))
    while first < len(sizes):
        begin = int(found.ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(found.ends, begin + step, side="right")))
        ends = found.ends[first:last] - begin
        slots = ngrams(found.data[begin : begin + int(ends[-1])], ends)
        p = (model.counts[0][slots[0]] + np.float32(0.5)) / (model.totals + np.float32(128))
        for n in range(1, ORDER):
            context = np.concatenate([[0], slots[n - 1][:-1]])
            p = (model.counts[n][slots[n]] + PRIOR * p) / (model.counts[n - 1][context] + PRIOR)
        starts = ends - sizes[first:last]
        p[starts] = 1
        made.append(np.add.reduceat(np.log(p), starts))
        first = last
    return np.concatenate(made) if made else np.zeros((0, len(model.names)))


def mixture(p: np.ndarray, count: np.ndarray, text: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares [text, language] after ROUNDS of expectation-maximisation from these, and the log-likelihood of each text.

    A word is one language's, chosen by the text's shares; p has its probability in each. Words of a text
    follow each other, and each text has some.
    """
    first = np.flatnonzero(np.diff(text, prepend=-1))
    words = np.add.reduceat(count, first)[:, None]
    for _ in range(ROUNDS):
        r = p * shares[text]
        total = r.sum(axis=1)
        r *= (count / total)[:, None]
        new = np.add.reduceat(r, first) / words
        moved = np.abs(new - shares).max(initial=0)
        shares = new
        if moved < 1e-4:
            break
    return shares, np.add.reduceat(count * np.log((p * shares[text]).sum(axis=1)), first)


def language_sets(found: Bags, model: Model) -> np.ndarray:
    """Shares [text, language] of the chosen languages of each text that has words, 0 for others.

    Languages enter a text's set by their shares in the mixture of all of them, as long as the next one raises
    the log-likelihood, at its best shares, by more than PENALTY * log(words) / 2.
    """
    log_p = likelihoods(found, model)
    top = log_p.max(axis=1, initial=-np.inf, keepdims=True)
    p, count = np.exp(np.maximum(log_p - top, -600)), found.count.astype(np.float64)
    text = np.cumsum(np.diff(found.text, prepend=-1) != 0) - 1
    texts, languages = int(text[-1]) + 1, len(model.names)
    shares, _ = mixture(p, count, text, np.full((texts, languages), 1 / languages))
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    chosen = (rank == 0).astype(np.float64)
    price = PENALTY * np.log(np.bincount(text, count)) / 2
    best = np.bincount(text, count * np.log((p * chosen[text]).sum(axis=1)))
    going = np.arange(texts)
    for k in range(2, languages + 1):
        start = np.where(rank[going] < k, np.maximum(shares[going], 1e-6), 0)
        words = np.flatnonzero(np.isin(text, going))
        new, likely = mixture(p[words], count[words], np.searchsorted(going, text[words]), start / start.sum(axis=1, keepdims=True))
        gained = likely - best[going] > price[going]
        going, new, likely = going[gained], new[gained], likely[gained]
        chosen[going], best[going] = new, likely
        if not len(going):
            break
    return chosen


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; rows of fold 2 are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def _count(names: list[str]):
    """Texts of languages (by place in ``names``) -> counts of their n-grams in this task."""
    place = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            language = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for at, found in bags(batch.column(1)):
                slots = ngrams(found.data, found.ends)
                sizes = np.diff(found.ends, prepend=0)
                of, n = np.repeat(language[at + found.text], sizes), np.repeat(found.count, sizes)
                for k in np.unique(of).tolist():
                    held = sums.setdefault(k, [np.zeros(size) for size in SIZES])
                    for total, slot in zip(held, slots, strict=True):
                        total += np.bincount(slot[of == k], n[of == k], len(total))
        for k, held in sums.items():
            for order, total in enumerate(held):
                slot = np.flatnonzero(total)
                columns = [pa.array(np.full(len(slot), k, np.int32)), pa.array(np.full(len(slot), order, np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[slot].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["language", "order", "slot", "n"])

    return run


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """N-gram counts of every language, from at most about ``sample`` distinct texts outside fold 2.

    Each language gets an equal share of the sample, or all its texts if there are fewer; texts are chosen by
    digest, equal texts of a language count once. Rows with a null key or language, and texts without a letter,
    teach nothing; other columns are ignored. Only counts by language and n-gram slot come to the driver, at most LANGUAGES
    times the slots, whatever the input.
    """
    rows = docs.filter(F.col(key).isNotNull() & F.col(lang).isNotNull() & (fold(F.col(key)) != 2) & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("language"), F.xxhash64(text).alias("digest"), F.col(text).alias("body"))
    sizes = rows.select("language", "digest").distinct().groupBy("language").count().orderBy(F.desc("count"), "language").limit(LANGUAGES).collect()
    names = sorted(r["language"] for r in sizes)
    if not names:
        return Model([], [np.zeros((n, 0), np.float32) for n in SIZES], np.zeros(0, np.float32))
    rates = [(r["language"], min(1 << 40, -(-(sample << 40) // (len(names) * r["count"])))) for r in sizes]
    rate = docs.sparkSession.createDataFrame(rates, "language string, rate long")
    chosen = rows.join(F.broadcast(rate), "language").filter(F.pmod("digest", F.lit(1 << 40)) < F.col("rate"))
    learnt = chosen.dropDuplicates(["language", "digest"]).select("language", F.lower("body").alias("body"))
    counted = learnt.mapInArrow(_count(names), "language int, order int, slot int, n long").groupBy("language", "order", "slot").agg(F.sum("n").alias("n")).toArrow()
    language, order, slot, n = (counted[c].to_numpy() for c in ("language", "order", "slot", "n"))
    counts = [np.zeros((size, len(names)), np.float32) for size in SIZES]
    for k, held in enumerate(counts):
        held[slot[order == k], language[order == k]] = n[order == k]
    return Model(names, counts, counts[0].sum(axis=0) - counts[0][START])


SHARES = "array<struct<lang:string,share:double>>"


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with lang_pred, score and languages.

    languages are those of the text with their shares of its words, largest first; lang_pred is the
    first of them and score its share. Texts that are null or without a letter get ``und``, 0 and none, and all do if the model
    knows no language. Whole texts are scored one by one, without a shuffle; repeated rows get equal
    results, keys are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", docs.select(*keep).schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T._parse_datatype_string(SHARES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, m = to_arrow_schema(schema).field("languages").type, shared.value
        for batch in batches:
            sets: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at, found in bags(batch.column(1)) if m.names else ():
                for part in portions(found, ROOM // len(m.names)):
                    for row, shares in zip(np.unique(part.text).tolist(), language_sets(part, m), strict=True):
                        order = np.argsort(-shares, kind="stable")
                        sets[at + row] = [{"lang": m.names[k], "share": min(float(shares[k]), 1.0)} for k in order.tolist() if shares[k] > 0]
            sets = [s if able else [] for s, able in zip(sets, batch.column(2).to_pylist(), strict=True)]
            best = [s[0] if s else {"lang": UNKNOWN, "share": 0.0} for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b["lang"] for b in best]), pa.array([b["share"] for b in best], pa.float64()), pa.array(sets, kind)], schema.names)

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.struct(*keep).alias("row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("body"), letters.alias("letters")).mapInArrow(run, schema).select("row.*", "lang_pred", "score", "languages")


def op12_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", F.transform("languages", lambda x: x["lang"]).alias("languages"))


QUERIES = {"op12_language_mixture": op12_language_mixture}
ORACLES: dict[str, str] = {}
