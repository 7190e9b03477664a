"""Scores of translations and corpus metrics."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import text as X

UNKNOWN = -1.0
REFINE_BELOW = 70.0
PENALTIES = {"critical": 25, "major": 5, "minor": 1}


def attach_scores(cues: DataFrame, scores: DataFrame) -> DataFrame:
    """Cues with the score of their place, -1 where there is none."""
    return cues.join(scores.select("video_id", "idx", "score"), ["video_id", "idx"], "left").withColumn("score", F.coalesce("score", F.lit(UNKNOWN)))


def low(score: Column, below: float = REFINE_BELOW) -> Column:
    return (score >= 0) & (score < below)


def summary(scored: DataFrame, by: str) -> DataFrame:
    """Per value of ``by`` and in total (null): mean of known scores, low, unknown and all rows."""
    return scored.rollup(by).agg(
        F.round(F.avg(F.when(F.col("score") >= 0, F.col("score"))), 6).alias("mean_score"),
        F.count_if(low(F.col("score"))).alias("n_low"), F.count_if(F.col("score") < 0).alias("n_unknown"), F.count("*").alias("n_rows"),
    )


def mqm(annotations: DataFrame) -> DataFrame:
    """(video_id, idx, mqm): 100 less the penalties, 0 at least."""
    weight = F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair])[F.col("severity")]
    return annotations.groupBy("video_id", "idx").agg(F.greatest(F.lit(0), 100 - F.sum(F.coalesce(weight, F.lit(0)))).cast("double").alias("mqm"))


def spread_failures(cues: DataFrame, batches: DataFrame) -> DataFrame:
    """Cues with ``failed``: their batch's answer could not be read. batches: video_id, batch_id, ok."""
    return cues.join(batches, ["video_id", "batch_id"], "left").withColumn("failed", ~F.coalesce("ok", F.lit(False))).drop("ok")


def metric_tokens(s: Column, language: Column | None = None) -> Column:
    """Words; for zh, ja and ko single characters. None for null."""
    s = F.coalesce(s, F.lit(""))
    if language is None:
        return X.tokens(s)
    return F.when(language.isin("zh", "ja", "ko"), F.filter(F.split(s, ""), lambda c: c.rlike(r"(?U)\S"))).otherwise(X.tokens(s))


def word_distance(a: list, b: list) -> int:
    """Levenshtein distance of two word lists.

    Equal words at both ends are left out. Of the rest a whole column of the table is one integer of
    bits, one for a step up and one for a step down in each row (Myers 1999, Hyyrö 2003), so Python
    does a few operations per word of ``b``, whatever the length of ``a``.
    """
    least = min(len(a), len(b))
    head = next((k for k in range(least) if a[k] != b[k]), least)
    tail = next((k for k in range(least - head) if a[-1 - k] != b[-1 - k]), least - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    top, up, down, distance = 1 << len(a) - 1, full, 0, len(a)
    for w in b:
        same = where.get(w, 0)
        level = ((same & up) + up ^ up) | same | down
        rise, fall = down | full & ~(level | up), up & level
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full | 1, fall << 1 & full
        up, down = fall | full & ~(same | down | rise), rise & (same | down)
    return distance


def _edits(distance: Callable[[list, list], int]) -> Callable[[Column, Column], Column]:
    """A distance of word lists as a function of two columns of words, which go to Python as one text."""
    @F.pandas_udf(T.IntegerType())
    def measured(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            yield pd.Series([0 if a == b else distance(a.split(" ") if a else [], b.split(" ") if b else []) for a, b in zip(left, right, strict=True)], dtype="int32")

    return lambda a, b: measured(F.array_join(a, " "), F.array_join(b, " "))


def wer(pairs: DataFrame, by: str = "video_id", language: Column | None = None) -> DataFrame:
    """Word error rate per ``by``: edits over reference words. pairs: hypothesis, reference; null counts as empty."""
    h, r = metric_tokens(F.col("hypothesis"), language), metric_tokens(F.col("reference"), language)
    measured = pairs.select(by, _edits(word_distance)(h, r).alias("edits"), F.size(r).alias("n"))
    return measured.groupBy(by).agg(F.sum("edits").alias("edits"), F.sum("n").alias("ref_words")).withColumn("wer", F.round(F.col("edits") / F.greatest("ref_words", F.lit(1)), 6))


ROOM = 1 << 61
#: Pairs whose n-grams are counted at once, few enough to be sorted fast.
COUNTED_PAIRS = 256


def _symbols(texts: pa.Array, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts in a row, as numbers from 0, and the place of each one's text: words between spaces, or characters."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not by_word:
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        return np.unique(codes, return_inverse=True)[1], np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy())
    words = pc.split_pattern(texts, " ")
    flat = words.flatten()
    some = pc.not_equal(flat, "")
    place = pc.list_parent_indices(words).filter(some).to_numpy()
    return flat.filter(some).dictionary_encode().indices.to_numpy().astype(np.int64), place


def gram_totals(hypotheses: pa.Array, references: pa.Array, orders: int, by_word: bool) -> list[int]:
    """For each order: matched n-grams, clipped by the reference of the same pair, those of the hypotheses, those of the references.

    An n-gram is a number, its symbols' digits; where digits and pair outgrow 61 bits, n-grams are numbered anew.
    """
    pairs = len(hypotheses)
    symbols, text = _symbols(pa.concat_arrays([hypotheses, references]), by_word)
    base = int(symbols.max(initial=0)) + 1
    at, gram, bound, out = np.arange(len(symbols)), symbols, base, []
    for n in range(1, orders + 1):
        if n > 1:
            able = at + n - 1 < len(symbols)
            able[able] = text[at[able]] == text[at[able] + n - 1]
            at, gram = at[able], gram[able]
            if bound * base * pairs >= ROOM:
                names, gram = np.unique(gram, return_inverse=True)
                bound = len(names)
            gram, bound = gram * base + symbols[at + n - 1], bound * base
        own = text[at]
        if bound * pairs >= ROOM:
            names, gram = np.unique(gram, return_inverse=True)
            bound = len(names)
        keys = own % pairs * bound + gram
        both = np.sort(keys * 2 + own // pairs)  # equal n-grams of a pair lie together, those of the hypothesis first
        name, reference = both >> 1, both & 1
        starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
        sizes = np.diff(starts, append=len(name))
        of_reference = np.add.reduceat(reference, starts) if len(starts) else sizes
        n_references = int(reference.sum())
        out += [int(np.minimum(sizes - of_reference, of_reference).sum()), len(both) - n_references, n_references]
    return out


def _sums(pairs: DataFrame, hypothesis: Column, reference: Column, orders: int, by_word: bool) -> DataFrame:
    """One row with m1, h1, r1, m2, ...: sums over all pairs. A batch of pairs is counted at once, so no n-gram is shuffled."""
    names = [f"{x}{n}" for n in range(1, orders + 1) for x in "mhr"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = (batch.slice(k, COUNTED_PAIRS) for k in range(0, batch.num_rows, COUNTED_PAIRS))
                totals = [sum(x) for x in zip(*(gram_totals(p.column(0), p.column(1), orders, by_word) for p in parts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in totals], names)

    counted = pairs.select(hypothesis, reference).mapInArrow(count, ", ".join(f"{n} long" for n in names))
    return counted.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def bleu(pairs: DataFrame, language: Column | None = None) -> DataFrame:
    """Corpus BLEU: one row with bleu and the precisions of orders 1 to 4."""
    words = lambda c: F.array_join(metric_tokens(F.col(c), language), " ")
    sums = _sums(pairs, words("hypothesis"), words("reference"), 4, True)
    p = [F.col(f"m{n}") / F.greatest(F.col(f"h{n}"), F.lit(1)) for n in range(1, 5)]
    logs = sum((F.log(F.greatest(x, F.lit(1e-9))) for x in p[1:]), F.log(F.greatest(p[0], F.lit(1e-9))))
    short = F.least(F.lit(0.0), 1 - F.col("r1") / F.greatest(F.col("h1"), F.lit(1)))
    return sums.select(F.round(100 * F.exp(logs / 4 + short), 6).alias("bleu"), *[F.round(x, 6).alias(f"p{n}") for n, x in enumerate(p, 1)])


def chrf(pairs: DataFrame, beta: float = 2.0) -> DataFrame:
    """Corpus chrF: character n-grams 1 to 6 without white space, F-score with beta 2, averaged over orders."""
    bare = lambda c: F.regexp_replace(F.col(c), r"(?U)\s+", "")
    sums = _sums(pairs, bare("hypothesis"), bare("reference"), 6, False)

    def score(n: int) -> Column:
        p, r = F.col(f"m{n}") / F.greatest(F.col(f"h{n}"), F.lit(1)), F.col(f"m{n}") / F.greatest(F.col(f"r{n}"), F.lit(1))
        return F.when(F.col(f"m{n}") > 0, (1 + beta**2) * p * r / F.when(F.col(f"m{n}") > 0, beta**2 * p + r).otherwise(1.0)).otherwise(0.0)

    return sums.select(F.round(100 * sum((score(n) for n in range(2, 7)), score(1)) / 6, 6).alias("chrf"))


FAR = 1 << 20
CELLS = 200_000
FIRST_BLOCKS, SHORT = 16, 64


def _blocks(x: np.ndarray, y: np.ndarray, longest: int, farthest: int):
    """Blocks of ``x`` that stand in ``y`` (words as numbers), longest, then nearest first: arrays of start, place and length."""
    room, at = max(len(x), len(y)) + 1, np.arange(len(x))
    keys = np.sort(y.astype(np.int64) * room + np.arange(len(y)))  # places of a word lie together
    own = x.astype(np.int64) * room
    low = np.searchsorted(keys, own + np.maximum(at - farthest, 0))
    n = np.searchsorted(keys, own + np.minimum(at + farthest, room - 1), "right") - low
    i = np.repeat(at, n)
    j = keys[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(i))] - own[i]
    along = np.lexsort((i, j - i))
    i, j = i[along], j[along]
    ends = np.flatnonzero(np.r_[(np.diff(j - i) != 0) | (np.diff(i) != 1), True][: len(i)]) + 1  # of runs of words that match one after the other
    n = np.minimum(np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(i)), longest)
    each = np.repeat(np.arange(len(n)), n)
    i, j, n = i[each], j[each], np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + 1
    order = np.lexsort((j, i, abs(i - j), -n))
    return i[order], j[order], n[order]


def _band(x: np.ndarray, y: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the edit distance of ``x`` and the begins of ``y``, w places around the diagonal, and ``y`` with room at both ends; FAR beyond w.

    Distances grow along a diagonal, so where each one passes 0, 1, ... w tells its cells: steps go by
    errors and not by words (Ukkonen 1985).
    """
    padded = np.full(max(len(x), len(y)) + 2 * w + 2, -1, np.int32)
    padded[w + 1 : w + 1 + len(y)] = y
    n, band = len(x), np.arange(2 * w + 1)
    differs = np.lib.stride_tricks.sliding_window_view(padded[1:], len(band))[:n] != x[:, None]
    to = np.full((n + 1, len(band)), n, np.int32)  # the first row from here on where a diagonal has other words
    to[:n][differs] = np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], differs.shape)[differs]
    to = np.minimum.accumulate(to[::-1], axis=0)[::-1]
    reached = np.full((w + 1, len(band)), -1, np.int64)  # the last row that a diagonal has within so many errors
    reached[0, w] = to[0, w]
    for e in range(1, w + 1):
        before = np.r_[-2, reached[e - 1], -2]
        before[before == -1] = -2
        now = np.maximum(np.maximum(before[1:-1] + 1, before[:-2]), before[2:] + 1)
        some = now >= 0
        reached[e, some] = to[np.minimum(now[some], n), band[some]]
    out = np.empty((n + 1, len(band)), np.int32)
    lines = np.arange(n + 1)
    for c in band:
        out[:, c] = np.searchsorted(reached[:, c], lines)
        out[: max(0, w - c), c] = FAR
    out[out > w] = FAR
    return out, padded


def _step(row, differs):
    """The next row of an edit distance in a band around the diagonal; rows of several strings may be stacked."""
    places = np.arange(row.shape[-1], dtype=np.int32)
    row, gone = row + differs, row[..., 1:] + 1
    np.minimum(row[..., :-1], gone, out=row[..., :-1])
    return np.minimum.accumulate(row - places, axis=-1) + places


def _moved(a: list | str | tuple, i: int, k: int, n: int) -> list | str | tuple:
    """``a`` with its ``n`` words from ``i`` on at place ``k`` of the others."""
    rest = a[:i] + a[i + n :]
    return rest[:k] + a[i : i + n] + rest[k:]


def best_shift(a: list, b: list, now: int, floor: int, longest: int, farthest: int) -> tuple[int, list] | None:
    """The shift that leaves the least distance, below ``now`` - 1, and the words after it; the first of equals in the order of ``_blocks``.

    Every block counts. One is skipped only if its distance cannot be less than the best so far: a
    shift of n words by m places takes 2 min(n, m) edits off at most, leaves what the words before and
    after it cost at least, and nothing falls below ``floor``.
    Distances that matter stay in a band of ``now`` - 2 places around the diagonal, and a shift changes
    only the rows between its ends, so these alone are computed again.
    """
    names: dict = {}
    x, y = (np.array([names.setdefault(w, len(names)) for w in side], np.int32) for side in (a, b))
    i, j, n = _blocks(x, y, longest, farthest)
    k = np.minimum(j, len(x) - n)
    i, k, n = (v[k != i] for v in (i, k, n))
    w = now - 2
    band = np.arange(2 * w + 1)

    (ahead, padded), (back, _) = _band(x, y, w), _band(x[::-1], y[::-1], w)
    mirror = len(y) - len(x) + 2 * w - band
    inside = (mirror >= 0) & (mirror < len(band))
    mirror = np.clip(mirror, 0, len(band) - 1)
    best, choice = now - 1, None
    ends = ahead.min(axis=1)[np.minimum(i, k)] + back.min(axis=1)[len(x) - np.maximum(i, k) - n]
    least = np.maximum(now - 2 * np.minimum(n, abs(i - k)), ends)
    words, wanted = x.tolist(), y.tolist()
    most = max(1, CELLS // len(band))
    size = FIRST_BLOCKS if len(y) <= SHORT else most
    open_ = np.flatnonzero(least < best)
    open_ = open_[np.argsort(least[open_], kind="stable")]  # those that may leave least first
    while len(open_) and best > floor:
        chunk, open_, size = open_[:size], open_[size:], min(size * 8, most)
        if len(y) <= SHORT and len(chunk) <= FIRST_BLOCKS:  # a few are measured one by one
            c = chunk
            d = np.array([word_distance(_moved(words, int(i[q]), int(k[q]), int(n[q])), wanted) for q in chunk])
        else:
            span = (n + abs(i - k))[chunk]
            longest_first = np.argsort(-span, kind="stable")
            c, span = chunk[longest_first], span[longest_first]
            low, later, move = np.minimum(i, k)[c], (k > i)[c], abs(i - k)[c]
            row = ahead[low]
            for s in range(int(span[0])):
                m = int(np.searchsorted(-span, -s, side="left"))  # those whose span is longer than s
                front = np.where(later[:m], move[:m], n[c[:m]])
                word = x[np.where(s < front, np.where(later[:m], n[c[:m]], move[:m]) + low[:m] + s, low[:m] + s - front)]
                row[:m] = _step(row[:m], padded[(low[:m] + s + 1)[:, None] + band] != word[:, None])
            d = (row + np.where(inside, back[len(x) - low - span][:, mirror], FAR)).min(axis=1)
        if d.min() < best or choice is not None and d.min() == best:
            first = int(c[d == d.min()].min())
            choice = first if d.min() < best else min(choice, first)
            best = int(d.min())
            open_ = open_[(least[open_] < best) | (least[open_] == best) & (open_ < choice)]
    if choice is None:
        return None
    i, k, n = int(i[choice]), int(k[choice]), int(n[choice])
    return best, _moved(a, i, k, n)


#: Errors up to which distances are found by runs of equal words, and places of a text that may begin or end a shift then.
NEAR, NEAR_PLACES = 8, 512
#: Numbers from 0xD800 on that are no letters, and pairs that get letters at once.
SURROGATES, LETTERED_PAIRS = 0x800, 1024


def _letters(a: list, b: list) -> tuple[str, str] | tuple[tuple, tuple]:
    """Two lists of words as strings with a letter for each word, which Python cuts and compares at once; tuples of numbers where letters run out."""
    names: dict = {}
    x, y = ([names.setdefault(w, len(names)) for w in side] for side in (a, b))
    return ("".join(map(chr, x)), "".join(map(chr, y))) if len(names) <= sys.maxunicode else (tuple(x), tuple(y))


def _lettered(hypotheses: pa.Array, references: pa.Array) -> Iterator[tuple]:
    """``_letters`` of pairs of texts (words between spaces), of all of them at once if there are letters enough."""
    pairs = len(hypotheses)
    symbols, text = _symbols(pa.concat_arrays([hypotheses, references]), True)
    if int(symbols.max(initial=0)) + SURROGATES > sys.maxunicode:
        if pairs == 1:
            yield tuple(symbols[text == 0].tolist()), tuple(symbols[text == 1].tolist())
            return
        for k, n in ((0, pairs // 2), (pairs // 2, pairs - pairs // 2)):
            yield from _lettered(hypotheses.slice(k, n), references.slice(k, n))
        return
    letters = (symbols + SURROGATES * (symbols >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")
    at = np.searchsorted(text, np.arange(2 * pairs + 1)).tolist()
    for k in range(pairs):
        yield letters[at[k] : at[k + 1]], letters[at[k + pairs] : at[k + pairs + 1]]


def _run(x: str | tuple, i: int, y: str | tuple, j: int) -> int:
    """Places from ``i`` on that are as those of ``y`` from ``j`` on: steps double as long as they are equal, then halve."""
    most, n, step = min(len(x) - i, len(y) - j), 0, 1
    while step <= most - n and x[i + n : i + n + step] == y[j + n : j + n + step]:
        n, step = n + step, step * 2
    while step > 1:
        step //= 2
        if step <= most - n and x[i + n : i + n + step] == y[j + n : j + n + step]:
            n += step
    return n


def _reached(x: str | tuple, y: str | tuple, most: int) -> tuple[list[list[int]], int | None]:
    """How far into ``x`` 0, 1, ... errors get on diagonals (places of ``y`` less those of ``x``, as in ``_band``) from -errors to errors, negative where they don't get; and the edit distance, None beyond ``most``."""
    rows, columns, far, before = len(x), len(y), [], []
    for e in range(most + 1):
        now, before = [], [-2, -2, *before, -2, -2] if e else [-1, -1, -1]
        for at in range(2 * e + 1):
            d, i, gone = at - e, before[at + 1] + 1, before[at + 2] + 1
            i = gone if gone > i else i
            i = before[at] if before[at] > i else i
            i = rows if i > rows else i
            i = columns - d if i > columns - d else i
            if i < 0 or i + d < 0:
                i = -2
            elif i < rows and i + d < columns and x[i] == y[i + d]:
                i += _run(x, i, y, i + d)
            now.append(i)
        far.append(now)
        if abs(columns - rows) <= e and now[columns - rows + e] == rows:
            return far, e
        before = now
    return far, None


def _doors(ahead: list[list[int]], back: list[list[int]], rows: int, skew: int, widest: int) -> list[tuple[int, int, int]]:
    """(cost, a, b): a shift of at most ``widest`` words whose first one is at ``a`` or before and whose last one is at ``b`` or after may leave so many errors, the cheapest first.

    What stands before and after it costs what it did, and its words the difference of the two diagonals that it joins.
    """
    w, found = len(ahead) - 1, set()
    for e, begins in enumerate(ahead):
        for f in range(w - e + 1):
            for d, a in enumerate(begins, -e):
                for g, rest in enumerate(back[f], -f):
                    if a >= 0 and rest >= 0 and rows - rest - a <= widest and (cost := e + f + abs(skew - g - d)) <= w:
                        found.add((cost, a, rows - rest))
    doors: list[tuple[int, int, int]] = []
    for cost, a, b in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not any(a <= p and b >= q for _, p, q in doors):
            doors.append((cost, a, b))
    return doors


def _turned(x: str | tuple, y: str | tuple, longest: int, farthest: int) -> bool:
    """Whether one shift makes ``x`` into ``y``: what lies between their equal ends is turned round."""
    if len(x) != len(y) or isinstance(x, tuple):
        return False
    head, tail = _run(x, 0, y, 0), _run(x[::-1], 0, y[::-1], 0)
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    n = (x + x).find(y, 1)
    while 0 < n < len(x):
        if min(n, len(x) - n) <= longest and max(n, len(x) - n) <= farthest or max(n, len(x) - n) <= longest and min(n, len(x) - n) <= farthest:
            return True
        n = (x + x).find(y, n + 1)
    return False


def _near_shift(x: str | tuple, y: str | tuple, now: int, floor: int, longest: int, farthest: int) -> tuple[int, str | tuple] | None | bool:
    """``best_shift`` of texts with few errors, whose blocks are looked for around errors only (``_doors``); False where that is too many places."""
    w, rows, columns = now - 2, len(x), len(y)
    doors = _doors(_reached(x, y, w)[0], _reached(x[::-1], y[::-1], w)[0], rows, columns - rows, longest + farthest)
    spans: list[list[int]] = []
    for low, high in sorted((max(0, b - longest - farthest), min(rows, a + farthest + 1)) for _, a, b in doors):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    if sum(high - low for low, high in spans) > NEAR_PLACES:
        return False
    edges = sorted({a for _, a, _ in doors})
    least_ends = [*(min(b for _, a, b in doors if a >= edge) for edge in edges), rows + longest + 1]
    found = []
    for low, high in spans:
        first, last = max(0, low - farthest), min(columns, high + farthest)
        where: dict = {}
        for j in range(first, last):
            where.setdefault(y[j], []).append(j)
        alike = {min(rows, last + longest) - 1: min(rows, last + longest)}  # the end of the equal words from a place on: to change their order changes nothing
        for i in range(min(rows, last + longest) - 2, first - 1, -1):
            alike[i] = alike[i + 1] if x[i] == x[i + 1] else i + 1
        for i in range(low, high):
            for j in where.get(x[i], ()):
                begin, end = (i, j) if i < j else (j, i)
                if i == j or end - begin > farthest:
                    continue
                least_end = least_ends[bisect_left(edges, begin)]
                if end + longest < least_end or alike[begin] >= min(rows, end + longest):
                    continue
                for n in range(1 if j + longest > rows else max(1, least_end - end), longest + 1):
                    if i + n > rows or j + n > columns or x[i : i + n] != y[j : j + n]:
                        break
                    k = min(j, rows - n)
                    after = max(i, k) + n
                    cost = next((c for c, a, b in doors if begin <= a and after >= b), now)
                    least = max(now - 2 * min(n, abs(i - k)), cost)
                    if k != i and least <= w and alike[begin] < after:
                        found.append((least, (-n, end - begin, i, j), k))
    best, choice, out, known = now - 1, None, None, {}
    for least, order, k in sorted(found):
        if least > best or least == best and (choice is None or order > choice):
            continue
        after = _moved(x, order[2], k, -order[0])
        if after not in known:
            known[after] = _reached(after, y, best)[1]
        d = known[after]
        if d is not None and (d < best or d == best and choice is not None and order < choice):
            best, choice, out = d, order, after
            if best <= floor:
                break
    return None if choice is None else (best, out)


def shifted_distance(a: list, b: list, longest: int, farthest: int) -> int:
    """Edits and shifts of blocks that turn ``a`` into ``b``, shifts chosen greedily."""
    return _shifted(*_letters(a, b), longest, farthest)


def _shifted(x: str | tuple, y: str | tuple, longest: int, farthest: int) -> int:
    if x == y:
        return 0
    if _turned(x, y, longest, farthest):  # the least that a shift can leave, so no other one is chosen
        return 1
    shifts, now = 0, _reached(x, y, NEAR)[1]
    now = word_distance(x, y) if now is None else now
    alike = len(x) == len(y) and sorted(x) == sorted(y)
    floor = 0 if alike else max(len(x), len(y)) - sum((Counter(x) & Counter(y)).values())  # whatever the order of the words
    while now - 1 > floor:
        found = _near_shift(x, y, now, floor, longest, farthest) if now <= NEAR else False
        found = best_shift(x, y, now, floor, longest, farthest) if found is False else found
        if not found:
            break
        (now, x), shifts = found, shifts + 1
    return now + shifts


def ter(pairs: DataFrame, by: str = "video_id", longest: int = 10, farthest: int = 50, language: Column | None = None) -> DataFrame:
    """Translation edit rate per ``by``: edits and shifts of blocks over reference words.

    Shifts are searched greedily, as in the published algorithm: as long as moving a block of the
    hypothesis (``longest`` words, ``farthest`` places at most) to where it stands in the
    reference lowers the distance by more than the shift costs. Each round tries every block. Null
    counts as empty.
    """
    h, r = (F.array_join(metric_tokens(F.col(c), language), " ").alias(a) for c, a in (("hypothesis", "_h"), ("reference", "_r")))
    schema = T.StructType([pairs.schema[by], T.StructField("edits", T.IntegerType()), T.StructField("n", T.IntegerType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x for k in range(0, batch.num_rows, LETTERED_PAIRS) for x in _lettered(*(batch.column(c).slice(k, LETTERED_PAIRS) for c in (1, 2)))]
            edits = pa.array([_shifted(x, y, longest, farthest) for x, y in both], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), edits, pa.array([len(y) for _, y in both], pa.int32())], schema.names)

    measured = pairs.select(by, h, r).mapInArrow(measure, schema)
    return measured.groupBy(by).agg(F.sum("edits").alias("edits"), F.sum("n").alias("ref_words")).withColumn("ter", F.round(F.col("edits") / F.greatest("ref_words", F.lit(1)), 6))


def pair_by_time(hypothesis: DataFrame, reference: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """Cues of both sides that overlap in time: (video_id, h_idx, r_idx, overlap_ms).

    Each cue goes to the time buckets it touches; a pair counts in the bucket where the later one starts.
    """
    def spread(df: DataFrame, p: str) -> DataFrame:
        touched = F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.greatest("end_ms", F.col("start_ms") + 1) - 1) / bucket_ms))
        return df.select("video_id", F.col("idx").alias(f"{p}_idx"), F.col("start_ms").alias(f"{p}_start"), F.col("end_ms").alias(f"{p}_end"), F.explode(touched).alias("bucket"))

    both = spread(hypothesis, "h").join(spread(reference, "r"), ["video_id", "bucket"]).filter("h_start < r_end and r_start < h_end")
    begin = F.greatest("h_start", "r_start")
    return both.filter(F.floor(begin / bucket_ms) == F.col("bucket")).select("video_id", "h_idx", "r_idx", (F.least("h_end", "r_end") - begin).alias("overlap_ms"))
