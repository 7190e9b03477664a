"""Subtitle edit rate: word edits, break edits and shifts between two sides of timed cues.

The measure of Wilken, Georgakopoulou and Matusov (2022). A cue is its words, a break between its
lines, and a break at its end; words and breaks match or replace each other, each its own kind, only
where their cues overlap in time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.operators.quality import metric_tokens, word_distance

LONGEST, FARTHEST = 10, 50
LINE, CUE, EMPTY = -1, -2, -3
FAR, BARRED = 1 << 20, 1 << 13
#: Tokens of a side up to which islands are compared several at a time, and how many.
SMALL, TOGETHER = 256, 256


class Side(NamedTuple):
    """Tokens as numbers (breaks are negative) and the cue of each."""

    tokens: np.ndarray
    cue: np.ndarray


class Row(NamedTuple):
    """Distances at the columns from ``low`` on; each further one costs one more."""

    low: int
    cost: np.ndarray

    def at(self, low: int, high: int) -> np.ndarray:
        """Of the columns low to high, which are not before this row's."""
        found = self.cost[low - self.low : high - self.low + 1]
        more = high - low + 1 - len(found)
        if more <= 0:
            return found
        first = max(low, self.low + len(self.cost))
        return np.concatenate([found, self.cost[-1] + np.arange(first, high + 1) - (self.low + len(self.cost) - 1)])


def step(row: Row, low: int, high: int, differs: np.ndarray) -> Row:
    """The next row in columns low to high, given what it costs to put its token for each reference token between."""
    before = row.at(low, high)
    new = before + 1
    np.minimum(new[1:], before[:-1] + differs, out=new[1:])
    places = np.arange(len(new))
    return Row(low, np.minimum.accumulate(new - places) + places)


class Task:
    """A hypothesis and a reference with the times [cue, start and end] of their cues, which stand in order of their starts.

    ``first`` and ``last`` bound the reference tokens that each hypothesis cue may meet, so a table of distances
    is a band: columns before it can't match any more and those after it not yet.
    """

    def __init__(self, hypothesis: Side, reference: Side, h_times: np.ndarray, r_times: np.ndarray):
        self.h, self.r, self.h_times, self.r_times = hypothesis, reference, h_times, r_times
        begun = np.searchsorted(r_times[:, 0], h_times[:, 1])  # reference cues that start before the end
        open_ = np.searchsorted(np.maximum.accumulate(r_times[:, 1]), h_times[:, 0], side="right")  # the first that ends after the start
        self.some = open_ < begun
        self.first = np.where(self.some, np.searchsorted(reference.cue, open_), 0)
        self.last = np.where(self.some, np.searchsorted(reference.cue, begun), 0)

    def meet(self, cue: int, others: np.ndarray) -> np.ndarray:
        """Which reference cues overlap a hypothesis cue."""
        return (self.h_times[cue, 0] < self.r_times[others, 1]) & (self.r_times[others, 0] < self.h_times[cue, 1])

    def differs(self, token: int, cue: int, low: int, high: int) -> np.ndarray:
        other = self.r.tokens[low:high]
        able = self.meet(cue, self.r.cue[low:high]) & ((other < 0) == (token < 0))
        return np.where(able, (other != token).astype(np.int64), FAR)

    def moved(self, i: int, k: int, n: int) -> Task:
        """With the n tokens from i on put at place k of the rest."""
        return Task(Side(*(shifted(v, i, k, n) for v in self.h)), self.r, self.h_times, self.r_times)

    def band(self, cue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token of a hypothesis the columns of its row: neither falls along the rows."""
        n = len(self.r.tokens)
        low = np.minimum.accumulate(np.where(self.some[cue], self.first[cue], n)[::-1])[::-1]
        high = np.maximum.accumulate(np.where(self.some[cue], self.last[cue], 0))
        return np.minimum(low, np.maximum(high, 0)), np.maximum(high, np.minimum(low, high))

    def rows(self, tokens: np.ndarray, cue: np.ndarray) -> list[Row]:
        low, high = self.band(cue)
        made = [Row(0, np.zeros(1, np.int64))]
        for t, c, a, b in zip(tokens.tolist(), cue.tolist(), low.tolist(), high.tolist(), strict=True):
            a = max(a, made[-1].low)
            made.append(step(made[-1], a, max(a, b), self.differs(t, c, a, max(a, b))))
        return made

    def reversed(self) -> Task:
        flip = Task.__new__(Task)
        n = len(self.r.tokens)
        flip.h, flip.r = (Side(side.tokens[::-1], side.cue[::-1]) for side in (self.h, self.r))
        flip.h_times, flip.r_times = self.h_times, self.r_times
        flip.first, flip.last, flip.some = np.where(self.some, n - self.last, 0), np.where(self.some, n - self.first, 0), self.some
        return flip


def _total(front: Row, back: Row, n: int) -> int:
    """Least sum of a row and the row of the rest, which is counted from the end, over the columns that both have."""
    low, high = front.low, n - back.low
    if high < low:
        return FAR
    return int((front.at(low, high) + back.at(n - high, n - low)[::-1]).min())


def places(task: Task, rows: list[Row]) -> np.ndarray:
    """For each reference token the number of hypothesis tokens before it in a cheapest alignment."""
    i, j = len(rows) - 1, len(task.r.tokens)
    found = np.zeros(j, np.int64)
    while j > 0:
        row = rows[i]
        here = int(row.at(j, j)[0]) if j >= row.low else FAR
        if i and j > rows[i].low and j - 1 >= rows[i - 1].low:
            paid = int(task.differs(int(task.h.tokens[i - 1]), int(task.h.cue[i - 1]), j - 1, j)[0])
            if int(rows[i - 1].at(j - 1, j - 1)[0]) + paid == here:
                i, j = i - 1, j - 1
                found[j] = i
                continue
        if i and j >= rows[i - 1].low and int(rows[i - 1].at(j, j)[0]) + 1 == here:
            i -= 1
            continue
        j -= 1
        found[j] = i
    return found


def blocks(task: Task, at: np.ndarray, longest: int, farthest: int) -> list[tuple[int, int, int]]:
    """(from, to, length): runs of hypothesis tokens that stand in the reference, in time, and the place where they would stand; longest, then nearest first."""
    where: dict[int, list[int]] = {}
    for j, t in enumerate(task.r.tokens.tolist()):
        where.setdefault(t, []).append(j)
    found, after = set(), {}
    for i in range(len(task.h.tokens) - 1, -1, -1):
        here, cue = {}, int(task.h.cue[i])
        same = where.get(int(task.h.tokens[i]), ())
        for j in same[bisect_left(same, int(task.first[cue])) : bisect_left(same, int(task.last[cue]))]:
            if task.meet(cue, task.r.cue[j]):
                here[j] = min(after.get(j + 1, 0) + 1, longest)
                to = int(at[j])
                for n in range(1, here[j] + 1):
                    k = to if to <= i else to - n
                    if k != i and (to <= i or to >= i + n) and abs(k - i) <= farthest:
                        found.add((-n, abs(k - i), i, k))
        after = here
    return [(i, k, -n) for n, _, i, k in sorted(found)]


def shifted(values: np.ndarray, i: int, k: int, n: int) -> np.ndarray:
    rest = np.concatenate([values[:i], values[i + n :]])
    return np.concatenate([rest[:k], values[i : i + n], rest[k:]])


def least_edits(h: Side, r: Side) -> int:
    """What the two sides differ by whatever the order of their tokens: words and breaks can't stand for each other."""
    out = 0
    for words in (True, False):
        a, b = ([t for t in side.tokens.tolist() if (t >= 0) == words] for side in (h, r))
        out += max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values())
    return out


def edits(task: Task, longest: int = LONGEST, farthest: int = FARTHEST) -> tuple[int, int]:
    """Edits and shifts between the two sides, shifts chosen greedily: each time the one that leaves the fewest edits, as long as it saves two.

    A shift changes only the rows between its ends; one is tried unless it can't beat the best one found:
    it takes off two edits a token or place at most, and what stands before and after its rows stays.
    """
    shifts, n, size = 0, len(task.r.tokens), len(task.h.tokens)
    floor = least_edits(task.h, task.r)
    while True:
        ahead = task.rows(task.h.tokens, task.h.cue)
        now = int(ahead[size].at(n, n)[0])
        best, choice = now - 1, None
        if best > floor:
            turned = task.reversed()
            back = turned.rows(turned.h.tokens, turned.h.cue)
            front, rear = np.array([int(r.cost.min()) for r in ahead]), np.array([int(r.cost.min()) for r in back])
            for i, k, m in blocks(task, places(task, ahead), longest, farthest):
                low, high = min(i, k), max(i, k) + m
                if max(now - 2 * min(m, abs(i - k)), front[low] + rear[size - high]) >= best:
                    continue
                tokens, cue = (shifted(v[low:high], i - low, k - low, m) for v in (task.h.tokens, task.h.cue))
                a = ahead[low].low
                b = max(a, int(task.last[cue].max(initial=0)), ahead[low].low + len(ahead[low].cost) - 1)
                row = ahead[low]
                for t, c in zip(tokens.tolist(), cue.tolist(), strict=True):
                    row = step(row, a, b, task.differs(t, c, a, b))
                if (d := _total(row, back[size - high], n)) < best:
                    best, choice = d, (i, k, m)
                    if best <= floor:
                        break
        if choice is None:
            return now, shifts
        shifts += 1
        task = task.moved(*choice)


def distances(h: np.ndarray, r: np.ndarray, h_size: np.ndarray, r_size: np.ndarray, timed: bool = True) -> np.ndarray:
    """Edits without shifts of several pairs of sides of up to SMALL tokens at once: [tokens, starts and ends of their cues; pair; place], padded.

    sizes: tokens of each. Not ``timed``: all cues of a pair overlap.
    """
    places = np.arange(r.shape[2] + 1, dtype=np.int16)
    row, is_break = np.broadcast_to(places, (len(h_size), len(places))).copy(), r[0] < 0
    tokens = r[0].astype(np.int32)
    last = int(h_size.min())
    for i in range(h.shape[2]):
        token = h[0, :, i, None].astype(np.int32)
        paid = (tokens != token).astype(np.int16)
        unable = is_break != (token < 0)
        if timed:
            unable |= (h[1, :, i, None] >= r[2]) | (r[1] >= h[2, :, i, None])
        paid[unable] = BARRED
        new = row + np.int16(1)
        np.minimum(new[:, 1:], row[:, :-1] + paid, out=new[:, 1:])
        new -= places
        np.minimum.accumulate(new, axis=1, out=new)
        new += places
        row = new if i < last else np.where((i < h_size)[:, None], new, row)
    return row[np.arange(len(r_size)), r_size]


def embedded(h: np.ndarray, r: np.ndarray, h_size: np.ndarray, r_size: np.ndarray) -> np.ndarray:
    """Edits that leave only insertions once the line ends are gone that the reference has none of, for pairs of sides [pair; place], padded; FAR where that is not so."""
    more = np.arange(h.shape[1]) >= h_size[:, None]
    is_line = (h == LINE) & ~more & ~((r == LINE) & (np.arange(r.shape[1]) < r_size[:, None])).any(axis=1)[:, None]
    order = np.argsort(is_line | more, axis=1, kind="stable")
    lines = is_line.sum(axis=1)
    left = h_size - lines
    kept = np.full((len(h), h.shape[1] + 1), EMPTY, h.dtype)  # equal to no token
    kept[:, :-1] = np.where(np.arange(h.shape[1]) < left[:, None], np.take_along_axis(h, order, axis=1), EMPTY)
    at, pairs = np.zeros(len(h), np.int64), np.arange(len(h))
    for j in range(r.shape[1]):
        at += (kept[pairs, at] == r[:, j]) & (j < r_size)
    return np.where(at == left, lines + r_size - left, FAR)


def together(h: np.ndarray, r: np.ndarray) -> int | None:
    """Edits without shifts of two sides whose cues all overlap; None if, between what both begin and end with, breaks stand in both.

    Breaks that only one side has are edits each, so words are left, whose distance takes bits instead of a table.
    """
    least = min(len(h), len(r))
    head = int(np.argmin(np.append(h[:least] == r[:least], False)))
    least -= head
    tail = int(np.argmin(np.append((h[len(h) - least :] == r[len(r) - least :])[::-1], False)))
    h, r = h[head : len(h) - tail], r[head : len(r) - tail]
    if (h < 0).any() and (r < 0).any():
        return None
    return int((h < 0).sum() + (r < 0).sum()) + word_distance(h[h >= 0].tolist(), r[r >= 0].tolist())


def _tokens(texts: pa.Array, cased: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts in a row, and the text of each: words between white space as numbers, LINE between lines that have words, CUE at a text's end.

    Unless ``cased``, words are compared in lower case and without punctuation; each distinct word is looked at once.
    """
    marked = pc.binary_join_element_wise(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \x01 "), pa.scalar("\x02", pa.large_string()), pa.scalar(" ", pa.large_string()))
    split = pc.utf8_split_whitespace(marked)
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary
    breaks = [pc.equal(names, name).to_numpy(zero_copy_only=False) for name in ("\x01", "\x02")]
    if not cased:
        names = pc.replace_substring_regex(pc.utf8_lower(names), r"\p{P}", "")
    number = names.dictionary_encode().indices.to_numpy().astype(np.int64)
    number[pc.equal(names, "").to_numpy(zero_copy_only=False)] = EMPTY
    for mark, found in zip((LINE, CUE), breaks, strict=True):
        number[found] = mark
    tokens, text = number[coded.indices.to_numpy()], pc.list_parent_indices(split).to_numpy().astype(np.int64)
    some = tokens != EMPTY
    tokens, text = tokens[some], text[some]
    # A line's end stands between words of its text; the last of several counts.
    words = np.cumsum(tokens >= 0)
    before = words - np.concatenate([[0], words])[np.searchsorted(text, text)] > 0
    after = np.concatenate([tokens[1:] >= 0, [False]])
    kept = (tokens != LINE) | before & after
    return tokens[kept], text[kept]


def island_edits(islands: pa.ListArray, longest: int = LONGEST, farthest: int = FARTHEST, cased: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, shifts and reference tokens of islands: each its cues (reference, start, end, text) in order of time.

    Islands of up to SMALL tokens a side are compared TOGETHER many at a time, by distances only where one side's tokens don't stand in the other in order; larger ones whose cues all overlap by bit vectors where they can be;
    only those whose edits a shift may lower are searched one by one.
    """
    many, cues = len(islands), islands.flatten()
    island = pc.list_parent_indices(islands).to_numpy().astype(np.int64)
    is_reference = cues.field("reference").to_numpy(zero_copy_only=False).astype(bool)
    times = np.stack([cues.field(c).to_numpy() for c in ("start", "end")])
    tokens, cue = _tokens(cues.field("text"), cased)
    side = is_reference[cue].astype(np.int64)
    order = np.lexsort((side, island[cue]))  # stable: the tokens of a side stay in order
    tokens, cue, side = tokens[order], cue[order], side[order]
    of = island[cue]
    sizes = np.stack([np.bincount(of[side == k], minlength=many) for k in (0, 1)])
    begins = np.cumsum(sizes.sum(axis=0)) - sizes.sum(axis=0)
    begins = np.stack([begins, begins + sizes[0]])
    # Whatever the order of tokens, each kind differs by as much.
    floor, kinds = np.zeros(many, np.int64), int(tokens.max(initial=0)) + 3
    for words in (True, False):
        keys = [of[m] * kinds + tokens[m] + 2 for m in ((side == k) & ((tokens >= 0) == words) for k in (0, 1))]
        (a, a_n), (b, b_n) = (np.unique(k, return_counts=True) for k in keys)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = np.bincount(both // kinds, np.minimum(a_n[i], b_n[j]), many)
        floor += (np.maximum(*(np.bincount(k // kinds, minlength=many) for k in keys)) - shared).astype(np.int64)
    edits_, shifts = sizes.sum(axis=0), np.zeros(many, np.int64)
    able = (sizes > 0).all(axis=0)
    largest = sizes.max(axis=0)

    def padded(k: int, rows: np.ndarray) -> np.ndarray:
        width = sizes[k, rows].max()
        at = np.minimum(begins[k, rows, None] + np.arange(width), len(tokens) - 1)
        return np.stack([tokens[at], *times[:, cue[at]]])

    alone = np.flatnonzero(able & (largest > SMALL)).tolist()
    small = np.flatnonzero(able & (largest <= SMALL))
    bounds = pc.list_value_length(islands).to_numpy()
    first = np.minimum(np.cumsum(bounds) - bounds, max(len(island) - 1, 0))
    apart = np.maximum.reduceat(times[0], first) >= np.minimum.reduceat(times[1], first) if len(island) else np.zeros(many, bool)
    small = small[np.lexsort((largest[small], apart[small]))]
    cuts = [*range(0, len(small), TOGETHER), len(small)]
    edge = int((~apart[small]).sum())  # pairs whose cues all overlap come first
    for k, j in zip(sorted({*cuts, edge}), sorted({*cuts, edge})[1:], strict=False):
        rows = small[k:j]
        h, r = padded(0, rows), padded(1, rows)
        edits_[rows] = np.minimum(embedded(h[0], r[0], *sizes[:, rows]), embedded(r[0], h[0], *sizes[::-1, rows])) if k < edge else FAR
        rest = np.flatnonzero(edits_[rows] != floor[rows])  # no order of tokens differs by less than the floor
        if len(rest):
            edits_[rows[rest]] = distances(h[:, rest], r[:, rest], *sizes[:, rows[rest]], timed=k >= edge)
        alone += rows[edits_[rows] - 1 > floor[rows]].tolist()
    for x in alone:
        owns = [slice(begins[k, x], begins[k, x] + sizes[k, x]) for k in (0, 1)]
        if largest[x] > SMALL and not apart[x] and (d := together(*(tokens[own] for own in owns))) is not None and d - 1 <= floor[x]:
            edits_[x] = d
            continue
        sides, spans = [], []
        for own in owns:
            names, place = np.unique(cue[own], return_inverse=True)
            sides.append(Side(tokens[own], place)), spans.append(times[:, names].T)
        edits_[x], shifts[x] = edits(Task(*sides, *spans), longest, farthest)
    return edits_, shifts, sizes[1]


def subtitle_edit_rate(hypothesis: DataFrame, reference: DataFrame, language: Column | None = None, cased: bool = False, longest: int = LONGEST, farthest: int = FARTHEST) -> DataFrame:
    """Per video_id: edits, shifts, ref_tokens (words and breaks of the reference) and suber, their sum over ref_tokens.

    Both sides: video_id, idx, start_ms, end_ms, text. Unless ``cased``, letters are compared in lower case and
    punctuation is left out; for zh, ja and ko (``language``, of a cue's video) every character is a word. Null texts are empty; a cue without words is its break;
    a cue without length lasts a millisecond; videos of one side only count in full; cues with a null key or time are left out.

    Cues that overlap in time, on either side and one through the other, form an island: tokens of two islands never
    match, so each is measured alone and a long video is split over tasks.
    """
    def placed(cues: DataFrame, is_reference: bool) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        marked = text.contains("\x01") | text.contains("\x02")  # these mark breaks
        text = F.when(marked, F.translate(text, "\x01\x02", "")).otherwise(text)  # character by character, so only where need be
        if language is not None:
            text = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.array_join(metric_tokens(line, language), " ")), "\n")
        end = F.greatest("end_ms", F.col("start_ms") + 1)
        return cues.filter("video_id is not null and start_ms is not null and end_ms is not null").select("video_id", F.lit(is_reference).alias("reference"), F.col("start_ms").alias("start"), end.alias("end"), "idx", text.alias("text"))

    both = placed(hypothesis, False).unionByName(placed(reference, True))
    order = Window.partitionBy("video_id").orderBy("start", "end", "reference", "idx")
    until = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = both.withColumn("opens", F.coalesce(F.col("start") >= until, F.lit(True)).cast("int"))
    tasks = int(hypothesis.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for stays, however small the rows are
    islands = opened.withColumn("island", F.sum("opens").over(order)).repartition(tasks, "video_id", "island").groupBy("video_id", "island")
    listed = islands.agg(F.array_sort(F.collect_list(F.struct("start", "end", "reference", "idx", "text"))).alias("cues"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, island_edits(batch.column(1), longest, farthest, cased))], ["video_id", "edits", "shifts", "ref_tokens"])

    kind = listed.schema["video_id"].dataType.simpleString()
    measured = listed.select("video_id", "cues").mapInArrow(measure, f"video_id {kind}, edits long, shifts long, ref_tokens long")
    summed = measured.groupBy("video_id").agg(*[F.sum(c).alias(c) for c in ("edits", "shifts", "ref_tokens")])
    return summed.withColumn("suber", F.round((F.col("edits") + F.col("shifts")) / F.greatest("ref_tokens", F.lit(1)), 6))
