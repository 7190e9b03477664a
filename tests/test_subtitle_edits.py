"""The subtitle edit rate against tables without bands and a full search over shifts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cueloom.operators import subtitle_edits as E

CUES = "video_id long, idx int, start_ms long, end_ms long, text string"


def distance(task, tokens, cue):
    """The whole table, cell by cell."""
    n = len(task.r.tokens)
    row = list(range(n + 1))
    for t, c in zip(tokens, cue, strict=True):
        new = [row[0] + 1]
        for j in range(n):
            able = task.meet(c, task.r.cue[j]) and (task.r.tokens[j] < 0) == (t < 0)
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (int(task.r.tokens[j] != t) if able else E.FAR)))
        row = new
    return row[n]


def random_cues(r, n, words=4, gap=0.3):
    out, t = [], 0
    for _ in range(n):
        length = r.randint(500, 2500)
        lines = [" ".join(r.choice("abcdef"[:words]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 2))]
        out.append((t, t + length, "\n".join(lines)))
        t += length + (r.randint(1, 900) if r.random() < gap else 0)
    return out


def changed(r, cues):
    out = []
    for a, b, text in cues:
        tokens = text.split(" ")
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(tokens))
            tokens[k : k + 1] = r.choice([[], [r.choice("abcdef")], [tokens[k], "x"]])
            tokens = tokens or ["y"]
        if r.random() < 0.4 and len(tokens) > 2:
            k = r.randrange(1, len(tokens))
            tokens = tokens[k:] + tokens[:k]
        late = r.randint(-300, 300)
        out.append((max(a + late, 0), b + late, " ".join(tokens)))
    return sorted(out)


def task_of(h, r):
    names = {}
    sides, times = [], []
    for cues in (h, r):
        tokens, cue = [], []
        for c, (_, _, text) in enumerate(cues):
            for k, line in enumerate(text.split("\n")):
                tokens += [E.LINE] * (k > 0) + [names.setdefault(w, len(names)) for w in line.split(" ")]
            tokens.append(E.CUE)
            cue += [c] * (len(tokens) - len(cue))
        sides.append(E.Side(np.array(tokens), np.array(cue))), times.append(np.array([(a, b) for a, b, _ in cues]))
    return E.Task(*sides, *times)


def test_distances_in_bands():
    r = random.Random(2)
    for _ in range(150):
        ref = random_cues(r, r.randint(1, 8))
        task = task_of(changed(r, ref), ref)
        rows = task.rows(task.h.tokens, task.h.cue)
        n = len(task.r.tokens)
        assert int(rows[-1].at(n, n)[0]) == distance(task, task.h.tokens, task.h.cue)
        back = task.reversed()
        b = back.rows(back.h.tokens, back.h.cue)
        assert {E._total(rows[k], b[len(rows) - 1 - k], n) for k in range(len(rows))} == {int(rows[-1].at(n, n)[0])}
        at = E.places(task, rows)
        assert (np.diff(at) >= 0).all() and at[-1] <= len(task.h.tokens)


def greedy(task):
    """The same search, each shift measured over the whole table."""
    shifts = 0
    while True:
        now, best, choice = distance(task, task.h.tokens, task.h.cue), None, None
        best = now - 1
        for i, k, m in E.blocks(task, E.places(task, task.rows(task.h.tokens, task.h.cue)), E.LONGEST, E.FARTHEST):
            d = distance(task, E.shifted(task.h.tokens, i, k, m), E.shifted(task.h.cue, i, k, m))
            if d < best:
                best, choice = d, (i, k, m)
        if choice is None:
            return now, shifts
        shifts += 1
        task = task.moved(*choice)


def test_shifts_by_full_search():
    r = random.Random(7)
    moved = 0
    for _ in range(40):
        ref = random_cues(r, r.randint(1, 4), 6)
        task = task_of(changed(r, ref), ref)
        wanted = greedy(task)
        assert E.edits(task) == wanted
        moved += wanted[1]
    assert moved > 10


def test_islands_together(monkeypatch):
    r = random.Random(5)
    islands, wanted = [], []
    for _ in range(60):
        ref = random_cues(r, r.randint(0, 4), 6)
        hyp = changed(r, ref) if r.random() < 0.9 else []
        islands.append([{"reference": side, "start": a, "end": b, "text": t} for side, cues in ((False, hyp), (True, ref)) for a, b, t in cues])
        task = task_of(hyp, ref) if hyp and ref else None
        tokens = sum(len(t.replace("\n", " ").split(" ")) + t.count("\n") + 1 for _, _, t in ref)
        wanted.append((*E.edits(task), tokens) if task else (sum(len(t.replace("\n", " ").split(" ")) + t.count("\n") + 1 for _, _, t in hyp) + tokens, 0, tokens))
    for small, together in ((256, 256), (16, 5), (0, 1)):
        monkeypatch.setattr(E, "SMALL", small)
        monkeypatch.setattr(E, "TOGETHER", together)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reference", pa.bool_()), ("text", pa.string())]))
        assert [*zip(*(x.tolist() for x in E.island_edits(pa.array(islands, kind))), strict=True)] == wanted


def test_known_rates(spark):
    ref = [(1, 1, 0, 1000, "Hello, world"), (1, 2, 1000, 2000, "how are\nyou today"), (2, 1, 0, 500, "one two"), (3, 1, 0, 900, "a b c d e f"), (4, 1, 0, 100, "only here"), (5, 1, 0, 100, None), (6, 1, 5, 5, "x y")]
    hyp = [
        (1, 1, 0, 1000, "hello world"), (1, 2, 1000, 2000, "how are you\ntoday"),  # a break moved: two edits, or one shift
        (2, 1, 600, 900, "one two"),  # no overlap: three deletions, three insertions
        (3, 1, 0, 900, "d e f a b c"),  # one shift
        (5, 1, 0, 100, ""), (6, 1, 5, 5, "x y"), (7, 1, 0, 10, "added words"),
        (None, 1, 0, 10, "no key"), (1, 3, None, 10, "no time"),
    ]
    tables = [spark.createDataFrame(rows, CUES).withColumns({"start": F.lit("clash"), "island": F.lit(1), "cues": F.lit(2)}) for rows in (hyp, ref)]
    got = {r.video_id: (r.edits, r.shifts, r.ref_tokens) for r in E.subtitle_edit_rate(*tables).collect()}
    assert got == {1: (0, 1, 9), 2: (6, 0, 3), 3: (0, 1, 7), 4: (3, 0, 3), 5: (0, 0, 1), 6: (0, 0, 3), 7: (3, 0, 0)}
    cased = {r.video_id: r.edits for r in E.subtitle_edit_rate(*tables, cased=True).collect()}
    assert cased[1] == 1 and E.subtitle_edit_rate(*[t.limit(0) for t in tables]).count() == 0
    both = [spark.createDataFrame([(1, 1, 0, 900, t)], CUES) for t in ("天 气好", "天气很好")]
    assert [(r.edits, r.ref_tokens) for r in E.subtitle_edit_rate(*both, language=F.lit("zh")).collect()] == [(1, 5)]


def test_long_videos(spark):
    """One island over a whole video of many cues, each overlapping the next: measured in a band."""
    r = random.Random(11)
    ref = [(1, k, k * 1000, k * 1000 + 1000, " ".join(f"w{r.randrange(300)}" for _ in range(8))) for k in range(1500)]
    hyp = [(v, k, a + 400, b + 400, " ".join(w for i, w in enumerate(t.split()) if (k + i) % 11)) for v, k, a, b, t in ref]
    got = E.subtitle_edit_rate(spark.createDataFrame(hyp, CUES), spark.createDataFrame(ref, CUES)).first()
    gone = sum(len(t[4].split()) for t in ref) - sum(len(t[4].split()) for t in hyp)
    assert (got.edits + got.shifts, got.ref_tokens) == (gone, 1500 * 9)


def test_distances_of_cues_that_all_overlap():
    r, some = random.Random(5), 0
    for _ in range(400):
        tokens = [np.array([r.choice([0, 1, 2, 3, E.LINE] if r.random() < p else [0, 1, 2, 3]) for _ in range(r.randint(0, 9))] + [E.CUE]) for p in (r.choice([0, 0.6]), r.choice([0, 0, 0.6]))]
        task = E.Task(*(E.Side(t, np.zeros(len(t), np.int64)) for t in tokens), np.array([(0, 10)]), np.array([(0, 10)]))
        if (found := E.together(*tokens)) is not None:
            some += 1
            assert found == distance(task, tokens[0], np.zeros(len(tokens[0]), np.int64)), tokens
    assert some > 200


def test_long_cues_by_bits_and_by_search():
    r = random.Random(6)
    words = [r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(700)]
    fewer = [w for k, w in enumerate(words) if k % 9]
    moved = words[300:304] + words[:300] + words[304:]
    sides = [" ".join(fewer), " ".join(moved), " ".join(words)]
    islands = [[{"reference": k == 1, "start": 0, "end": 9, "text": t} for k, t in enumerate((h, " ".join(words)))] for h in sides]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reference", pa.bool_()), ("text", pa.string())]))
    edits, shifts, size = E.island_edits(pa.array(islands, kind))
    assert (edits[0], shifts[0]) == (78, 0) and edits[2] == 0 and set(size) == {701}
    assert E.together(*(np.array([ord(c) for c in t]) for t in ("abcd", "abxd"))) == 1
    assert edits[1] + shifts[1] <= 8


def test_sides_in_order_need_no_distances(monkeypatch):
    """Where one side's words stand in the other in order, the bags of words tell the edits: no table of distances is filled."""
    r = random.Random(8)
    pick = lambda n: [r.choice("abcdef") for _ in range(n)]
    texts, sure = [], 0
    for _ in range(600):
        words = pick(r.randint(0, 9))
        fewer = [w for w in words if r.random() < 0.8] if r.random() < 0.7 else pick(5)
        cut = [r.randint(0, len(w)) if r.random() < 0.4 else 0 for w in (fewer, words)]
        texts.append([" ".join(w[:c]) + "\n" + " ".join(w[c:]) for w, c in zip((fewer, words), cut, strict=True)][:: r.choice([1, -1])])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reference", pa.bool_()), ("text", pa.string())]))
    islands = pa.array([[{"reference": k == 1, "start": 0, "end": 9, "text": t} for k, t in enumerate(pair)] for pair in texts], kind)
    seen, true = [], E.distances
    monkeypatch.setattr(E, "distances", lambda h, *more, **named: seen.append(h.shape[1]) or true(h, *more, **named))
    found = E.island_edits(islands)
    sure = 600 - sum(seen)
    monkeypatch.setattr(E, "embedded", lambda h, *more: np.full(len(h), E.FAR))
    assert all((x == y).all() for x, y in zip(found, E.island_edits(islands), strict=True)) and 150 < sure < 600


def test_texts_that_hold_the_marks_of_breaks(spark):
    both = [spark.createDataFrame([(1, 1, 0, 900, t)], CUES) for t in ("a\x01 \x02b c", "a b c")]
    assert [(r.edits, r.shifts, r.ref_tokens) for r in E.subtitle_edit_rate(*both).collect()] == [(0, 0, 4)]
