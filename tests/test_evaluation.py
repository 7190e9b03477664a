"""Pairs by place and by time, all metrics, merges and single translations by scripted services, against plain loops."""

import json
import random
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from cueloom.operators import evaluation, inference
from cueloom.operators import quality as Q

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests' folder
CUES = "video_id long, idx int, start_ms long, end_ms long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, CUES).withColumns({"hypothesis": F.lit("clash"), "k": F.lit(1), "at": F.lit(2), "v": F.lit(3)})


def timed(r, video, n):
    out, t = [], r.randint(0, 300)
    for k in range(1, n + 1):
        length = r.randint(0, 3000)
        out.append((video, k, t, t + length, r.choice([None, "", " ".join(f"w{r.randrange(50)}" for _ in range(r.randint(1, 9)))])))
        t += r.randint(1, 2500)
    return out


def dealt(hyp, ref):
    """Each word to the last cue that has begun in its middle, else the first."""
    words, out = [], {(v, i): [t or "", []] for v, i, _, _, t in ref}
    for v, i, a, b, t in hyp:
        w = (t or "").split()
        for k, word in enumerate(w):
            at = (2 * len(w) * a + (b - a) * (2 * k + 1)) // (2 * len(w))
            begun = [(s, j) for u, j, s, _, _ in ref if u == v and s <= at]
            mine = [(s, j) for u, j, s, _, _ in ref if u == v]
            cue = max(begun)[1] if begun else min(mine)[1] if mine else None
            words.append((v, -1 if cue is None else cue, at, i, k, word))
    for v, c, _, _, _, word in sorted(words):
        out.setdefault((v, None if c < 0 else c), ["", []])[1].append(word)
    return sorted((v, c or 0, " ".join(w), t) for (v, c), (t, w) in out.items())


def test_words_by_time(spark):
    r = random.Random(4)
    ref = [x for v in (1, 2) for x in timed(r, v, 30)] + [(4, 1, 0, 10, "alone")]
    hyp = [x for v in (1, 2) for x in timed(r, v, 25)] + [(3, 1, 0, 100, "no reference"), (1, 99, -900, -100, "before all"), (2, 98, 10**7, 10**7 + 5, "after all")]
    lost = [(None, 1, 0, 10, "x"), (1, None, 0, 10, "x"), (1, 200, None, 10, "x")]
    got = sorted((x.video_id, x.idx or 0, x.hypothesis, x.reference) for x in evaluation.retimed(table(spark, hyp + lost + [(1, 201, 5, None, "x")]), table(spark, ref + lost)).collect())
    assert got == dealt(hyp, ref)
    assert evaluation.retimed(table(spark, []), table(spark, [])).count() == 0


def test_all_metrics(spark):
    ref = table(spark, [(1, 1, 0, 1000, "the cat sat on the mat"), (1, 2, 1000, 2000, "and then it slept"), (2, 1, 0, 900, "a good dog ran home")])
    same = evaluation.evaluate(ref, ref).first()
    assert (same.suber, same.wer, same.ter, same.bleu, same.chrf) == (0.0, 0.0, 0.0, 100.0, 100.0)
    whole = table(spark, [(1, 1, 0, 2000, "the cat sat on the mat and then it slept"), (2, 1, 0, 900, "a good dog ran home")])
    cut = evaluation.evaluate(whole, ref, by_time=True).first()
    by_place = evaluation.evaluate(whole, ref).first()
    assert cut.wer < by_place.wer and cut.bleu > by_place.bleu and cut.suber == by_place.suber == round(1 / 18, 6)
    hyp = table(spark, [(1, 1, 0, 1000, "the dog sat on the mat"), (2, 1, 0, 900, "ran home a good dog")])
    got = evaluation.evaluate(hyp, ref).first()
    pairs = evaluation.paired(hyp, ref).withColumn("all", F.lit(0))
    assert (got.wer, got.ter) == (Q.wer(pairs, "all").first().wer, Q.ter(pairs, "all").first().ter) and got.wer == round((1 + 4 + 4) / 15, 6)
    assert got.suber == round((1 + 5 + 1) / 18, 6)  # a word, a cue that is missing with its break, a shift
    zh = [table(spark, [(1, 1, 0, 900, t)]) for t in ("天气好", "天气很好")]
    assert evaluation.evaluate(*zh, language="zh").first().wer == 0.25 and evaluation.evaluate(*zh).first().wer == 1.0
    none = evaluation.evaluate(table(spark, []), table(spark, [])).first()
    assert (none.suber, none.wer, none.ter) == (0.0, 0.0, 0.0)


def test_merges_by_a_model(spark):
    def client():
        def ask(prompt):
            items = json.loads(prompt.split("\n\n", 1)[1])
            if any("fail" in x["text"] for x in items):
                raise OSError("down")
            if any("prose" in x["text"] for x in items):
                return "none of them"
            return json.dumps([[a["i"], b["i"]] for a, b in zip(items, items[1:], strict=False) if a["text"].endswith("+")] + [[1, 9], ["x"]][:1])

        return ask

    r = random.Random(3)
    rows = [(1, k, k * 10, k * 10 + 9, f"c{k}" + r.choice(["", "+"])) for k in range(1, 70)] + [(2, 1, 0, 5, "a+"), (2, 2, 5, 9, "prose")] + [(3, 1, 0, 5, "only+")] + [(4, 1, 0, 5, "a+"), (4, 3, 5, 9, "gap"), (4, 4, 9, 12, None)]
    got = {}
    for x in inference.merge_by_model(spark.createDataFrame(rows, CUES).fillna("", ["text"]), client).orderBy("video_id", "idx").collect():
        got.setdefault(x.video_id, []).append((x.start_ms, x.end_ms, x.text))
    wanted = []
    for _, _, a, b, t in rows[:69]:
        if wanted and wanted[-1][2].endswith("+"):
            wanted[-1] = (wanted[-1][0], b, f"{wanted[-1][2]} {t}")
        else:
            wanted.append((a, b, t))
    assert got[1] == wanted and [t for _, _, t in got[2]] == ["a+", "prose"] and got[3] == [(0, 5, "only+")] and len(got[4]) == 3


def test_texts_one_by_one(spark):
    calls = spark.sparkContext.accumulator(0)

    def client():
        def ask(text):
            calls.add(1)
            if text == "bad":
                raise ValueError("never")
            return text.upper()

        return ask

    rows = [(1, k, 0, 1, t) for k, t in enumerate(["a", "b", "a", "bad", "", None, " ", "a"])]
    got = [(x.target, x.error) for x in inference.translate_each(table(spark, rows).withColumn("target", F.lit("old")), client).orderBy("idx").collect()]
    assert got == [("A", None), ("B", None), ("A", None), (None, "ValueError: never"), ("", None), ("", None), (" ", None), ("A", None)] and calls.value == 3


def test_long_texts_are_measured_by_errors():
    from cueloom.operators import quality as Q

    words = [f"w{k % 977}" for k in range(20_000)]
    begin = time.process_time()
    assert Q.shifted_distance(words[2:] + words[:2], words, 10, 50) == 4
    assert time.process_time() - begin < 1  # a step a word took over a second


def test_first_arrays():
    from cueloom.operators import answers as A

    assert A.first_array('a ["x]\\"", [1]] ["y"]') == '["x]\\"", [1]]' and A.first_array('"[1]') == "[1]" and A.first_array('["a]') is A.first_array("] [") is None
    long = '["' + "word " * 200_000 + '"]'
    begin = time.process_time()
    assert A.first_array("see [x and " + long) is None and A.first_array(long) == long
    assert time.process_time() - begin < 0.08  # a step a character took longer


def test_grams_of_many_pairs(spark):
    from cueloom.operators import quality as Q

    rows = [(f"some words of line {k} {k * k}", f"some other words of line {k % 7} {k}") for k in range(700)]
    df = spark.createDataFrame(rows, "hypothesis string, reference string").coalesce(1)
    one = Q.gram_totals(*[__import__("pyarrow").array([r[c].replace(" ", "") for r in rows]) for c in (0, 1)], 6, False)
    names = [f"{x}{n}" for n in range(1, 7) for x in "mhr"]
    bare = [F.replace(c, F.lit(" "), F.lit("")) for c in ("hypothesis", "reference")]
    assert [Q._sums(df, *bare, 6, False).first()[n] for n in names] == one and Q.COUNTED_PAIRS < len(rows)


def test_near_texts_are_shifted_by_their_errors(spark, monkeypatch):
    """Shifts of texts with few errors are those of ``best_shift``, found without measuring every block."""
    r = random.Random(5)
    for _ in range(300):
        b = [f"w{r.randrange(r.choice([3, 9, 90]))}" for _ in range(r.choice([6, 20, 70]))]
        a, i, k = list(b), r.randrange(len(b)), r.randrange(len(b))
        a = Q._moved(a, i, k, r.randint(1, 3))
        a[k] = r.choice([a[k], "new"])
        for longest, farthest in ((10, 50), (2, 4)):
            x, y = Q._letters(a, b)
            if 2 < (now := Q.word_distance(a, b)) <= Q.NEAR:
                assert (Q._near_shift(x, y, now, -1, longest, farthest) or None) == Q.best_shift(x, y, now, -1, longest, farthest), (a, b)
            assert Q.shifted_distance(a, b, longest, farthest) == Q._shifted(tuple(a), tuple(b), longest, farthest)
    lines = [[f"w{r.randrange(400)}" for _ in range(n)] for n in range(20, 120)]
    begin = time.process_time()
    assert [Q.shifted_distance(line[2:] + line[:2], line, 10, 50) for line in lines] == [1 if len(line) <= 52 else 4 for line in lines]
    assert time.process_time() - begin < 0.1  # every block took 0.25 s and more

    monkeypatch.setattr(Q, "SURROGATES", Q.sys.maxunicode - 5)  # six letters at once
    rows = [("v", " ".join(line[2:] + line[:2]), " ".join(line)) for line in lines] + [("v", None, "a b"), ("v", "a b", "a b"), ("v", "", " ")]
    sides = [__import__("pyarrow").array([x[c] for x in rows]) for c in (1, 2)]
    assert [Q._shifted(x, y, 10, 50) for x, y in Q._lettered(*sides)] == [*(1 if len(line) <= 52 else 4 for line in lines), 2, 0, 0]
    got = Q.ter(spark.createDataFrame(rows, "video_id string, hypothesis string, reference string")).first()
    assert (got.edits, got.ref_words) == (sum(1 if len(line) <= 52 else 4 for line in lines) + 2, sum(map(len, lines)) + 4)
