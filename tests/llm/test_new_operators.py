"""Prefix tries, language mixtures and hard negatives against brute force, with null, empty, long, equal and extra rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import words

from cueloom.llm import conversations, language, negatives

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows, branch=True):
    """Conversations as lists of (role, text, words), by id."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32], r, x))
    own = {c: [v[3:] for v in sorted(turns)] for c, turns in own.items()}
    if not branch:
        return own
    start = lambda c: own.get(c - int(math.fmod(c, 20)), [])[: zlib.crc32(str(c).encode()) % 4]
    return {c: start(c) + turns[zlib.crc32(str(c).encode()) % 4 :] for c, turns in own.items()}


def trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    size = lambda p: len([w for w in p[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if p else 0
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * size(p)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def turns_of(seed, n=150):
    r = random.Random(seed)
    texts = ["a", "a b", "", None, "x\ty z", words(r, 300)]
    rows = [(c, t, r.choice(["user", None]), r.choice(texts)) for c in range(-3, n) if c % 7 for t in range(r.randint(0, 5))]
    rows += [(1000 + k, t, "user", "hot") for k in range(90) for t in range(3)]  # copies, over several shards
    rows += [(2000, t, "user", f"t{t}") for t in range(400)] + [(2001, t, "user", f"t{t}") for t in range(380)]
    return rows + rows[:9] + [(None, 1, "user", "a"), (5, None, "user", "first"), (2020, 1, "user", "one"), (2022, 1, None, None)]


@pytest.mark.parametrize("shard", [1 << 19, 40, 3])
def test_prefix_trie(spark, monkeypatch, shard):
    monkeypatch.setattr(conversations, "SHARD", shard)
    monkeypatch.setattr(conversations, "PIECE", 7)
    rows = turns_of(shard)
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("clash"), "words": F.lit(1), "part": F.lit(2)})
    convs = conversations.conversations(df)
    assert nodes(conversations.prefix_trie(convs)) == trie(rebuilt(rows, False))
    found = conversations.prefix_trie(conversations.branched(convs))
    assert nodes(found) == trie(rebuilt(rows))
    named = conversations.with_turns(found, df)
    assert named.count() == found.count() and named.filter("depth = 0").first().text is None
    last = {(c, d): turns[d - 1] for c, turns in rebuilt(rows).items() for d in range(1, len(turns) + 1)}
    assert all((r.role, r.text) == last[r.conv_id, r.depth] for r in named.filter("depth > 0").collect())


def test_prefix_trie_without_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.prefix_trie(conversations.branched(conversations.conversations(empty))).count() == 0
    alone = spark.createDataFrame([(c, 0, "user", "x") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20], TURNS)
    got = conversations.prefix_trie(conversations.branched(conversations.conversations(alone))).collect()
    assert [(r.depth, r.n_convs, r.n_leaves, r.turn_digest) for r in got] == [(0, alone.count(), 1, None)]


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, la, x in whole:
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, lab) for i, lab, y in whole if i != a and len(y) == len(x)]
        for p, pid, _ in sorted(s for s in scored if s[2] == la)[:5]:
            fit = sorted(s for s in scored if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(a, pid, k, n[1], -p, -n[0]) for k, n in enumerate(fit, 1)]
    return sorted(out)


def vector_rows(n=700, width=12):
    r = np.random.default_rng(9)
    centre = r.standard_normal((6, width))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 6] + r.standard_normal(width) * [0.05, 0.6][i % 2]], int(r.integers(0, 3 if i % 3 else 10))) for i in range(n)]
    same = rows[100][1]
    rows += [(n + k, same, 1 + k % 2) for k in range(60)]  # ties
    rows += [(n + 100, None, 1), (n + 101, [1.0] * (width - 1) + [None], 1), (n + 102, [float("nan")] * width, 2), (n + 103, same, None), (None, same, 1), (n + 104, [float("inf")] * width, 2)]
    rows += [(n + 110, [0.0] * width, 1), (1050, [0.0] * width, 2), (1100, [1.0, 2.0, 3.0], 1), (1101, [1.0, 2.0, 2.5], 1), (1102, [1.0, 1.0, 1.0], 2), (1150, [], 1), (1151, [], 1), (1152, [], 3)]
    return rows + [(1200, [300.0] * width, 1), (1201, [299.0] * width, 1), (1202, [200.0] * width, 2), (1250, [1e6] * width, 1), (1251, [9e5] * width, 1), (1252, [7e5] * width, 3)]


def ours(found):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def label():
    return F.expr("if(vec_id % 7 = 0, (cast(label as long) + 1) % 10, label)")



@pytest.mark.parametrize(("anchors", "window"), [(1 << 14, 256), (7, 5)])
def test_hard_negatives(spark, monkeypatch, anchors, window):
    for name, value in {"ANCHORS": anchors, "WINDOW": window, "GATHERED": 400, "SEEDS": 4}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"angle": F.lit("clash"), "score": F.lit(1), "number": F.lit(2)})
    wanted = brute_negatives(rows)
    assert wanted and ours(negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label())) == wanted


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label()).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1)], VECTORS)
    assert negatives.hard_negatives(one, F.col("vec_id") % 50 == 0, label()).count() == 0
    again = vector_rows(200) * 2  # each row twice: the copy of an anchor is none of its other rows
    got = ours(negatives.hard_negatives(spark.createDataFrame(again, VECTORS), F.col("vec_id") % 50 == 0, label()))
    assert got == brute_negatives(again)


def test_score_bounds_hold():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.standard_normal((40, 8)) * 0.2)
    side_vectors = np.floor(256 * r.standard_normal((30, 8)))
    refs = negatives.directions(x, 8)
    angle = lambda v: np.arccos(np.clip((v / np.linalg.norm(v, axis=1, keepdims=True)) @ refs.T, -1, 1)).astype("<f4").astype(float)
    side = negatives.Wanted(None, None, None, side_vectors, np.linalg.norm(side_vectors, axis=1), angle(side_vectors), None, None)
    for rows in np.array_split(x[np.argsort(angle(x)[:, 0])], 8):
        least, most = negatives.score_bounds(side, np.linalg.norm(rows, axis=1), angle(rows))
        scores = side_vectors @ rows.T
        assert (scores.min(axis=1) >= least).all() and (scores.max(axis=1) <= most).all() and (most < np.inf).all()


def test_products_are_exact():
    a = np.array([[2.0**40, 1, -3], [5, 6, 7]])
    assert negatives.products(a, a, 3 * 2.0**80).tolist() == [[negatives.MOST, 5 * 2**40 + 6 - 21], [5 * 2**40 + 6 - 21, 110]]
    b = np.array([[2.0**26, 1.0], [1.0, 2.0**26]])
    assert negatives.products(b, b, 2.0**53).tolist() == [[2**52 + 1, 2**27], [2**27, 2**52 + 1]]


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["strü", "gen", "ach"], "cc": ["ço", "ão", "lhe"]}


def tongue(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))).capitalize() for _ in range(n))


def test_languages(spark):
    r = random.Random(6)
    rows = [(i, tongue(r, lang, r.randint(5, 80)), lang) for i in range(300) for lang in [r.choice(list(SYLLABLES))]]
    rows += [(300, tongue(r, "aa", 60) + " " + tongue(r, "cc", 30), "aa"), (301, tongue(r, "bb", 200_000), "bb"), (302, None, "aa"), (303, " 12 ☃ \n", "bb"), (304, "", None), (None, "kalo", "aa"), (305, "kalo", None)]
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"row": F.lit("x"), "score": F.lit("y"), "language": F.lit(1), "body": F.lit(2)})
    model = language.fit(df)
    assert model.names == ["aa", "bb", "cc"]
    got = [r for r in language.identify(df, model).collect()]
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang and by[i].score > 0.9 for i, _, lang in rows[:300])
    assert [(x.lang, round(x.share, 1)) for x in by[300].languages] == [("aa", 0.7), ("cc", 0.3)] and by[301].lang_pred == "bb"
    assert [(by[i].lang_pred, by[i].score, by[i].languages) for i in (302, 303, 304)] == [("und", 0.0, [])] * 3
    assert by[None].lang_pred == by[305].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    few = language.fit(df, sample=30)
    assert sum(x.lang_pred == lang for x, lang in zip(language.identify(df.limit(300).orderBy("doc_id"), few).orderBy("doc_id").collect(), [x[2] for x in sorted(rows[:300])], strict=False)) > 290


def test_languages_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.names == [] and language.identify(df, model).count() == 0
    one = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(one, language.fit(one)).collect()] == [("und", 0.0)]


def test_likelihoods_are_probabilities():
    """Over all words the probabilities of a model add up to no more than 1, and nearly to 1."""
    import pyarrow as pa

    texts = pa.array(["ab ba aab b"])
    _, found = next(language.bags(texts))
    counts = [np.zeros((n, 1), np.float32) for n in language.SIZES]
    sizes = np.diff(found.ends, prepend=0)
    for held, slots in zip(counts, language.ngrams(found.data, found.ends), strict=True):
        held[:, 0] += np.bincount(slots, np.repeat(found.count, sizes), len(held))
    model = language.Model(["x"], counts, counts[0].sum(axis=0) - counts[0][language.START])
    every = [w for n in range(1, 7) for w in map("".join, __import__("itertools").product("ab", repeat=n))]
    _, all_words = next(language.bags(pa.array([" ".join(every)])))
    total = np.exp(language.likelihoods(all_words, model)).sum()
    assert 0.5 < total <= 1.0001


def test_mixture_by_brute_force():
    r = np.random.default_rng(5)
    p, count = r.random((30, 2)), r.integers(1, 5, 30).astype(float)
    text = np.repeat([0, 1], [12, 18])
    shares, likely = language.mixture(p, count, text, np.full((2, 2), 0.5))
    grid = np.linspace(1e-6, 1 - 1e-6, 4001)
    for t in (0, 1):
        of = text == t
        sums = (count[of][:, None] * np.log(p[of, :1] * grid + p[of, 1:] * (1 - grid))).sum(axis=0)
        assert abs(sums.max() - likely[t]) < 0.02 and abs(shares[t].sum() - 1) < 1e-9
