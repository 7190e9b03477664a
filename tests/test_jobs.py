"""Translation jobs, processing and batches against plain loops over a scripted model."""

import json
import re
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cueloom import storage
from cueloom.operators import memory as M
from cueloom.operators import runs
from cueloom.operators import translation as W
from cueloom.operators.ordering import numbered
from cueloom.storage import new_path, shared_dir
from cueloom.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests' folder
CUES = "video_id string, idx int, start_ms long, end_ms long, text string"


def cues_of(spark, texts, extra=True):
    rows = [(v, k * 2, k * 1000, k * 1000 + 900, t) for v, lines in texts.items() for k, t in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, CUES)
    return df.withColumns({"target": F.lit("clash"), "batch_id": F.lit(1), "wave": F.lit(2), "terms": F.lit("x")}) if extra else df


def shouting():
    """Upper case, with the last text of the context it was shown; fails on texts that say so."""
    tries = {}

    def ask(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        seen = re.findall(r'^- "(.*)" → ', prompt[prompt.find(M.CONTEXT_HEAD) :], re.M) if M.CONTEXT_HEAD in prompt else []
        if prompt.startswith("Translate the "):
            items = json.loads(prompt[prompt.rindex("\n\n[{") + 2 :])
            said = " ".join(x["text"] for x in items)
            if "busy" in said and tries[prompt] < 3:
                raise OSError("try again")
            if "broken" in said:
                return '["too", "few"' if tries[prompt] < 3 else "[]"
            if "down" in said:
                raise RuntimeError("down")
            known = "+M" if M.MEMORY_HEAD in prompt else ""
            known += "+G" if M.GLOSSARY_HEAD in prompt else ""
            return json.dumps([f"{x['text'].upper()}<{seen[-1] if seen else ''}>{known}" for x in items])
        if prompt.startswith("Translate this "):
            text = prompt.rsplit("\n\n", 1)[1]
            if "lost" in text or "down" in text:
                raise OSError("lost")
            return f'"{text} alone"' if "mute" not in text else '""'
        if prompt.startswith("List "):
            lines = prompt.split("\n\n", 1)[1].split("\n")
            return json.dumps([{"term": t, "action": "keep"} for t in lines[0].split()[:1]]) if "noterms" not in lines[0] else "none"
        if prompt.startswith("Rate "):
            return json.dumps([{"i": x["i"], "score": 40 if "poor" in x["src"] else 95} for x in json.loads(prompt.split("\n\n", 1)[1])])
        return '"improved"' if "poor one" in prompt else ""

    return ask


def no_wait(seconds):
    pass


def expected(lines, settings):
    """(target, origin) of a video's lines by a loop over its batches."""
    pairs, out, n = [], [], settings.batch
    for wave in waves(-(-len(lines) // n), settings):
        last, found = (pairs[-1][0] if pairs else ""), []
        for b in wave:
            batch = lines[b * n : (b + 1) * n]
            said = " ".join(batch)
            if "broken" in said or "down" in said:
                for t in batch:
                    found.append((t, t, "source") if "lost" in t or "down" in t else (t, "", "cue") if "mute" in t else (t, f"{t} alone", "cue"))
            else:
                found += [(t, f"{t.upper()}<{last}>", "batch") for t in batch]
        pairs += [(t, x) for t, x, _ in found if x]
        out += [f[1:] for f in found]
    return out


def waves(batches, settings):
    if settings.chained:
        return [[b] for b in range(batches)]
    first = [[b] for b in range(min(3, batches))]
    return first + [list(range(b, min(b + settings.threads, batches))) for b in range(3, batches, settings.threads)]


TEXTS = {
    "a": [f"line {k} of a" for k in range(40)],
    "b": ["busy one", "and two"] + [f"b {k}" for k in range(12)],
    "c": ["c starts", "is broken", "lost here", "mute now", "fine"] + [f"c {k}" for k in range(9)],
    "d": ["down"] * 3,
    "e": ["x" * 3000, "", "z"],
}


@pytest.mark.parametrize("settings", [W.Settings(terms=False, scoring=False), W.Settings(terms=False, scoring=False, chained=False, threads=2, batch=3), W.Settings(terms=False, scoring=False, tasks=1)])
def test_batches_in_order(spark, settings):
    got = W.translate(cues_of(spark, TEXTS), shouting, settings=settings, sleep=no_wait).cues.orderBy("video_id", "idx").collect()
    for v, lines in TEXTS.items():
        mine = [r for r in got if r.video_id == v]
        assert [r.idx for r in mine] == [*range(1, len(lines) + 1)]
        assert [(r.target, r.origin) for r in mine] == expected(lines, settings), v
    assert {r.score for r in got} == {-1.0}


def test_scores_and_stores(spark):
    texts = {"a": ["poor one here", "a poor thing this", "good words are here", "two words"], "b": ["noterms at all here", "a poor thing this"]}
    memory = spark.createDataFrame([(7, "good words are here", "OLD", 99.0)], W.MEMORY)
    glossary = spark.createDataFrame([(3, "old", "translate", "vieux", "")], W.GLOSSARY)
    done = W.translate(cues_of(spark, texts), shouting, memory, glossary, W.Settings(batch=2), sleep=no_wait)
    got = {(r.video_id, r.idx): (r.target, r.score, r.failed) for r in done.cues.collect()}
    assert got["a", 1] == ("improved", 40.0, False) and got["a", 2][0] == "A POOR THING THIS<>+M+G"
    assert got["a", 3] == ("GOOD WORDS ARE HERE<a poor thing this>+M+G", 95.0, False)
    held = {r.source: (r.seq, r.target, r.score) for r in done.memory().collect()}
    assert held["good words are here"] == (7, got["a", 3][0], 99.0)
    assert held["a poor thing this"][1:] == (got["b", 2][0], 40.0) and "two words" not in held and len(held) == 4
    assert [(r.term, r.action) for r in done.glossary().orderBy("seq").collect()] == [("old", "translate"), ("poor", "keep")]


def test_without_cues(spark):
    none = W.translate(cues_of(spark, {}), shouting, settings=W.Settings(), sleep=no_wait)
    assert none.cues.count() == none.memory().count() == none.glossary().count() == 0
    nulls = spark.createDataFrame([(None, 1, 0, 10, "x"), ("v", 1, None, None, None), ("v", 2, 0, 10, "ok")], CUES)
    got = W.translate(nulls, shouting, settings=W.Settings(terms=False, scoring=False), sleep=no_wait).cues.orderBy("idx").collect()
    assert [(r.text, r.target) for r in got] == [("", "<>"), ("ok", "OK<>")]


def test_answers_are_read():
    assert W.read_strings('["a", "b"]', 2) == ["a", "b"] and W.read_strings('["a", 1]', 2) is None and W.read_strings('["a"]', 2) is None
    assert W.read_strings('So:\n```json\n["a"]\n```', 1) == ["a"] and W.read_strings('I say ["[a]"] and [b]', 1) == ["[a]"] and W.read_strings("", 0) is None


def test_scores_and_terms_are_read():
    assert W.read_scores('[{"i": 1, "score": 90}, {"i": 0, "score": 1}, {"i": 2}, {"i": 1, "score": 5}, {"i": 3, "score": 7.5}]') == {1: 90.0, 3: 7.5}
    assert W.read_scores('see [{"i": 2, "score": 1}] and') == {2: 1.0} and W.read_scores('```\nnone\n``` [{"i": 2, "score": 1}]') == {} and W.read_scores("no") == {}
    assert W.read_terms('```json\n[{"term": "a", "action": "keep"}]\n```') == [("a", "keep", "", "")] and W.read_terms('[{"term": "a"}]') == [] and W.read_terms("") == []


def payloads(spark, texts):
    made = lambda lines: json.dumps({"utterances": [{"transcript": t, "start_time": k * 1000, "end_time": k * 1000 + 900} for k, t in enumerate(lines)]})
    return spark.createDataFrame([(v, made(lines)) for v, lines in texts.items()], "path string, payload string")


def calls_of(spark):
    """A client that counts the batches it translates, over all tasks."""
    counter = spark.sparkContext.accumulator(0)

    def client():
        inner = shouting()

        def ask(prompt):
            if prompt.startswith("Translate the "):
                counter.add(1)
            return inner(prompt)

        return ask

    return client, counter


SILENT = W.Settings(terms=False, scoring=False)


def test_steps_are_kept(spark):
    store, (client, counter) = runs.StepStore(spark, new_path(spark, "steps")), calls_of(spark)
    texts = {"v1": ["one of the", "rest", "two"], "v2": ["three"], "v3": [" "], "v4": ["three"]}
    rows = payloads(spark, texts).withColumnRenamed("path", "video_id").withColumns({"step": F.lit("clash"), "value": F.lit(1), "hit": F.lit(2)})
    first = {r.video_id: r for r in runs.process(rows, "utterances", client, store, SILENT, sleep=no_wait).items.collect()}
    assert first["v1"].srt == "1\n00:00:00,000 --> 00:00:01,900\none of the rest\n\n2\n00:00:02,000 --> 00:00:02,900\ntwo\n"
    assert "ONE OF THE REST<>\none of the rest" in first["v1"].translated and first["v3"].translated is None
    assert not any(r.transcribed_hit or r.translated_hit for r in first.values()) and first["v2"].translated == first["v4"].translated
    asked = counter.value
    assert asked == 2  # v2 and v4 are the same
    again = {r.video_id: r for r in runs.process(rows, "utterances", client, store, SILENT, sleep=no_wait).items.collect()}
    assert counter.value == asked and {v: (r.transcribed_hit, r.translated_hit) for v, r in again.items()} == {"v1": (True, True), "v2": (True, True), "v3": (False, None), "v4": (True, True)}
    assert {v: r.translated for v, r in again.items()} == {v: r.translated for v, r in first.items()}
    other = W.Settings(terms=False, scoring=False, layout="target-only")
    changed = {r.video_id: r for r in runs.process(rows, "utterances", client, store, other, sleep=no_wait).items.collect()}
    assert changed["v2"].transcribed_hit and not changed["v2"].translated_hit and changed["v2"].translated.endswith("\nTHREE<>\n")


def test_payloads_are_made_once(spark):
    """A run evaluates what makes its payloads once for each row, and its result not again when that is read."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    given = payloads(spark, {"v1": ["one"], "v2": ["two"], "v3": [" "]}).withColumnRenamed("path", "video_id")
    rows = given.mapInArrow(counted, given.schema)
    items = runs.process(rows, "utterances", shouting, runs.StepStore(spark, new_path(spark, "steps")), SILENT, sleep=no_wait).items
    assert len(items.collect()) == len(items.collect()) == 3 and made.value == 3
    assert "FileScan" not in items._jdf.queryExecution().optimizedPlan().toString() and "Join" not in items._jdf.queryExecution().optimizedPlan().toString()


def test_runs_go_by_slices(spark, monkeypatch):
    """Slices give what the whole gives; what a run leaves are its items and the store, and its shuffle files go."""
    folder = Path(shared_dir(spark).removeprefix("file://"))
    texts = {f"v{k}": [f"line {k % 7}", "two", *["more"] * (k % 3)] for k in range(20)} | {"w": [" "]}
    rows = payloads(spark, texts).withColumnRenamed("path", "video_id")
    changed = payloads(spark, texts | {"v3": ["new"], "v4": ["new"], "v5": [" "]}).withColumnRenamed("path", "video_id")

    def twice(**more):
        store, before = runs.StepStore(spark, new_path(spark, "steps")), {*folder.iterdir()}
        done = [runs.process(x, "utterances", shouting, store, SILENT, sleep=no_wait, **more) for x in (rows, changed)]
        left = sorted(p.name.split("-")[0] for p in {*folder.iterdir()} - before)
        return [sorted(map(tuple, d.items.collect()), key=str) for d in done], left, done[1].translation

    whole, left, translation = twice()
    assert left == ["processed", "processed", "steps", "translated", "translated"] and [r.target for r in translation.cues.collect()] == ["NEW<>"]
    assert whole[1][0][2] and not any(r[2] for r in whole[0]) and {r[0] for r in whole[1] if r[4] is False} == {"v3", "v4"}
    monkeypatch.setattr(storage, "SLICE_BYTES", 1)
    monkeypatch.setattr(storage, "SLICES", 2)
    assert twice(details=False, keep=lambda items: items.filter("video_id <> ''")) == (whole, ["processed", "processed", "steps"], None)
    sliced = runs.process(rows, "utterances", shouting, runs.StepStore(spark, new_path(spark, "steps")), SILENT, sleep=no_wait).translation
    assert {r.video_id for r in sliced.cues.collect()} == {f"v{k}" for k in range(20)}


def test_lost_runs_leave_earlier_steps(spark):
    store = runs.StepStore(spark, new_path(spark, "steps"))
    rows = payloads(spark, {"v1": ["one"], "v2": ["two"]}).withColumnRenamed("path", "video_id")
    runs.process(rows.filter("video_id = 'v1'"), "utterances", shouting, store, SILENT, sleep=no_wait).items.collect()

    def broken():
        raise RuntimeError("no client")

    with pytest.raises(Exception, match="no client"):
        runs.process(rows, "utterances", broken, store, SILENT, sleep=no_wait).items.collect()
    got = {r.video_id: (r.transcribed_hit, r.translated_hit) for r in runs.process(rows, "utterances", shouting, store, SILENT, sleep=no_wait).items.collect()}
    assert got == {"v1": (True, True), "v2": (True, False)}


def test_stream_goes_on(spark):
    """Files that arrive later are translated with the memory of the earlier ones; a batch that runs again asks for nothing."""
    base = new_path(spark, "stream")
    settings = W.Settings(terms=False, scoring=False)
    client, counter = calls_of(spark)
    srt = lambda *lines: "\n\n".join(f"{k}\n00:00:0{k},000 --> 00:00:0{k},900\n{t}" for k, t in enumerate(lines, 1))
    schema = "video_id string, text string"

    def run(table=f"{base}/memory", out=f"{base}/cues", checkpoint=f"{base}/checkpoint"):
        stream = spark.readStream.schema(schema).parquet(f"{base}/srt")
        incremental.translate_subtitles(stream, client, out, checkpoint, incremental.MemoryTable(spark, table), settings, no_wait).awaitTermination()
        rows = {(r.video_id, r.idx): r.target for r in spark.read.parquet(out).collect()}
        return rows, {r.source: r.target for r in incremental.MemoryTable(spark, table).read().collect()}

    spark.createDataFrame([("v1", srt("one two three", "short"))], schema).write.mode("append").parquet(f"{base}/srt")
    assert run() == ({("v1", 1): "ONE TWO THREE<>", ("v1", 2): "SHORT<>"}, {"one two three": "ONE TWO THREE<>"})
    spark.createDataFrame([("v2", srt("one two three four"))], schema).write.mode("append").parquet(f"{base}/srt")
    rows, held = run()
    assert rows["v2", 1] == "ONE TWO THREE FOUR<>+M" and len(rows) == 3 and set(held) == {"one two three", "one two three four"} and counter.value == 2
    again = run(checkpoint=f"{base}/checkpoint")  # nothing new
    assert again == (rows, held) and counter.value == 2
    rerun = run(checkpoint=f"{base}/other")  # its first batch finds the cues of batch 0 there, and takes them
    assert rerun[0] == rows and counter.value == 2


def test_stream_goes_by_slices(spark, monkeypatch):
    """Slices of a batch give what the whole gives, lines of the memory in order; a batch that was not written whole is done again, and only results stay."""
    monkeypatch.setattr(storage, "SLICE_BYTES", 1)
    monkeypatch.setattr(storage, "SLICES", 2)
    base, folder = new_path(spark, "stream"), Path(shared_dir(spark).removeprefix("file://"))
    texts = {f"v{k}": "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\none two three {w}" for i, w in enumerate("abc"[: 1 + k % 3], 1)) for k in range(9)}
    known = spark.createDataFrame([(k, f"one two three {w}", f"<{w}>", 80.0) for k, w in enumerate("xcab", 1)], W.MEMORY)
    memory = incremental.MemoryTable(spark, f"{base}/memory")
    memory.upsert(known, 0, "given")
    spark.createDataFrame(list(texts.items()), "video_id string, text string").write.parquet(f"{base}/srt")
    storage.write(spark.createDataFrame([("lost", 1)], "video_id string, idx int"), f"{base}/cues/batch=0", whole=False)

    def telling():
        return lambda prompt: json.dumps([" ".join(re.findall(r"→ \"<(.)>\"", prompt))] * len(json.loads(prompt[prompt.rindex("\n\n[{") + 2 :])))

    before = {*folder.iterdir()}
    stream = spark.readStream.schema("video_id string, text string").parquet(f"{base}/srt")
    incremental.translate_subtitles(stream, telling, f"{base}/cues", f"{base}/checkpoint", memory, SILENT, no_wait).awaitTermination()
    assert {p for p in {*folder.iterdir()} - before if not re.fullmatch("[0-9a-f-]{36}", p.name)} == set()  # Spark's own checkpoints have such names
    got = {(r.video_id, r.idx): r.target for r in spark.read.parquet(f"{base}/cues").collect()}
    assert got == {(f"v{k}", i): ["a x", "a x b", "a x b c"][k % 3] for k in range(9) for i in range(1, 2 + k % 3)}


def test_memories_take_only_what_they_hold(spark):
    """Rows of other sources than those that a memory has or will take are left out, and it is the same as with all of them."""
    import random

    some, base = random.Random(8), new_path(spark, "held")
    held, whole = (incremental.MemoryTable(spark, f"{base}/{n}", cap=5) for n in ("held", "whole"))
    for batch in range(4):
        rows = [(f"v{some.randrange(40):02}", k, f"s{some.randrange(9 * (batch + 1))}", f"t{batch}-{k}", float(some.randrange(99))) for k in range(60)]
        df = storage.materialize(spark.createDataFrame(rows, "video_id string, idx int, source string, target string, score double"))
        taken = held.held(df)
        numbers = {(v, i): n for n, (v, i) in enumerate(sorted(r[:2] for r in rows), 1)}
        assert {tuple(r) for r in taken.collect()} < {(numbers[v, i], *rest) for v, i, *rest in rows}
        held.upsert(taken, batch, first=1)
        whole.upsert(numbered(df, "video_id", "idx").drop("video_id", "idx"), batch)
        got, want = ({r.source: (r.target, r.score, r.first_seq) for r in m.read().collect()} for m in (held, whole))
        assert got == want and len(got) == 5
    all_ = incremental.MemoryTable(spark, f"{base}/all", cap=None).held(df)
    assert {tuple(r) for r in all_.collect()} == {(numbers[v, i], *rest) for v, i, *rest in rows}


def test_batches_report(spark):
    store = runs.StepStore(spark, new_path(spark, "steps"))
    inventory = spark.createDataFrame([("in/a.mp4", "in"), ("in/sub/b.MKV", "in"), ("in/c.mov", "in"), ("in/d.mp4", "in"), ("in/a.mp4", "in"), ("in/note.txt", "in")], "path string, root string")
    existing = spark.createDataFrame([("out/d_translated.srt",)], "path string")
    results = payloads(spark, {"in/a.mp4": ["hello"], "in/sub/b.MKV": [" "], "in/d.mp4": ["done before"], "in/note.txt": ["no video"]})
    plan = runs.run_batch(inventory, existing, results, "utterances", shouting, store, "out", SILENT, dry_run=True)
    assert {r.input: r.status for r in plan.items.collect()} == {"in/a.mp4": "planned", "in/sub/b.MKV": "planned", "in/c.mov": "planned", "in/d.mp4": "skipped"} and plan.texts is None
    report = runs.run_batch(inventory, existing, results, "utterances", shouting, store, "out", SILENT, sleep=no_wait)
    assert {r.input: (r.status, r.error) for r in report.items.collect()} == {
        "in/a.mp4": ("success", None), "in/sub/b.MKV": ("failed", "no subtitles found"), "in/c.mov": ("failed", "no recognition result"), "in/d.mp4": ("skipped", None),
    }
    assert report.totals.first().asDict() == {"planned": 0, "success": 1, "skipped": 1, "failed": 2, "total": 4}
    assert [(r.output, r.translated.split("\n")[2]) for r in report.texts.collect()] == [("out/a_translated.srt", "HELLO<>")]
    lines = [json.loads(r.report) for r in runs.report_lines(report, "in").orderBy("line").collect()]
    assert lines[0]["total"] == 4 and [x["input"] for x in lines[1:]] == ["a.mp4", "c.mov", "d.mp4", "sub/b.MKV"]
    again = runs.run_batch(inventory, existing, results, "utterances", shouting, store, "out", SILENT, overwrite=True, sleep=no_wait)
    assert again.totals.first().success == 2
    with pytest.raises(runs.Collision, match="out/a_translated.srt would be written by in/a.avi and in/a.mp4"):
        runs.run_batch(inventory.union(spark.createDataFrame([("in/a.avi", "in")], inventory.schema)), existing, results, "utterances", shouting, store, "out", SILENT)
    nothing = runs.run_batch(inventory.limit(0), existing, results, "utterances", shouting, store, "out", SILENT, sleep=no_wait)
    assert nothing.items.count() == 0 and nothing.totals.first().total == 0


def listing():
    """Terms are the numbers in the lines it is shown, the first line's twice; a batch's answer tells which terms it was shown."""

    def ask(prompt):
        if prompt.startswith("List "):
            numbers = [line.split()[-1] for line in prompt.split("\n\n", 1)[1].split("\n")]
            return json.dumps([{"term": t, "action": a} for t, a in [(f"t{','.join(numbers)}", "keep"), (numbers[0], "flexible"), (numbers[0], "keep"), ("old", "keep")]])
        items = json.loads(prompt[prompt.rindex("\n\n[{") + 2 :])
        shown = re.findall(r'^- "([^"]*)" → (decide|keep)', prompt, re.M)
        return json.dumps([" ".join(f"{t}:{a}" for t, a in shown)] * len(items))

    return ask


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("n", [1, 49, 50, 51, 137])
def test_terms_come_from_an_even_sample(spark, n, stored):
    cues = cues_of(spark, {"v": [f"line {k}" for k in range(n)], "w": ["only 7"]})
    memory = spark.createDataFrame([], W.MEMORY) if stored else None
    glossary = spark.createDataFrame([(1, "old", "translate", "vieux", "")], W.GLOSSARY)
    done = W.translate(cues, listing, memory, glossary, W.Settings(scoring=False), sleep=no_wait)
    lines = [str(i * n // 50) for i in range(50)] if n > 50 else [str(k) for k in range(n)]
    own = f"t{','.join(lines)}"
    assert [(r.video_id, r.pos, r.term, r.action) for r in done.found.orderBy("video_id", "pos").collect()][:4] == [("v", 0, own, "keep"), ("v", 1, "0", "flexible"), ("v", 2, "0", "keep"), ("v", 3, "old", "keep")]
    got = done.cues.orderBy("video_id", "idx").collect()
    assert [(r.video_id, r.idx, r.text) for r in got] == [*(("v", k + 1, f"line {k}") for k in range(n)), ("w", 1, "only 7")]
    assert {r.target for r in got if r.video_id == "v"} == {f"{own}:keep 0:decide"} and got[-1].target == "t7:keep 7:decide"
    assert sorted(r.term for r in done.glossary().collect()) == sorted({"old", own, "0", "t7", "7"})


def test_term_lines_are_those_of_the_glossary(spark):
    rows = [("a", "keep", ""), ("b", "translate", "x"), ("c", "flexible", "y"), ('d"', "other", "")]
    made = spark.createDataFrame(rows, "term string, action string, target string").select("term", M.glossary_line(F.col("term"), F.col("action"), F.col("target")).alias("line"))
    assert {r.term: r.line for r in made.collect()} == {t: W.term_line(t, a, x) for t, a, x in rows}
