"""Queries over cues and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import cues as C
from cueloom.operators import inference
from cueloom.operators.memory import CONTEXT_HEAD, context_lines
from cueloom.plans.base import CUES, TOKENS, WORDS, cues, words
from cueloom.sources import sinks
from cueloom.sources import subtitles as S
from cueloom.storage import table

QUERIES, SQL = {}, {}
BAD = ", ".join(f"'{w}'" for w in X.BAD_ENDINGS)
BADLY = rf"""coalesce(lower(list_last(regexp_split_to_array(trim(regexp_replace(trim(text), '[,.;:!?"'']+$', '')), '\s+'))) IN ({BAD}), false)"""
TIME = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000)"
ASS = "printf('%d:%02d:%02d.%02d', {0} // 3600000, {0} % 3600000 // 60000, {0} % 60000 // 1000, {0} % 1000 // 10)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {CUES}, b AS (SELECT d.lang, length(c.text) AS n, greatest(4, floor(dur / 1000 * CASE d.lang WHEN 'zh' THEN 9 WHEN 'ja' THEN 4 WHEN 'ko' THEN 7 ELSE 17 END)) AS most
  FROM cues c JOIN documents d ON d.doc_id = c.video_id)
SELECT lang, count(*) AS n_cues, count(*) FILTER (n > most) AS n_over, round(avg(n), 6) AS mean_chars FROM b GROUP BY lang""")
def reading_speed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues(spark, sf_dir, "lang")
    over = F.length("text") > X.max_chars(C.duration_ms(F.col("start_ms"), F.col("end_ms")), F.col("lang"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_cues"), F.count_if(over).alias("n_over"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query(f"""WITH {CUES} SELECT video_id, idx, CAST(CASE WHEN idx % 5 = 0 THEN 2000 ELSE greatest(100, dur - (idx % 3) * 450) END AS BIGINT) AS duration_ms FROM cues""")
def cue_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = F.col("idx") % 5 != 0
    start = F.when(timed, F.col("start_ms") + (F.col("idx") % 3) * 450)
    return cues(spark, sf_dir).select("video_id", "idx", C.duration_ms(start, F.when(timed, F.col("end_ms"))).alias("duration_ms"))


@query(f"""WITH {CUES}, t AS (SELECT *, CASE WHEN idx % 7 = 0 THEN '' WHEN idx % 3 = 0 THEN '<font color="#FFFF00">» ' || text || '</font>' ELSE '» ' || text END AS target FROM cues)
SELECT video_id, idx, CASE WHEN target = '' THEN text WHEN idx % 4 = 0 THEN target || chr(10) || text WHEN idx % 4 = 1 THEN text || chr(10) || target WHEN idx % 4 = 2 THEN target ELSE text END AS shown FROM t""")
def cue_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("target-above", "source-above", "target-only", "source-only"))), (F.col("idx") % 4 + 1).cast("int"))
    target = F.when(F.col("idx") % 7 == 0, "").otherwise(F.concat(F.lit("» "), "text"))
    return cues(spark, sf_dir).select("video_id", "idx", X.layout(kind, F.col("text"), target, F.when(F.col("idx") % 3 == 0, "ffff00").otherwise("")).alias("shown"))


@query(r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), r AS (SELECT doc_id AS video_id, unnest(range(1, len(a) + 1)) AS raw, unnest(a) AS t FROM l)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY raw) AS idx, raw AS raw_idx FROM r WHERE regexp_matches(t, '[^\s]')""")
def renumbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "text"))
    return C.renumber(C.drop_blank(lines.select("video_id", (F.col("p") + 1).alias("idx"), (F.col("p") + 1).alias("raw_idx"), "text"))).select("video_id", "idx", "raw_idx")


@query(rf"""WITH {CUES}, {WORDS},
e AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(tok, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM words),
b AS (SELECT *, (row_number() OVER (PARTITION BY video_id, s ORDER BY pos) - 1) // 12 AS b FROM e)
SELECT video_id, min(pos) AS first_word, floor(min(w_start) * 1000) AS "start", floor(max(w_end) * 1000) AS "end", string_agg(tok, ' ' ORDER BY pos) AS text FROM b GROUP BY video_id, s, b""")
def rule_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rule_segments(words(spark, sf_dir)).withColumn("start", F.floor(F.col("start") * 1000).cast("double")).withColumn("end", F.floor(F.col("end") * 1000).cast("double"))


@query(rf"""WITH {CUES}, m AS (SELECT *, coalesce(lag({BADLY}) OVER (PARTITION BY video_id ORDER BY idx), false) AS joins FROM cues),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY idx) AS g FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY video_id, g) AS n, row_number() OVER (PARTITION BY video_id, g ORDER BY idx) AS k FROM g)
SELECT video_id, CAST(g AS INTEGER) AS idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
  string_agg(CASE WHEN n = 1 THEN text WHEN k = 1 THEN regexp_replace(text, '\s+$', '') WHEN k = n THEN regexp_replace(text, '^\s+', '') ELSE trim(text) END, ' ' ORDER BY idx) AS text FROM n GROUP BY video_id, g""")
def merged_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.merge_suggested(cues(spark, sf_dir))


@query(f"""WITH {CUES}, n AS (SELECT *, lead(idx) OVER (PARTITION BY video_id ORDER BY idx) AS b FROM cues)
SELECT video_id, CAST(idx AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM n WHERE {BADLY} AND b IS NOT NULL""")
def suggested_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.suggest_merges(cues(spark, sf_dir))


@query(f"""WITH {CUES}, p AS (SELECT video_id, '[[' || idx || ',' || (idx + 1) || '],[' || idx || ',' || (idx + 2) || '],[' || idx || ']]' AS raw, idx FROM cues) SELECT video_id, CAST(idx AS INTEGER) AS a, CAST(idx + 1 AS INTEGER) AS b FROM p""")
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("idx")
    raw = F.format_string("[[%d,%d],[%d,%d],[%d]]", i, i + 1, i, i + 2, i)
    return cues(spark, sf_dir).select("video_id", F.explode(C.neighbour_pairs(raw)).alias("p")).select("video_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).distinct()


@query(f"""WITH {CUES} SELECT video_id, CAST(idx AS INTEGER) AS a, CAST(idx + 1 AS INTEGER) AS b FROM cues WHERE idx % 4 <> 3""")
def prose_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from answers that hold them plainly, between other words, or after a broken list."""
    i = F.col("idx")
    plain = F.format_string("[[%d,%d], [%d,%d,%d], [%d,%d]]", i, i + 1, i, i + 1, i + 2, i + 1, i)
    raw = F.when(i % 4 == 0, F.concat(F.lit(" "), plain, F.lit("\n"))).when(i % 4 == 1, F.concat(F.lit("These belong together: "), plain, F.lit(" as asked"))).when(i % 4 == 2, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise(F.concat(F.lit("[1] or "), plain))
    return cues(spark, sf_dir).select("video_id", F.explode(C.neighbour_pairs(raw)).alias("p")).select("video_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


@query(f"""WITH {CUES}, n AS (SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS n FROM cues),
k AS (SELECT DISTINCT video_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 1) / 19) AS BIGINT)))) AS chunk FROM n)
SELECT n.video_id, CAST(chunk AS INTEGER) AS chunk, idx FROM n JOIN k ON k.video_id = n.video_id AND r >= 19 * chunk AND r < 19 * chunk + 20""")
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlapping_chunks(cues(spark, sf_dir))


@query(f"""WITH {CUES}, b AS (SELECT video_id, (idx - 1) // 7 AS batch FROM cues)
SELECT CAST(batch AS INTEGER) AS batch, CAST(CASE WHEN batch < 3 THEN batch ELSE 3 + (batch - 3) // 4 END AS INTEGER) AS wave, count(*) AS n_cues, count(DISTINCT video_id) AS n_videos FROM b GROUP BY batch""")
def batch_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues(spark, sf_dir).withColumn("batch", C.batch_of(F.col("idx")))
    return rows.withColumn("wave", C.wave_of(F.col("batch"), False, 4)).groupBy("batch", "wave").agg(F.count("*").alias("n_cues"), F.countDistinct("video_id").alias("n_videos"))


@query(f"""WITH {CUES}, b AS (SELECT *, (idx - 1) // 7 AS batch, CASE WHEN (idx - 1) // 7 < 3 THEN (idx - 1) // 7 ELSE 3 + ((idx - 1) // 7 - 3) // 4 END AS wave FROM cues),
w AS (SELECT DISTINCT video_id, batch, wave FROM b),
p AS (SELECT w.*, b.idx, row_number() OVER (PARTITION BY w.video_id, w.batch ORDER BY b.idx DESC) AS k FROM w LEFT JOIN b ON b.video_id = w.video_id AND b.wave < w.wave AND b.idx % 4 <> 0)
SELECT video_id, CAST(batch AS INTEGER) AS batch, CAST(wave AS INTEGER) AS wave, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (k <= 5 AND idx IS NOT NULL), '') AS context FROM p GROUP BY ALL""")
def wave_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cues(spark, sf_dir).withColumn("target", F.when(F.col("idx") % 4 == 0, "").otherwise(F.concat(F.lit("» "), "text")))
    found = C.wave_contexts(done, chained=False, threads=4)
    return found.select("video_id", "batch", "wave", F.array_join(F.transform("context", lambda x: x["idx"].cast("string")), ",").alias("context"))


@query(f"""WITH {CUES}, b AS (SELECT *, (idx - 1) // 7 AS batch FROM cues), w AS (SELECT DISTINCT video_id, batch FROM b),
p AS (SELECT w.*, b.idx, b.text, row_number() OVER (PARTITION BY w.video_id, w.batch ORDER BY b.idx DESC) AS k FROM w LEFT JOIN b ON b.video_id = w.video_id AND b.batch < w.batch AND b.idx % 4 <> 0)
SELECT video_id, CAST(batch AS INTEGER) AS batch, coalesce('{CONTEXT_HEAD}' || chr(10) || string_agg('- "' || text || '" → "» ' || text || '"', chr(10) ORDER BY idx) FILTER (k <= 5 AND idx IS NOT NULL), '') AS lines FROM p GROUP BY ALL""")
def context_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cues(spark, sf_dir).withColumn("target", F.when(F.col("idx") % 4 == 0, "").otherwise(F.concat(F.lit("» "), "text")))
    return C.wave_contexts(done).select("video_id", "batch", context_lines(F.col("context")).alias("lines"))


@query(f"""WITH {CUES}, {WORDS} SELECT video_id, pos, CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM words""")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_offsets(words(spark, sf_dir)).select("video_id", "pos", "off")


@query(f"""WITH {CUES}, {WORDS} SELECT video_id, idx AS seg, min(pos) AS first_word, max(pos) AS last_word FROM words GROUP BY ALL""")
def word_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues(spark, sf_dir)
    segments = rows.select("video_id", F.col("idx").alias("seg"), F.concat(F.lit(" "), F.array_join(X.tokens(F.col("text")), " ")).alias("text"))
    return C.word_ranges(segments, C.words_of_cues(rows))


@query(rf"""WITH RECURSIVE {CUES}, f AS (
  SELECT video_id, idx AS k, idx, start_ms, end_ms, text FROM cues WHERE idx = 1 UNION ALL
  SELECT f.video_id, c.idx, CASE WHEN m THEN f.idx ELSE c.idx END, CASE WHEN m THEN f.start_ms ELSE c.start_ms END, c.end_ms,
    CASE WHEN m THEN regexp_replace(f.text, '\s+$', '') || ' ' || regexp_replace(c.text, '^\s+', '') ELSE c.text END
  FROM (SELECT *, {BADLY} AS badly FROM f) f JOIN cues c ON c.video_id = f.video_id AND c.idx = f.k + 1,
    LATERAL (SELECT badly AND length(f.text) + 1 + length(c.text) <= 126 AS m))
SELECT video_id, CAST(idx AS INTEGER) AS idx, start_ms, max(end_ms) AS end_ms, arg_max(text, k) AS text FROM f GROUP BY video_id, idx, start_ms""")
def boundary_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repair_boundaries(cues(spark, sf_dir), 84)


@query(f"""WITH {CUES}, n AS (SELECT video_id, idx, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS n FROM cues),
k AS (SELECT DISTINCT video_id, unnest(CASE WHEN n <= 10 THEN range(0, n) ELSE list_transform(range(0, 10), lambda i: i * n // 10) END) AS r FROM n)
SELECT video_id, idx FROM n JOIN k USING (video_id, r)""")
def stride_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stride_sample(cues(spark, sf_dir), 10).select("video_id", "idx")


@query(rf"""WITH {CUES}, {WORDS}, j AS (SELECT video_id, string_agg(' ' || tok, '' ORDER BY pos) AS s FROM words WHERE pos < 100 GROUP BY video_id),
c AS (SELECT video_id, length(s) AS n, length(regexp_replace(s, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) AS h, length(regexp_replace(s, '[^\x{{3040}}-\x{{30ff}}]', '', 'g')) AS k, length(regexp_replace(s, '[^\x{{ac00}}-\x{{d7af}}]', '', 'g')) AS g FROM j)
SELECT video_id, CASE WHEN h / n > 0.2 THEN 'zh' WHEN k / n > 0.2 OR (h > 0 AND k > 0) THEN 'ja' WHEN g / n > 0.2 THEN 'ko' ELSE 'en' END AS language FROM c""")
def sample_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_language(words(spark, sf_dir))


@query()
def realigned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = words(spark, sf_dir).withColumn("word", F.concat(F.lit(" "), F.regexp_replace("word", r"[^\p{L}\p{N}]", "")))
    return C.realign(bare, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")).select("video_id", "pos", "word")


@query(f"""WITH {CUES} SELECT video_id, string_agg(idx || chr(10) || {TIME.format('start_ms')} || ' --> ' || {TIME.format('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS srt FROM cues GROUP BY video_id""")
def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.srt_texts(cues(spark, sf_dir))


@query(f"""WITH {CUES} SELECT video_id, idx, start_ms, end_ms, text FROM cues""")
def srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_srt(sinks.srt_texts(cues(spark, sf_dir)), text="srt")


@query(f"""WITH {CUES}, v AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN 1920 ELSE 1280 END AS w, CASE WHEN video_id % 2 = 0 THEN 1080 ELSE 720 END AS h FROM cues)
SELECT video_id, '[Script Info]' || chr(10) || 'ScriptType: v4.00+' || chr(10) || 'PlayResX: ' || w || chr(10) || 'PlayResY: ' || h || chr(10) || 'WrapStyle: 1' || chr(10) || 'ScaledBorderAndShadow: yes' || chr(10) || chr(10)
  || '[V4+ Styles]' || chr(10) || 'Format: {sinks.STYLE_FIELDS}' || chr(10) || 'Style: Default,Arial,' || CASE WHEN h = 1080 THEN 48 ELSE 32 END || ',&H00FFFFFF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,8,'
  || 10 * w // 200 || ',' || 10 * w // 200 || ',' || CASE WHEN h = 1080 THEN 43 ELSE 28 END || ',1' || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: {sinks.EVENT_FIELDS}' || chr(10)
  || string_agg('Dialogue: 0,' || {ASS.format('start_ms')} || ',' || {ASS.format('end_ms')} || ',Default,,0,0,0,,' || CASE WHEN idx % 2 = 0 THEN '{{\\c&H00BC3412&}}' || text || '{{\\r}}' ELSE text END || chr(10), '' ORDER BY idx) AS ass
FROM v GROUP BY video_id, w, h""".replace("\\\\", "\\"))
def ass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cues(spark, sf_dir)
    shown = X.font_wrap(F.col("text"), F.when(F.col("idx") % 2 == 0, "1234bc").otherwise(""))
    even = F.col("video_id") % 2 == 0
    videos = rows.select("video_id").distinct().select("video_id", F.when(even, 1920).otherwise(1280).alias("width"), F.when(even, 1080).otherwise(720).alias("height"))
    return sinks.ass_texts(rows.withColumn("text", shown), videos, position="Top", width_ratio=90)


def _payload(rows: DataFrame, field: str, *item) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*item).alias("x")))), lambda i: i["x"])
    return rows.groupBy("video_id").agg(F.to_json(F.struct(items.alias(field))).alias("payload"))


@query(f"""WITH {CUES}, c AS (SELECT video_id, idx, CASE WHEN idx % 3 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text, start_ms, end_ms FROM cues)
SELECT video_id, CAST(idx AS INTEGER) AS idx, start_ms, end_ms, text FROM c WHERE text <> ''""".replace("\\\\", "\\"))
def utterance_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    third, said = F.col("idx") % 3, F.concat(F.lit("  "), "text", F.lit(" "))
    payloads = _payload(cues(spark, sf_dir), "utterances", F.when(third == 1, said).when(third == 0, "  ").alias("transcript"), F.when(third == 2, said).alias("text"), F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"))
    return S.utterance_cues(payloads)


@query(f"""WITH {CUES} SELECT DISTINCT video_id FROM cues WHERE video_id % 3 = 0""")
def results_without_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose utterances are all blank."""
    said = F.when(F.col("video_id") % 3 != 0, F.col("text")).otherwise("  ")
    payloads = _payload(cues(spark, sf_dir), "utterances", said.alias("transcript"), F.col("start_ms").alias("start_time"))
    return S.without_cues(payloads, S.utterance_cues(payloads)).select("video_id")


@query(f"""WITH {CUES} SELECT video_id, CAST(idx AS INTEGER) AS idx, CASE WHEN idx % 4 = 0 THEN 0 ELSE start_ms // 1000 * 1000 END AS start_ms, end_ms // 1000 * 1000 AS end_ms, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM cues""".replace("\\\\", "\\"))
def verbose_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = lambda c: F.floor(F.col(c) / 1000).cast("double")
    payloads = _payload(cues(spark, sf_dir), "segments", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"), F.when(F.col("idx") % 4 != 0, seconds("start_ms")).alias("start"), seconds("end_ms").alias("end"))
    return S.verbose_cues(payloads)


@query(f"""WITH {CUES} SELECT video_id, CAST(idx AS INTEGER) AS idx, start_ms // 1000 * 1000 + 500 AS start_ms, end_ms // 1000 * 1000 + 500 AS end_ms, ' ' || text AS text FROM cues""")
def segment_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = lambda c: F.floor(F.col(c) / 1000) + F.lit(0.5)
    payloads = _payload(cues(spark, sf_dir), "segments", F.concat(F.lit(" "), "text").alias("text"), seconds("start_ms").alias("start"), seconds("end_ms").alias("end"))
    return S.segment_cues(payloads)


@query("SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(kind == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return S.decode_subtitles(docs.select("doc_id", content.alias("content"))).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n"))


@query(f"""WITH {CUES}, {WORDS}, a AS (SELECT lower(regexp_replace(tok, '[^\\p{{L}}]', '', 'g')) AS letters FROM words) SELECT letters, count(*) AS n FROM a GROUP BY letters""".replace("\\\\", "\\"))
def word_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy(X.alpha_lower(F.col("word")).alias("letters")).agg(F.count("*").alias("n"))


@query(f"""WITH {CUES} SELECT count(*) AS n_cues, sum(len({TOKENS})) AS n_words, sum(length(text)) AS n_chars, count(DISTINCT text) AS n_distinct FROM cues""")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).agg(F.count("*").alias("n_cues"), F.sum(F.size(X.tokens(F.col("text")))).alias("n_words"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("text").alias("n_distinct"))


@query(f"""WITH {CUES} SELECT video_id, CAST((idx - 1) // 7 AS INTEGER) AS batch_id, '[' || string_agg('{{"i":' || idx || ',"duration":"' || printf('%.1fs', dur / 1000) || '","max_chars":' || CAST(greatest(4, floor(dur / 1000 * 17)) AS INTEGER)
  || ',"text":' || to_json(text) || '}}', ',' ORDER BY idx) || ']' || chr(10) || chr(10) || 'Answer with a JSON array that holds ' || count(*) || ' strings and nothing else.' AS prompt FROM cues GROUP BY video_id, (idx - 1) // 7""")
def prompt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.prompt_records(cues(spark, sf_dir).withColumn("dur_ms", C.duration_ms(F.col("start_ms"), F.col("end_ms"))))


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b([A-Za-z]+[_.][A-Za-z_.]*[A-Za-z]|[a-z]+[A-Z][A-Za-z]*|[A-Za-z]+[0-9]+[A-Za-z0-9]*)\b', 1)) AS term FROM documents)
SELECT term, count(*) AS videos, 'keep' AS action FROM t GROUP BY term ORDER BY videos DESC, term LIMIT 30""")
def extracted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.extract_terms(cues(spark, sf_dir))
