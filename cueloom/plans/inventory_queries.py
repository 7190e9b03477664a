"""Queries over inventories, run logs, pages and other text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions import text as X
from cueloom.operators import inventory as I
from cueloom.sources import sinks
from cueloom.sources import subtitles as S
from cueloom.storage import table

QUERIES, SQL = {}, {}
NAMES = "|".join(X.SECRET_NAMES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of an inventory."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("in/"), "source", F.lit("/f"), (F.col("doc_id") % 211).cast("string"), F.when(F.col("doc_id") % 5 == 0, ".srt").otherwise(".MP4")).alias("path"), F.concat(F.lit("in/"), "source").alias("root"), F.col("source").alias("step"), F.col("n_chars").alias("length"), (F.col("doc_id") % 1000).alias("age"))


FILES = "f AS (SELECT doc_id, 'in/' || source || '/f' || (doc_id % 211) || CASE WHEN doc_id % 5 = 0 THEN '.srt' ELSE '.MP4' END AS path, 'in/' || source AS root, source AS step, n_chars AS length, doc_id % 1000 AS age FROM documents)"


@query(f"WITH {FILES} SELECT step, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_bytes FROM f GROUP BY ROLLUP (step)")
def inventory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stats(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT DISTINCT path, root FROM f WHERE path LIKE '%.MP4'")
def discovered_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.discover(files(spark, sf_dir).select("path", "root"))[0]


@query(f"WITH {FILES} SELECT DISTINCT path FROM f WHERE path LIKE '%.srt'")
def other_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.discover(files(spark, sf_dir).select("path", "root"))[1]


def _plan(spark: SparkSession, sf_dir: str, mode: str = "both") -> DataFrame:
    rows = files(spark, sf_dir)
    return rows.select("doc_id", F.concat("path", F.lit("#"), "doc_id").alias("input"), X.predicted_outputs(F.col("path"), F.col("root"), "out", mode).alias("outputs"))


OUTPUTS = """o AS (SELECT doc_id, path || '#' || doc_id AS input, 'out/f' || (doc_id % 211) || '_captioned' || m || CASE WHEN doc_id % 5 = 0 THEN '.srt' ELSE '.MP4' END AS output FROM f, (VALUES (''), ('_softsub')) t(m))"""


@query(f"WITH {FILES}, {OUTPUTS} SELECT output, list_sort(list(DISTINCT input)) AS inputs FROM o GROUP BY output HAVING count(DISTINCT input) > 1")
def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.collisions(_plan(spark, sf_dir))


@query(f"WITH {FILES} SELECT path || '#' || doc_id AS input, ['out/f' || (doc_id % 211) || '_translated.srt'] AS outputs FROM f")
def text_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "text").select("input", "outputs")


@query(f"WITH {FILES}, {OUTPUTS}, e AS (SELECT DISTINCT output AS there FROM o WHERE doc_id % 211 % 3 = 0 OR (doc_id % 211 % 3 = 1 AND output LIKE '%softsub%')) SELECT input, bool_and(there IS NOT NULL) AS skipped FROM o LEFT JOIN e ON there = output GROUP BY input")
def finished_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    third = F.col("doc_id") % 211 % 3
    existing = plan.select(third.alias("t"), F.explode("outputs").alias("path")).filter((F.col("t") == 0) | ((F.col("t") == 1) & F.col("path").contains("softsub"))).select("path")
    return I.mark_done(plan, existing).select("input", "skipped")


@query(f"WITH {FILES} SELECT doc_id, step FROM f WHERE NOT (doc_id % 4 = 0 AND length % 3 > 0)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = files(spark, sf_dir).withColumn("key", X.fingerprint([F.col("path"), F.col("length"), F.col("doc_id")], F.lit("style=plain")))
    cached = keyed.filter("doc_id % 4 = 0").select("step", "key", (F.col("length") % 3).alias("bytes"))
    return I.cache_misses(keyed, cached).select("doc_id", "step")


@query(f"WITH {FILES} SELECT doc_id, substr(sha256(path || '|' || length || '|' || age), 1, 16) || '_' || substr(sha256('style=plain'), 1, 16) AS key FROM f")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", X.fingerprint([F.col("path"), F.col("length"), F.col("age")], F.lit("style=plain")).alias("key"))


@query(f"WITH {FILES}, k AS (SELECT *, sum(length) OVER (ORDER BY age, path || doc_id) AS run FROM f WHERE age <= 700) SELECT doc_id, run > 900000 AS removed FROM k UNION ALL SELECT doc_id, TRUE FROM f WHERE age > 700")
def retention_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("path", F.concat("path", "doc_id"))
    return I.retention(rows, 700, 900_000).select("doc_id", "removed")


@query(f"WITH {FILES}, k AS (SELECT *, sum(length) OVER (PARTITION BY step ORDER BY age, path || doc_id) AS run FROM f WHERE age <= 700) SELECT doc_id, run > 50000 AS removed FROM k UNION ALL SELECT doc_id, TRUE FROM f WHERE age > 700")
def retention_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("path", F.concat("path", "doc_id"))
    return I.retention(rows, 700, 50_000, by="step").select("doc_id", "removed")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of runs."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("planned", "success", "skipped", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    inside = F.concat(F.lit("work/"), F.col("event_id").cast("string"), F.lit(".mp4"))
    outputs = F.array(F.lit("work/b.srt"), F.lit("work/a.srt"), F.lit("work/b.srt"), F.concat(F.lit("/else/"), F.col("event_id").cast("string")))
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, "/else/x").otherwise(inside).alias("input"), status.alias("status"), outputs.alias("outputs"), F.when(status == "failed", F.col("event_type")).alias("error"), F.col("value").alias("elapsed_secs"))


@query("SELECT count(*) FILTER (event_id % 4 = 0) AS planned, count(*) FILTER (event_id % 4 = 1) AS success, count(*) FILTER (event_id % 4 = 2) AS skipped, count(*) FILTER (event_id % 4 = 3) AS failed, count(*) AS total FROM events")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.run_summary(run_log(spark, sf_dir))


@query("""SELECT CASE WHEN event_id % 10 = 0 THEN '<external-path>' ELSE event_id || '.mp4' END AS input, ['planned', 'success', 'skipped', 'failed'][event_id % 4 + 1] AS status, ['<external-path>', 'a.srt', 'b.srt'] AS outputs, CASE WHEN event_id % 4 = 3 THEN event_type END AS error, value AS elapsed_secs FROM events""")
def run_report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.report_items(run_log(spark, sf_dir), "work")


@query("""SELECT CASE WHEN event_id % 12 = 0 THEN 429 ELSE 200 + event_id % 4 * 100 END AS status, CASE WHEN event_id % 12 = 0 OR event_id % 4 = 3 THEN 'transient' ELSE 'permanent' END AS class, count(*) AS n FROM events GROUP BY ALL""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 12 == 0, 429).otherwise(200 + F.col("event_id") % 4 * 100).cast("long")
    return table(spark, sf_dir, "events").select(status.alias("status"), X.failure_class(status).alias("class")).groupBy("status", "class").agg(F.count("*").alias("n"))


@query(rf"""WITH u AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'API_Key=a' || page_id || '&q=1&token=''x'' Bearer sk-' || page_id || '.b_c, Authorization=1' AS s FROM pages)
SELECT page_id, regexp_replace(regexp_replace(s, '([?&])((?i:{NAMES}))=[^&\s"'',)]*', '\1\2=***', 'g'), 'Bearer [A-Za-z0-9\-._+/=]*', 'Bearer ***', 'g') AS shown FROM u""")
def redacted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    s = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("API_Key=a"), i, F.lit("&q=1&token='x' Bearer sk-"), i, F.lit(".b_c, Authorization=1"))
    return table(spark, sf_dir, "pages").select("page_id", X.redact(s).alias("shown"))


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '<title>[^<]*<') THEN regexp_extract(html, '<title>([^<]*)<', 1) END AS title, md5(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''')) AS plain FROM pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.after_marker(F.col("html"), "<title>").alias("title"), F.md5(X.unescape_html(F.col("html")).cast("binary")).alias("plain"))


@query("SELECT page_id, url_encode(url || ' ~*' || html) AS encoded FROM pages")
def encoded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_encode(F.concat("url", F.lit(" ~*"), "html")).alias("encoded"))


@query("SELECT page_id, md5(e) AS digest, length(e) AS n_chars FROM (SELECT page_id, url_encode(url || ' ~*' || html) AS e FROM pages)")
def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of each page's address and whole text, encoded."""
    encoded = X.url_encode(F.concat("url", F.lit(" ~*"), "html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(encoded.cast("binary")).alias("digest"), F.length(encoded).cast("long").alias("n_chars"))


@query("""WITH c AS (SELECT event_id, printf('%06x', event_id * 7919 % 16777216) AS h FROM events), s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN h WHEN 1 THEN '#' || h || ' ' WHEN 2 THEN substr(h, 1, 3) ELSE 'z' || substr(h, 2) END AS s, upper(h) AS h FROM c)
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '#' || h END AS colour, CASE WHEN event_id % 4 < 2 THEN '&H00' || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) END AS literal FROM s""")
def colour_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.lower(F.lpad(F.hex(F.col("event_id") * 7919 % 16777216), 6, "0"))
    kind = F.col("event_id") % 4
    s = F.when(kind == 0, h).when(kind == 1, F.concat(F.lit("#"), h, F.lit(" "))).when(kind == 2, F.substring(h, 1, 3)).otherwise(F.concat(F.lit("z"), F.substring(h, 2, 5)))
    return table(spark, sf_dir, "events").select("event_id", X.colour(s).alias("colour"), X.ass_colour(s).alias("literal"))


@query("""WITH m(a, g, b, i) AS (VALUES """ + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in X.LANGUAGES) + """), s AS (SELECT DISTINCT CASE WHEN length(lang) % 2 = 0 AND doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 3 = 1 THEN 'German' WHEN doc_id % 7 = 0 THEN 'Xx-Yy' ELSE lang END AS lang FROM documents)
SELECT lang, coalesce(g, lang) AS first_service, coalesce(b, lang) AS second_service, coalesce(i, lower(lang)) AS iso FROM s LEFT JOIN m ON a = lower(lang)""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    lang = F.when((F.length("lang") % 2 == 0) & (d % 3 == 0), F.upper("lang")).when(d % 3 == 1, "German").when(d % 7 == 0, "Xx-Yy").otherwise(F.col("lang"))
    names = table(spark, sf_dir, "documents").select(lang.alias("lang")).distinct()
    codes = F.broadcast(spark.createDataFrame(list(X.LANGUAGES), "alias string, g string, b string, i string"))  # a fixed list
    return names.join(codes, F.lower("lang") == F.col("alias"), "left").select("lang", F.coalesce("g", "lang").alias("first_service"), F.coalesce("b", "lang").alias("second_service"), F.coalesce("i", F.lower("lang")).alias("iso"))


@query(f"""WITH {FILES}, n AS (SELECT path || '#' || doc_id AS input, doc_id FROM f) SELECT input, CASE WHEN doc_id % 211 % 3 = 0 THEN 'skipped' ELSE 'success' END AS status FROM n""")
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    existing = plan.filter(F.col("doc_id") % 211 % 3 == 0).select(F.explode("outputs").alias("path"))
    marked = I.mark_done(plan, existing)
    done = marked.filter(~F.col("skipped")).select("input", F.lit("success").alias("status"))
    return I.all_reports(marked.filter("skipped").select("input"), done)


@query("""SELECT '' AS line, CAST(NULL AS VARCHAR) AS input, count(*) AS total, count(*) FILTER (event_id % 4 = 0) AS planned, count(*) FILTER (event_id % 4 = 3) AS failed, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR[]) AS outputs, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS DOUBLE) AS elapsed_secs FROM events
UNION ALL SELECT i, i, NULL, NULL, NULL, ['planned', 'success', 'skipped', 'failed'][event_id % 4 + 1], ['<external-path>', 'a.srt', 'b.srt'], CASE WHEN event_id % 4 = 3 THEN event_type END, value
FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN '<external-path>' ELSE event_id || '.mp4' END AS i FROM events)""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report, their JSON read back."""
    log = run_log(spark, sf_dir)
    report = sinks.run_report(I.report_items(log, "work"), I.run_summary(log))
    fields = "input string, total bigint, planned bigint, failed bigint, status string, outputs array<string>, error string, elapsed_secs double"
    return report.select("line", F.from_json("report", fields).alias("r")).select("line", "r.*")
