"""Scalar functions against fixed rows."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as X


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string").select(column.alias("v"), "i").orderBy("i").select("v").collect()]


@pytest.mark.parametrize(("given", "wanted"), [("00:00:01,5", 1500), ("00:00:01,50", 1500), ("00:00:01,500", 1500), ("00:00:01,5000", 1500), ("-00:00:01,000", None), ("12.5", 12500), ("x", None), ("01:01:01.500", 3661500)])
def test_parse_time(spark, given, wanted):
    assert values(spark, [given], X.parse_srt_time(F.col("s"))) == [wanted]


def test_format_time(spark):
    rows = spark.createDataFrame([(0,), (1500,), (3661500,), (360000000,)], "ms long").select(X.srt_time(F.col("ms")), X.ass_time(F.col("ms"))).collect()
    assert [r[0] for r in rows] == ["00:00:00,000", "00:00:01,500", "01:01:01,500", "100:00:00,000"]
    assert rows[2][1] == "1:01:01.50"


def test_redact(spark):
    given = ["http://host.test/a?key=k-77&page=3", "http://host.test/?SECRET=zz", "proxy-header: Bearer p_Q.7-x", "GET http://host.test/b?pwd=one then Bearer two denied", "http://host.test/?keys=1&tokens=2&lang=en", "中文 http://host.test/?access_token=t;u 结束", None]
    wanted = ["http://host.test/a?key=***&page=3", "http://host.test/?SECRET=***", "proxy-header: Bearer ***", "GET http://host.test/b?pwd=*** then Bearer *** denied", "http://host.test/?keys=1&tokens=2&lang=en", "中文 http://host.test/?access_token=*** 结束", None]
    assert values(spark, given, X.redact(F.col("s"))) == wanted


def test_language_and_colour(spark):
    assert values(spark, ["你好世界", "これは日本", "ひらがな", "안녕하세요", "hello", ""], X.script_language(F.col("s"))) == ["zh", "zh", "ja", "ko", "en", "en"]
    assert values(spark, ["ffff00", "#FFFFFF", "", "FFF", "ZZZZZZ"], X.colour(F.col("s"))) == ["#FFFF00", "#FFFFFF", None, None, None]


def test_layout_and_tags(spark):
    assert values(spark, ["hello"], X.layout(F.lit("target-above"), F.col("s"), F.lit("x"), F.lit("FFFF00"))) == ['<font color="#FFFF00">x</font>\nhello']
    assert values(spark, ["hello"], X.layout(F.lit("target-above"), F.col("s"), F.lit(""), F.lit("FFFF00"))) == ["hello"]
    assert values(spark, ['<font color="#12ab56">a</font>\nb'], X.font_to_ass(F.col("s"))) == ["{\\c&H0056AB12&}a{\\r}\\Nb"]
    assert values(spark, ["&amp;lt;"], X.unescape_html(F.col("s"))) == ["<"]


def test_reading_speed(spark):
    rows = spark.createDataFrame([("zh-Hans", 2000), ("Japanese", 2000), ("ko", 2000), ("en", 2000), ("zh", 100)], "l string, ms int")
    assert [r[0] for r in rows.select(X.max_chars(F.col("ms"), F.col("l"))).collect()] == [18, 8, 14, 34, 4]


def test_outputs(spark):
    path = lambda mode, out: values(spark, ["season/ep1.mp4"], X.predicted_outputs(F.col("s"), F.lit("season"), out, mode))[0]
    assert path("text", "out") == ["out/ep1_translated.srt"]
    assert path("both", None) == ["season/ep1_captioned.mp4", "season/ep1_captioned_softsub.mp4"]
    assert values(spark, ["a/x_translated.mp4"], X.predicted_outputs(F.col("s"), F.lit("a"), None, "text"))[0] == ["a/x_translated.srt"]


def test_fenced_blocks(spark):
    given = ["```json\n[1]\n```", "x ```\n a \n``` ```json\n b\n```", "```json\nopen", "none", None]
    assert values(spark, given, X.fenced_block(F.col("s"))) == ["[1]", "b", None, None, None]


def test_string_arrays(spark):
    both = X.string_array(F.col("s"), F.lit(2))
    assert values(spark, ['["a","b"]', '["a"]', '[1,"b"]', '["a\\"x", "b]"]', None], both) == [["a", "b"], None, None, ['a"x', "b]"], None]
