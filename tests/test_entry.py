"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def compare(spark, queries, sql, names):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for name in names:
        got = queries[name](spark, SF)
        found = c.execute(sql[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(got.columns), name
        rows = sorted(tuple(map(plain, r)) for r in got.select(columns).collect())
        assert rows == sorted(tuple(map(plain, r)) for r in found.fetchall()), name


def test_queries(spark):
    from cueloom.plans import catalog

    compare(spark, catalog.queries(), catalog.oracle_sql(), catalog.oracle_sql())


def test_encoded_pages(spark):
    import hashlib
    import urllib.parse

    from cueloom.plans import catalog

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = catalog.queries()["encoded_pages"](spark, SF).collect()
    assert len(got) == len(pages) and any(len(p.html or "") > 80 for p in pages.values())
    for row in got:
        page = pages[row.page_id]
        want = None if page.url is None or page.html is None else urllib.parse.quote(f"{page.url} ~*{page.html}", safe="")
        assert (row.digest, row.n_chars) == (None if want is None else (hashlib.md5(want.encode()).hexdigest()), want and len(want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["answer_scatter", "subtitle_job", "subtitle_job_memory"])
def test_texts_that_end_in_quotes(spark, tmp_path, name):
    import duckdb

    from cueloom.plans import catalog

    text = "\n".join(f'line {"o" * (k % 9)} number {k} says "so{chr(34) * (k % 3)}' for k in range(160))
    spark.createDataFrame([(k, text, "en", None) for k in range(5)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    rows = sorted(tuple(map(plain, r)) for r in catalog.queries()[name](spark, str(tmp_path)).select(columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in found.fetchall())
