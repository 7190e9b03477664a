import random

import pytest


#: Columns that the operators use themselves.
CLASHES = ["'x' AS `row`", "1 AS size", "'y' AS source_key", "CAST(NULL AS INT) AS bucket", "2 AS length"]


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    """Documents with toxic ones, copies, a secret, nulls and repeated rows, and labels of most."""
    from test_operators import words

    r, rows, labels = random.Random(3), [], []
    for i in range(900):
        w = words(r, r.randint(20, 120)).split()
        if i % 8 == 0:
            for _ in range(6):
                w[r.randrange(len(w))] = r.choice(["vilest", "scumbag", "morons"])
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 8 == 0)))
    copy = words(r, 100)
    rows += [(900, copy, "en", "s1", 1), (901, copy + " end", "en", "s2", 1), (902, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + words(r, 20), "en", "s0", 1)]
    rows += [(903, None, None, None, None), (904, "", "en", "s0", 0), (905, words(r, 30), "en", None, 1)]
    rows += [rows[1]] * 3 + [(None, words(r, 25), None, "s1", 2)] * 2 + [(906, words(r, 30_000), "en", "s1", 2)]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASHES).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
