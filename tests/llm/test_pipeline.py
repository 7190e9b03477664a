"""Stages of the corpus pipeline on a small table."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf_dir)
        assert out.columns == columns
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [sorted(r.doc_id for r in x.collect() if r.doc_id is not None) for x in seen]
    assert [x.filter("doc_id is null").count() for x in seen[:4]] == [2] * 4
    assert ids[0].count(1) == 4 and ids[2].count(1) == 1
    toxic = {i for i in ids[0] if i < 900 and i % 8 == 0}
    assert len(toxic & set(ids[1])) <= 0.05 * len(toxic) and len(set(ids[0]) - set(ids[1]) - toxic) <= 0.01 * len(ids[0])
    assert {900, 901} & set(ids[2]) == {900} and ids[2] == ids[3]
    assert not any(re.search("[0-9a-f]{40}", r.text or "") for r in seen[3].collect())
    assert set(ids[4]) <= set(ids[3])
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen[4], sf_dir).collect()
    assert {p.doc_id for p in pieces if p.doc_id is not None} == set(ids[4])


def test_run(spark, sf_dir):
    """The run gives what the stages give one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    count = lambda x: sorted((r.doc_id is None, r.doc_id, r.n, r.tokens) for r in x.groupBy("doc_id").agg(F.count_if(F.col("start") == 0).alias("n"), F.sum("length").alias("tokens")).collect())
    one_by_one = count(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir))
    assert count(corpus_pipeline.run(spark, sf_dir)) == one_by_one


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_fit_ignores_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", (toxicity.fold(labels["doc_id"]) == 0).cast("int") * (1 - labels["toxic"]) + (toxicity.fold(labels["doc_id"]) != 0).cast("int") * labels["toxic"])
    assert (toxicity.fit(docs, labels).scores == toxicity.fit(docs, flipped).scores).all()


def test_stages_hand_rows_to_python_in_small_batches(spark, sf_dir):
    """Batches of the session's own 64 MB, with what is made of them, had taken an executor's memory."""
    name, long = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 14

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    rows = spark.range(0, 1200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), long // 6).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(long).alias("n_chars"))
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            stage(spark, rows.limit(20), sf_dir)
            seen = rows.mapInArrow(sizes, "bytes long, rows long").collect()
            assert sum(x.rows for x in seen) == 1200 and max(x.bytes for x in seen) < corpus_pipeline.BATCH + 4 * long
    finally:
        spark.conf.unset(name)
