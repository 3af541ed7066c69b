"""The pipeline against its plain Python version, and on a table of copies."""

import os
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")

import brute_joins  # noqa: E402
import corpus_pipeline  # noqa: E402
from loomline.llm.exchange import landed, shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(brute_joins.pipeline(docs, items))


def test_stages_keep_columns_and_one_of_each(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    text = " ".join(f"w{i}" for i in range(60))
    copies = spark.createDataFrame([(i, text, "en", "s", 9) for i in (7, 3, 5, 3)] + [(9, "other " + text[::-1], "en", "s", 9)], docs.schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, copies, SF).collect()) == [3, 9]
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_lines(spark, copies, SF).collect()) == [3, 3, 9]


def test_line_dedup_stage_drops_short_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    line = "Licensed under the Apache License"
    made = [(i, f"{line}\n{' '.join(f'w{i}x{k}' for k in range(9))}", "en", "s", 9) for i in (1, 2, 3)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(made, docs.schema), SF).collect()}
    assert [i for i in out if line in out[i]] == [1] and len(out) == 3


def test_empty_and_awkward_tables(spark, tmp_path):
    odd = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, "one line only " * 20, "en", "s", 9), (4, "one line only " * 20, "en", "s", 9), (None, "no id " * 30, "en", None, 9), (5, "long " * 40_000, "en", "s", 9)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    names = ("first_id", "__first__", "kept", "n_words", "hit_spans", "removed", "component_id", "ids", "n", "words_left")
    docs = spark.createDataFrame(odd, schema)
    for made, columns in ((docs.limit(0), 0), (docs, 0), (docs, len(names))):
        out = made.withColumns({c: corpus_pipeline.F.lit("mine") for c in names[:columns]})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            more = stage(spark, out, SF)
            assert more.columns == out.columns and [r[-columns:] for r in more.collect() if columns] == [("mine",) * columns] * (more.count() if columns else 0), name
    folder = f"file://{tmp_path}"
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    clean = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([*odd, (7, clean, "en", "s", 9)], schema).write.parquet(f"{folder}/documents.parquet")
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()] == [7]


def test_stages_leave_their_results_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = urlparse(shared_dir(spark)).path.rsplit("/", 1)[0]
    for stage in (corpus_pipeline.dedup_lines, corpus_pipeline.one_of_each):
        before = set(os.listdir(root))
        stage(spark, docs, "")
        assert len(set(os.listdir(root)) - before) == 1


def test_landed_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    rows = spark.range(2000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before, until = files(), time.time() + 20
    landed(rows)
    while (left := [f for f in files() - before if f.endswith(".data")]) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_one_of_each_shuffles_no_texts(spark):
    key, text = "spark.sql.autoBroadcastJoinThreshold", " ".join(f"w{i}" for i in range(60))
    docs = [(7, text, "a"), (3, text, "b"), (3, text, "c"), (3, "another " + text[::-1], "d"), (None, text + " more", "e"), (9, None, "f"), (9, None, "g"), (8, "", "h")]
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = corpus_pipeline.one_of_each(spark, spark.createDataFrame(docs, "doc_id long, text string, batch string"), SF)
    finally:
        spark.conf.set(key, before)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in out.collect()]
    assert sorted(x[:2] for x in got if x[1]) == sorted([(3, text), (3, "another " + text[::-1])])
    assert sorted(x[0] for x in got if not x[1]) == [8, 9] and {x[2] for x in got} <= set("bcdfgh")
