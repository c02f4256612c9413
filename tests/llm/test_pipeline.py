"""Each stage of the pipeline against plain code on a small corpus."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import pii, quality_classifier

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    draw = random.Random(9)
    good = [(i, words(draw, 80)) for i in range(120)]
    junk = [(200 + i, " ".join(w + "###" for w in words(draw, 60).split())) for i in range(40)]
    copies = [(300 + i, good[i][1] + " tail") for i in range(10)]
    item = words(draw, 15)
    leaked = [(400 + i, f"{words(draw, 40)} {item} {words(draw, 40)}") for i in range(5)]
    private = [(500, words(draw, 60) + " me@mail.example.com")]
    rows = [(i, t, "aa", "s", len(t)) for i, t in good + junk + copies + leaked + private]
    docs = spark.createDataFrame(rows, KIND)
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[-1][1]] == [5, corpus_pipeline.keep_quality, corpus_pipeline.pack_sequences]
    one = corpus_pipeline.keep_quality(spark, docs, d)
    predicted = {r.doc_id for r in quality_classifier.quality_scores(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in one.collect()} == predicted and {i for i, _ in good} <= predicted and not {i for i, _ in junk} & predicted
    two = corpus_pipeline.drop_near_duplicates(spark, docs, d)
    assert {r.doc_id for r in two.collect()} == {r[0] for r in rows} - {i for i, _ in copies}
    more = [(None, "x", None, None, 1), (None, good[0][1], None, None, 1), (1, other := words(draw, 30), None, None, 1)]
    again = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs.limit(3)).union(spark.createDataFrame(more, KIND)), d)
    kept = again.collect()  # rows of one id with different texts both stay, copies without id go
    assert len(kept) == two.count() + 2 and {r.text for r in kept if r.doc_id == 1} == {good[1][1], other} and [r.text for r in kept if r.doc_id is None] == ["x"]
    three = corpus_pipeline.drop_contaminated(spark, docs, d)
    assert {r.doc_id for r in three.collect()} == {r[0] for r in rows} - {i for i, _ in leaked}
    four = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, d).collect()}
    assert four[500].text.endswith("[EMAIL]") and four[500].n_chars == len(four[500].text) and four[0].text == good[0][1]
    for stage in (one, two, three):
        assert stage.columns == docs.columns
    packed = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    assert packed == {i for i, _ in good} | {500}
    empty = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_statistics_of_texts_once_and_in_small_steps(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, words(draw, 50) + (" ###" * 30 if i % 3 == 0 else ""), None, None, i) for i in range(60)] + [(None, None, "aa", "s", None), (1, "", None, None, 0)]
    docs = spark.createDataFrame(rows, KIND)
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stats = quality_classifier.with_statistics(docs).collect()
    beside = quality_classifier.beside_statistics(docs, "own").collect()
    assert [(r.doc_id, r.own) for r in beside] == [(r.doc_id, r.stats) for r in stats] and [tuple(r)[:5] for r in beside] == rows
    kept = corpus_pipeline.keep_quality(spark, docs.withColumn("_stats", F.lit("x")), str(tmp_path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [run(_stats_of_docs#" in plan and "run(text#" not in plan and "run(coalesce(text#" not in plan
    assert kept.columns == [*docs.columns, "_stats"] and {r.n_chars for r in kept.collect()} >= {i for i in range(60) if i % 3}

    text = np.frombuffer(words(draw, 400_000).encode()[: 2 << 20], np.uint8)
    tracemalloc.start()
    got = quality_classifier.statistics(text, np.arange(0, len(text) + 1, 4096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and np.array_equal(got[7], quality_classifier.statistics(text[7 * 4096 : 8 * 4096], np.array([0, 4096]))[0])
