from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import assemble as am
from driftloom.operators import evaluate as ev
from driftloom.operators.ordered import fresh
from driftloom.plans import experiment
from driftloom.storage import cut


def test_each_drawn_document_is_cleaned_and_embedded_once(spark, monkeypatch):
    texts = [(c, " ".join(f"{c}w{chr(97 + (i * k) % 23)}" for k in range(12)) if i else "42 --") for c in ("a", "b") for i in range(10)]
    corpus = spark.createDataFrame([(k, t, c) for k, (c, t) in enumerate(texts)], "doc_key long, text string, category string")
    plan = am.schedule_frame(spark, {"p": am.plan_segments(("a", "b", "a", "b"), (120, 240, 360), gradual_window=40, recurring_period=20)})
    runs = spark.createDataFrame([("r", "p", 1)], "run_id string, schedule string, seed long")
    streams = cut(am.assemble_ids(corpus, plan, runs, 480, subset_size=6))
    params = experiment.ExperimentParams(triggers=(20,), detectors=("mmd",), reference=20, dim=16, evaluation=ev.EvaluationParams(100, 10))
    seen = []
    embed = experiment.embed
    monkeypatch.setattr(experiment, "embed", lambda df, *more: (seen.append(df.count()), embed(df, *more))[1])
    once = experiment.run_experiments(streams, corpus, params).collect()
    assert seen == [streams.select("doc_id").distinct().count()] and seen[0] <= 12

    # every place of the stream with a text of its own gives the same result rows
    own = fresh(streams).join(corpus.select(F.col("doc_key").alias("doc_id"), "text"), "doc_id")
    places = own.select(F.col("sequenceNumber").alias("doc_key"), "text")
    apart = experiment.run_experiments(streams.withColumn("doc_id", F.col("sequenceNumber")), places, params).collect()
    assert seen[1] == 480 and once and sorted(map(str, once)) == sorted(map(str, apart))


def test_streams_with_texts_have_those_of_their_documents(spark, monkeypatch):
    corpus = spark.createDataFrame([(k, f"text {k}", "a") for k in range(30)], "doc_key long, text string, category string")
    plan = am.schedule_frame(spark, {"p": [am.Segment(0, 100, None, "a")]})
    runs = spark.createDataFrame([("r", "p", 1), ("s", "p", 2)], "run_id string, schedule string, seed long")
    ids = am.assemble_ids(corpus, plan, runs, 50, subset_size=8).select("docId", F.concat(F.lit("text "), "doc_id").alias("text"))
    for most in (100_000, 0):  # ids broadcast, and exchanged
        monkeypatch.setattr(am, "BROADCAST_DOCUMENTS", most)
        out = am.assemble_streams(corpus, plan, runs, 50, subset_size=8).select("docId", "text")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, ids.collect())) and out.count() == 100
    assert am.texts_of(am.assemble_ids(corpus, plan, runs, 50, subset_size=8), corpus).count() <= 16
