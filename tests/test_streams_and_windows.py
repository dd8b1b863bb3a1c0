"""Schedules, draws and windows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftloom.operators import assemble as am
from driftloom.operators import evaluate as ev
from driftloom.operators import windows as wn


def labels(spark, plan, n, seed=1):
    seqs = spark.range(n).select(F.col("id").alias("seq"), F.lit("p").alias("schedule"))
    return am.schedule_categories(seqs, am.schedule_frame(spark, {"p": plan}), seed).orderBy("seq").collect()


def test_gradual(spark):
    plan = [am.Segment(0, 4, "gradual", "a", "b", 0, 4), am.Segment(4, am._END, None, "b")]
    many = [labels(spark, plan, 6, seed) for seed in range(12)]
    for rows in many:
        assert [r.drift_label for r in rows] == [True, True, True, False, False, False]
        assert rows[0].category == "a" and [r.category for r in rows[3:]] == ["b", "b", "b"]
        assert rows[3].drift_type is None and rows[3].drift_start is None
    assert {rows[2].category for rows in many} == {"a", "b"}


def test_recurring(spark):
    plan = [am.Segment(0, am._END, "recurring", "base", "target", 9, 2)]
    rows = labels(spark, plan, 7)
    assert [r.category for r in rows] == ["target", "target", "base", "base", "target", "target", "base"]
    assert {(r.drift_label, r.drift_type, r.drift_start) for r in rows} == {(True, "recurring", 9)}


def test_preset_and_unknown_name(spark):
    plan = am.preset("yahoo")
    assert [(s.start_seq, s.kind) for s in plan] == [(0, None), (1000, "sudden"), (2000, "gradual"), (2200, None), (2400, "recurring")]
    assert plan[-1].declared_start == 3200 and plan[-1].base == "yahoo_politics"
    assert am.preset("wikipedia") == am.preset("newsgroups")


def test_gradual_cut_short_keeps_the_sudden_base():
    plan = am.plan_segments(("i", "s", "g", "r"), (10, 20, 25), gradual_window=10)
    assert [(s.kind, s.base) for s in plan] == [(None, "i"), ("sudden", "i"), ("gradual", "s"), ("recurring", "s")]


def test_draws_use_each_document_once_a_pass(spark):
    pool = spark.createDataFrame([("r", c, i) for c, n in (("a", 5), ("b", 1)) for i in range(n)], "run_id string, category string, doc_key long")
    asked = spark.range(23).select(F.lit("r").alias("run_id"), F.when(F.col("id") % 4 == 3, "b").otherwise("a").alias("category"), F.col("id").alias("seq"))
    rows = am.cyclic_draw(asked, pool, 3).orderBy("seq").collect()
    assert len(rows) == 23
    a = [r.doc_key for r in rows if r.category == "a"]
    assert a[:5] == [0, 1, 2, 3, 4] and len(a) == 18
    for at in range(0, 15, 5):
        assert sorted(a[at : at + 5]) == [0, 1, 2, 3, 4]
    assert a[5:10] != a[10:15] or a[:5] != a[5:10]
    assert {r.doc_key for r in rows if r.category == "b"} == {0}


def test_unknown_category_is_an_error(spark):
    pool = spark.createDataFrame([("r", "a", 0)], "run_id string, category string, doc_key long")
    asked = spark.createDataFrame([("r", "zzz", 0)], "run_id string, category string, seq long")
    with pytest.raises(Exception, match="nothing to draw from in category 'zzz'"):
        am.cyclic_draw(asked, pool, 3).collect()


def test_explode_range_crosses_widths(spark):
    df = spark.createDataFrame([("a", 11), ("b", 0), ("c", 4)], "k string, n long")
    rows = am.explode_range(df, F.col("n"), "i", ["k"], width=4).collect()
    assert Counter(r.k for r in rows) == {"a": 11, "c": 4}
    assert sorted(r.i for r in rows if r.k == "a") == list(range(11))


def test_high_water(spark):
    sent = spark.createDataFrame([("c", i, n) for i, n in enumerate((5, 8, 8, 6, 10))], "category string, arrival long, document_count long")
    rows = wn.new_documents_high_water(sent, ["category"], "arrival").orderBy("arrival").collect()
    assert [(r.arrival, r.first_index, r.n_new) for r in rows] == [(0, 0, 5), (1, 5, 3), (4, 8, 2)]


@pytest.mark.parametrize("chunk", [1, 3, 7, 100])
def test_high_water_over_split_windows(spark, chunk):
    docs = spark.range(60).select(F.lit("c").alias("category"), F.col("id").alias("seq"), (F.col("id") * 3000).alias("ms"))
    windowed = wn.hopping(docs, "ms", 60_000, 15_000)
    whole = wn.batch_messages(windowed, ["category"], "seq", ["seq"]).withColumn("arrival", F.col("windowStart"))
    split = wn.batch_messages(windowed, ["category"], "seq", ["seq"], chunk=chunk).withColumn("arrival", F.col("windowStart"))
    want = wn.new_documents_high_water(whole, ["category"], "arrival", "documentCount")
    got = wn.new_documents_high_water(split, ["category"], "arrival", "documentCount", batch="batchId")
    flat = lambda df: sorted((r.arrival, d.seq) for r in df.collect() for d in r.documents)
    assert flat(got) == flat(want)
    ends = lambda df, batch: ev.batch_ends(df.select(F.lit("r").alias("run_id"), F.col("windowEnd").alias("window_end"), F.col("documentCount").alias("doc_count"), "arrival", "batchId", F.inline("documents")), "arrival", batch)
    assert sorted(map(tuple, ends(split, "batchId").collect())) == sorted(map(tuple, ends(whole, None).collect()))


def test_hopping_starts_at_zero_and_tumbling(spark):
    df = spark.createDataFrame([(10_000,), (61_000,)], "ms long")
    rows = wn.hopping(df, "ms", 60_000, 15_000).collect()
    assert sorted(r.window_start for r in rows if r.ms == 10_000) == [0]
    assert sorted(r.window_start for r in rows if r.ms == 61_000) == [15_000, 30_000, 45_000, 60_000]
    assert [r.window_start for r in wn.tumbling(df, "ms").orderBy("ms").collect()] == [0, 60_000]


def test_large_windows_are_sent_whole_in_parts(spark):
    df = spark.range(25).select(F.lit("c").alias("category"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ms"))
    sent = wn.batch_messages(wn.tumbling(df, "ms"), ["category"], "seq", ["seq"], chunk=10).orderBy("part").collect()
    assert [len(r.documents) for r in sent] == [10, 10, 5]
    assert {(r.documentCount, r.batchId) for r in sent} == {(25, sent[0].batchId)}
    assert [d.seq for r in sent for d in r.documents] == list(range(25))


def test_late_rows(spark):
    rows = [("c", 0, 10_000), ("c", 1, 70_000), ("c", 2, 20_000), ("c", 3, 65_000)]
    df = spark.createDataFrame(rows, "category string, arrival long, ms long")
    kept = wn.drop_late(wn.tumbling(df, "ms"), ["category"], "arrival", "ms")
    assert sorted(r.arrival for r in kept.collect()) == [0, 1, 3]


def test_record_defaults(spark):
    records = spark.createDataFrame([("k", '{"text": "Hi 5"}', 1), ("k", "{no", 2), ("k", '{"text": "123"}', 3)], "key string, value string, offset long")
    docs = wn.clean_documents(wn.parse_raw(records, record_id=F.col("offset"), now=F.lit(77)))
    (row,) = docs.collect()
    assert (row.cleanedText, row.sourceCategory, row.sequenceNumber, row.driftLabel, row.timestamp) == ("hi", "k", -1, False, 77)
    assert row.docId == docs.first().docId
