"""Streams give what tables give."""

from __future__ import annotations

import itertools
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import detect as dt
from driftloom.operators import embed as em
from driftloom.operators import windows as wn
from driftloom.plans import live
from driftloom.sources import topics
from driftloom.streaming import detect as sd
from driftloom.streaming import sinks
from driftloom.streaming import windows as sw


def run(out, mode, path):
    name = uuid.uuid4().hex
    target = f"{path}/{name}"
    sinks.run_available(out, name, target, mode).awaitTermination()
    return out.sparkSession.read.option("recursiveFileLookup", True).parquet(target)


def test_verdicts_over_several_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    path = str(tmp_path / "vectors")
    frames = None
    for name in ("s", "t"):
        vectors = np.vstack([rng.normal(0, 1, (90, 5)), rng.normal(1, 1, (57, 5))]).astype(np.float32)
        data = [(name, i, i, v.tolist()) for i, v in enumerate(vectors)]
        frame = spark.createDataFrame(data, "stream_id string, pos long, seq long, vec array<float>")
        frames = frame if frames is None else frames.unionByName(frame)
    for at in range(0, 150, 37):
        frames.where(f"seq >= {at} and seq < {at + 37}").coalesce(1).write.mode("append").parquet(path)
    found = dt.load_detectors(["mmd", "padd"], padd={"max_history": 60})
    # files in order of their names within one trigger each
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(sd.detect_stream(stream, found, 20, 30), "append", tmp_path)
    want = dt.detect(frames, found, 20, 30)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("is_alert").count() > 0


def test_noise_warm_up_over_several_micro_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    path, given = str(tmp_path / "vectors"), rng.normal(2, 1, (30, 4)).astype(np.float32)
    data = [("s", i, i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (95, 4)).astype(np.float32))]
    frame = spark.createDataFrame(data, "stream_id string, pos long, seq long, vec array<float>")
    for at in range(0, 95, 30):
        frame.where(f"seq >= {at} and seq < {at + 30}").coalesce(1).write.mode("append").parquet(path)
    found = dt.load_detectors(["mmd"], mmd={"noise_warmup": True})
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(sd.detect_stream(stream, found, 20, 30, given), "append", tmp_path)
    reference = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(given)], "stream_id string, pos long, vec array<float>")
    want = dt.detect(frame, found, 20, 30, reference)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.count() == 3 and got.where("threshold is null or is_alert is null").count() == 0


def test_windows_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs = spark.range(200).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("sourceCategory"), (F.col("id") * 1700).alias("timestamp"), F.col("id").alias("sequenceNumber"))
    for part in range(4):
        docs.where(F.floor(F.col("sequenceNumber") / 50) == part).coalesce(1).write.mode("append").parquet(path)
    stream = sw.with_event_time(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path))
    keys = ["sourceCategory", "window_start", "document_count"]
    batch = wn.window_batches(wn.hopping(docs, "timestamp"), ["sourceCategory"])
    want = {tuple(r) for r in batch.select(*keys).collect()}
    final = run(sw.sliding_batches(stream, fields=["sequenceNumber"]), "append", tmp_path)
    got = {tuple(r) for r in final.select(*keys).collect()}
    closed = 199 * 1700 - 60_000 - 50 * 1700
    assert got <= want and {w for w in want if w[1] < closed} <= got
    assert all(r.document_count == len(r.documents) for r in final.collect())
    versions = run(sw.sliding_batches(stream), "update", tmp_path).groupBy("sourceCategory", "window_start").agg(F.max("document_count").alias("document_count"))
    assert {tuple(r) for r in versions.select(*keys).collect()} == want


def test_progress_listener_adds_up(spark, tmp_path):
    class Event:
        class progress:  # noqa: N801
            observedMetrics = {"progress": {"batches": 30, "documents": 300, "max_seq": 9}}

    seen: list = []
    listener = sinks.ProgressListener(seen.append)
    listener.onQueryProgress(Event())
    listener.onQueryProgress(Event())
    assert seen == [{"batches": 60, "documents": 600, "max_seq": 9}]
    df = spark.createDataFrame([(5, 1), (7, 2)], "document_count long, max_seq long")
    assert sinks.observed(df).count() == 2


def test_epochs_are_written_once(spark, tmp_path):
    write = sinks.alert_writer(str(tmp_path / "alerts"))
    batch = spark.createDataFrame([("s", "mmd", 60, 1, 0.5), ("s", "mmd", 60, 2, 0.7), ("s", "padd", 60, 1, 0.1)], "stream_id string, detector string, window_end long, detected_at long, score double")
    write(batch, 3)
    write(batch, 3)
    again = batch.union(spark.createDataFrame([("s", "padd", 75, 9, 0.2)], batch.schema))
    write(again, 4)
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "alerts")).collect()
    assert sorted((r.detector, r.score, r.epoch) for r in rows) == [("mmd", 0.7, 3), ("padd", 0.1, 3), ("padd", 0.2, 4)]


def test_listener_on_a_running_stream(spark, tmp_path):
    path, seen = str(tmp_path / "batches"), []
    spark.range(6).selectExpr("id + 1 as document_count", "id as max_seq").coalesce(1).write.parquet(path)
    listener = sinks.ProgressListener(seen.append, every=5)
    sinks.watch(spark, listener)
    try:
        stream = spark.readStream.schema("document_count long, max_seq long").parquet(path)
        assert run(sinks.observed(stream), "append", tmp_path).count() == 6
        for _ in range(100):
            if seen:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert seen == [{"batches": 6, "documents": 21, "max_seq": 5}]


def test_live_alerts_equal_the_table_plan(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = [["sun", "sea", "sand", "wind"], ["tax", "bank", "loan", "debt"]]
    raw = [
        (f"d{i}", i * 1000, " ".join(rng.choice(words[i >= 260 if c == "a" else 0], 12)), c, i)
        for i in range(420)
        for c in ("a", "b")
    ]
    docs = spark.createDataFrame(raw, "docId string, timestamp long, text string, sourceCategory string, sequenceNumber long")
    docs = wn.clean_documents(docs.withColumns({"driftLabel": F.lit(False), "driftType": F.lit(None).cast("string"), "driftStartTs": F.lit(None).cast("long")}))
    source, topic, table, target = (str(tmp_path / n) for n in ("raw", "topic", "documents", "alerts"))
    for at in range(0, 420, 70):
        docs.where(f"sequenceNumber >= {at} and sequenceNumber < {at + 70}").coalesce(1).write.mode("append").parquet(source)
    found, loader, now = dt.load_detectors(["mmd", "isolation_forest"]), em.hashing_encoder(16), F.col("window_end") + 5
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.publish_batches(stream, topic, uuid.uuid4().hex).awaitTermination()
    live.collect_documents(topics.file_stream(spark, topic, "key string, value string", 1), table, uuid.uuid4().hex).awaitTermination()
    documents = spark.read.option("recursiveFileLookup", True).parquet(table)
    assert documents.count() == documents.select("stream_id", "seq").distinct().count() > 700
    live.publish_alerts(live.document_stream(spark, table), table, target, found, loader, uuid.uuid4().hex, now, 50, 100).awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(target)
    vectors = em.embed(documents, "text", loader)
    verdicts = dt.detect(dt.positions_by(vectors, "stream_id", F.col("seq"), "vec", "seq"), found, 50, 100)
    want = dt.enrich_alerts(verdicts, documents, now)
    keys = ["stream_id", "detector", "window_end", "last_seq", "doc_count", "detected_at"]
    assert got.count() > 0 and documents.select("epoch").distinct().count() > 1
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))


def test_split_windows_equal_the_table_form(spark, tmp_path):
    rng = np.random.default_rng(3)
    raw = [(i, int(i * 400 + rng.integers(0, 300)), "hot" if i % 3 else "b", None if i % 7 == 0 else f"t{i}") for i in range(420)]
    docs = spark.createDataFrame(raw, "sequenceNumber long, timestamp long, sourceCategory string, cleanedText string")
    path = str(tmp_path / "docs")
    for at in range(0, 420, 70):
        docs.where(f"sequenceNumber >= {at} and sequenceNumber < {at + 70}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    parts = run(sw.split_batches(sw.with_event_time(stream), ["sequenceNumber", "cleanedText"], chunk=20), "append", tmp_path).collect()
    closed = max(r[1] for r in raw)
    want = {}
    for seq, at, name, text in raw:
        for start in range(max(0, at - 60_000 + 15_000) // 15_000 * 15_000, at + 1, 15_000):
            if start + 60_000 <= closed:
                want.setdefault((name, start), []).append((seq, text))
    got = {}
    for r in sorted(parts, key=lambda r: r.part):
        assert len(r.documents) <= 20 and r.first_index == r.part * 20
        got.setdefault((r.sourceCategory, r.window_start), []).append(r)
    whole = {k: sorted((d.sequenceNumber, d.cleanedText) for r in v for d in r.documents) for k, v in got.items() if v[-1].is_last}
    assert whole == {k: v for k, v in want.items() if len(v) >= 5}
    assert all(v[-1].document_count == len(want[k]) and v[-1].max_seq == want[k][-1][0] for k, v in got.items() if v[-1].is_last)
    assert max(len(v) for v in got.values()) >= 5


def _in_files(df, path, column, borders):
    for low, high in itertools.pairwise(borders):
        df.where((F.col(column) >= low) & (F.col(column) < high)).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("together", [True, False])
def test_high_water_documents_of_a_stream(spark, tmp_path, together):
    docs = spark.range(60).select(F.when(F.col("id") % 4 == 0, "b").otherwise("c").alias("category"), F.col("id").alias("seq"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") * 3000).alias("ms"))
    sent = wn.batch_messages(wn.hopping(docs, "ms"), ["category"], "seq", ["seq", "text"], chunk=3).withColumn("arrival", F.col("windowStart"))
    want = wn.new_documents_high_water(sent, ["category"], "arrival", "documentCount", batch="batchId")
    # parts of two windows may come in turns once both have begun
    turn = F.col("arrival") * 10 + F.when(F.col("part") == 0, 0).otherwise(0 if together else 160_000) + F.col("part")
    files = sent.withColumn("turn", turn)
    stream = _in_files(files, str(tmp_path / "sent"), "turn", (0, 200_000, 400_000, 650_000, 10**9))
    got = run(sw.new_documents_high_water(stream, "category", "arrival"), "append", tmp_path)
    flat = lambda df: sorted((r.category, r.arrival, d.seq, d.text) for r in df.collect() for d in r.documents)
    assert flat(got) == flat(want) and flat(got)
    assert all(r.n_new == len(r.documents) for r in got.collect())


def test_latest_vectors_in_any_order(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i * 7 % 101, [float(i), 1.0], i) for i in range(101)] + [("a", None, [1.0, 1.0], 5), ("a", 500, None, 5)]
    docs = spark.createDataFrame(rows, "stream_id string, seq long, vec array<float>, turn int")
    out = run(sd.latest_vectors(_in_files(docs, str(tmp_path / "vectors"), "turn", (0, 30, 31, 101)), 10), "update", tmp_path)
    got = {}
    for r in out.collect():
        got.setdefault((r.stream_id, r.epoch), []).append((r.age, r.seq, list(r.vec)))
    for name in "ab":
        last = max(e for s, e in got if s == name)
        want = sorted(((s, v) for k, s, v, _ in rows if k == name and s is not None and v is not None), reverse=True)[:10]
        assert sorted(got[name, last]) == [(k, s, v) for k, (s, v) in enumerate(want, 1)]


def test_alerts_read_only_the_days_they_are_of(spark, tmp_path):
    path, day = str(tmp_path / "alerts"), sinks.DAY_MS
    write = sinks.alert_writer(path)
    schema = "stream_id string, detector string, window_end long, detected_at long"
    write(spark.createDataFrame([("s", "mmd", 5, 1), ("s", "mmd", day + 5, 1), (None, "mmd", None, 1)], schema), 0)
    # what is no Parquet in another day's folder is not looked at
    (tmp_path / "alerts" / "_day=7").mkdir()
    (tmp_path / "alerts" / "_day=7" / "part.parquet").write_text("broken")
    again = spark.createDataFrame([("s", "mmd", 5, 2), ("s", "mmd", day + 5, 2), ("s", "mmd", day + 6, 2), (None, "mmd", None, 2)], schema)
    for _ in range(2):
        write(again, 1)
    write(again.limit(0), 2)
    rows = [r for d in (0, 1) for r in spark.read.option("recursiveFileLookup", True).parquet(f"{path}/_day={d}").collect()]
    assert sorted((str(r.window_end), r.epoch) for r in rows) == [("5", 0), (str(day + 5), 0), (str(day + 6), 1), ("None", 0)]
