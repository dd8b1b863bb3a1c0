"""Sources, sinks and streaming forms: what is written is read again, streams equal tables.

Files go to a new folder below the shared one for each call.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from checks import detector_checks as dc
from checks import stream_checks as sc
from checks import table
from checks.corpus_checks import ORACLE as CORPUS_ORACLE
from checks.corpus_checks import digest, sql_clean
from checks.report_checks import results
from driftloom.functions.timecols import epoch_ms
from driftloom.operators import detect as dt
from driftloom.operators import embed as em
from driftloom.operators import report as rp
from driftloom.operators import windows as wn
from driftloom.sources import corpus_files, topics
from driftloom.sources.results import append_results, read_results, write_summary
from driftloom.storage import shared_folder
from driftloom.streaming import detect as sd
from driftloom.streaming import sinks
from driftloom.streaming import windows as sw


def _folder(spark, name):
    return f"{shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    """A table as a stream; the pattern matches a single file as well as a folder of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _run(out, name, mode="append"):
    """Run a stream over what is there and return what it wrote."""
    spark = out.sparkSession
    path = _folder(spark, name)
    query = sinks.run_available(out, f"{name}-{uuid.uuid4().hex}", path, mode)
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema(_with_epoch(out, mode)).parquet(path)


def _with_epoch(out, mode):
    schema = out.schema
    return schema.add("epoch", "integer") if mode != "append" else schema


def _corpus(spark, sf):
    return table(spark, sf, "documents").select("text", F.col("lang").alias("category"))


def s1(spark, sf):
    path = _folder(spark, "corpus")
    corpus_files.write_corpus(_corpus(spark, sf), path)
    return corpus_files.read_corpus(spark, path).select("category", *digest("text"))


def s11(spark, sf):
    path = _folder(spark, "corpus")
    corpus_files.write_corpus(_corpus(spark, sf), path, by_category=True)
    return spark.read.parquet(path).select("category", *digest("text"))


def _raw_docs(spark, sf):
    e = F.col("event_id")
    events = table(spark, sf, "events")
    return events.select(
        F.concat(F.lit("d"), e).alias("docId"), epoch_ms(events, "ts").alias("timestamp"),
        F.concat_ws(" ", "event_type", "props").alias("text"), F.col("event_type").alias("sourceCategory"), e.alias("sequenceNumber"),
        (e % 2 == 0).alias("driftLabel"), F.when(e % 2 == 0, "sudden").alias("driftType"), F.when(e % 2 == 0, e - e % 100).alias("driftStartTs"),
    )


def s6(spark, sf):
    sent = topics.raw_messages(_raw_docs(spark, sf))
    return sent.select("key", F.get_json_object("value", "$.docId").alias("doc_name"), F.contains("value", F.lit("driftType")).alias("has_type"))


def s2(spark, sf):
    """Raw documents written as messages and read back as a stream."""
    path = _folder(spark, "raw")
    topics.write_messages(topics.raw_messages(_raw_docs(spark, sf)), path)
    records = topics.file_stream(spark, path, "key string, value string")
    docs = wn.parse_raw(records, now=F.lit(0))
    out = _run(docs.select("sourceCategory", "sequenceNumber", "timestamp", "driftLabel"), "raw")
    return out.select(F.col("sourceCategory").alias("category"), F.col("sequenceNumber").alias("seq"), F.col("timestamp").alias("ms"), F.col("driftLabel").alias("drift_label"))


def _windowed(spark, sf):
    docs = wn.clean_documents(_raw_docs(spark, sf))
    return wn.hopping(docs, "timestamp", sc.SIZE, sc.ADVANCE)


def _batches(spark, sf):
    fields = [f.split()[0] for f in topics.PROCESSED.split(", ")]
    return wn.batch_messages(_windowed(spark, sf), ["sourceCategory"], "sequenceNumber", fields)


def s7(spark, sf):
    """Batches as their receiver finds them: the messages of one batch together, by the documents they carry."""
    sent = topics.batch_messages(_batches(spark, sf))
    read = sent.select("key", F.from_json("value", "batchId string, windowStart long, documents array<struct<docId: string>>").alias("m"))
    whole = read.groupBy("key", "m.batchId", "m.windowStart").agg(F.sum(F.size("m.documents")).cast("long").alias("document_count"))
    return whole.select("key", F.col("windowStart").alias("window_start"), "document_count")


def _alert_rows(spark, sf):
    """One alert of each batch, however many messages the batch was sent in; it carries the batch's count as score."""
    sent = wn.window_batches(_windowed(spark, sf), ["sourceCategory"])
    number = F.col("document_count").cast("double")
    alerts = sent.select(
        F.when(F.col("document_count") % 2 == 0, "mmd").otherwise("padd").alias("detector"), number.alias("score"), (number / 2).alias("threshold"),
        F.col("window_end").alias("detected_at"), "window_type", *wn.WINDOW, F.col("document_count").cast("int").alias("doc_count"),
    )
    return topics.alert_messages(alerts).withColumn("topic", F.lit(topics.ALERT_TOPIC))


def _topic_rows(spark, sf):
    """Batches and alerts on one frame of messages."""
    sent = topics.batch_messages(_batches(spark, sf)).withColumn("topic", F.lit(topics.BATCH_TOPIC))
    return sent.unionByName(_alert_rows(spark, sf))


def s3(spark, sf):
    broken = F.when(F.hash("value") % 2 == 0, F.col("value")).otherwise(F.substring("value", 1, 40))
    records = _topic_rows(spark, sf).where(F.col("topic") == topics.BATCH_TOPIC)
    both = records.unionByName(records.withColumn("value", F.concat(F.lit("{"), broken)))
    docs = topics.read_batches(both).select("windowStart", F.inline("documents"))
    return docs.select(F.col("windowStart").alias("window_start"), F.col("sourceCategory").alias("category"), F.col("sequenceNumber").alias("seq"), F.col("cleanedText").alias("cleaned"))


def s4(spark, sf):
    batches, alerts = topics.read_evaluation_inputs(_topic_rows(spark, sf), "mmd")
    seen = batches.groupBy("windowEnd").agg(F.sum(F.size("documents")).cast("long").alias("n_docs"))
    raised = alerts.groupBy("windowEnd").agg(F.count(F.lit(1)).alias("n_alerts"), F.max("score").alias("top_score"))
    return seen.join(raised, "windowEnd", "left").withColumnRenamed("windowEnd", "window_end")


def s8(spark, sf):
    rows = _topic_rows(spark, sf).where(F.col("topic") == topics.ALERT_TOPIC)
    alerts = topics.read_alerts(rows)
    return alerts.select("detector", "score", "threshold", F.col("windowEnd").alias("window_end"), F.col("docCount").cast("long").alias("doc_count"))


def s9_files(spark, sf):
    path = _folder(spark, "results")
    rows = results(spark, sf)
    for d in ("mmd", "padd"):
        append_results(rows.where(F.col("detector") == d), path)
    good, _ = read_results(spark, path)
    return good.select("dataset", "detector", "trigger_n", "drift_type", "f1", "latency_docs", "far")


def s10(spark, sf):
    path = _folder(spark, "summary")
    write_summary(rp.cross_dataset_summary(results(spark, sf)), path)
    return spark.read.option("header", True).schema("dataset string, detector string, drift_type string, f1_mean double, f1_std double, latency_mean double, far_mean double").csv(path)


def s12(spark, sf):
    """Files of about equal size, as many as the texts need, read back as they are found."""
    path = _folder(spark, "watched")
    table(spark, sf, "documents").select(F.col("text")).hint("rebalance").write.json(path)
    seen = corpus_files.watch_directory(spark, path, "text string", "json")
    out = _run(seen.select("text", F.col("file_path").isNotNull().alias("has_file"), F.col("file_time").isNotNull().alias("has_time")), "watched")
    return out.select(F.md5("text").alias("text_md5"), "has_file", "has_time")


def s13(spark, sf):
    """A bounded run in several micro-batches, one file each."""
    path = _folder(spark, "bounded")
    _raw_docs(spark, sf).select(F.col("sourceCategory").alias("key"), F.col("text").alias("value")).repartition(4).write.json(path)
    out = _run(topics.file_stream(spark, path, "key string, value string", limit=1), "bounded")
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _events_stream(spark, sf):
    events = _stream(spark, sf, "events")
    return sw.with_event_time(events.select("event_id", "event_type", epoch_ms(events, "ts").alias("ms")), "ms")


def w1_stream(spark, sf):
    """Growing versions of the windows; the last one of each is the batch result."""
    out = sw.sliding_batches(_events_stream(spark, sf), "event_type", "6 hours", "90 minutes", 5, seq="event_id")
    sent = _run(out, "windows", "update")
    last = sent.groupBy("event_type", "window_start", "window_end").agg(F.max_by(F.struct("document_count", "max_seq"), "epoch").alias("b"))
    return last.select("event_type", "window_start", "window_end", "b.*")


CHUNK = 40


def w6_stream(spark, sf):
    """Windows that the watermark has closed, from parts of at most 40 documents."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    parts = _run(sw.split_batches(_events_stream(spark, sf), ["event_id"], "event_type", "ms", sc.SIZE, sc.ADVANCE, 5, "event_id", CHUNK), "parts")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    ids = F.array_sort(F.flatten(F.collect_list(F.transform("documents", lambda d: d.event_id))))
    whole = parts.groupBy("event_type", "window_start").agg(
        F.max(F.when(F.col("is_last"), F.col("document_count"))).alias("document_count"), F.count(F.lit(1)).alias("parts"),
        F.max(F.size("documents")).cast("long").alias("largest"), F.array_join(ids.cast("array<string>"), ",").alias("ids"),
    )
    return whole.where("document_count is not null")


def v16_stream(spark, sf):
    """Counters of a bounded run over four files of window batches."""
    path = _folder(spark, "counted")
    wn.window_batches(sc.hopped(spark, sf), sc.KEY, seq="event_id").select("document_count", "max_seq").repartition(4).write.parquet(path)
    arriving = spark.readStream.schema("document_count long, max_seq long").option("maxFilesPerTrigger", 1).parquet(path)
    query = sinks.run_available(sinks.observed(arriving), f"counted-{uuid.uuid4().hex}", _folder(spark, "progress"))
    query.awaitTermination()
    found = sinks.progress_counters(query)
    return spark.createDataFrame([(found["batches"], found["documents"], found["max_seq"])], "batches long, documents long, max_seq long")


def w8_stream(spark, sf):
    docs = sw.new_documents(_events_stream(spark, sf), ["event_type", "event_id"])
    return _run(docs.select("event_type", "event_id", "ms"), "documents")


def w7_stream(spark, sf):
    path = _folder(spark, "sent")
    sent = wn.window_batches(sc.hopped(spark, sf), sc.KEY, seq="event_id")
    sent.select("event_type", F.col("window_end").alias("arrival"), "document_count").write.parquet(path)
    arriving = spark.readStream.schema("event_type string, arrival long, document_count long").parquet(path)
    return _run(sw.high_water(arriving, "event_type"), "high_water")


def w7_documents(spark, sf):
    """The documents of ``w7_split_windows``, from the messages as a stream of several micro-batches."""
    sent = wn.batch_messages(sc.hopped(spark, sf), sc.KEY, "event_id", ["event_id", "ms"], chunk=7).withColumn("arrival", F.col("windowEnd"))
    path = f"{shared_folder(spark)}/messages/{uuid.uuid4().hex}"
    # three files in the order of arrival, borders anywhere within a window's parts
    sent.repartitionByRange(3, "arrival", "part").sortWithinPartitions("arrival", "part").write.parquet(path)
    names = sorted(r.name for r in spark.read.parquet(path).select(F.input_file_name().alias("name")).distinct().collect())
    for name in names:
        spark.read.parquet(name).coalesce(1).write.mode("append").parquet(f"{path}_in_order")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}_in_order")
    new = _run(sw.new_documents_high_water(stream, "event_type", "arrival"), "documents")
    return new.select("event_type", "arrival", F.inline("documents")).select("event_type", "arrival", "event_id")


def e6_stream(spark, sf):
    rows = _run(sd.latest_vectors(_vector_stream(spark, sf)), "store", "update")
    last = rows.groupBy("stream_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["stream_id", "epoch"]).select("stream_id", (F.col("seq") % (1 << 32)).alias("seq"), "age")


def x4_stream(spark, sf):
    counts = _run(wn.word_count(_stream(spark, sf, "conversations"), "text"), "words", "complete")
    last = counts.groupBy("word").agg(F.max_by("n", "epoch").alias("n"))
    return last


def _vector_stream(spark, sf):
    vectors = _stream(spark, sf, "embeddings")
    order = F.shiftleft(F.col("label").cast("long"), 32) + F.col("vec_id")
    return vectors.select(F.concat(F.lit("s"), F.col("vec_id") % 2).alias("stream_id"), order.alias("seq"), F.col("embedding").alias("vec"))


def m6_stream(spark, sf):
    noise = em.embed(em.noise_documents(dc.vocab(spark, sf)), "text", em.hashing_encoder(dc.DIM))
    # a reference of a fixed number of vectors, given to every stream
    held = sorted((r.noise_id, r.vec) for r in noise.select("noise_id", "vec").collect())
    given = np.array([v for _, v in held], np.float32) / np.float32(40)
    out = sd.detect_stream(_vector_stream(spark, sf), dt.load_detectors(["mmd"], mmd={"noise_warmup": True}), dc.N, dc.REF, given)
    rows = _run(out, "warmup")
    return rows.select("stream_id", "batch_no", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "is_alert")


def _stream_verdicts(names):
    def query(spark, sf):
        out = sd.detect_stream(_vector_stream(spark, sf), dt.load_detectors(names), dc.N, dc.REF)
        rows = _run(out, "verdicts")
        return rows.select(
            "stream_id", "batch_no", "detector", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "is_alert",
            (F.col("last_seq") % (1 << 32)).alias("last_seq"), F.col("doc_count").cast("long").alias("doc_count"),
        )

    return query


QUERIES = {
    "s1_read_corpus": s1,
    "s2_read_raw_stream": s2,
    "s3_read_batches": s3,
    "s4_read_evaluation_inputs": s4,
    "s6_raw_messages": s6,
    "s7_batch_messages": s7,
    "s8_alert_messages": s8,
    "s9_append_results": s9_files,
    "s10_write_summary": s10,
    "s11_write_corpus": s11,
    "s12_watch_directory": s12,
    "s13_bounded_run": s13,
    "w1_stream_batches": w1_stream,
    "v16_progress_counters": v16_stream,
    "w6_stream_split_windows": w6_stream,
    "w7_stream_high_water": w7_stream,
    "w7_stream_documents": w7_documents,
    "e6_stream_store": e6_stream,
    "w8_stream_new_documents": w8_stream,
    "m6_stream_warmup": m6_stream,
    "x4_stream_word_count": x4_stream,
    "m7_stream_verdicts": _stream_verdicts(["mmd"]),
    "a4_stream_history": _stream_verdicts(["padd"]),
}

# ---- SQL -------------------------------------------------------------------------------------

_CORPUS_SQL = "SELECT lang AS category, md5(text) AS text_md5, length(text) AS n_chars FROM documents"
_TEXT = "event_type || ' ' || props"
_CLEAN_EVENTS = f"SELECT * FROM (SELECT *, {sql_clean(_TEXT)} AS cleaned FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)) WHERE cleaned <> ''"
_BATCH_SQL = f"""SELECT event_type, window_start, window_end, count(*) AS n FROM ({sc.hop_sql(_CLEAN_EVENTS)}) GROUP BY ALL HAVING count(*) >= 5"""

from checks.report_checks import ORACLE as _REPORTS  # noqa: E402
from checks.report_checks import RES  # noqa: E402

ORACLE = {
    "s1_read_corpus": _CORPUS_SQL,
    "s2_read_raw_stream": "SELECT event_type AS category, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_id % 2 = 0 AS drift_label FROM events",
    "s3_read_batches": f"""SELECT window_start, event_type AS category, event_id AS seq, cleaned FROM ({sc.hop_sql(_CLEAN_EVENTS)})
QUALIFY count(*) OVER (PARTITION BY event_type, window_start) >= 5""",
    "s4_read_evaluation_inputs": f"SELECT window_end, sum(n)::BIGINT AS n_docs, nullif(count(*) FILTER (n % 2 = 0), 0) AS n_alerts, max(n::DOUBLE) FILTER (n % 2 = 0) AS top_score FROM ({_BATCH_SQL}) GROUP BY window_end",
    "s6_raw_messages": "SELECT event_type AS key, 'd' || event_id AS doc_name, event_id % 2 = 0 AS has_type FROM events",
    "s7_batch_messages": f"SELECT event_type AS key, window_start, n AS document_count FROM ({_BATCH_SQL})",
    "s8_alert_messages": f"SELECT CASE WHEN n % 2 = 0 THEN 'mmd' ELSE 'padd' END AS detector, n::DOUBLE AS score, n / 2.0::DOUBLE AS threshold, window_end, n AS doc_count FROM ({_BATCH_SQL})",
    "s9_append_results": f"{RES} SELECT dataset, detector, trigger_n, drift_type, round(f1, 4) AS f1, round(latency_docs, 2) AS latency_docs, round(far, 6) AS far FROM res",
    "s10_write_summary": _REPORTS["g3_cross_dataset_summary"],
    "s11_write_corpus": _CORPUS_SQL,
    "s12_watch_directory": "SELECT md5(text) AS text_md5, true AS has_file, true AS has_time FROM documents",
    "s13_bounded_run": "SELECT event_type AS key, count(*) AS n FROM events GROUP BY ALL",
    "w1_stream_batches": sc.batches_sql(5, extra=", max(event_id) AS max_seq"),
    "v16_progress_counters": f"SELECT count(*) AS batches, sum(document_count)::BIGINT AS documents, max(max_seq) AS max_seq FROM ({sc.batches_sql(5, extra=', max(event_id) AS max_seq')})",
    "w6_stream_split_windows": f"""SELECT event_type, window_start, count(*) AS document_count, CAST(ceil(count(*) / {CHUNK}) AS BIGINT) AS parts, least(count(*), {CHUNK})::BIGINT AS largest,
  string_agg(event_id, ',' ORDER BY event_id) AS ids FROM ({sc.hop_sql(sc.EVENTS_SQL)}) GROUP BY event_type, window_start
HAVING count(*) >= 5 AND max(window_end) < (SELECT max(ms) FROM ({sc.EVENTS_SQL}))""",
    "m6_stream_warmup": dc.ORACLE["m6_noise_warmup"],
    "w7_stream_high_water": sc.ORACLE["w7_new_documents_high_water"],
    "w7_stream_documents": sc.ORACLE["w7_split_windows"],
    "e6_stream_store": dc.ORACLE["e6_bounded_store"],
    "w8_stream_new_documents": sc.ORACLE["w8_new_documents_exact"],
    "x4_stream_word_count": CORPUS_ORACLE["x4_word_count"].replace("FROM documents", "FROM conversations"),
    "m7_stream_verdicts": dc.ORACLE["m7_mmd_verdict"],
}
