"""The live job: raw messages -> window batches -> new documents -> verdicts -> alerts.

Three streaming queries hand over through topics and a table of documents, so each can be restarted,
replayed and scaled on its own. State is bounded: of each open window the part of at most 10,000 documents
that has not been sent, and for each stream of vectors what ``streaming.detect`` holds. What has been seen
before is looked up in what the earlier epochs wrote.

An epoch is written in many files, with each key in one of them. The next query takes files in the order of
their time, so it reads each key in the order of epochs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftloom.operators import embed as em
from driftloom.operators.detect import Detector, enrich_alerts
from driftloom.sources import topics
from driftloom.storage import shared_folder
from driftloom.streaming import detect as sd
from driftloom.streaming import sinks
from driftloom.streaming import windows as sw

_FIELDS = [field.split()[0] for field in topics.PROCESSED.split(", ")]


def publish_batches(docs: DataFrame, target: str, name: str, **window) -> StreamingQuery:
    """Cleaned documents (``operators.windows.clean_documents``) as batches on a topic.

    A window is sent in messages of at most ``chunk`` documents with the same ``batchId``, full ones as soon as
    they are; ``documentCount`` is that of the window so far.
    """
    sent = sw.split_batches(sw.with_event_time(docs), _FIELDS, **window)
    named = sent.select(
        "sourceCategory",
        F.md5(F.concat_ws("|", "sourceCategory", "window_start", "window_end")).alias("batchId"),
        F.col("window_type").alias("windowType"),
        F.col("window_start").alias("windowStart"),
        F.col("window_end").alias("windowEnd"),
        F.col("document_count").cast("int").alias("documentCount"),
        "part",
        F.col("first_index").alias("firstIndex"),
        "documents",
    )
    return sinks.run_available(topics.batch_messages(named).repartition("key"), name, target, "append", "json")


def collect_documents(records: DataFrame, table: str, name: str) -> StreamingQuery:
    """Each document of a stream of batch messages once, with the first window that brought it."""

    def write(batch: DataFrame, epoch: int) -> None:
        docs = topics.read_batches(batch).select("windowType", "windowStart", "windowEnd", "documentCount", F.inline("documents"))
        window = F.struct(F.col("windowEnd").alias("window_end"), F.col("windowStart").alias("window_start"), F.col("windowType").alias("window_type"), F.col("documentCount").alias("doc_count"), F.col("cleanedText").alias("text"))
        first = docs.groupBy(F.col("sourceCategory").alias("stream_id"), F.col("sequenceNumber").alias("seq")).agg(F.min(window).alias("w"))
        rows = first.select("stream_id", "seq", "w.*")
        earlier = sinks.earlier_epochs(batch.sparkSession, table, epoch)
        if earlier is not None:
            # a document that came before came in a window that overlaps one of these
            since = docs.agg(F.coalesce(F.min("windowStart"), F.lit(0))).scalar()
            rows = rows.join(earlier.where(F.col("window_end") > since).select("stream_id", "seq"), ["stream_id", "seq"], "left_anti")
        sinks.epoch_writer(table)(rows.repartition("stream_id"), epoch)

    return _each(records, write, name)


def publish_alerts(
    docs: DataFrame,
    table: str,
    target: str,
    detectors: list[Detector],
    loader: Callable[[], em.Encoder],
    name: str,
    detected_at: Column,
    n: int = em.TRIGGER_N,
    reference: int = em.REFERENCE_SIZE,
    **options,
) -> StreamingQuery:
    """Alerts for a stream of the documents in ``table``, one for each stream, detector and window end."""
    vectors = em.embed(docs, "text", loader).select("stream_id", "seq", "vec")
    verdicts = sd.detect_stream(vectors, detectors, n, reference, **options)
    keep = sinks.alert_writer(target)

    def write(batch: DataFrame, epoch: int) -> None:
        known = batch.sparkSession.read.option("recursiveFileLookup", True).parquet(table)
        keep(enrich_alerts(batch, known, detected_at), epoch)

    return _each(verdicts, write, name)


def document_stream(spark, table: str) -> DataFrame:
    """The table of documents as a stream, an epoch at a time."""
    schema = "stream_id string, seq long, window_end long, window_start long, window_type string, doc_count int, text string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{table}/*")


def _each(out: DataFrame, write: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
    place = f"{shared_folder(out.sparkSession)}/streams/{name}"
    return out.writeStream.queryName(name).option("checkpointLocation", place).foreachBatch(write).trigger(availableNow=True).start()
