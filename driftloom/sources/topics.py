"""Messages: raw documents, window batches and alerts as keyed JSON.

Each reader takes any frame of ``(key, value)`` rows: a broker topic, a file stream or a table.
:func:`broker_stream` is the only place that needs the broker connector on the class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic names and message schemas.
RAW_TOPIC = "raw-documents"
BATCH_TOPIC = "preprocessed-batches-sliding"
ALERT_TOPIC = "drift-alerts"
PROCESSED = (
    "docId string, timestamp long, sourceCategory string, sequenceNumber long, cleanedText string, "
    "driftLabel boolean, driftType string, driftStartTs long"
)
BATCH = (
    "batchId string, windowType string, windowStart long, windowEnd long, documentCount int, "
    f"part long, firstIndex long, documents array<struct<{', '.join(f.replace(' ', ': ', 1) for f in PROCESSED.split(', '))}>>"
)
ALERT = (
    "detector string, score double, threshold double, detected_at long, windowType string, "
    "windowStart long, windowEnd long, docCount int"
)


def broker_stream(spark: SparkSession, servers: str, topics: str, start: str = "latest", limit: int | None = None) -> DataFrame:
    """Keyed string messages of one or several comma-separated topics."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topics).option("startingOffsets", start)
    if limit:
        reader = reader.option("maxOffsetsPerTrigger", limit)
    return reader.load().withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})


def file_stream(spark: SparkSession, path: str, schema: str = "key string, value string, topic string", limit: int | None = None) -> DataFrame:
    """The same shape from JSON files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if limit:
        reader = reader.option("maxFilesPerTrigger", limit)
    return reader.json(path)


def _decode(records: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = records.withColumn("_m", parsed).where("_m is not null and _m._bad is null")
    return good.select(*[c for c in records.columns if c not in ("value",)], "_m.*").drop("_bad")


def read_batches(records: DataFrame) -> DataFrame:
    """Window batches with at least one document; malformed messages are skipped."""
    return _decode(records, BATCH).where(F.col("documentCount") > 0)


def read_alerts(records: DataFrame, detector: str | None = None) -> DataFrame:
    alerts = _decode(records, ALERT)
    return alerts.where(F.col("detector") == detector) if detector else alerts


def read_evaluation_inputs(records: DataFrame, detector: str, batches: str = BATCH_TOPIC, alerts: str = ALERT_TOPIC) -> tuple[DataFrame, DataFrame]:
    """Non-empty batches and the alerts of one detector, from one frame with a ``topic`` column."""
    filled = read_batches(records.where(F.col("topic") == batches)).where(F.size("documents") > 0)
    return filled, read_alerts(records.where(F.col("topic") == alerts), detector)


def raw_messages(docs: DataFrame) -> DataFrame:
    """Raw documents as messages keyed by category; nulls are left out of the JSON."""
    fields = ["docId", "timestamp", "text", "sourceCategory", "sequenceNumber", "driftLabel", "driftType", "driftStartTs"]
    return docs.select(F.col("sourceCategory").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def batch_messages(batches: DataFrame, key: str = "sourceCategory") -> DataFrame:
    """Window batches (see ``operators.windows.batch_messages``) as messages keyed by category."""
    fields = [f for f in batches.columns if f in ("batchId", "windowType", "windowStart", "windowEnd", "documentCount", "part", "firstIndex", "documents")]
    value = F.to_json(F.struct(*fields))
    return batches.select(F.col(key).alias("key"), value.alias("value")).where("value is not null")


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Enriched alerts as messages keyed by detector."""
    value = F.to_json(
        F.struct(
            "detector",
            "score",
            "threshold",
            "detected_at",
            F.col("window_type").alias("windowType"),
            F.col("window_start").alias("windowStart"),
            F.col("window_end").alias("windowEnd"),
            F.col("doc_count").alias("docCount"),
        )
    )
    return alerts.select(F.col("detector").alias("key"), value.alias("value"))


def write_messages(messages: DataFrame, target: str, servers: str | None = None) -> None:
    """A finite frame of messages to a topic (with ``servers``) or a folder of JSON files."""
    if servers:
        writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
        writer.option("topic", target).save()
    else:
        messages.write.mode("append").json(target)
