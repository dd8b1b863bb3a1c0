"""Event-time windows over keyed documents, as exploded rows until the sink.

Streams use Spark's own ``window`` with a watermark (see ``driftloom.streaming``); the functions
here are the batch forms, on epoch milliseconds, and also give the strict per-record rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.hashing import hash60
from driftloom.functions.text import clean_text
from driftloom.operators.ordered import dense_position, fresh, running

# Window size and advance in milliseconds, smallest batch that is sent on.
SIZE_MS = 60_000
ADVANCE_MS = 15_000
MIN_BATCH = 5

RAW_DOCUMENT = (
    "docId string, timestamp long, text string, sourceCategory string, sequenceNumber long, "
    "driftLabel boolean, driftType string, driftStartTs long"
)
WINDOW = ["window_start", "window_end"]


def parse_raw(records: DataFrame, key: str = "key", value: str = "value", record_id: Column | None = None, now: Column | None = None) -> DataFrame:
    """JSON records as raw documents with defaults for missing fields; malformed records go.

    A missing id becomes a hash of ``record_id`` (topic, partition and offset on a broker), so that
    a replay yields the same id. A missing timestamp becomes ``now``.
    """
    parsed = F.from_json(value, RAW_DOCUMENT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = records.withColumn("_d", parsed).where("_d is not null and _d._bad is null")
    ident = hash60("doc", record_id if record_id is not None else F.col(value)).cast("string")
    clock = now if now is not None else F.unix_millis(F.current_timestamp())
    d = lambda name: F.col(f"_d.{name}")
    return rows.select(
        F.coalesce(d("docId"), ident).alias("docId"),
        F.coalesce(d("timestamp"), clock).alias("timestamp"),
        F.coalesce(d("text"), F.lit("")).alias("text"),
        F.coalesce(d("sourceCategory"), F.col(key).cast("string")).alias("sourceCategory"),
        F.coalesce(d("sequenceNumber"), F.lit(-1)).cast("long").alias("sequenceNumber"),
        F.coalesce(d("driftLabel"), F.lit(False)).alias("driftLabel"),
        d("driftType").alias("driftType"),
        d("driftStartTs").alias("driftStartTs"),
    )


def clean_documents(raw: DataFrame) -> DataFrame:
    """Raw documents with cleaned text; documents that are blank after cleaning go."""
    cleaned = raw.withColumn("cleanedText", clean_text("text")).drop("text")
    return cleaned.where(F.col("cleanedText") != "")


def hopping(df: DataFrame, time_ms: str, size: int = SIZE_MS, advance: int = ADVANCE_MS) -> DataFrame:
    """Each row once for every epoch-aligned window that holds it (``size / advance`` windows)."""
    t = F.col(time_ms)
    first = F.floor(F.greatest(F.lit(0).cast("long"), t - size + advance) / advance) * advance
    last = F.floor(t / advance) * advance
    starts = F.sequence(first.cast("long"), last.cast("long"), F.lit(advance).cast("long"))
    out = df.withColumn("window_start", F.explode(starts))
    return out.withColumn("window_end", F.col("window_start") + F.lit(size).cast("long"))


def tumbling(df: DataFrame, time_ms: str, size: int = SIZE_MS) -> DataFrame:
    return hopping(df, time_ms, size, size)


def drop_late(windowed: DataFrame, keys: list[str], arrival: str, time_ms: str, grace: int = 0) -> DataFrame:
    """Strict per-record rule: a row is late for a window that closed before or with its arrival.

    Stream time is the running maximum of event time in arrival order, the row itself included.
    """
    clock = {"_clock": ("max", F.col(time_ms))}
    timed = running(windowed, keys, arrival, clock, peers=True)
    return timed.where(F.col("window_end") + grace > F.col("_clock")).drop("_clock")


def window_batches(
    windowed: DataFrame, keys: list[str], min_batch: int = MIN_BATCH, window_type: str = "sliding", seq: str | None = None
) -> DataFrame:
    """One envelope row per key and window: id, type, bounds and document count."""
    extra = [F.max(seq).alias("max_seq")] if seq else []
    counts = windowed.groupBy(*keys, *WINDOW).agg(F.count(F.lit(1)).alias("document_count"), *extra)
    kept = counts.where(F.col("document_count") >= min_batch)
    ident = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*keys, "window_start", "document_count"]]))
    return kept.withColumn("batch_id", ident).withColumn("window_type", F.lit(window_type))


def window_versions(windowed: DataFrame, keys: list[str], arrival: str, min_batch: int = MIN_BATCH) -> DataFrame:
    """Every growing version of every window: the row that arrived and the count it led to."""
    numbered = dense_position(windowed, [*keys, *WINDOW], arrival, "version")
    counted = numbered.withColumn("document_count", F.col("version") + 1).drop("version")
    return counted.where(F.col("document_count") >= min_batch)


def batch_messages(
    windowed: DataFrame,
    keys: list[str],
    order: str,
    fields: list[str],
    min_batch: int = MIN_BATCH,
    window_type: str = "sliding",
    chunk: int = 10_000,
) -> DataFrame:
    """Envelopes that carry their documents, ordered by ``order``.

    A window of up to ``chunk`` documents is one message. A larger one is sent whole as several
    messages with the same ``batchId``, running ``part`` numbers and the index in the window of the
    first document (``firstIndex``), so no task or message has to hold a hot window;
    ``documentCount`` is always that of the window.
    """
    by = [*keys, *WINDOW]
    placed = dense_position(windowed, by, order, "_at")
    parts = placed.groupBy(*by, F.floor(F.col("_at") / chunk).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("d")))).alias("_docs")
    )
    counts = window_batches(windowed, keys, min_batch, window_type)
    joined = parts.join(counts, by)
    return joined.select(
        *keys,
        F.col("batch_id").alias("batchId"),
        F.col("window_type").alias("windowType"),
        F.col("window_start").alias("windowStart"),
        F.col("window_end").alias("windowEnd"),
        F.col("document_count").cast("int").alias("documentCount"),
        "part",
        (F.col("part") * chunk).alias("firstIndex"),
        F.transform("_docs", lambda x: x.d).alias("documents"),
    )


def new_documents_high_water(
    batches: DataFrame, keys: list[str], arrival: str, count: str = "document_count", batch: str | None = None
) -> DataFrame:
    """Index range of unseen documents of each arriving batch, by the largest count seen so far.

    A batch that is no larger than an earlier one of its key yields nothing, even if its documents
    are new; :func:`new_documents_exact` has no such gap. Windows sent in several messages
    (:func:`batch_messages`) need ``batch``, the column that the parts share: they are one arrival,
    and each part yields its own unseen documents.
    """
    if batch is not None:
        whole = batches.groupBy(*keys, batch).agg(F.min(arrival).alias("_arrived"), F.max(count).alias("_count"))
        before = running(whole, keys, "_arrived", {"_seen": ("max", F.col("_count"))}, tiebreak=[batch], inclusive=False)
        first = before.select(*keys, batch, F.coalesce(F.col("_seen"), F.lit(0)).cast("long").alias("first_index"))
        parts = batches.join(fresh(first), [*keys, batch])
        skip = F.greatest(F.col("first_index") - F.col("firstIndex"), F.lit(0)).cast("int")
        rest = parts.where(skip < F.size("documents"))
        return rest.withColumn("n_new", F.size("documents") - skip).withColumn(
            "documents", F.slice("documents", skip + 1, F.size("documents"))
        )
    seen = running(batches, keys, arrival, {"_seen": ("max", F.col(count))}, inclusive=False)
    seen = seen.withColumn("first_index", F.coalesce(F.col("_seen"), F.lit(0)).cast("long")).drop("_seen")
    grown = seen.where(F.col(count) > F.col("first_index"))
    out = grown.withColumn("n_new", F.col(count) - F.col("first_index"))
    if "documents" in batches.columns:
        rest = F.slice("documents", (F.col("first_index") + 1).cast("int"), F.col("n_new").cast("int"))
        out = out.withColumn("documents", rest)
    return out


def new_documents_exact(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document key, whichever windows it came in."""
    return windowed.drop(*WINDOW).dropDuplicates(keys)


def word_count(df: DataFrame, text: str) -> DataFrame:
    """Occurrences of each lower-cased word; counts are combined before the exchange."""
    from driftloom.functions.text import split_words

    words = df.select(F.explode(split_words(text)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
