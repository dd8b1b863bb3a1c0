"""Structured Streaming forms of the window operators.

State lives in Spark's state store; batches are keyed by category and window. Streams need event
time as a zoned timestamp column ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def with_event_time(docs: DataFrame, ms: str = "timestamp", delay: str = "0 seconds") -> DataFrame:
    """Event time from epoch milliseconds, with a watermark; no delay means no grace.

    Spark moves the watermark once a micro-batch, so fewer rows are late than under the per-record
    rule (``operators.windows.drop_late``).
    """
    return docs.withColumn("ts", F.timestamp_millis(F.col(ms).cast("long"))).withWatermark("ts", delay)


def sliding_batches(
    docs: DataFrame,
    key: str = "sourceCategory",
    size: str = "60 seconds",
    advance: str = "15 seconds",
    min_batch: int = 5,
    fields: list[str] | None = None,
    seq: str = "sequenceNumber",
) -> DataFrame:
    """Window batches of a stream: bounds and counts, and the documents where ``fields`` is given.

    With output mode ``update`` a consumer sees growing versions of a window, with ``append`` only
    the final one.
    """
    aggregates = [F.count(F.lit(1)).alias("document_count"), F.max(seq).alias("max_seq")]
    if fields:
        doc = F.struct(F.col(seq).alias("_o"), F.struct(*fields).alias("d"))
        aggregates.append(F.array_sort(F.collect_list(doc)).alias("_docs"))
    grouped = docs.groupBy(key, F.window("ts", size, advance)).agg(*aggregates)
    # windows begin at the epoch, as in the batch form
    out = grouped.where((F.col("document_count") >= min_batch) & (F.unix_millis(F.col("window.start")) >= 0))
    bounds = {
        "window_start": F.unix_millis(F.col("window.start")),
        "window_end": F.unix_millis(F.col("window.end")),
        "window_type": F.lit("tumbling" if size == advance else "sliding"),
    }
    out = out.withColumns(bounds).drop("window")
    return out.withColumn("documents", F.transform("_docs", lambda x: x.d)).drop("_docs") if fields else out


def new_documents(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Each document once, however many windows or replays bring it."""
    return docs.dropDuplicatesWithinWatermark(keys)


def high_water(batches: DataFrame, key: str = "category", arrival: str = "arrival", count: str = "document_count") -> DataFrame:
    """Index range of unseen documents of each arriving batch; state is one long for each key."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        arrived = pd.concat(list(parts)).sort_values(arrival)
        rows = []
        for at, n in zip(arrived[arrival], arrived[count]):
            if n > seen:
                rows.append((name[0], int(at), int(n), int(seen), int(n - seen)))
                seen = int(n)
        state.update((seen,))
        yield pd.DataFrame(rows, columns=[key, arrival, count, "first_index", "n_new"])

    slim = batches.select(key, arrival, count)
    return slim.groupBy(key).applyInPandasWithState(
        step,
        f"{key} string, {arrival} long, {count} long, first_index long, n_new long",
        "seen long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def new_documents_high_water(
    messages: DataFrame, key: str, arrival: str, count: str = "documentCount", batch: str = "batchId", first: str = "firstIndex"
) -> DataFrame:
    """The unseen ``documents`` of each arriving message, by the largest count its key has brought before.

    The parts of a split window share ``batch`` and are one arrival, even if parts of other windows come between
    them. State of a key: the largest count, and two numbers for each window that has not come whole. Rows of a
    micro-batch are taken in the order of ``arrival`` and ``first``. Documents stay in the JVM's hands: Python
    decides where they are cut and passes them on unread. Messages without new documents are dropped.
    """
    kinds = {f.name: f.dataType for f in messages.schema}
    slim = messages.select(
        F.col(key).alias("_key"), F.col(arrival).alias("arrival"), F.col(batch).alias("batch"), F.col(count).cast("long").alias("whole"),
        F.col(first).cast("long").alias("first"), F.size("documents").cast("long").alias("here"), F.to_json("documents").alias("documents"),
    )

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        highest, names, firsts, missing = state.get if state.exists else (0, [], [], [])
        open_windows = {b: [f, m] for b, f, m in zip(names, firsts, missing, strict=True)}
        arrived = pd.concat(parts).sort_values(["arrival", "first"], kind="stable")
        rows = []
        for at, b, whole, begin, here, documents in zip(*(arrived[c] for c in ("arrival", "batch", "whole", "first", "here", "documents")), strict=True):
            seen, left = open_windows.pop(b, None) or (highest, whole)
            if left > here:
                open_windows[b] = [int(seen), int(left - here)]
            highest = max(highest, int(whole))
            skip = min(max(int(seen - begin), 0), int(here))
            if skip < here:
                rows.append((name[0], int(at), b, int(whole), int(begin + skip), int(here - skip), skip, documents))
        state.update((int(highest), list(open_windows), [f for f, _ in open_windows.values()], [m for _, m in open_windows.values()]))
        yield pd.DataFrame(rows, columns=["_key", "arrival", "batch", "whole", "first_index", "n_new", "skip", "documents"])

    found = slim.groupBy("_key").applyInPandasWithState(
        step,
        "_key string, arrival long, batch string, whole long, first_index long, n_new long, skip int, documents string",
        "highest long, names array<string>, firsts array<long>, missing array<long>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    documents = F.from_json("documents", kinds["documents"])
    return found.select(
        F.col("_key").alias(key), F.col("arrival").alias(arrival), F.col("batch").alias(batch), F.col("whole").alias(count),
        "first_index", "n_new", F.slice(documents, F.col("skip") + 1, F.col("n_new").cast("int")).alias("documents"),
    )


class _SplitWindow(StatefulProcessor):
    """Documents of one window, sent in parts as they come; only those of the part not yet sent are state."""

    def __init__(self, fields: StructType, seq: str, chunk: int, min_batch: int):
        self.fields, self.seq, self.chunk, self.min_batch = fields, seq, chunk, min_batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.sent = handle.getValueState("sent", "parts long, documents long, max_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[2] <= timerValues.getCurrentWatermarkInMs():  # the window has closed
            return
        if not self.sent.exists():
            self.handle.registerTimer(key[2])
        parts, documents, highest = self.sent.get() if self.sent.exists() else (0, 0, None)
        held = list(self.waiting.get())
        for frame in rows:
            arrived = frame[self.fields.fieldNames()].astype(object)
            held += arrived.where(arrived.notna(), None).itertuples(index=False, name=None)
            documents += len(frame)
            highest = max(int(frame[self.seq].max()), highest if highest is not None else int(frame[self.seq].max()))
            full = max(0, len(held) - 1) // self.chunk  # one document stays behind for the part that closes the window
            if full:  # all parts that the frame fills leave in one frame
                ready = [held[k * self.chunk : (k + 1) * self.chunk] for k in range(full)]
                yield self._parts(key, parts, documents, highest, ready, False)
                parts, held = parts + full, held[full * self.chunk :]
        self.sent.update((parts, documents, highest))
        self.waiting.put(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts, documents, highest = self.sent.get()
        if documents >= self.min_batch:
            yield self._parts(key, parts, documents, highest, [list(self.waiting.get())], True)
        self.waiting.clear()
        self.sent.clear()

    def _parts(self, key, first: int, documents: int, highest: int, ready: list[list], last: bool) -> pd.DataFrame:
        names = self.fields.fieldNames()
        at = names.index(self.seq)
        sent = []
        for part, rows in enumerate(ready, first):
            docs = [dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: r[at])]
            sent.append((key[0], int(key[1]), int(key[2]), part, part * self.chunk, documents, highest, last, docs))
        columns = ["key", "window_start", "window_end", "part", "first_index", "document_count", "max_seq", "is_last", "documents"]
        return pd.DataFrame(sent, columns=columns)

    def close(self) -> None:
        pass


def split_batches(
    docs: DataFrame,
    fields: list[str],
    key: str = "sourceCategory",
    ms: str = "timestamp",
    size: int = 60_000,
    advance: int = 15_000,
    min_batch: int = 5,
    seq: str = "sequenceNumber",
    chunk: int = 10_000,
) -> DataFrame:
    """Windows of a stream with their documents, in parts of at most ``chunk``.

    A part leaves as soon as it is full and is dropped from the state, so a hot window never stands whole in
    a row or a state value. ``document_count`` and ``max_seq`` are those of the window so far; the part with
    ``is_last`` comes when the watermark has closed the window, and has those of the whole. A
    window of fewer than ``min_batch`` documents sends nothing. Documents keep their order within a part, and over
    the parts the order in which micro-batches brought them. ``docs`` carry the watermark column ``ts``
    (:func:`with_event_time`). Lists and timers need the RocksDB state store: this sets the session to it.
    """
    if chunk < min_batch:
        raise ValueError("a part holds at least the documents of the smallest batch")
    names = list(dict.fromkeys([*fields, seq]))
    kinds = StructType([docs.schema[n] for n in names])
    t = F.col(ms).cast("long")
    first = F.floor(F.greatest(F.lit(0).cast("long"), t - size + advance) / advance) * advance
    starts = F.sequence(first.cast("long"), (F.floor(t / advance) * advance).cast("long"), F.lit(advance).cast("long"))
    placed = docs.select("ts", F.col(key).alias("_key"), *[F.col(n) for n in names], F.explode(starts).alias("_start"))
    grouped = placed.withColumn("_end", F.col("_start") + F.lit(size).cast("long")).groupBy("_key", "_start", "_end")
    body = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in kinds)
    schema = f"key string, window_start long, window_end long, part long, first_index long, document_count long, max_seq long, is_last boolean, documents array<struct<{body}>>"
    docs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    found = grouped.transformWithStateInPandas(_SplitWindow(kinds, seq, chunk, min_batch), schema, "append", "eventTime")
    kind = "tumbling" if size == advance else "sliding"
    return found.withColumnRenamed("key", key).withColumn("window_type", F.lit(kind))


#: The state store that keeps lists and timers, and state beyond the memory of an executor.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
