"""Starting, bounding and watching streaming queries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from driftloom.storage import shared_folder

PROGRESS_EVERY = 50


def run_available(out: DataFrame, name: str, path: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Process what is there and stop: the bounded form of an endless job.

    Limit the work of a micro-batch at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """
    folder = shared_folder(out.sparkSession)
    writer = out.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/streams/{name}")
    if mode == "append":
        return writer.format(fmt).option("path", path).trigger(availableNow=True).start()
    return writer.foreachBatch(epoch_writer(path)).trigger(availableNow=True).start()


def epoch_writer(path: str):
    """A ``foreachBatch`` function that overwrites the folder of its epoch, so a retry changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/{epoch:012d}")

    return write


def earlier_epochs(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """What :func:`epoch_writer` wrote below ``path`` before this epoch; None where there is nothing yet."""
    reader = spark.read.option("recursiveFileLookup", True)
    # the folder of this epoch may be there from an attempt that failed, and is about to be replaced
    reader = reader.option("ignoreMissingFiles", True)
    try:
        return reader.parquet(path).where(F.col("epoch") < epoch)
    except AnalysisException:
        return None


DAY_MS = 86_400_000


def alert_writer(path: str):
    """The same for alerts: one row for each stream, detector and window end over all epochs.

    Within an epoch the latest counts; an alert that an earlier epoch has written is not written again. Alerts
    lie in folders by the day of their window's end, so an epoch reads only the days it has alerts of.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        keys = [c for c in ("stream_id", "detector", "window_end") if c in batch.columns]
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("detected_at")).alias("_a")).select(*keys, "_a.*")
        day = F.floor(F.coalesce(F.col("window_end"), F.lit(0)) / DAY_MS) if "window_end" in keys else F.lit(0)
        last = last.withColumns({"_day": day.cast("int"), "epoch": F.lit(epoch), "_epoch": F.lit(epoch)})
        last = last.persist()
        try:
            # a number for each day that a micro-batch has alerts of
            days = sorted(r[0] for r in last.select("_day").distinct().collect())
            new = last
            for earlier in filter(None, (earlier_epochs(batch.sparkSession, f"{path}/_day={d}", epoch) for d in days)):
                known = earlier.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
                same = [new[k].eqNullSafe(known[f"_{k}"]) for k in keys]
                new = new.join(known, same, "left_anti")
            if days:
                # a retry replaces what the attempt before it wrote
                new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "_epoch").parquet(path)
        finally:
            last.unpersist()

    return write


def observed(batches: DataFrame, name: str = "progress") -> DataFrame:
    """The same rows, with counters that a listener can read as they pass."""
    return batches.observe(
        name, F.count(F.lit(1)).alias("batches"), F.sum("document_count").alias("documents"), F.max("max_seq").alias("max_seq")
    )


def progress_counters(query: StreamingQuery, name: str = "progress") -> dict[str, int | None]:
    """Counters of :func:`observed` over the micro-batches that a query still remembers.

    Spark keeps the latest hundred (``spark.sql.streaming.numRecentProgressUpdates``); a run that is longer needs the listener.
    """
    rows = [p.observedMetrics[name] for p in query.recentProgress if name in (p.observedMetrics or {})]
    highest = [r["max_seq"] for r in rows if r["max_seq"] is not None]
    return {"batches": sum(r["batches"] for r in rows), "documents": sum(r["documents"] or 0 for r in rows), "max_seq": max(highest, default=None)}


class ProgressListener(StreamingQueryListener):
    """Adds up observed counters and calls ``report`` each time ``every`` more batches are seen."""

    def __init__(self, report, name: str = "progress", every: int = PROGRESS_EVERY):
        self.report, self.name, self.every = report, name, every
        self.batches = self.documents = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is None:
            return
        before = self.batches // self.every
        self.batches += row["batches"] or 0
        self.documents += row["documents"] or 0
        if self.batches // self.every > before:
            self.report({"batches": self.batches, "documents": self.documents, "max_seq": row["max_seq"]})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def watch(spark: SparkSession, listener: ProgressListener) -> None:
    spark.streams.addListener(listener)
