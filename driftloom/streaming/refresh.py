"""Result rows kept up to date while documents and alerts arrive.

What documents have shown is folded into summaries that the next micro-batch adds to, so no document is
read twice: for each run the state at its last document, its drift events, and the places where the state
(drift, cool-down, baseline) changes. Alerts are kept as they are. Matching, false positives and measures are
then made anew from events and alerts, of those runs only that the micro-batch touches.

What is kept grows with events, state changes and alerts, not with documents; documents of a run arrive in
the order of their numbers (one that does not come behind all earlier ones is passed over, as a repeated one
must be). After each micro-batch the results equal those of :func:`driftloom.operators.evaluate.evaluate` on all
that has arrived. Each epoch writes a folder of its own from that of the epoch before, so a repeated
attempt changes nothing, and folders before the last two may be deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftloom.operators import evaluate as ev
from driftloom.operators.evaluate import RUN
from driftloom.operators.ordered import fresh, running
from driftloom.storage import cut, shared_folder

DOCUMENT = "run_id string, seq long, is_drift boolean, drift_start long, drift_type string, ts long"
ALERT = "run_id string, window_end long, doc_count long, detected_at long, window_end_seq long, arrival long"
_SUMMARY = "run_id string, last_seq long, since_drift long, last_state string, open_event long, open_start long, n_docs long, n_nondrift long, n_baseline long"
_EVENT = "run_id string, first_seq long, start_seq long, end_seq long, type string, start_ts long"
_CHANGE = "run_id string, seq long, state string"
_RESULT = (
    "run_id string, drift_type string, precision double, recall double, f1 double, latency_docs double, latency_ms double, far double, d1 double, d2 double,"
    " r double, r_matchaware double, tp long, fn long, fp long"
)
def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


TABLES = {"summaries": _SUMMARY, "events": _EVENT, "changes": _CHANGE, "alerts": ALERT, "results": _RESULT}


def fold_documents(docs: DataFrame, summaries: DataFrame, cooldown: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, events, state changes) of newly arrived documents, for the runs they belong to.

    An event that was open goes on under its first number; of the returned events the largest end counts.
    """
    latest = docs.groupBy(RUN, "seq").agg(F.max(F.struct("is_drift", "drift_start", "drift_type", "ts")).alias("_d")).select(RUN, "seq", "_d.*")
    good, _ = ev.usable_documents(latest)
    known = good.join(fresh(summaries), RUN, "left").where(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq")))
    known = cut(known)

    # states go on from the number of documents since the last drift one
    counted = running(known, [RUN], "seq", {"_k": ("since", F.col("is_drift")), "_p": ("sum", F.lit(1).cast("long"))})
    k = F.coalesce("_k", F.col("since_drift") + F.col("_p"))
    calm = k.isNull() | (k >= cooldown)
    state = F.when(F.col("is_drift"), "DRIFT").when(calm, "BASELINE").otherwise("COOLDOWN")
    is_counted = ~F.col("is_drift") & (k.isNull() | (k > max(cooldown, 1)))
    states = cut(counted.select(*known.columns, k.alias("_since"), state.alias("state"), is_counted.alias("_counted")))
    before = running(states.select(RUN, "seq", "state", "last_state"), [RUN], "seq", {"_before": ("max", F.struct("seq", "state"))}, inclusive=False)
    changes = before.where(~F.coalesce("_before.state", "last_state").eqNullSafe(F.col("state"))).select(RUN, "seq", "state")

    # an event begins where the start differs from that of the drift document before
    drift = states.where("is_drift").select(RUN, "seq", "drift_start", "drift_type", "ts", "open_event", "open_start")
    seen = running(drift, [RUN], "seq", {"_prev": ("max", F.struct("seq", "drift_start"))}, inclusive=False)
    begins = ~F.coalesce("_prev.drift_start", "open_start").eqNullSafe(F.col("drift_start"))
    owned = running(cut(seen.withColumn("_begin", F.when(begins, F.col("seq")))), [RUN], "seq", {"_first": ("max", F.col("_begin"))})
    first = F.struct("drift_start", "drift_type", "ts")
    events = owned.groupBy(RUN, F.coalesce("_first", "open_event").alias("first_seq")).agg(
        F.max("seq").alias("end_seq"), F.max(F.when(F.col("_begin").isNotNull(), first)).alias("_f"), F.max_by("drift_start", "seq").alias("_start")
    )
    events = cut(events)
    ends = states.groupBy(RUN).agg(
        F.max("seq").alias("last_seq"),
        F.max_by("_since", "seq").alias("since_drift"),
        F.max_by("state", "seq").alias("last_state"),
        (F.coalesce(F.first("n_docs"), F.lit(0)) + F.count(F.lit(1))).alias("n_docs"),
        (F.coalesce(F.first("n_nondrift"), F.lit(0)) + F.count_if(~F.col("is_drift"))).alias("n_nondrift"),
        (F.coalesce(F.first("n_baseline"), F.lit(0)) + F.count_if("_counted")).alias("n_baseline"),
        F.first("open_event").alias("_event"),
        F.first("open_start").alias("_start"),
    )
    opened = events.groupBy(RUN).agg(F.max("first_seq").alias("open_event"), F.max_by("_start", "first_seq").alias("open_start"))
    out = ends.join(fresh(opened), RUN, "left").withColumns({"open_event": F.coalesce("open_event", "_event"), "open_start": F.coalesce("open_start", "_start")})
    begun = events.select(RUN, "first_seq", "_f.drift_start", "end_seq", "_f.drift_type", "_f.ts").toDF(*_names(_EVENT))
    return out.select(*_names(_SUMMARY)), begun, changes


class EvaluationRefresh:
    """Summaries and results below ``folder``, by epoch."""

    def __init__(self, spark: SparkSession, folder: str, p: ev.EvaluationParams = ev.EvaluationParams()):
        self.spark, self.folder, self.p = spark, folder.rstrip("/"), p

    def table(self, name: str, epoch: int) -> DataFrame:
        if epoch < 0:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{epoch:012d}/{name}")

    def apply(self, docs: DataFrame, alerts: DataFrame, epoch: int) -> DataFrame:
        """Add a micro-batch; the result rows of all runs after it."""
        old = {name: self.table(name, epoch - 1) for name in TABLES}
        docs, alerts = cut(docs), cut(alerts)
        summaries, events, changes = fold_documents(docs, old["summaries"], self.p.cooldown)
        renewed = cut(summaries)
        new = {
            "summaries": old["summaries"].join(fresh(renewed.select(RUN)), RUN, "left_anti").unionByName(renewed),
            "changes": old["changes"].unionByName(changes),
            # the beginning of an event is known to one of the rows, its end to the latest
            "events": old["events"].unionByName(events).groupBy(RUN, "first_seq").agg(
                *[F.max(c).alias(c) for c in ("start_seq", "end_seq", "type", "start_ts")]
            ),
        }
        rest = [c for c in alerts.columns if c not in (RUN, "window_end")]
        kept = old["alerts"].unionByName(alerts.where("window_end is not null")).groupBy(RUN, "window_end")
        new["alerts"] = kept.agg(F.max_by(F.struct(*rest), F.col("arrival")).alias("_a")).select(RUN, "window_end", "_a.*")
        for name, rows in new.items():
            self._write(rows, name, epoch)

        touched = cut(docs.select(RUN).union(alerts.select(RUN)).distinct())
        now = {name: self.table(name, epoch).join(fresh(touched), RUN, "left_semi") for name in new}
        located = now["alerts"].drop("arrival")
        whole = now["events"].withColumn("match_deadline", F.col("start_seq") + self.p.match_window)
        matched = ev.match_alerts(located, whole, self.p.match_window)
        totals = now["summaries"].select(RUN, "n_docs", "n_nondrift", "n_baseline")
        results = ev.result_rows(matched, ev.false_positives(located, matched, now["changes"]), totals, self.p)
        self._write(old["results"].join(fresh(touched), RUN, "left_anti").unionByName(results), "results", epoch)
        return self.table("results", epoch)

    def _write(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.select(*_names(TABLES[name])).write.mode("overwrite").parquet(f"{self.folder}/{epoch:012d}/{name}")


def refresh_stream(docs: DataFrame, alerts: DataFrame, refresh: EvaluationRefresh, name: str) -> StreamingQuery:
    """Streams of labelled documents and of located alerts into ``refresh``, what is there now."""
    doc, alert = StructType.fromDDL(DOCUMENT), StructType.fromDDL(ALERT)
    arrived = docs.select(F.struct(*doc.names).cast(doc).alias("doc"), F.lit(None).cast(alert).alias("alert"))
    arrived = arrived.unionByName(alerts.select(F.lit(None).cast(doc).alias("doc"), F.struct(*alert.names).cast(alert).alias("alert")))

    def write(batch: DataFrame, epoch: int) -> None:
        refresh.apply(batch.where("doc is not null").select("doc.*"), batch.where("alert is not null").select("alert.*"), epoch)

    place = f"{shared_folder(refresh.spark)}/streams/{name}"
    return arrived.writeStream.queryName(name).option("checkpointLocation", place).foreachBatch(write).trigger(availableNow=True).start()
