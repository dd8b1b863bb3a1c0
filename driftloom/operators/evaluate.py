"""Evaluation of alerts against labelled streams, for any number of runs in one job.

Everything is keyed by ``run_id`` and ordered by sequence number. Runs may be long: ordered logic
goes through :func:`driftloom.operators.ordered.running`, intervals meet points by equal grid
cells or by ordered look-up, and no pairs are formed within a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.ordered import fresh, running
from driftloom.storage import cut

# Match window and cool-down in documents, name of the total row.
MATCH_WINDOW = 500
COOLDOWN = 50
GLOBAL = "__GLOBAL__"
RUN = "run_id"
#: Alerts up to which their keys are sent to all batches (about 50 bytes each); beyond that both are exchanged.
BROADCAST_ALERTS = 100_000
RATIOS = ("precision", "recall", "f1")


@dataclass(frozen=True)
class EvaluationParams:
    match_window: int = MATCH_WINDOW
    cooldown: int = COOLDOWN
    far_ignore_cooldown: bool = False


def unique_documents(exploded: DataFrame, arrival: str, keys: tuple[str, ...] = (RUN,)) -> DataFrame:
    """One row for each sequence number, the last to arrive; rows without a number go."""
    rest = [c for c in exploded.columns if c not in (*keys, "seq", arrival, "window_start", "window_end")]
    last = F.max_by(F.struct(*rest), F.col(arrival)).alias("_d")
    return exploded.where("seq is not null").groupBy(*keys, "seq").agg(last).select(*keys, "seq", "_d.*")


def unique_alerts(alerts: DataFrame, arrival: str, detector: str | None = None) -> DataFrame:
    """One alert for each window end, the last to arrive; of one detector where given."""
    chosen = alerts.where(F.col("detector") == detector) if detector else alerts
    rest = [c for c in alerts.columns if c not in (RUN, "window_end", arrival)]
    last = F.max_by(F.struct(*rest), F.col(arrival)).alias("_a")
    return chosen.where("window_end is not null").groupBy(RUN, "window_end").agg(last).select(RUN, "window_end", "_a.*")


def batch_ends(exploded: DataFrame, arrival: str, batch: str | None = None) -> DataFrame:
    """Largest sequence number of each batch ``(run_id, window_end, doc_count, arrival)``.

    A window sent in several messages needs ``batch``, the column that its parts share: they count as
    one batch, which arrives with its first part.
    """
    largest = F.max(F.coalesce(F.col("seq"), F.lit(0))).alias("max_seq")
    by = [RUN, "window_end", "doc_count"]
    if batch is None:
        return exploded.groupBy(*by, arrival).agg(largest)
    return exploded.groupBy(*by, batch).agg(F.min(arrival).alias(arrival), largest).drop(batch)


def window_end_seq(alerts: DataFrame, batches: DataFrame, arrival: str, base: str = RUN) -> DataFrame:
    """Alerts with the sequence number their window ended at.

    The batch of equal end and count decides (the last one); where there is none, the first batch
    of equal end does. Both look-ups are unique on their keys. ``base`` is the column of ``alerts`` that
    names the run of ``batches``. Of the batches, of which nearly each has a count of its own, only those that an
    alert asks for are grouped by count.
    """
    alerts = cut(alerts)
    by = [base, "window_end", "doc_count"]
    few = alerts.count() <= BROADCAST_ALERTS
    known = batches.where("window_end is not null and window_end <> 0").withColumnRenamed(RUN, base)
    asked = known.join((F.broadcast if few else fresh)(alerts.select(*by).distinct()), by, "left_semi")
    exact = asked.groupBy(*by).agg(F.max_by("max_seq", arrival).alias("_exact"))
    loose = known.groupBy(base, "window_end").agg(F.min_by("max_seq", arrival).alias("_loose"))
    both = alerts.join(fresh(exact), by, "left").join(fresh(loose), [base, "window_end"], "left")
    return both.withColumn("window_end_seq", F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def usable_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that can be evaluated, and drift documents without a start (quarantined)."""
    broken = F.col("is_drift") & F.col("drift_start").isNull()
    return docs.where(~broken), docs.where(broken)


def drift_events(docs: DataFrame, match_window: int = MATCH_WINDOW) -> DataFrame:
    """Stretches of drift documents with the same declared start; gaps do not split a stretch.

    An event begins where the start differs from that of the previous drift document. Its end is
    the drift document before the next beginning, so only beginnings have to be ordered again.
    """
    drift = docs.where("is_drift").select(RUN, "seq", "drift_start", "drift_type", "ts")
    prev = {"_prev": ("max", F.struct(F.col("seq"), F.col("drift_start")))}
    seen = running(drift, [RUN], "seq", prev, inclusive=False)
    begins = cut(seen.where(F.col("_prev").isNull() | (F.col("_prev.drift_start") != F.col("drift_start"))))
    ahead = {"_next": ("min", F.struct(F.col("seq"), F.col("_prev.seq").alias("before")))}
    linked = running(begins, [RUN], "seq", ahead, inclusive=False, descending=True)
    last = drift.groupBy(RUN).agg(F.max("seq").alias("_last"))
    return linked.join(fresh(last), RUN).select(
        RUN,
        F.col("seq").alias("first_seq"),
        F.col("drift_start").alias("start_seq"),
        F.coalesce("_next.before", "_last").alias("end_seq"),
        F.col("drift_type").alias("type"),
        F.col("ts").alias("start_ts"),
        (F.col("drift_start") + match_window).alias("match_deadline"),
    )


def sequence_states(docs: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """DRIFT, COOLDOWN or BASELINE for each document, whether it counts as baseline, and where the state may change.

    ``k`` is the rank of a non-drift document after the last drift one. A document without ``is_change`` has the
    state of the one before it, or is BASELINE with no drift before it.
    """
    is_drift = F.coalesce("is_drift", F.lit(False))
    passed = {"_k": ("since", is_drift), "_d": ("since", ~is_drift)}
    marked = running(docs.select(RUN, "seq", "is_drift"), [RUN], "seq", passed)
    k, d = F.col("_k"), F.col("_d")
    calm = k.isNull() | (k >= cooldown)
    state = F.when(F.col("is_drift"), "DRIFT").when(calm, "BASELINE").otherwise("COOLDOWN")
    counted = ~F.col("is_drift") & (k.isNull() | (k > max(cooldown, 1)))
    change = F.when(is_drift, d.isNull() | (d == 1)).otherwise(k.isNotNull() & k.isin(1, cooldown))
    return marked.select(RUN, "seq", "is_drift", state.alias("state"), counted.alias("is_counted"), change.alias("is_change"))


def run_totals(states: DataFrame) -> DataFrame:
    return states.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(~F.col("is_drift")).alias("n_nondrift"),
        F.count_if("is_counted").alias("n_baseline"),
    )


def interval_distance(seq: Column, start: Column, end: Column) -> Column:
    """0 inside the interval, else the distance to the nearer bound."""
    inside = (seq >= start) & (seq <= end)
    return F.when(inside, F.lit(0.0)).otherwise(F.least(F.abs(seq - start), F.abs(seq - end)).cast("double"))


def candidates(alerts: DataFrame, events: DataFrame, cell: int) -> DataFrame:
    """Pairs of alerts and events whose match interval holds the alert.

    Events go to each grid cell their interval touches (two for the usual width), alerts to their
    own; the join is on equal cells.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start_seq") / cell), F.floor(F.col("match_deadline") / cell)))
    gridded = fresh(events.withColumn("_cell", cells).withColumnRenamed(RUN, "_run").withColumnRenamed("_cell", "_ecell"))
    points = alerts.withColumn("_cell", F.floor(F.col("window_end_seq") / cell))
    hit = (
        (F.col(RUN) == F.col("_run"))
        & (F.col("_cell") == F.col("_ecell"))
        & (F.col("window_end_seq") >= F.col("start_seq"))
        & (F.col("window_end_seq") <= F.col("match_deadline"))
    )
    pairs = points.join(gridded, hit).drop("_run", "_cell", "_ecell")
    distance = interval_distance(F.col("window_end_seq"), F.col("start_seq"), F.col("end_seq"))
    return pairs.withColumn("distance", distance)


def match_alerts(alerts: DataFrame, events: DataFrame, match_window: int = MATCH_WINDOW) -> DataFrame:
    """Events with the alert that matched them, or null.

    Alerts take turns by window end; each takes the nearest event that is still free. This is done in
    rounds of joins, for all runs at once: an alert takes the nearest of its open events as soon as no
    earlier open alert wants that event too. None of those can take it any more, and nearer ones are
    gone, so it is what the alert's turn would give. The earliest open alert of every run, and of every
    group of overlapping events, is always settled; in practice nearly all are within a few rounds.
    """
    usable = alerts.where("window_end_seq is not null").select(RUN, "window_end", "window_end_seq", "detected_at")
    open_pairs = cut(candidates(usable, events, max(match_window, 1)).select(RUN, "window_end", "first_seq", "distance"))
    settled = open_pairs.select(RUN, "window_end", "first_seq").limit(0)
    while not open_pairs.isEmpty():
        nearest = open_pairs.groupBy(RUN, "window_end").agg(F.min(F.struct("distance", "first_seq")).alias("_e"))
        nearest = nearest.select(RUN, "window_end", F.col("_e.first_seq").alias("first_seq"))
        earliest = open_pairs.groupBy(RUN, "first_seq").agg(F.min("window_end").alias("window_end"))
        won = cut(nearest.join(fresh(earliest), [RUN, "window_end", "first_seq"]))
        settled = settled.unionByName(won)
        free = open_pairs.join(fresh(won.select(RUN, "first_seq")), [RUN, "first_seq"], "left_anti")
        open_pairs = cut(free.join(fresh(won.select(RUN, "window_end")), [RUN, "window_end"], "left_anti").select(*open_pairs.columns))
    matches = settled.join(fresh(usable), [RUN, "window_end"])
    out = events.join(fresh(matches), [RUN, "first_seq"], "left")
    verdict = {
        "matched": F.col("window_end").isNotNull(),
        "latency_docs": F.col("window_end_seq") - F.col("start_seq"),
        "latency_ms": F.col("detected_at") - F.col("start_ts"),
    }
    return cut(out.withColumns(verdict))


def false_positives(alerts: DataFrame, matched: DataFrame, states: DataFrame, base: str = RUN) -> DataFrame:
    """Unmatched alerts whose state, as of their last document, is BASELINE (also before any document).

    ``base`` is the column of ``alerts`` that names the run whose documents ``states`` describes, where
    several settings share them. Of states that tell where they change only those places are put in order.
    """
    states = states.where("is_change") if "is_change" in states.columns else states
    winners = matched.where("matched").select(RUN, "window_end")
    open_alerts = alerts.where("window_end_seq is not null").join(fresh(winners), [RUN, "window_end"], "left_anti")
    points = states.select(F.col(RUN).alias("_base"), F.col("seq").alias("_at"), "state").unionByName(
        open_alerts.select(F.col(base).alias("_base"), RUN, F.col("window_end_seq").alias("_at"), "window_end"), allowMissingColumns=True
    )
    last = F.when(F.col("state").isNotNull(), F.struct(F.col("_at"), F.col("state").alias("s")))
    seen = running(points, ["_base"], "_at", {"_last": ("max", last)}, peers=True).where("window_end is not null")
    state = F.coalesce(F.col("_last.s"), F.lit("BASELINE"))
    return seen.where(state == "BASELINE").select(RUN, "window_end", F.col("_at").alias("window_end_seq"))


def distance_measures(matched: DataFrame) -> DataFrame:
    """D1, D2 and R of each run; null where a run has no events or no detections.

    The distance of a point to the nearest interval is 0 if some interval covers it, else that to
    the nearest bound of any interval; the distance of an interval to the nearest point is 0 if the
    next point after its start is within it, else that of its bounds to their neighbours. So both
    need only the neighbours on either side, from one forward and one backward pass.
    """
    events = matched.select(RUN, "first_seq", "start_seq", "end_seq")
    detections = matched.where("matched").select(RUN, F.col("window_end_seq").alias("x")).distinct()
    ends = F.array(
        F.struct(F.col("start_seq").alias("x"), F.lit(True).alias("is_start")),
        F.struct(F.col("end_seq").alias("x"), F.lit(False).alias("is_start")),
    )
    bounds = events.select("*", F.inline(ends))
    points = bounds.unionByName(detections.withColumn("is_start", F.lit(None).cast("boolean")), allowMissingColumns=True)
    is_bound, is_hit, x = F.col("first_seq").isNotNull(), F.col("first_seq").isNull(), F.col("x")
    back = {
        "_lb": ("max", F.when(is_bound, x)),
        "_lh": ("max", F.when(is_hit, x)),
        "_cover": ("max", F.when(F.col("is_start"), F.col("end_seq"))),
    }
    ahead = {"_nb": ("min", F.when(is_bound, x)), "_nh": ("min", F.when(is_hit, x))}
    behind = running(points, [RUN], "x", back, peers=True)
    both = running(behind, [RUN], "x", ahead, peers=True, descending=True)
    near = lambda a, b: F.least(x - F.col(a), F.col(b) - x)
    d1 = F.when(F.col("_cover") >= x, F.lit(0)).otherwise(near("_lb", "_nb"))
    hits = both.where(is_hit).groupBy(RUN).agg(F.avg(d1.cast("double")).alias("d1"), F.count(F.lit(1)).alias("n_detections"))
    inside = F.col("is_start") & (F.col("_nh") <= F.col("end_seq"))
    to_hit = F.when(inside, F.lit(0)).otherwise(near("_lh", "_nh"))
    per_event = both.where(is_bound).groupBy(RUN, "first_seq").agg(F.min(to_hit).alias("_d"))
    totals = per_event.groupBy(RUN).agg(F.avg(F.col("_d").cast("double")).alias("d2"), F.count(F.lit(1)).alias("n_events"))
    ratio = F.abs(F.col("n_events") / F.col("n_detections") - 1)
    return totals.join(fresh(hits), RUN, "left").select(RUN, "d1", "d2", ratio.alias("r"))


def r_matchaware(fp: Column, tp: Column, fn: Column) -> Column:
    return (fp + fn) / F.greatest(F.lit(1), tp + fn)


def false_alarm_rate(fp: Column, non_drift: Column, baseline: Column, ignore_cooldown: bool) -> Column:
    return fp / F.greatest(F.lit(1), baseline if ignore_cooldown else non_drift)


def result_rows(matched: DataFrame, fp: DataFrame, totals: DataFrame, p: EvaluationParams = EvaluationParams()) -> DataFrame:
    """One row for each run and drift type and one total row for each run, not rounded.

    Counts and latencies of types and total come from one aggregate over grouping sets; false
    positives belong to the run, so each type's precision uses all of them.
    """
    matched_flag = F.col("matched").cast("long")
    counts = matched.groupingSets([[RUN, "type"], [RUN]], RUN, "type").agg(
        F.grouping("type").alias("_total"),
        F.sum(matched_flag).alias("tp"),
        F.sum(1 - matched_flag).alias("fn"),
        F.avg(F.when(F.col("matched"), F.col("latency_docs"))).alias("latency_docs"),
        F.avg(F.when(F.col("matched"), F.col("latency_ms"))).alias("latency_ms"),
    )
    alarms = fp.groupBy(RUN).agg(F.count(F.lit(1)).alias("fp"))
    joined = (
        counts.join(fresh(totals), RUN)
        .join(fresh(alarms), RUN, "left")
        .join(fresh(distance_measures(matched)), RUN, "left")
        .withColumn("fp", F.coalesce("fp", F.lit(0)))
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fn, alarm = F.col("tp"), F.col("fn"), F.col("fp")
    scored = joined.withColumns({"precision": ratio(tp, tp + alarm), "recall": ratio(tp, tp + fn)})
    pr = F.col("precision") + F.col("recall")
    is_total = F.col("_total") == 1
    return scored.select(
        RUN,
        F.when(is_total, GLOBAL).otherwise(F.col("type")).alias("drift_type"),
        "precision",
        "recall",
        ratio(2 * F.col("precision") * F.col("recall"), pr).alias("f1"),
        "latency_docs",
        "latency_ms",
        false_alarm_rate(alarm, F.col("n_nondrift"), F.col("n_baseline"), p.far_ignore_cooldown).alias("far"),
        "d1",
        "d2",
        "r",
        F.when(is_total & F.col("d1").isNull(), F.lit(None)).otherwise(r_matchaware(alarm, tp, fn)).alias("r_matchaware"),
        "tp",
        "fn",
        "fp",
    )


def evaluate(docs: DataFrame, alerts: DataFrame, p: EvaluationParams = EvaluationParams(), runs: DataFrame | None = None) -> DataFrame:
    """Result rows of all runs from unique documents and located, unique alerts.

    Where many settings (detectors, trigger sizes) were tried on the same documents, ``runs`` names the base run
    ``base_id`` of each ``run_id`` that alerts use, and documents come once for each base run. Events, states
    and counts are then made once for the base run and meet the settings only with the alerts.
    """
    good, _ = usable_documents(docs)
    states = cut(sequence_states(good, p.cooldown))
    events, totals, base = cut(drift_events(good, p.match_window)), run_totals(states), RUN
    if runs is not None:
        base = "base_id"
        events, totals = (df.withColumnRenamed(RUN, base).join(fresh(runs), base).drop(base) for df in (events, totals))
        alerts = alerts.join(fresh(runs), RUN)
    matched = match_alerts(alerts, events, p.match_window)
    return result_rows(matched, false_positives(alerts, matched, states, base), totals, p)


def rounded(results: DataFrame) -> DataFrame:
    """Result values as they are written: four decimals, latencies two, alarm rate six."""
    places = {"latency_docs": 2, "latency_ms": 2, "far": 6}
    names = (*RATIOS, "latency_docs", "latency_ms", "far", "d1", "d2", "r", "r_matchaware")
    return results.withColumns({n: F.round(n, places.get(n, 4)) for n in names})
