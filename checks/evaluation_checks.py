"""Evaluation of labelled runs derived from ``events``.

A run is (data set, seed, detector, N): data set from the event type, seed from the user. Documents
are the events of (data set, seed) in order; every 240 of them hold one drift of 80 with some gaps;
alerts are versions of six-hour windows whose last event has a high value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import table
from checks.stream_checks import ADVANCE, SIZE, hop_sql
from driftloom.functions.timecols import epoch_ms
from driftloom.operators import evaluate as ev
from driftloom.operators import windows as wn
from driftloom.operators.ordered import dense_position
from driftloom.storage import cut, shared_folder
from driftloom.streaming.refresh import ALERT, DOCUMENT, EvaluationRefresh, refresh_stream

PERIOD, FIRST, LENGTH = 240, 100, 80
PARAMS = ev.EvaluationParams(match_window=100, cooldown=20)
WIDE = ev.EvaluationParams(match_window=500, cooldown=20, far_ignore_cooldown=True)
ONE = (("mmd", 100),)
ALL = tuple((d, n) for d in ("mmd", "padd") for n in (50, 100, 200))
_TYPES = ("sudden", "gradual", "recurring")


def runs(spark, sf):
    """Documents of the base runs with their drift labels."""
    events = table(spark, sf, "events")
    kind = F.col("event_type")
    dataset = F.when(kind.isin("click", "signup"), "newsgroups").when(kind == "purchase", "agnews").otherwise("yahoo")
    base = events.select(F.concat_ws("|", dataset, F.col("user_id") % 5).alias("run_id"), "event_id", "value", epoch_ms(events, "ts").alias("ts"))
    placed = dense_position(base, ["run_id"], "event_id", "seq")
    at, cycle = F.col("seq") % PERIOD, F.floor(F.col("seq") / PERIOD)
    drift = (at >= FIRST) & (at < FIRST + LENGTH) & (F.col("event_id") % 10 != 0)
    kinds = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (cycle % 3 + 1).cast("int"))
    start = F.when(drift, cycle * PERIOD + FIRST)
    return cut(placed.withColumns({"is_drift": drift, "drift_start": start, "drift_type": F.when(drift, kinds)}))


def _variants(df, variants):
    settings = F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(n).alias("n")) for d, n in variants])
    return df.select("*", F.inline(settings)).withColumn("run_id", F.concat_ws("|", "run_id", "detector", "n"))


def exploded(spark, sf):
    """Documents once for each window they are in, windows arriving in order."""
    docs = wn.hopping(runs(spark, sf), "ts", SIZE, ADVANCE)
    return docs.withColumn("arrival", F.col("window_start")).withColumn("tag", F.col("window_start"))


def versions(base):
    slim = base.select("run_id", "seq", "ts", "value", "event_id")
    sent = wn.window_versions(wn.hopping(slim, "ts", SIZE, ADVANCE), ["run_id"], "seq", 3)
    return cut(sent.select("run_id", "window_end", "seq", "ts", "value", "event_id", F.col("document_count").alias("doc_count")))


def _labelled(base):
    return base.select("run_id", "seq", "is_drift", "drift_start", "drift_type", "ts")


def _ends(sent):
    return sent.select("run_id", "window_end", "doc_count", F.col("seq").alias("arrival"), F.col("seq").alias("max_seq"))


def _alerts(sent, variants):
    """Raw alerts of all variants; a batch that is below the limit of each does not meet them."""
    least = min(60 + n / 5 + (40 if d == "padd" else 0) for d, n in variants)
    limit = 60 + F.col("n") / 5 + F.when(F.col("detector") == "padd", 40).otherwise(0)
    odd = F.when(F.col("event_id") % 3 == 0, 1000).otherwise(0)
    return _variants(sent.where(F.col("value") > least), variants).where(F.col("value") > limit).select(
        "run_id", "detector", "window_end", (F.col("doc_count") + odd).alias("doc_count"),
        (F.col("ts") + 250).alias("detected_at"), F.col("seq").alias("arrival"),
    )


def inputs(spark, sf, variants):
    """Labelled documents, batch ends and raw alerts of all variants."""
    base = runs(spark, sf)
    sent = versions(base)
    return _variants(_labelled(base), variants).drop("detector", "n"), _ends(_variants(sent, variants)), _alerts(sent, variants)


def located(spark, sf, variants=ONE):
    docs, ends, alerts = inputs(spark, sf, variants)
    return docs, cut(ev.window_end_seq(ev.unique_alerts(alerts, "arrival"), ends, "arrival"))


def results(spark, sf, variants=ALL, params=PARAMS):
    """All variants over the documents and batches of their base runs, which come once."""
    base = runs(spark, sf)
    sent = versions(base)
    of_base = cut(_variants(base.select("run_id").distinct().withColumn("base_id", F.col("run_id")), variants).select("run_id", "base_id"))
    alerts = ev.unique_alerts(_alerts(sent, variants), "arrival").join(of_base, "run_id")
    found = ev.window_end_seq(alerts, _ends(sent), "arrival", "base_id").drop("base_id")
    return ev.evaluate(_labelled(base), cut(found), params, of_base)


def v1(spark, sf):
    docs = ev.unique_documents(exploded(spark, sf), "arrival")
    return docs.select("run_id", "seq", "event_id", "is_drift", "drift_start", "ts", "tag")


def v3(spark, sf):
    return located(spark, sf)[1].select("run_id", "window_end", "doc_count", "detected_at", "window_end_seq")


def v4(spark, sf):
    return ev.drift_events(inputs(spark, sf, ONE)[0], PARAMS.match_window)


def _states(spark, sf):
    return ev.sequence_states(inputs(spark, sf, ONE)[0], PARAMS.cooldown)


def _matched(spark, sf, params=PARAMS):
    docs, alerts = located(spark, sf)
    return docs, alerts, ev.match_alerts(alerts, ev.drift_events(docs, params.match_window), params.match_window)


def v7(spark, sf, params=PARAMS):
    columns = ["run_id", "first_seq", "start_seq", "end_seq", "type", "matched", "window_end", "latency_docs", "latency_ms"]
    return _matched(spark, sf, params)[2].select(*columns)


def v8(spark, sf):
    docs, alerts, matched = _matched(spark, sf)
    return ev.false_positives(alerts, matched, cut(ev.sequence_states(docs, PARAMS.cooldown)))


def v9(spark, sf):
    docs, alerts = located(spark, sf)
    pairs = ev.candidates(alerts.where("window_end_seq is not null"), ev.drift_events(docs, PARAMS.match_window), PARAMS.match_window)
    return pairs.select("run_id", "window_end", "first_seq", "distance")


def v10(spark, sf):
    out = ev.distance_measures(_matched(spark, sf)[2])
    return out.select("run_id", *[F.round(c, 6).alias(c) for c in ("d1", "d2", "r")])


def _columns(*names, variants=ALL, params=PARAMS):
    def query(spark, sf):
        out = results(spark, sf, variants, params)
        whole = ("tp", "fn", "fp")
        return out.select("run_id", "drift_type", *[F.col(n) if n in whole else F.round(n, 6).alias(n) for n in names])

    return query


def v13(spark, sf):
    return _columns("precision", "recall", "f1", "tp", "fn", "fp")(spark, sf).where(F.col("drift_type") == ev.GLOBAL)


def s9(spark, sf):
    return ev.rounded(results(spark, sf, ONE)).drop("tp", "fn", "fp")


def v12_stream(spark, sf):
    """Documents and alerts in three micro-batches; the rows after the last one."""
    docs, alerts = located(spark, sf)
    place = f"{shared_folder(spark)}/refreshed/{uuid.uuid4().hex}"
    longest = docs.agg(F.max("seq")).scalar() + 1
    for k in range(3):
        docs.where(F.floor(F.col("seq") * 3 / longest) == k).coalesce(1).write.mode("append").parquet(f"{place}/docs")
        alerts.withColumn("arrival", F.col("window_end_seq")).where(F.floor(F.col("window_end_seq") * 3 / longest) == k).coalesce(1).write.mode("append").parquet(f"{place}/alerts")
    one = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/{name}")
    kept = EvaluationRefresh(spark, f"{place}/kept", PARAMS)
    query = refresh_stream(one("docs", DOCUMENT), one("alerts", ALERT), kept, f"refreshed-{uuid.uuid4().hex}")
    query.awaitTermination()
    return kept.table("results", 2).select("run_id", "drift_type", *[F.round(c, 6).alias(c) for c in _REFRESHED[:-3]], *_REFRESHED[-3:])


_REFRESHED = ("precision", "recall", "f1", "latency_docs", "latency_ms", "far", "d1", "d2", "r", "r_matchaware", "tp", "fn", "fp")

QUERIES = {
    "v1_unique_documents": v1,
    "v2_unique_alerts": lambda s, d: ev.unique_alerts(inputs(s, d, ONE)[2], "arrival", "mmd").drop("detector"),
    "v3_window_end_seq": v3,
    "v4_drift_events": v4,
    "v5_sequence_states": lambda s, d: _states(s, d).select("run_id", "seq", "state"),
    "v6_baseline_counts": lambda s, d: ev.run_totals(_states(s, d)),
    "v7_match_alerts": v7,
    "v7_match_overlapping": lambda s, d: v7(s, d, WIDE),
    "v8_false_positives": v8,
    "v9_interval_distance": v9,
    "v10_distance_measures": v10,
    "v11_r_matchaware": _columns("r_matchaware", variants=ONE),
    "v12_precision_recall": _columns("precision", "recall", "f1", "tp", "fn", "fp"),
    "v12_stream_refreshed": v12_stream,
    "v13_global_rows": v13,
    "v14_latencies": _columns("latency_docs", "latency_ms", variants=ONE),
    "v15_false_alarm_rate": _columns("far"),
    "v15_far_ignoring_cooldown": _columns("far", variants=ONE, params=ev.EvaluationParams(100, 20, True)),
    "s9_result_rows": s9,
}

# ---- SQL -------------------------------------------------------------------------------------

_RUN_SQL = f"""SELECT *, CASE WHEN d THEN seq // {PERIOD} * {PERIOD} + {FIRST} END AS drift_start, d AS is_drift,
  CASE WHEN d THEN ['sudden', 'gradual', 'recurring'][seq // {PERIOD} % 3 + 1] END AS drift_type
FROM (SELECT *, seq % {PERIOD} >= {FIRST} AND seq % {PERIOD} < {FIRST + LENGTH} AND event_id % 10 <> 0 AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) - 1 AS seq FROM (
    SELECT CASE WHEN event_type IN ('click', 'signup') THEN 'newsgroups' WHEN event_type = 'purchase' THEN 'agnews' ELSE 'yahoo' END
      || '|' || user_id % 5 AS run_id, event_id, value, epoch_us(ts) // 1000 AS ts FROM events)))"""


def evaluation_sql(variants=ONE, p=PARAMS) -> str:
    """CTEs up to ``res``: the rows of :func:`results`."""
    settings = ", ".join(f"('{d}', {n})" for d, n in variants)
    w, c = p.match_window, p.cooldown
    return f"""base AS MATERIALIZED ({_RUN_SQL}), var(detector, n) AS (VALUES {settings}),
docs AS MATERIALIZED (SELECT run_id || '|' || detector || '|' || n AS run_id, seq, is_drift, drift_start, drift_type, ts FROM base, var),
ver AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, window_start ORDER BY seq) AS doc_count FROM ({hop_sql('SELECT run_id, seq, ts AS ms, ts, value, event_id FROM base')})) WHERE doc_count >= 3),
sent AS MATERIALIZED (SELECT * EXCLUDE (run_id), run_id || '|' || detector || '|' || n AS run_id FROM ver, var),
raw_alerts AS (SELECT run_id, window_end, doc_count + CASE WHEN event_id % 3 = 0 THEN 1000 ELSE 0 END AS doc_count, ts + 250 AS detected_at, seq AS arrival
  FROM sent WHERE value > 60 + n / 5 + CASE WHEN detector = 'padd' THEN 40 ELSE 0 END),
ua AS MATERIALIZED (SELECT * EXCLUDE (arrival) FROM raw_alerts QUALIFY row_number() OVER (PARTITION BY run_id, window_end ORDER BY arrival DESC) = 1),
exact AS (SELECT run_id, window_end, doc_count, max_by(seq, seq) AS x FROM sent GROUP BY ALL), loose AS (SELECT run_id, window_end, min_by(seq, seq) AS l FROM sent GROUP BY ALL),
al AS MATERIALIZED (SELECT ua.*, coalesce(x, l) AS wes FROM ua LEFT JOIN exact USING (run_id, window_end, doc_count) LEFT JOIN loose USING (run_id, window_end)),
dr AS (SELECT *, lag(drift_start) OVER (PARTITION BY run_id ORDER BY seq) IS DISTINCT FROM drift_start AS fresh FROM docs WHERE is_drift),
num AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) AS no FROM dr),
evt AS MATERIALIZED (SELECT run_id, min(seq) AS first_seq, min_by(drift_start, seq) AS start_seq, max(seq) AS end_seq, min_by(drift_type, seq) AS type, min_by(ts, seq) AS start_ts,
  min_by(drift_start, seq) + {w} AS match_deadline FROM num GROUP BY run_id, no),
isl AS (SELECT *, max(CASE WHEN is_drift THEN seq END) OVER (PARTITION BY run_id ORDER BY seq) AS lastd FROM docs),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, lastd, is_drift ORDER BY seq) AS k FROM isl),
st AS MATERIALIZED (SELECT run_id, seq, is_drift, CASE WHEN is_drift THEN 'DRIFT' WHEN lastd IS NULL OR k >= {c} THEN 'BASELINE' ELSE 'COOLDOWN' END AS state,
  NOT is_drift AND (lastd IS NULL OR k > greatest({c}, 1)) AS counted FROM rk),
tot AS (SELECT run_id, count(*) AS n_docs, count(*) FILTER (NOT is_drift) AS n_nondrift, count(*) FILTER (counted) AS n_baseline FROM st GROUP BY run_id),
hit AS (SELECT e.run_id, e.first_seq, a.window_end, a.wes, a.detected_at FROM evt e JOIN al a ON a.run_id = e.run_id AND a.wes BETWEEN e.start_seq AND e.match_deadline
  QUALIFY row_number() OVER (PARTITION BY e.run_id, e.first_seq ORDER BY a.window_end) = 1),
mat AS MATERIALIZED (SELECT e.*, h.window_end, h.wes, h.detected_at, h.window_end IS NOT NULL AS matched, h.wes - e.start_seq AS latency_docs, h.detected_at - e.start_ts AS latency_ms
  FROM evt e LEFT JOIN hit h USING (run_id, first_seq)),
fpos AS MATERIALIZED (SELECT a.run_id, a.window_end, a.wes AS window_end_seq FROM al a LEFT JOIN mat m ON m.run_id = a.run_id AND m.window_end = a.window_end
  WHERE a.wes IS NOT NULL AND m.run_id IS NULL AND coalesce((SELECT max_by(s.state, s.seq) FROM st s WHERE s.run_id = a.run_id AND s.seq <= a.wes), 'BASELINE') = 'BASELINE'),
det AS (SELECT DISTINCT run_id, wes FROM mat WHERE matched),
dst AS (SELECT m.run_id, m.first_seq, d.wes, CASE WHEN d.wes BETWEEN m.start_seq AND m.end_seq THEN 0 ELSE least(abs(d.wes - m.start_seq), abs(d.wes - m.end_seq)) END AS dist FROM mat m JOIN det d USING (run_id)),
meas AS MATERIALIZED (SELECT run_id, d1, d2, abs(ne / nd::DOUBLE - 1) AS r FROM (SELECT run_id, count(*) AS ne FROM mat GROUP BY ALL)
  LEFT JOIN (SELECT run_id, count(*) AS nd FROM det GROUP BY ALL) USING (run_id)
  LEFT JOIN (SELECT run_id, avg(m) AS d1 FROM (SELECT run_id, wes, min(dist) AS m FROM dst GROUP BY ALL) GROUP BY ALL) USING (run_id)
  LEFT JOIN (SELECT run_id, avg(m) AS d2 FROM (SELECT run_id, first_seq, min(dist) AS m FROM dst GROUP BY ALL) GROUP BY ALL) USING (run_id)),
cnt AS (SELECT run_id, CASE WHEN grouping(type) = 1 THEN '__GLOBAL__' ELSE type END AS drift_type, grouping(type) AS g, count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fn,
  avg(latency_docs) FILTER (matched) AS latency_docs, avg(latency_ms) FILTER (matched) AS latency_ms FROM mat GROUP BY GROUPING SETS ((run_id, type), (run_id))),
sc AS (SELECT c.*, coalesce(f.fp, 0) AS fp, t.n_nondrift, t.n_baseline, m.d1, m.d2, m.r,
    CASE WHEN tp + coalesce(f.fp, 0) > 0 THEN tp / (tp + coalesce(f.fp, 0))::DOUBLE ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall
  FROM cnt c JOIN tot t USING (run_id) LEFT JOIN (SELECT run_id, count(*) AS fp FROM fpos GROUP BY ALL) f USING (run_id) LEFT JOIN meas m USING (run_id)),
res AS MATERIALIZED (SELECT run_id, drift_type, "precision", recall, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1,
  latency_docs, latency_ms, fp / greatest(1, {'n_baseline' if p.far_ignore_cooldown else 'n_nondrift'})::DOUBLE AS far, d1, d2, r,
  CASE WHEN g = 1 AND d1 IS NULL THEN NULL ELSE (fp + fn) / greatest(1, tp + fn)::DOUBLE END AS r_matchaware, tp, fn, fp FROM sc)"""


def _sql(select: str, variants=ONE, p=PARAMS) -> str:
    return f"WITH {evaluation_sql(variants, p)} {select}"


def _in_turns(p) -> str:
    """Alerts that take turns, each with the list of events taken before it."""
    return f"""WITH RECURSIVE {evaluation_sql(ONE, p)},
seen AS MATERIALIZED (SELECT run_id, window_end, wes, detected_at, row_number() OVER (PARTITION BY run_id ORDER BY window_end) AS turn, ev FROM (
  SELECT a.run_id, a.window_end, any_value(a.wes) AS wes, any_value(a.detected_at) AS detected_at,
    list(e.first_seq ORDER BY CASE WHEN a.wes BETWEEN e.start_seq AND e.end_seq THEN 0 ELSE least(abs(a.wes - e.start_seq), abs(a.wes - e.end_seq)) END, e.first_seq) AS ev
  FROM evt e JOIN al a ON a.run_id = e.run_id AND a.wes BETWEEN e.start_seq AND e.match_deadline GROUP BY a.run_id, a.window_end)),
turns(run_id, turn, taken, pick) AS (
  SELECT DISTINCT run_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM seen
  UNION ALL
  SELECT t.run_id, t.turn + 1, list_concat(t.taken, list_filter(s.ev, lambda x: NOT list_contains(t.taken, x))[1:1]), list_filter(s.ev, lambda x: NOT list_contains(t.taken, x))[1]
  FROM turns t JOIN seen s ON s.run_id = t.run_id AND s.turn = t.turn + 1),
won AS (SELECT t.run_id, t.pick, s.window_end, s.wes, s.detected_at FROM turns t JOIN seen s USING (run_id, turn) WHERE t.pick IS NOT NULL)
SELECT e.run_id, first_seq, start_seq, end_seq, type, w.window_end IS NOT NULL AS matched, w.window_end, w.wes - start_seq AS latency_docs, w.detected_at - start_ts AS latency_ms
FROM evt e LEFT JOIN won w ON w.run_id = e.run_id AND w.pick = e.first_seq"""


def _res(*names: str) -> str:
    whole = ("tp", "fn", "fp")
    return "SELECT run_id, drift_type, " + ", ".join(n if n in whole else f'round("{n}", 6) AS "{n}"' for n in names) + " FROM res"


_PRF = ("precision", "recall", "f1", "tp", "fn", "fp")
_PLACES = {"latency_docs": 2, "latency_ms": 2, "far": 6}

ORACLE = {
    "v1_unique_documents": f"""WITH base AS ({_RUN_SQL}) SELECT run_id, seq, event_id, is_drift, drift_start, ts, max(window_start) AS tag
FROM ({hop_sql('SELECT *, ts AS ms FROM base')}) GROUP BY ALL""",
    "v2_unique_alerts": _sql("SELECT * FROM ua"),
    "v3_window_end_seq": _sql("SELECT run_id, window_end, doc_count, detected_at, wes AS window_end_seq FROM al"),
    "v4_drift_events": _sql("SELECT * FROM evt"),
    "v5_sequence_states": _sql("SELECT run_id, seq, state FROM st"),
    "v6_baseline_counts": _sql("SELECT * FROM tot"),
    "v7_match_alerts": _sql("SELECT run_id, first_seq, start_seq, end_seq, type, matched, window_end, latency_docs, latency_ms FROM mat"),
    "v7_match_overlapping": _in_turns(WIDE),
    "v8_false_positives": _sql("SELECT * FROM fpos"),
    "v9_interval_distance": _sql("""SELECT e.run_id, a.window_end, e.first_seq, CASE WHEN wes BETWEEN start_seq AND end_seq THEN 0.0::DOUBLE
  ELSE least(abs(wes - start_seq), abs(wes - end_seq))::DOUBLE END AS distance FROM evt e JOIN al a ON a.run_id = e.run_id AND wes BETWEEN start_seq AND match_deadline"""),
    "v10_distance_measures": _sql("SELECT run_id, round(d1, 6) AS d1, round(d2, 6) AS d2, round(r, 6) AS r FROM meas"),
    "v11_r_matchaware": _sql(_res("r_matchaware")),
    "v12_precision_recall": _sql(_res(*_PRF), ALL),
    "v12_stream_refreshed": _sql(_res(*_REFRESHED)),
    "v13_global_rows": _sql(_res(*_PRF) + " WHERE drift_type = '__GLOBAL__'", ALL),
    "v14_latencies": _sql(_res("latency_docs", "latency_ms")),
    "v15_false_alarm_rate": _sql(_res("far"), ALL),
    "v15_far_ignoring_cooldown": _sql(_res("far"), ONE, ev.EvaluationParams(100, 20, True)),
    "s9_result_rows": _sql("SELECT run_id, drift_type, " + ", ".join(f'round("{n}", {_PLACES.get(n, 4)}) AS "{n}"' for n in ("precision", "recall", "f1", "latency_docs", "latency_ms", "far", "d1", "d2", "r", "r_matchaware")) + " FROM res"),
}
