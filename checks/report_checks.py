"""Result summaries over rows aggregated from ``events``, and over a full evaluation.

Each group of events stands for one run and drift type; its shares and bounds are the metrics. They
pass through the text form of result files first (``nan``, blanks, an unknown detector). Bounds
enter as square roots: means of two-decimal values can fall on a rounding tie, which the last bit
of a sum decides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import table
from checks.evaluation_checks import ALL, evaluation_sql
from checks.evaluation_checks import results as evaluated
from checks.stream_checks import d9_corpus, d9_streams
from driftloom.operators import evaluate as ev
from driftloom.operators import report as rp
from driftloom.operators.assemble import assemble_ids
from driftloom.plans.experiment import ExperimentParams, run_experiments
from driftloom.sources.results import METRICS, normalise_results

_TYPES = ("sudden", "gradual", "recurring", ev.GLOBAL)


def raw_results(spark, sf):
    """Result lines as text columns."""
    e, v = F.col("event_id"), F.col("value")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values]), (i + 1).cast("int"))
    kind = F.col("event_type")
    keyed = table(spark, sf, "events").select(
        F.when(kind.isin("click", "signup"), "newsgroups").when(kind == "purchase", "agnews").when(kind == "view", "yahoo").otherwise("").alias("dataset"),
        pick(("mmd", "padd", "other"), F.floor(e / 12) % 3).alias("detector"),
        pick(("50", "100", "200", ""), e % 4).alias("trigger_n"),
        pick(_TYPES, F.floor(e / 4) % 3 + F.when(F.col("user_id") % 4 == 0, 1).otherwise(0)).alias("drift_type"),
        (F.col("user_id") % 10).alias("seed"),
        "value",
    )
    keys = ["dataset", "detector", "trigger_n", "drift_type", "seed"]
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    sums = keyed.groupBy(*keys).agg(
        share(v > 20).alias("p"), share(v < 60).alias("q"), F.sqrt(F.max(v)).alias("hi"), F.sqrt(F.min(v)).alias("lo"), F.count(F.lit(1)).alias("n")
    )
    p, q, hi, lo = F.col("p"), F.col("q"), F.col("hi"), F.col("lo")
    late = F.when(hi > 9.5, hi)
    metrics = {
        "precision": p,
        "recall": q,
        "f1": F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0),
        "latency_docs": late,
        "latency_ms": late * 100,
        "far": lo / 1000,
        "d1": F.when(hi > 7.8, lo),
        "d2": F.when(hi > 7.8, hi),
        "r": F.abs(F.col("n") / 7 - 1),
        "r_matchaware": F.col("n") / 3,
    }
    texts = [F.coalesce(c.cast("double").cast("string"), F.lit("nan")).alias(n) for n, c in metrics.items()]
    return sums.select("dataset", "detector", F.lit("sliding").alias("window_type"), "trigger_n", "drift_type", "seed", *texts)


def results(spark, sf):
    return normalise_results(raw_results(spark, sf))


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _of(report, digits=6):
    return lambda spark, sf: _rounded(report(results(spark, sf)), digits)


def g14(spark, sf):
    labelled = rp.display_labels(rp.per_type(results(spark, sf)))
    return labelled.groupBy("dataset_label", "detector_label", "drift_label").agg(F.count(F.lit(1)).alias("n"))


def g16(spark, sf):
    won = rp.winners(rp.ablation_summary(results(spark, sf)), ["trigger_n", "drift_type"], True)
    return won.select("trigger_n", "drift_type", "mmd_latency_mean", "padd_latency_mean", "latency_winner", "far_winner")


def g17(spark, sf):
    stats = rp.metric_statistics(rp.per_type(results(spark, sf)), ["dataset", "detector", "drift_type"], ["f1", "latency_docs"])
    return stats.select(
        "dataset", "detector", "drift_type",
        rp.mean_std_cell(F.col("f1_mean"), F.col("f1_std"), 3).alias("f1_cell"),
        rp.mean_std_cell(F.col("latency_docs_mean"), F.col("latency_docs_std"), 1).alias("latency_cell"),
    )


def evaluated_rows(spark, sf):
    """Result rows of the evaluated runs, with the run name taken apart."""
    rows = evaluated(spark, sf, ALL)
    part = F.split("run_id", r"\|")
    return rows.withColumns({"dataset": part[0], "detector": part[2], "trigger_n": part[3].cast("int")})


def experiment(spark, sf):
    """Two whole runs, from corpus to result rows, as long as the corpus."""
    streams = d9_streams(spark, sf, assemble=assemble_ids)
    n = table(spark, sf, "documents").count()
    params = ExperimentParams(triggers=(50,), reference=50, evaluation=ev.EvaluationParams(n // 5, n // 40))
    return _rounded(run_experiments(streams, d9_corpus(spark, sf), params))


QUERIES = {
    "s5_read_results": lambda s, d: _rounded(results(s, d)),
    "g1_mean_std": _of(lambda r: rp.metric_statistics(r, ["detector", "drift_type"], ["f1", "latency_docs", "d1"])),
    "g2_dataset_table": _of(rp.dataset_table),
    "g3_cross_dataset_summary": _of(rp.cross_dataset_summary),
    "g3_cross_dataset_evaluated": lambda s, d: _rounded(rp.cross_dataset_summary(evaluated_rows(s, d))),
    "g4_ablation_summary": _of(rp.ablation_summary),
    "g5_full_statistics": _of(rp.full_statistics),
    "g6_standard_error": _of(lambda r: rp.series(r, ["dataset", "detector"], "f1", F.col("n_rows"))),
    "g7_cross_dataset_f1_series": _of(rp.cross_dataset_f1_series),
    "g8_ablation_f1_series": _of(rp.ablation_f1_series),
    "g9_ablation_latency_series": _of(rp.ablation_latency_series),
    "g10_detector_series": _of(rp.detector_series),
    "g11_per_seed_points": _of(lambda r: rp.per_seed_points(r).select("drift_type", "detector", "f1", "group_mean")),
    "g12_far_series": _of(rp.far_series),
    "g13_split_global": lambda s, d: rp.global_rows(results(s, d)).groupBy("detector").agg(F.count(F.lit(1)).alias("n_global")),
    "g14_display_labels": g14,
    "g15_winners": _of(lambda r: rp.winners(rp.cross_dataset_summary(r), ["dataset", "drift_type"], False)),
    "g16_latency_winners": g16,
    "g17_cells": g17,
    "experiment_grid": experiment,
}

# ---- SQL -------------------------------------------------------------------------------------

RAW_SQL = """SELECT dataset, detector, 'sliding' AS window_type, trigger_n, drift_type, seed, p AS "precision", q AS recall,
  CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1, CASE WHEN hi > 9.5 THEN hi END AS latency_docs, CASE WHEN hi > 9.5 THEN hi * 100 END AS latency_ms,
  lo / 1000 AS far, CASE WHEN hi > 7.8 THEN lo END AS d1, CASE WHEN hi > 7.8 THEN hi END AS d2, abs(n / 7.0::DOUBLE - 1) AS r, n / 3.0::DOUBLE AS r_matchaware
FROM (SELECT dataset, detector, trigger_n, drift_type, seed, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END) AS q, sqrt(max(value)) AS hi, sqrt(min(value)) AS lo, count(*) AS n
  FROM (SELECT CASE WHEN event_type IN ('click', 'signup') THEN 'newsgroups' WHEN event_type = 'purchase' THEN 'agnews' WHEN event_type = 'view' THEN 'yahoo' ELSE '' END AS dataset,
    ['mmd', 'padd', 'other'][event_id // 12 % 3 + 1] AS detector, ['50', '100', '200', ''][event_id % 4 + 1] AS trigger_n,
    ['sudden', 'gradual', 'recurring', '__GLOBAL__'][event_id // 4 % 3 + 1 + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END] AS drift_type, user_id % 10 AS seed, value FROM events)
  GROUP BY ALL)"""
RES = f"""WITH res AS (SELECT CASE WHEN dataset = '' THEN 'unknown' ELSE dataset END AS dataset, detector, window_type,
  CASE WHEN trigger_n = '' THEN 100 ELSE trigger_n::INTEGER END AS trigger_n, drift_type, {', '.join(f'"{m}"' for m in METRICS)} FROM ({RAW_SQL}) WHERE detector IN ('mmd', 'padd'))"""


def _r(e: str, name: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) AS {name}"


def _ms(metric: str, name: str | None = None, digits: int = 6) -> str:
    name = name or metric
    m = f'"{metric}"'
    return f"{_r(f'avg({m})', name + '_mean', digits)}, {_r(f'stddev_samp({m})', name + '_std', digits)}"


def _series(keys: str, metric: str, where: str, n: str = "10", zero: bool = False) -> str:
    mean, std = f"avg({metric})", f"stddev_samp({metric})"
    if zero:
        mean, std = f"coalesce({mean}, 0)", f"coalesce({std}, 0)"
    return f"{RES} SELECT {keys}, count(*) AS n_rows, {_r(mean, 'value_mean')}, {_r(std, 'value_std')}, {_r(f'{std} / sqrt({n})', 'value_err')} FROM res WHERE {where} GROUP BY {keys}"


_NOT_GLOBAL = "drift_type <> '__GLOBAL__'"
_SUMMARY = "round(avg(f1), 4) AS f1_mean, round(stddev_samp(f1), 4) AS f1_std, round(avg(latency_docs), 4) AS latency_mean, round(avg(far), 4) AS far_mean"
_ABL = f"{_NOT_GLOBAL} AND dataset = 'newsgroups'"
_SG = "drift_type IN ('sudden', 'gradual')"
_CROSS = f"SELECT dataset, detector, drift_type, {_SUMMARY} FROM res WHERE trigger_n = 100 AND {_NOT_GLOBAL} GROUP BY ALL"
_ABLATION = f"SELECT trigger_n, detector, drift_type, {_SUMMARY} FROM res WHERE {_ABL} GROUP BY ALL"


def _f1_by_type(t: str) -> str:
    return f"{_r(f'avg(f1) FILTER (drift_type = {t!r})', t + '_f1_mean')}, {_r(f'stddev_samp(f1) FILTER (drift_type = {t!r})', t + '_f1_std')}"


def _pair(metric: str) -> str:
    return f"max({metric}) FILTER (detector = 'mmd') AS mmd_{metric}, max({metric}) FILTER (detector = 'padd') AS padd_{metric}"


def _winner_sql(summary: str, keys: str, f1_first: str) -> str:
    lat = "CASE WHEN a IS NOT NULL AND (b IS NULL OR a <= b) THEN 'mmd' WHEN b IS NOT NULL AND (a IS NULL OR b < a) THEN 'padd' END"
    lat = lat.replace(" a ", " mmd_latency_mean ").replace("(a ", "(mmd_latency_mean ").replace("b IS", "padd_latency_mean IS").replace("<= b", "<= padd_latency_mean").replace("b < a", "padd_latency_mean < mmd_latency_mean")
    return f"""SELECT *, CASE WHEN has_both THEN CASE WHEN mmd_f1_mean {f1_first} padd_f1_mean THEN 'mmd' WHEN padd_f1_mean > mmd_f1_mean THEN 'padd' END END AS f1_winner,
  CASE WHEN has_both THEN {lat} END AS latency_winner,
  CASE WHEN has_both THEN CASE WHEN mmd_far_mean <= padd_far_mean THEN 'mmd' WHEN padd_far_mean < mmd_far_mean THEN 'padd' END END AS far_winner
FROM (SELECT {keys}, {_pair('f1_mean')}, {_pair('latency_mean')}, {_pair('far_mean')}, count(DISTINCT detector) = 2 AS has_both FROM ({summary}) GROUP BY ALL)"""


def _cell(metric: str, digits: int) -> str:
    one = lambda e: f"coalesce(printf('%.{digits}f', {e}), '---')"
    return f"{one(f'avg({metric})')} || ' ± ' || {one(f'stddev_samp({metric})')}"


ORACLE = {
    "s5_read_results": f"{RES} SELECT dataset, detector, window_type, trigger_n, drift_type, " + ", ".join(_r(f'"{m}"', f'"{m}"') for m in METRICS) + " FROM res",
    "g1_mean_std": f"{RES} SELECT detector, drift_type, {_ms('f1')}, {_ms('latency_docs')}, {_ms('d1')} FROM res GROUP BY ALL",
    "g2_dataset_table": f"""{RES}, t AS (SELECT dataset, detector, {', '.join(_f1_by_type(t) for t in _TYPES[:3])}, {_r("avg(far) FILTER (drift_type = '__GLOBAL__')", 'far_mean')},
  coalesce(nullif(count(*) FILTER (drift_type = 'recurring'), 0), nullif(count(*) FILTER (drift_type = 'gradual'), 0), nullif(count(*) FILTER (drift_type = 'sudden'), 0), 0) AS n
  FROM res WHERE trigger_n = 100 GROUP BY ALL)
SELECT f.*, t.* EXCLUDE (dataset, detector, n), coalesce(n, 0) AS n FROM (VALUES (0, 'newsgroups', 'mmd'), (1, 'newsgroups', 'padd'), (2, 'yahoo', 'mmd'), (3, 'yahoo', 'padd'), (4, 'agnews', 'mmd'), (5, 'agnews', 'padd')) f(row_no, dataset, detector)
LEFT JOIN t USING (dataset, detector)""",
    "g3_cross_dataset_summary": f"{RES} {_CROSS}",
    "g3_cross_dataset_evaluated": f"WITH {evaluation_sql(ALL).replace('res AS MATERIALIZED', 'res0 AS MATERIALIZED')}, res AS (SELECT *, split_part(run_id, '|', 1) AS dataset, split_part(run_id, '|', 3) AS detector, split_part(run_id, '|', 4)::INTEGER AS trigger_n FROM res0) {_CROSS}",
    "g4_ablation_summary": f"{RES} {_ABLATION}",
    "g5_full_statistics": f"{RES} SELECT detector, trigger_n, drift_type, count(*) AS n_runs, {', '.join(_ms(m, None, d) for m, d in rp.FULL_METRICS.items())} FROM res GROUP BY ALL",
    "g6_standard_error": _series("dataset, detector", "f1", "true", "count(*)"),
    "g7_cross_dataset_f1_series": _series("drift_type, dataset, detector", "f1", f"trigger_n = 100 AND {_NOT_GLOBAL} AND dataset <> 'unknown'"),
    "g8_ablation_f1_series": _series("drift_type, trigger_n, detector", "f1", f"dataset = 'newsgroups' AND {_SG}"),
    "g9_ablation_latency_series": _series("drift_type, trigger_n, detector", "latency_docs", f"dataset = 'newsgroups' AND {_SG}", zero=True),
    "g10_detector_series": _series("drift_type, dataset", "f1", f"trigger_n = 100 AND detector = 'padd' AND {_SG}"),
    "g11_per_seed_points": f"{RES} SELECT drift_type, detector, round(f1, 6) AS f1, round(avg(f1) OVER (PARTITION BY drift_type, detector), 6) AS group_mean FROM res WHERE dataset = 'newsgroups' AND trigger_n = 100 AND {_SG}",
    "g12_far_series": _series("dataset, detector", "far", "trigger_n = 100 AND drift_type = 'sudden'"),
    "g13_split_global": f"{RES} SELECT detector, count(*) AS n_global FROM res WHERE drift_type = '__GLOBAL__' GROUP BY ALL",
    "g14_display_labels": f"""{RES} SELECT CASE dataset WHEN 'newsgroups' THEN '20 Newsgroups' WHEN 'yahoo' THEN 'Yahoo Answers' WHEN 'agnews' THEN 'AG News' ELSE dataset END AS dataset_label,
  upper(detector) AS detector_label, upper(drift_type[1]) || lower(drift_type[2:]) AS drift_label, count(*) AS n FROM res WHERE {_NOT_GLOBAL} GROUP BY ALL""",
    "g15_winners": f"{RES} {_winner_sql(_CROSS, 'dataset, drift_type', '>')}",
    "g16_latency_winners": f"{RES} SELECT trigger_n, drift_type, mmd_latency_mean, padd_latency_mean, latency_winner, far_winner FROM ({_winner_sql(_ABLATION, 'trigger_n, drift_type', '>=')})",
    "g17_cells": f"{RES} SELECT dataset, detector, drift_type, {_cell('f1', 3)} AS f1_cell, {_cell('latency_docs', 1)} AS latency_cell FROM res WHERE {_NOT_GLOBAL} GROUP BY ALL",
}
