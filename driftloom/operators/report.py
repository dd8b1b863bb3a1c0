"""Summaries of result rows over seeds: means, deviations, series, pivots and winners.

Inputs are result rows ``(dataset, detector, window_type, trigger_n, drift_type, precision, ...)``
with null for a missing value. Groups are few, so every summary is one aggregate whose partial
sums are combined before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.evaluate import GLOBAL
from driftloom.operators.ordered import fresh

# Row orders, display names and decimals of the published tables.
DATASETS = ("newsgroups", "yahoo", "agnews")
DETECTORS = ("mmd", "padd")
DRIFT_TYPES = ("sudden", "gradual", "recurring")
DATASET_LABELS = {"newsgroups": "20 Newsgroups", "yahoo": "Yahoo Answers", "agnews": "AG News"}
TRIGGER = 100
ABLATION_DATASET = "newsgroups"
SEEDS = 10
FULL_METRICS = {
    "f1": 4,
    "precision": 4,
    "recall": 4,
    "far": 6,
    "latency_docs": 1,
    "latency_ms": 1,
    "d1": 2,
    "d2": 2,
    "r": 4,
}
DASH = "---"


def per_type(results: DataFrame) -> DataFrame:
    return results.where(F.col("drift_type") != GLOBAL)


def global_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("drift_type") == GLOBAL)


def mean_std(metric: str, prefix: str | None = None) -> list[Column]:
    """Mean and sample deviation over the known values; null below one and two of them."""
    name = prefix or metric
    return [F.avg(metric).alias(f"{name}_mean"), F.stddev_samp(metric).alias(f"{name}_std")]


def metric_statistics(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(*[c for m in metrics for c in mean_std(m)])


def dataset_table(results: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """F1 by drift type and mean alarm rate, one row for each known data set and detector.

    The frame of expected rows comes from the parameters above, so empty cells stay as nulls;
    ``n`` counts the rows of the last drift type that has any.
    """
    chosen = results.where(F.col("trigger_n") == trigger)
    table = chosen.groupBy("dataset", "detector").agg(
        *[
            c
            for t in DRIFT_TYPES
            for c in (
                F.avg(F.when(F.col("drift_type") == t, F.col("f1"))).alias(f"{t}_f1_mean"),
                F.stddev_samp(F.when(F.col("drift_type") == t, F.col("f1"))).alias(f"{t}_f1_std"),
                F.nullif(F.count_if(F.col("drift_type") == t), F.lit(0)).alias(f"_n_{t}"),
            )
        ],
        F.avg(F.when(F.col("drift_type") == GLOBAL, F.col("far"))).alias("far_mean"),
    )
    order = [(i * len(DETECTORS) + j, ds, det) for i, ds in enumerate(DATASETS) for j, det in enumerate(DETECTORS)]
    frame = results.sparkSession.createDataFrame(order, "row_no int, dataset string, detector string")
    seen = F.coalesce(*[F.col(f"_n_{t}") for t in reversed(DRIFT_TYPES)], F.lit(0))
    joined = frame.join(table, ["dataset", "detector"], "left").withColumn("n", seen)
    return joined.drop(*[f"_n_{t}" for t in DRIFT_TYPES])


def _summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.groupBy(*keys).agg(*mean_std("f1"), F.avg("latency_docs").alias("latency_mean"), F.avg("far").alias("far_mean"))
    return out.select(*keys, *[F.round(c, 4).alias(c) for c in ("f1_mean", "f1_std", "latency_mean", "far_mean")])


def cross_dataset_summary(results: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    return _summary(per_type(results).where(F.col("trigger_n") == trigger), ["dataset", "detector", "drift_type"])


def ablation_summary(results: DataFrame, dataset: str = ABLATION_DATASET) -> DataFrame:
    return _summary(per_type(results).where(F.col("dataset") == dataset), ["trigger_n", "detector", "drift_type"])


def full_statistics(results: DataFrame) -> DataFrame:
    """Run count, mean and deviation of every metric by detector, trigger size and drift type."""
    keys = ["detector", "trigger_n", "drift_type"]
    stats = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), *[c for m in FULL_METRICS for c in mean_std(m)])
    return stats.select(
        *keys, "n_runs", *[F.round(f"{m}_{s}", d).alias(f"{m}_{s}") for m, d in FULL_METRICS.items() for s in ("mean", "std")]
    )


def standard_error(std: Column, n: Column | int = SEEDS) -> Column:
    """Error bar of a mean; ``n`` is ten seeds unless the true count is given."""
    return std / F.sqrt(n if isinstance(n, Column) else F.lit(n))


def series(rows: DataFrame, keys: list[str], metric: str, n: Column | int = SEEDS, zero: bool = False) -> DataFrame:
    """Mean, deviation and error bar of one metric; with ``zero`` a missing one is drawn as 0."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *mean_std(metric, "value"))
    if zero:
        out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("value_mean", "value_std")})
    return out.withColumn("value_err", standard_error(F.col("value_std"), n))


def cross_dataset_f1_series(results: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    rows = per_type(results).where((F.col("trigger_n") == trigger) & F.col("dataset").isin(*DATASETS))
    return series(rows.where(F.col("drift_type").isin(*DRIFT_TYPES)), ["drift_type", "dataset", "detector"], "f1")


def _ablation_rows(results: DataFrame, dataset: str) -> DataFrame:
    return per_type(results).where((F.col("dataset") == dataset) & F.col("drift_type").isin("sudden", "gradual"))


def ablation_f1_series(results: DataFrame, dataset: str = ABLATION_DATASET) -> DataFrame:
    return series(_ablation_rows(results, dataset), ["drift_type", "trigger_n", "detector"], "f1")


def ablation_latency_series(results: DataFrame, dataset: str = ABLATION_DATASET) -> DataFrame:
    rows = _ablation_rows(results, dataset)
    return series(rows, ["drift_type", "trigger_n", "detector"], "latency_docs", zero=True)


def detector_series(results: DataFrame, detector: str = "padd", trigger: int = TRIGGER) -> DataFrame:
    rows = per_type(results).where((F.col("trigger_n") == trigger) & (F.col("detector") == detector))
    return series(rows.where(F.col("drift_type").isin("sudden", "gradual")), ["drift_type", "dataset"], "f1")


def per_seed_points(results: DataFrame, dataset: str = ABLATION_DATASET, trigger: int = TRIGGER) -> DataFrame:
    """Each run's F1 next to the mean of its group (an aggregate joined back, not one window task)."""
    rows = _ablation_rows(results, dataset).where(F.col("trigger_n") == trigger)
    means = rows.groupBy("drift_type", "detector").agg(F.avg("f1").alias("group_mean"))
    return rows.join(fresh(means), ["drift_type", "detector"])


def far_series(results: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """Alarm rate by data set from the sudden rows: the rate is the same in all rows of a run."""
    rows = results.where((F.col("trigger_n") == trigger) & (F.col("drift_type") == "sudden"))
    return series(rows, ["dataset", "detector"], "far")


def display_labels(df: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in DATASET_LABELS.items() for x in pair])
    return df.withColumns(
        {
            "dataset_label": F.coalesce(F.try_element_at(names, F.col("dataset")), F.col("dataset")),
            "detector_label": F.upper("detector"),
            "drift_label": F.initcap("drift_type"),
        }
    )


def side_by_side(summary: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Both detectors of a summary in one row: ``mmd_<metric>`` and ``padd_<metric>``."""
    picked = [F.max(F.when(F.col("detector") == d, F.col(m))).alias(f"{d}_{m}") for d in DETECTORS for m in metrics]
    present = F.count_distinct(F.when(F.col("detector").isin(*DETECTORS), F.col("detector"))) == len(DETECTORS)
    return summary.groupBy(*keys).agg(*picked, present.alias("has_both"))


def _winner(first: Column, second: Column) -> Column:
    return F.when(first, DETECTORS[0]).when(second, DETECTORS[1])


def f1_winner(a: Column, b: Column, ties_to_first: bool) -> Column:
    """The greater F1; a tie has no winner, or the first detector where asked."""
    return _winner(a >= b if ties_to_first else a > b, b > a)


def far_winner(a: Column, b: Column) -> Column:
    return _winner(a <= b, b < a)


def latency_winner(a: Column, b: Column) -> Column:
    """The lower latency; a missing one loses, two missing ones have no winner, ties to the first."""
    return _winner(a.isNotNull() & (b.isNull() | (a <= b)), b.isNotNull() & (a.isNull() | (b < a)))


def winners(summary: DataFrame, keys: list[str], ties_to_first: bool) -> DataFrame:
    """Winner of F1, latency and alarm rate in each row of a summary."""
    both = side_by_side(summary, keys, ["f1_mean", "latency_mean", "far_mean"])
    pair = lambda m: (F.col(f"mmd_{m}"), F.col(f"padd_{m}"))
    ok = F.col("has_both")
    return both.withColumns(
        {
            "f1_winner": F.when(ok, f1_winner(*pair("f1_mean"), ties_to_first)),
            "latency_winner": F.when(ok, latency_winner(*pair("latency_mean"))),
            "far_winner": F.when(ok, far_winner(*pair("far_mean"))),
        }
    )


def mean_std_cell(mean: Column, std: Column, decimals: int) -> Column:
    """``mean ± std`` with fixed decimals and dashes for what is missing."""
    cell = lambda c: F.when(c.isNull(), DASH).otherwise(F.format_string(f"%.{decimals}f", c))
    return F.concat(cell(mean), F.lit(" ± "), cell(std))
