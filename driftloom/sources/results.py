"""Result files: evaluation rows as CSV, read leniently and appended with fixed rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators.evaluate import rounded

# The column order of result files.
RESULT_COLUMNS = {
    "Dataset": "dataset",
    "Detector": "detector",
    "WindowType": "window_type",
    "TriggerN": "trigger_n",
    "DriftType": "drift_type",
    "Precision": "precision",
    "Recall": "recall",
    "F1": "f1",
    "LatencyDocs": "latency_docs",
    "LatencyMs": "latency_ms",
    "FAR": "far",
    "D1": "d1",
    "D2": "d2",
    "R": "r",
    "R_matchaware": "r_matchaware",
}
METRICS = list(RESULT_COLUMNS.values())[5:]
KNOWN_DETECTORS = ("mmd", "padd")
_TEXTS = ("dataset", "detector", "window_type", "drift_type")


def clean_number(c: str | Column) -> Column:
    """A number, or null for ``nan``, blank and anything else that is none."""
    value = (F.col(c) if isinstance(c, str) else c).cast("string")
    number = F.trim(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def normalise_results(raw: DataFrame, detectors: tuple[str, ...] = KNOWN_DETECTORS) -> DataFrame:
    """Typed result rows of the known detectors from string columns; missing columns become null."""
    have = {c.lower(): c for c in raw.columns}
    text = lambda c: F.trim(F.col(have[c]).cast("string")) if c in have else F.lit(None).cast("string")
    filled = lambda c, default: F.coalesce(F.nullif(text(c), F.lit("")), F.lit(default))
    typed = raw.select(
        filled("dataset", "unknown").alias("dataset"),
        text("detector").alias("detector"),
        text("window_type").alias("window_type"),
        filled("trigger_n", "100").try_cast("int").alias("trigger_n"),
        text("drift_type").alias("drift_type"),
        *[(clean_number(have[m]) if m in have else F.lit(None).cast("double")).alias(m) for m in METRICS],
    )
    return typed.where(F.col("detector").isin(*detectors))


def read_results(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Result rows and the lines that hold none.

    Columns go by position under an explicit schema: files name 14 or 15 columns and hold 14 or 15
    values whatever they name. Lines with another number of values are returned apart.
    """
    schema = ", ".join(f"{c} string" for c in RESULT_COLUMNS.values()) + ", _line string"
    reader = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_line")
    # with pruned columns a line of the wrong length would not be noticed
    rows = reader.option("mode", "PERMISSIVE").option("columnPruning", False).csv(paths)
    older = len(RESULT_COLUMNS) - 1
    good = rows.where(F.col("_line").isNull() | (F.size(F.split("_line", ",")) == older))
    lines = spark.read.text(paths).where(F.trim("value") != "")
    bad = lines.where(~F.size(F.split("value", ",")).isin(older, older + 1)).select(F.col("value").alias("line"))
    return normalise_results(good), bad


def append_results(results: DataFrame, path: str) -> None:
    """Append rounded rows below one header a file; a missing number is written as ``nan``."""
    named = rounded(results).select(*[F.col(c).alias(n) for n, c in RESULT_COLUMNS.items()])
    named.write.mode("append").option("header", True).option("nullValue", "nan").csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("header", True).csv(path)
