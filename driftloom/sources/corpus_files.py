"""Corpus files: one JSON object ``{text, category}`` on each line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "text string, category string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus documents; empty lines are skipped, a malformed or incomplete line ends the job."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)

    def needed(name: str):
        missing = F.raise_error(F.lit(f"corpus line without {name}")).cast("string")
        return F.when(F.col(name).isNull(), missing).otherwise(F.col(name)).alias(name)

    return rows.select(needed("text"), needed("category"))


def write_corpus(df: DataFrame, path: str, by_category: bool = False) -> None:
    """JSON lines as they are read back; with ``by_category`` as Parquet, one folder a category."""
    rows = df.select("text", "category")
    if by_category:
        rows.write.mode("overwrite").partitionBy("category").parquet(path)
    else:
        rows.write.mode("overwrite").json(path)


def read_keyword_map(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """An ordered ``{bucket: [keyword, ...]}`` object: a small settings file, not data."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def watch_directory(spark: SparkSession, path: str, schema: str = "value string", fmt: str = "text") -> DataFrame:
    """A stream of the rows of files that appear below ``path``, with file name and time.

    Spark reports new files only; changes and deletions of files are not events.
    """
    rows = spark.readStream.schema(schema).format(fmt).load(path)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )
