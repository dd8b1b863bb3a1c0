"""Time columns as epoch milliseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds of a long, timestamp or zone-less timestamp column."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    if kind == "timestamp_ntz":
        gap = c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        part = lambda unit: F.extract(F.lit(unit), gap)
        whole = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
        return (whole.cast("long") * 60000 + F.floor(part("SECOND") * 1000)).cast("long")
    if kind == "timestamp":
        return F.unix_millis(c)
    return c.cast("long")
