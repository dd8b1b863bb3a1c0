"""From stored vectors to verdicts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

from driftloom.operators.detect import Detector, detect, load_detectors, positions_by
from driftloom.operators.embed import REFERENCE_SIZE, TRIGGER_N


def detect_in_table(
    table: DataFrame,
    stream: str,
    order: Column,
    vec: str,
    seq: str,
    names: Iterable[str] | Iterable[Detector] = ("mmd",),
    n: int = TRIGGER_N,
    reference: int = REFERENCE_SIZE,
) -> DataFrame:
    """Verdicts for every trigger batch of every stream of a table of vectors."""
    names = list(names)
    detectors = load_detectors(names) if names and isinstance(names[0], str) else names
    return detect(positions_by(table, stream, order, vec, seq), detectors, n, reference)
