"""Batches of hot windows, which are sent in several messages, as the queries see them."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from checks import source_checks, stream_checks
from driftloom.streaming.windows import _SplitWindow

N = 10_050
HOUR = 3_600_000


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """One six-hour stretch of ``N`` clicks: four windows of two messages each."""
    path = str(tmp_path_factory.mktemp("hot"))
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    spark.range(N).select(
        F.col("id").alias("event_id"), (start + F.make_dt_interval(secs=F.col("id") % 60)).alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(f"{path}/events.parquet")
    return path


def test_documents_of_a_batch_are_put_together(spark, hot):
    rows = stream_checks.w6(spark, hot).collect()
    assert sorted(r.window_start % (6 * HOUR) for r in rows) == sorted(k * HOUR * 3 // 2 % (6 * HOUR) for k in range(4))
    for r in rows:
        assert r.document_count == N
        assert r.ids.split(",") == [str(i) for i in range(N)]


def test_inputs_of_an_evaluation_have_one_alert_a_batch(spark, hot):
    rows = source_checks.s4(spark, hot).collect()
    assert sorted((r.n_docs, r.n_alerts, r.top_score) for r in rows) == [(N, 1, float(N))] * 4


def test_messages_of_a_batch_count_as_one(spark, hot):
    rows = source_checks.s7(spark, hot).collect()
    assert len({r.window_start for r in rows}) == 4
    assert [(r.key, r.document_count) for r in rows] == [("click", N)] * 4


def test_a_batch_raises_one_alert(spark, hot):
    rows = source_checks.s8(spark, hot).collect()
    assert len({r.window_end for r in rows}) == 4
    assert [(r.detector, r.score, r.threshold, r.doc_count) for r in rows] == [("mmd", float(N), N / 2, N)] * 4


class _Held:
    """State of one key, and the clock, held in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value or []

    def update(self, value):
        self.value = value

    put = update

    def registerTimer(self, at):  # noqa: N802
        pass

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_the_parts_that_a_frame_fills_leave_in_one_frame():
    window = _SplitWindow(StructType([StructField("n", LongType())]), "n", 40, 5)
    window.handle, window.waiting, window.sent = _Held(), _Held(), _Held()
    frames = [pd.DataFrame({"n": range(start, start + 500)}) for start in (0, 500)]
    out = list(window.handleInputRows(("k", 0, 100), iter(frames), _Held()))
    assert [len(f) for f in out] == [12, 12]
    rows = pd.concat(out)
    assert rows["part"].tolist() == list(range(24)) and rows["first_index"].tolist() == list(range(0, 960, 40))
    assert rows["document_count"].tolist() == [500] * 12 + [1000] * 12 and not rows["is_last"].any()
    assert [d["n"] for docs in rows["documents"] for d in docs] == list(range(960))
    assert [n for (n,) in window.waiting.value] == list(range(960, 1000)) and window.sent.value == (24, 1000, 999)
