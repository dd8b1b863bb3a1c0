"""Refreshed result rows after every micro-batch equal the evaluation of all that has arrived."""

from __future__ import annotations

import random

from driftloom.operators import evaluate as ev
from driftloom.streaming.refresh import ALERT, DOCUMENT, EvaluationRefresh


def test_equals_the_table_after_each_micro_batch(spark, tmp_path):
    rng = random.Random(4)
    docs, alerts = [], []
    for run in ("a", "b"):
        seq, start = 0, None
        for _ in range(150):
            seq += rng.choice((1, 1, 2))
            if rng.random() < 0.12:
                start = rng.choice((None, None, seq, seq - 2, start))
            drift = start is not None and rng.random() < 0.85
            docs.append((run, seq, drift, start if drift else None, "sudden" if drift else None, seq * 100))
        alerts += [(run, i * 15, 1, rng.randrange(10**5), rng.randrange(1, seq + 5), i) for i in range(1, 45)]
    p = ev.EvaluationParams(40, 4)
    kept = EvaluationRefresh(spark, f"{tmp_path}/kept", p)
    # the second batch brings alerts only for one run, the last repeats a document and renews an alert
    parts = [(0, 60, 0, 15, "ab"), (60, 90, 15, 30, "a"), (90, 400, 0, 45, "ab")]
    given_docs, given_alerts = [], []
    for epoch, (low, high, first, last, runs) in enumerate(parts):
        d = [r for r in docs if low <= r[1] < high and r[0] in runs] + [r for r in docs if epoch == 2 and r[0] == "b" and 60 <= r[1] < 90]
        a = [r for r in alerts if first <= r[5] < last and r not in given_alerts] + ([alerts[3][:4] + (alerts[3][4] + 1, 99)] if epoch == 2 else [])
        repeated = given_docs[-1:] if epoch == 2 else []
        given_docs, given_alerts = given_docs + d, given_alerts + a
        frames = spark.createDataFrame(d + repeated, DOCUMENT), spark.createDataFrame(a, ALERT)
        for _ in range(1 + (epoch == 1)):  # a repeated attempt changes nothing
            got = kept.apply(*frames, epoch)
        latest = {r[:2]: r for r in sorted(given_alerts, key=lambda r: r[5])}
        want = ev.evaluate(spark.createDataFrame(given_docs, DOCUMENT), spark.createDataFrame(list(latest.values()), ALERT).drop("arrival"), p)
        rounded = lambda df: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in df.select(*got.columns).collect())
        assert rounded(got) == rounded(want) and got.count() >= 2
    assert kept.table("changes", 2).count() < len(docs) / 2
