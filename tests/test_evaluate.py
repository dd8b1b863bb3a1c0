"""Evaluation by hand-made cases and against a plain loop over one run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators import evaluate as ev

DOCS = "run_id string, seq long, is_drift boolean, drift_start long, drift_type string, ts long"
ALERTS = "run_id string, window_end long, doc_count long, detected_at long, window_end_seq long"


def docs(spark, starts, run="r", kind="sudden"):
    rows = [(run, i, s is not None, s, kind if s is not None else None, 1000 * i) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, DOCS)


def alerts(spark, seqs, run="r"):
    rows = [(run, 10 * (i + 1), 1, d, s) for i, (s, d) in enumerate(seqs)]
    return spark.createDataFrame(rows, ALERTS)


def test_worked_case(spark):
    d = docs(spark, [None, None, 2, 2, 2, None, None, None, None, None])
    a = alerts(spark, [(4, 4500), (5, 5000), (8, 8000)])
    p = ev.EvaluationParams(3, 2)
    (event,) = ev.drift_events(d, 3).collect()
    assert (event.start_seq, event.end_seq, event.match_deadline, event.start_ts) == (2, 4, 5, 2000)
    states = {r.seq: r.state for r in ev.sequence_states(d, 2).collect()}
    assert states[5] == "COOLDOWN" and {states[s] for s in (0, 1, 6, 7, 8, 9)} == {"BASELINE"}
    assert ev.run_totals(ev.sequence_states(d, 2)).first().n_baseline == 5
    rows = {r.drift_type: r for r in ev.evaluate(d, a, p).collect()}
    total = rows[ev.GLOBAL]
    assert (total.tp, total.fn, total.fp) == (1, 0, 1)
    assert (total.precision, total.recall) == (0.5, 1.0) and total.f1 == pytest.approx(0.6667, abs=1e-4)
    assert (total.latency_docs, total.latency_ms) == (2, 2500)
    assert total.far == pytest.approx(1 / 7) and (total.d1, total.d2, total.r, total.r_matchaware) == (0, 0, 0, 1)
    again = ev.evaluate(d, a, ev.EvaluationParams(3, 2, True)).where(F.col("drift_type") == "sudden").first()
    assert again.far == pytest.approx(0.2)


def test_events_and_gaps(spark):
    found = ev.drift_events(docs(spark, [2, 2, None, None, 2, 7, 7, 2])).orderBy("first_seq").collect()
    assert [(e.start_seq, e.first_seq, e.end_seq) for e in found] == [(2, 0, 4), (7, 5, 6), (2, 7, 7)]


@pytest.mark.parametrize("cooldown, states, counted", [(0, "BBB", 2), (1, "BBB", 2), (2, "CBB", 1), (50, "CCC", 0)])
def test_cooldown_edges(spark, cooldown, states, counted):
    rows = ev.sequence_states(docs(spark, [0, None, None, None]), cooldown).orderBy("seq").collect()
    assert "".join(r.state[0] for r in rows[1:]) == states
    assert sum(r.is_counted for r in rows) == counted


def test_drift_rows_without_a_start_are_set_apart(spark):
    df = spark.createDataFrame([("r", 0, True, None, "x", 0), ("r", 1, False, None, None, 0)], DOCS)
    good, broken = ev.usable_documents(df)
    assert [r.seq for r in good.collect()] == [1] and [r.seq for r in broken.collect()] == [0]


def test_no_alerts_and_no_events(spark):
    rows = ev.evaluate(docs(spark, [None, 1, None]), alerts(spark, []).limit(0), ev.EvaluationParams(3, 1)).collect()
    assert {(r.drift_type, r.f1, r.d1, r.r_matchaware if r.drift_type == ev.GLOBAL else None) for r in rows} == {("sudden", 0.0, None, None), (ev.GLOBAL, 0.0, None, None)}
    assert {r.r_matchaware for r in rows if r.drift_type == "sudden"} == {1.0}
    assert ev.evaluate(docs(spark, [None, None]), alerts(spark, [(1, 5)]), ev.EvaluationParams(3, 1)).collect() == []


def test_window_lookup_falls_back_and_last_alert_wins(spark):
    raw = spark.createDataFrame([("r", "mmd", 60, 5, 1, 1), ("r", "mmd", 60, 7, 2, 2), ("r", "mmd", 75, 9, 3, 3), ("r", "padd", 90, 9, 4, 4), ("r", "mmd", 99, 1, 1, 5)],
                                "run_id string, detector string, window_end long, doc_count long, detected_at long, arrival long")
    ends = spark.createDataFrame([("r", 60, 6, 1, 10), ("r", 60, 7, 2, 11), ("r", 60, 7, 3, 12), ("r", 75, 4, 4, 20), ("r", 75, 5, 5, 21)],
                                 "run_id string, window_end long, doc_count long, arrival long, max_seq long")
    one = ev.unique_alerts(raw, "arrival", "mmd")
    got = {r.window_end: (r.doc_count, r.window_end_seq) for r in ev.window_end_seq(one, ends, "arrival").collect()}
    assert got == {60: (7, 12), 75: (9, 20), 99: (1, None)}


def test_only_batches_that_alerts_ask_for_are_grouped_by_count(spark):
    ends = spark.createDataFrame([("r", 60, n, n, n) for n in range(50)], "run_id string, window_end long, doc_count long, arrival long, max_seq long")
    one = spark.createDataFrame([("r", 60, 7), ("r", 60, 999)], "run_id string, window_end long, doc_count long")
    found = ev.window_end_seq(one, ends, "arrival")
    assert sorted((r.doc_count, r.window_end_seq) for r in found.collect()) == [(7, 7), (999, 0)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cooldown", [0, 1, 2, 5])
def test_states_between_their_changes_are_those_of_the_change_before(spark, cooldown):
    rng = random.Random(cooldown)
    starts = [1 if rng.random() < p else None for p in (0.0, 0.9, 0.0, 1.0, 0.1, 0.0) for _ in range(40)]
    for cut_off in (0, 45):  # without drift, and with drift, at the start
        rows = ev.sequence_states(docs(spark, starts[cut_off:]), cooldown).orderBy("seq").collect()
        state = "BASELINE"
        for r in rows:
            state = r.state if r.is_change else state
            assert r.state == state
        assert sum(r.is_change for r in rows) < sum(r.is_drift for r in rows)


def loop(doc_rows, alert_rows, window, cooldown):
    """One run, document after document and alert after alert."""
    events, states, active, last, calm, left = [], {}, None, None, 0, 0
    cooling, base = False, 0
    for d in doc_rows:
        if d["drift"]:
            cooling, left = False, 0
            if active is not None and events and d["start"] == last:
                active["end"] = d["seq"]
            elif d["start"] != last:
                active = dict(start=d["start"], end=d["seq"], ts=d["ts"], hit=None)
                events.append(active)
                last = d["start"]
            else:
                active = events[-1]
                active["end"] = d["seq"]
        else:
            if active is not None:
                active, cooling, left = None, True, cooldown
            if cooling:
                left -= 1
                cooling = left > 0
            else:
                base += 1
        states[d["seq"]] = "D" if active is not None else "C" if cooling else "B"
    gap = lambda s, e: 0 if e["start"] <= s <= e["end"] else min(abs(s - e["start"]), abs(s - e["end"]))
    false = set()
    for a in sorted(alert_rows, key=lambda a: a["end"]):
        open_events = [e for e in events if e["hit"] is None and e["start"] <= a["seq"] <= e["start"] + window]
        if open_events:
            min(open_events, key=lambda e: gap(a["seq"], e))["hit"] = a
        else:
            before = [s for s in states if s <= a["seq"]]
            if not before or states[max(before)] == "B":
                false.add(a["end"])
    hits = {e["hit"]["seq"] for e in events if e["hit"]}
    d1 = sum(min(gap(h, e) for e in events) for h in hits) / len(hits) if hits and events else None
    d2 = sum(min(gap(h, e) for h in hits) for e in events) / len(events) if hits and events else None
    return events, states, false, base, d1, d2


@pytest.mark.parametrize("window, cooldown", [(12, 3), (60, 1), (400, 7)])
def test_equals_the_loop(spark, window, cooldown):
    rng = random.Random(window)
    doc_rows, alert_rows, wanted = [], [], {}
    for run in ("a", "b", "c"):
        seq, start, mine = 0, None, []
        for _ in range(160):
            seq += rng.choice((1, 1, 1, 2))
            if rng.random() < 0.12:
                start = rng.choice((None, None, seq, seq - 3, start))
            drift = start is not None and rng.random() < 0.9
            mine.append(dict(seq=seq, drift=drift, start=start if drift else None, ts=seq * 100))
        al = [dict(end=i * 15, seq=rng.randrange(0, seq + 5), at=rng.randrange(10**5)) for i in range(1, 70)]
        wanted[run] = loop(mine, al, window, cooldown)
        doc_rows += [(run, d["seq"], d["drift"], d["start"], "sudden" if d["drift"] else None, d["ts"]) for d in mine]
        alert_rows += [(run, a["end"], 1, a["at"], a["seq"]) for a in al]
    d, a = spark.createDataFrame(doc_rows, DOCS), spark.createDataFrame(alert_rows, ALERTS)
    events = ev.drift_events(d, window)
    matched = ev.match_alerts(a, events, window)
    states = ev.sequence_states(d, cooldown)
    fps = ev.false_positives(a, matched, states).collect()
    measures = {r.run_id: (r.d1, r.d2) for r in ev.distance_measures(matched).collect()}
    found, got_states = matched.orderBy("first_seq").collect(), states.collect()
    totals = {r.run_id: r.n_baseline for r in ev.run_totals(states).collect()}
    for run, (events_, states_, false, base, d1, d2) in wanted.items():
        mine = [r for r in found if r.run_id == run]
        assert [(r.start_seq, r.end_seq, r.window_end) for r in mine] == [(e["start"], e["end"], e["hit"] and e["hit"]["end"]) for e in events_]
        assert {r.seq: r.state[0] for r in got_states if r.run_id == run} == states_
        assert {r.window_end for r in fps if r.run_id == run} == false and totals[run] == base
        assert measures[run] == (pytest.approx(d1), pytest.approx(d2))
