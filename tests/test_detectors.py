"""Detectors against direct restatements of their formulas."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions.student import critical, two_sided_p
from driftloom.operators import detect as dt
from driftloom.operators import embed as em
from driftloom.operators import iforest, mmd, padd


def rows(spark, vectors, stream="s"):
    data = [(stream, i, i * 10, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "stream_id string, pos long, seq long, vec array<float>")


def plain_mmd2(x, y):
    """Loops over pairs."""
    z = [*x, *y]
    positive = [((a - b) ** 2).sum() for i, a in enumerate(z) for b in z[i + 1 :] if ((a - b) ** 2).sum() > 0]
    base, total = np.median(positive), 0.0
    for f in (0.1, 0.5, 1.0, 2.0, 10.0):
        k = lambda a, b: math.exp(-((a - b) ** 2).sum() / (2 * base * f))  # noqa: E731, B023
        xx = sum(k(a, b) for i, a in enumerate(x) for j, b in enumerate(x) if i != j) / (len(x) * (len(x) - 1))
        yy = sum(k(a, b) for i, a in enumerate(y) for j, b in enumerate(y) if i != j) / (len(y) * (len(y) - 1))
        total += xx + yy - 2 * sum(k(a, b) for a in x for b in y) / (len(x) * len(y))
    return total, base


def test_mmd_small_cases():
    value, base = mmd.mmd2(np.array([[0.0], [2.0]]), np.array([[10.0], [12.0]]))
    assert base == pytest.approx(82) and value == pytest.approx(4.331039752, abs=1e-9)
    assert mmd.score(np.array([[0.0], [2.0]]), np.array([[10.0], [12.0]])) == pytest.approx(2.081115026, abs=1e-9)
    value, base = mmd.mmd2(np.array([[0.0], [1.0]]), np.array([[0.0], [1.0]]))
    assert base == 1 and value == pytest.approx(-2.288821745, abs=1e-9)
    assert math.isnan(mmd.score(np.ones((3, 2)), np.ones((3, 2))))


@pytest.mark.parametrize("seed", range(4))
def test_mmd_equals_loops_and_is_symmetric(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(0, 1, (12, 5)), rng.normal(seed / 2, 1, (9, 5))
    y[:3] = x[:3]
    want, base = plain_mmd2(x, y)
    got, got_base = mmd.mmd2(x, y)
    assert got == pytest.approx(want, abs=1e-10) and got_base == pytest.approx(base, rel=1e-12)
    assert mmd.mmd2(y, x)[0] == pytest.approx(got, abs=1e-12) and mmd.score(x, y) >= 0


def test_student():
    assert critical(0.07, 98) == pytest.approx(1.8319245, abs=1e-6)
    assert critical(0.05, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert two_sided_p(np.array([0.0, np.inf]), 5.0).tolist() == [1.0, 0.0]


def test_degenerate_t_tests():
    p = padd.PaddParams(hidden=2, replications=3, sample_size=4)
    raw = padd.draws(p, "s", 1)
    same = padd.rejections(np.zeros((5, 2)), np.zeros((6, 2)), raw, p)
    apart = padd.rejections(np.zeros((5, 2)), np.ones((6, 2)), raw, p)
    assert (same, apart) == (0, 6)
    assert padd.PaddParams().most_rejections == 38 and padd.WELCH.most_rejections == pytest.approx(76.8)


def test_network_is_that_of_the_seed():
    rng = np.random.default_rng(42)
    first, second = rng.normal(0, 0.1, (8, 10)), rng.normal(0, 0.1, (11, 32))
    x = np.random.default_rng(0).normal(0, 1, (6, 7)).astype(np.float32)
    h = np.maximum(0, np.column_stack([x, np.ones(6)]) @ first)
    want = np.maximum(0, np.column_stack([h, np.ones(6)]) @ second)
    assert np.allclose(padd.activate(x, padd.PaddParams()), want)
    assert np.allclose(padd.activate(x, padd.SOFTMAX).sum(axis=1), 1)


def one_after_the_other(name, vectors, n, reference, p):
    """The history rule as a plain loop."""
    batches = [vectors[i : i + n] for i in range(reference, len(vectors) - n + 1, n)]
    history, found = padd.activate(vectors[:reference], p), []
    for b, batch in enumerate(batches):
        if b == 0:
            continue
        now = padd.activate(batch, p)
        count = padd.rejections(history, now, padd.draws(p, name, b), p)
        alert = count > p.most_rejections
        found.append((name, b, round(count / p.tests, 9), alert))
        history = now if alert else np.concatenate([history, now])[-p.max_history :]
    return found


@pytest.mark.parametrize("segment, max_history", [(4, 35), (256, 35), (3, 25)])
def test_history_in_segments_equals_the_loop(spark, segment, max_history):
    p = replace(padd.PaddParams(), hidden=6, replications=4, sample_size=12, max_history=max_history, theta=0.2)
    rng = np.random.default_rng(3)
    want, frames = [], None
    for name, length in (("s", 265), ("t", 81), ("short", 25)):
        steps = np.repeat(rng.normal(0, 0.8, (length // 20 + 1, 8)), 20, axis=0)[:length]
        vectors = (rng.normal(0, 1, (length, 8)) + steps).astype(np.float32)
        want += one_after_the_other(name, vectors, 10, 20, p)
        frame = rows(spark, vectors, name)
        frames = frame if frames is None else frames.unionByName(frame)
    out = padd.sequential(frames, 10, 20, p, segment).collect()
    got = [(r.stream_id, r.batch_no, round(r.score, 9), r.is_alert) for r in out]
    assert sorted(got) == sorted(want)
    assert {a for *_, a in want} == {True, False}


def test_chunks_do_not_change_scores(spark):
    vectors = np.random.default_rng(1).normal(0, 1, (330, 6))
    df = rows(spark, vectors)
    found = dt.load_detectors(["mmd", "padd_frozen", "isolation_forest"], isolation_forest={"n_trees": 5})
    small = dt.detect(df, found, 20, 40, chunk_rows=40).orderBy("detector", "batch_no").collect()
    large = dt.detect(df.repartition(5), found, 20, 40).orderBy("detector", "batch_no").collect()
    assert small == large and len(small) == 3 * 14
    assert [r.last_seq for r in small[:2]] == [590, 790]


def test_drift_is_seen(spark):
    rng = np.random.default_rng(2)
    vectors = np.vstack([rng.normal(0, 1, (160, 8)), rng.normal(1.5, 1, (60, 8))])
    found = dt.detect(rows(spark, vectors), dt.load_detectors(["mmd", "padd_frozen", "isolation_forest"]), 30, 100).collect()
    last = {r.detector: r.is_alert for r in found if r.batch_no == 3}
    first = {r.detector: r.is_alert for r in found if r.batch_no == 0}
    assert last == {"mmd": True, "padd_frozen": True, "isolation_forest": True} and not first["mmd"]


def test_guards_and_registry(spark):
    with pytest.raises(ValueError, match="no detector is called nope"):
        dt.load_detectors(["mmd", "nope"])
    with pytest.raises(ValueError, match="without their detector: padd"):
        dt.load_detectors(["mmd"], padd={})
    for name in ("padd_welch", "padd_softmax"):
        assert dt.load_detectors([name], **{name: {"theta": 0.9}})[0].params.theta == 0.9
        with pytest.raises(TypeError):
            dt.load_detectors([name], **{name: {"no_such_setting": 1}})
    df = rows(spark, np.random.default_rng(0).normal(0, 1, (60, 3)))
    assert dt.detect(df, dt.load_detectors(["mmd"]), 9, 30).count() == 0
    assert dt.detect(df, dt.load_detectors(["mmd"]), 10, 15).count() == 0
    assert dt.detect(df, dt.load_detectors(["mmd"]), 10, 30).count() == 3


def test_noise_warm_up_sets_the_threshold(spark):
    rng = np.random.default_rng(5)
    ref = rows(spark, rng.normal(3, 1, (30, 4))).select("pos", "vec")
    df = rows(spark, rng.normal(0, 1, (60, 4)))
    full = dt.shared_reference(df.select("stream_id").distinct(), ref)
    out = dt.detect(df, dt.load_detectors(["mmd"], mmd={"noise_warmup": True}), 20, 30, full).orderBy("batch_no").collect()
    x = np.array([r.vec for r in df.orderBy("pos").collect()], dtype=np.float32)
    y = np.array([r.vec for r in ref.orderBy("pos").collect()], dtype=np.float32)
    assert [r.batch_no for r in out] == [1, 2]
    assert out[0].threshold == pytest.approx(1.2 * mmd.score(x[:20], y))


def test_forest():
    rng = np.random.default_rng(0)
    inside = rng.normal(0, 1, (120, 4))
    forest = iforest.grow(inside, iforest.ForestParams(n_trees=40))
    near = iforest.score_samples(forest, np.zeros((1, 4)), 120)[0]
    far = iforest.score_samples(forest, np.full((1, 4), 8.0), 120)[0]
    assert -1 <= far < near < 0
    assert iforest.mean_path(np.array([1, 2])).tolist() == [0, 1]
    assert float(iforest.mean_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def path_by_walking(tree, row):
    feature, cut, left, path = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + int(row[feature[node]] > cut[node])
    return path[node]


def test_forest_scores_by_walking():
    rng = np.random.default_rng(1)
    ref, new = rng.normal(0, 1, (50, 3)), rng.normal(0, 2, (7, 3))
    forest = iforest.grow(ref, iforest.ForestParams(n_trees=9))
    want = [-(2 ** -(np.mean([path_by_walking(t, r) for t in forest]) / float(iforest.mean_path(50)))) for r in new]
    assert np.allclose(iforest.score_samples(forest, new, 50), want)


def test_null_trials_use_each_vector_once(spark):
    df = spark.range(100).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    trials = dt.null_trials(df, "v", "id", 15, 10)
    assert trials.select("seq").distinct().count() == 100
    assert sorted(r["count"] for r in trials.groupBy("stream_id").count().collect()) == [25] * 4


def test_embedding_and_noise(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, " "), (3, "c")], "id long, t string")
    out = {r.id: np.array(r.vec) for r in em.embed(docs, "t", em.hashing_encoder(8)).collect()}
    assert set(out) == {1, 3} and np.abs(out[1]).sum() in (1.0, 3.0)
    vocab = em.vocabulary(docs, "t")
    noise = em.noise_documents(vocab, 6, 4).collect()
    assert len(noise) == 6 and all(len(r.text.split()) == 4 for r in noise)
    assert sorted(r.word_rank for r in vocab.collect()) == [0, 1, 2]


def test_vocabulary_reads_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(f"w{i} w{i + 1}",) for i in range(60)], "t string").select(read.asNondeterministic()("t").alias("t"))
    noise = em.noise_documents(em.vocabulary(docs, "t"), 6, 4).collect()
    assert len(noise) == 6 and seen.value == 60
