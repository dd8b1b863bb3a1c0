from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import source_checks
from driftloom.operators import report as rp
from driftloom.sources import corpus_files, topics
from driftloom.sources.results import RESULT_COLUMNS, append_results, read_results
from driftloom.storage import cut

HEADER = ",".join(list(RESULT_COLUMNS)[:14])


@pytest.fixture()
def result_file(tmp_path):
    path = tmp_path / "results.csv"
    lines = [
        HEADER,
        "newsgroups,mmd,sliding,100,sudden,0.25,0.8,0.381,77.5,9050.0,0.004,3.5,118.25,4.0,2.5",
        "newsgroups,mmd,sliding,100,sudden,1.0,1.0,1.0,nan,nan,0.003,nan,nan,nan,0.0",
        "newsgroups,padd,sliding,100,sudden,0.0,0.0,0.0,nan,,x,0.0,1.0,2.0",
        "",
        ",mmd,sliding,,__GLOBAL__,0.75,0.6,0.6667,61.0,7120.0,0.006,1.25,95.5,3.0,1.75",
        "yahoo,isolation_forest,sliding,100,sudden,1,1,1,1,1,1,1,1,1,1",
        "a,mmd,sliding,50,sudden,1,1,1,1,1,1,1,1,1,1,1b,mmd,sliding,50,gradual,1,1,1,1,1,1,1,1,1,1",
    ]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_results_are_read_leniently(spark, result_file):
    good, bad = read_results(spark, result_file)
    rows = good.orderBy("dataset", "detector", "f1").collect()
    assert [(r.dataset, r.detector, r.trigger_n, r.f1) for r in rows] == [
        ("newsgroups", "mmd", 100, 0.381),
        ("newsgroups", "mmd", 100, 1.0),
        ("newsgroups", "padd", 100, 0.0),
        ("unknown", "mmd", 100, 0.6667),
    ]
    assert rows[1].latency_docs is None and rows[1].d1 is None
    assert (rows[2].latency_ms, rows[2].far, rows[2].r, rows[2].r_matchaware) == (None, None, 2.0, None)
    assert len(bad.collect()) == 1


def test_summaries(spark, result_file):
    good, _ = read_results(spark, result_file)
    (mmd, padd) = rp.cross_dataset_summary(good).orderBy("detector").collect()
    assert (mmd.f1_mean, mmd.f1_std, mmd.latency_mean, mmd.far_mean) == (0.6905, 0.4377, 77.5, 0.0035)
    assert padd.f1_std is None and padd.latency_mean is None
    table = rp.dataset_table(good).orderBy("row_no").collect()
    assert [(r.dataset, r.detector) for r in table][:3] == [("newsgroups", "mmd"), ("newsgroups", "padd"), ("yahoo", "mmd")]
    assert [r.n for r in table] == [2, 1, 0, 0, 0, 0] and table[2].sudden_f1_mean is None
    zero = rp.ablation_latency_series(good).where("detector = 'padd'").first()
    assert (zero.value_mean, zero.value_std, zero.value_err) == (0, 0, 0)


def test_winners(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, None, 90.0), (2, 0.5, 0.6, None, None), (3, 0.7, 0.6, 80.0, 80.0)], "k int, a double, b double, x double, y double")
    a, b, x, y = (F.col(c) for c in "abxy")
    rows = df.select("k", rp.f1_winner(a, b, False).alias("cross"), rp.f1_winner(a, b, True).alias("abl"), rp.latency_winner(x, y).alias("lat"), rp.far_winner(a, b).alias("far")).orderBy("k").collect()
    assert [tuple(r)[1:] for r in rows] == [(None, "mmd", "padd", "mmd"), ("padd", "padd", None, "mmd"), ("mmd", "mmd", "mmd", "padd")]


def test_cells(spark):
    df = spark.createDataFrame([(0.12345, None)], "m double, s double")
    assert df.select(rp.mean_std_cell(F.col("m"), F.col("s"), 3)).first()[0] == "0.123 ± ---"


def test_results_round_trip(spark, result_file, tmp_path):
    good, _ = read_results(spark, result_file)
    path = str(tmp_path / "out")
    append_results(good, path)
    append_results(good, path)
    again, bad = read_results(spark, path)
    assert again.count() == 2 * good.count() and bad.count() == 0
    assert sorted(map(str, again.dropDuplicates().collect())) == sorted(map(str, good.dropDuplicates().collect()))
    assert any("nan" in line.value for line in spark.read.text(path).collect())


def test_corpus_files(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text('{"text": "a é", "category": "x"}\n\n{"text": "b", "category": "y"}\n')
    df = corpus_files.read_corpus(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [("a é", "x"), ("b", "y")]
    out = str(tmp_path / "out")
    corpus_files.write_corpus(df, out)
    assert "é" in "".join(r.value for r in spark.read.text(out).collect())
    path.write_text('{"text": "a"')
    with pytest.raises(Exception):
        corpus_files.read_corpus(spark, str(path)).collect()
    path.write_text('{"text": "a"}\n')
    with pytest.raises(Exception, match="without category"):
        corpus_files.read_corpus(spark, str(path)).collect()


def test_keyword_map_keeps_its_order(spark, tmp_path):
    path = tmp_path / "keywords.json"
    path.write_text('{"z": ["a b"], "a": ["c"]}')
    assert list(corpus_files.read_keyword_map(spark, str(path)).items()) == [("z", ["a b"]), ("a", ["c"])]


def test_messages(spark):
    raw = spark.createDataFrame([("d", 1, "t", "c", 0, False, None, None)], "docId string, timestamp long, text string, sourceCategory string, sequenceNumber long, driftLabel boolean, driftType string, driftStartTs long")
    (row,) = topics.raw_messages(raw).collect()
    assert row.key == "c" and "driftType" not in row.value
    batches = spark.createDataFrame([('{"documentCount": 0}',), ("{bad",), ('{"documentCount": 2, "windowEnd": 9, "documents": []}',)], "value string")
    assert [r.windowEnd for r in topics.read_batches(batches).collect()] == [9]
    both = batches.withColumn("topic", F.lit(topics.BATCH_TOPIC)).unionByName(spark.createDataFrame([('{"detector": "mmd", "windowEnd": 5}', topics.ALERT_TOPIC), ('{"detector": "padd"}', topics.ALERT_TOPIC)], "value string, topic string"))
    filled, alerts = topics.read_evaluation_inputs(both, "mmd")
    assert filled.count() == 0 and [r.windowEnd for r in alerts.collect()] == [5]


def test_cut_and_small(spark):
    df = spark.range(100)
    assert cut(df).count() == 100


def test_watched_files_grow_in_number(spark, tmp_path, monkeypatch):
    spark.range(4000).select(F.concat(F.lit("text "), F.repeat(F.md5(F.col("id").cast("string")), 20)).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(source_checks, "_folder", lambda spark, name, seen=iter(("watched", "out")): f"{tmp_path}/{next(seen)}")
    small = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        assert source_checks.s12(spark, str(tmp_path)).where("has_file and has_time").select("text_md5").distinct().count() == 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [f.stat().st_size for f in (tmp_path / "watched").glob("part-*.json")]
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4
