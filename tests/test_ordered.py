"""Block-wise ordered scans against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftloom.operators.ordered import dense_position, range_borders, running, top_n

ROWS = [(k, o, random.Random(o * 7 + (k or 5)).randint(-50, 50)) for k in (0, 1, None) for o in random.Random(5).sample(range(-400, 4000), 90)]


@pytest.mark.parametrize("ranges", ["1", "4", "300"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_equals_loop(spark, ranges, descending, inclusive):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    df = spark.createDataFrame(ROWS, "k int, o long, v long")
    folds = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v"))}
    out = running(df, ["k"], "o", folds, descending=descending, inclusive=inclusive)
    found = {(r.k, r.o): (r.s, r.m, r.n) for r in out.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(ROWS) and set(out.columns) == {"k", "o", "v", "s", "m", "n"}
    for k in (0, 1, None):
        seen: list[int] = []
        for _, o, v in sorted((r for r in ROWS if r[0] == k), key=lambda r: r[1], reverse=descending):
            held = seen + [v] if inclusive else seen
            want = (sum(held), max(held), min(held)) if held else (None, None, None)
            assert found[(k, o)] == want
            seen.append(v)


def test_peers_see_each_other(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 5, 2), (1, 5, 3), (1, 40, 4)], "k int, o long, v long")
    out = running(df, ["k"], "o", {"s": ("sum", F.col("v"))}, peers=True)
    assert sorted((r.o, r.s) for r in out.collect()) == [(0, 1), (5, 6), (5, 6), (40, 10)]


def test_positions_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 5003).alias("o"))
    a = dense_position(df, ["k"], "o").orderBy("k", "o").collect()
    b = dense_position(df.repartition(7), ["k"], "o").orderBy("k", "o").collect()
    assert a == b and [r.pos for r in a if r.k == 0] == list(range(667))


def test_top_n_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = top_n(df, ["k"], [F.col("id").desc()], 5, ["id"])
    hot = sorted((r.rank, r.id) for r in out.where("k = 'hot'").collect())
    assert hot == [(1, 2997), (2, 2994), (3, 2991), (4, 2988), (5, 2985)]
    assert out.count() == 2000 + 5


def test_sparse_order_equals_loop(spark):
    rng = random.Random(3)
    rows = [(k, rng.getrandbits(62), rng.randint(-9, 9)) for k in (0, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, o long, v long")
    found = {(r.k, r.o): (r.s, r.p) for r in dense_position(running(df, ["k"], "o", {"s": ("sum", F.col("v"))}), ["k"], "o", "p").collect()}
    for k in (0, 1):
        total = 0
        for at, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            total += v
            assert found[k, o] == (total, at)


def test_one_exchange_and_one_read(spark, tmp_path):
    spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 5003).alias("o"), "id").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = running(df, ["k"], "o", {"s": ("sum", F.col("id")), "m": ("max", F.col("id")), "p": ("sum", F.lit(1).cast("long"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString() + "\n" + out._jdf.queryExecution().executedPlan().toString()
    physical = plan.split("AdaptiveSparkPlan", 1)[1]
    assert physical.count("FileScan") == 1 and sum("Exchange" in line and "Broadcast" not in line for line in physical.splitlines()) == 1
    total = 0
    for at, r in enumerate(out.where("k = 0").orderBy("o").collect()):
        total += r.id
        assert (r.s, r.p) == (total, at + 1)


def test_large_keys_are_cut_by_their_share(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.lit(None)).alias("k"), (F.col("id") * 7919).alias("o"))
    (hot,) = range_borders(df, ["k"], "o").collect()
    assert hot.k is None and 2 <= len(hot["_borders"]) <= 5
    counts = dense_position(df, ["k"], "o").where("k is null").agg(F.max("pos"), F.countDistinct("pos")).first()
    assert tuple(counts) == (29_999, 30_000)
    assert range_borders(df.limit(0), ["k"], "o") is None and dense_position(df.limit(0), ["k"], "o").collect() == []


def test_rows_since_a_condition(spark):
    rng = random.Random(8)
    rows = [(k, o, rng.random() < (0.01, 0.3, 0)[k]) for k in (0, 1, 2) for o in rng.sample(range(10_000), 400)]
    out = running(spark.createDataFrame(rows, "k int, o long, c boolean"), ["k"], "o", {"n": ("since", F.col("c")), "p": ("sum", F.lit(1).cast("long"))})
    found = {(r.k, r.o): (r.n, r.p) for r in out.collect()}
    for k in (0, 1, 2):
        last = None
        for at, (_, o, c) in enumerate(sorted(r for r in rows if r[0] == k)):
            last = at if c else last
            assert found[k, o] == (None if last is None else at - last, at + 1)


def test_ranges_are_found_in_as_few_steps_as_there_are_borders(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    out = dense_position(df, ["k"], "o")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.pos for r in out.orderBy("o").collect()] == list(range(2000))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "16,8,4,2,1" in plan.replace(" ", "") and "32,16" not in plan.replace(" ", "")
