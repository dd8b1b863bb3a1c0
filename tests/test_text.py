from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftloom.functions import text as tx
from driftloom.operators import corpus as cp


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Mail Bob.K+x@site.org or see https://a.b/c?d=1 NOW!! 42", "mail or see now"),
        ("www.x.y Z", "z"),
        ("123 !", ""),
        (None, ""),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, tx.clean_text("t")) == want


def test_addresses_equal_the_plain_pattern(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1._@+- .c") for _ in range(40)) for _ in range(400)]
    texts += ["a@b.com_x@d.org", "a@b.com1x@d.org", "x@@a.bc", "a@b.c", "é_a@b.cd"]
    plain = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(F.regexp_replace("t", plain, "#").alias("a"), F.regexp_replace("t", tx._linear(plain), "#").alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_long_runs_are_linear(spark):
    assert one(spark, "x" * 300_000 + " y", tx.clean_text("t")) == "x" * 300_000 + " y"


def test_compose_keeps_the_space_of_an_empty_part(spark):
    row = spark.createDataFrame([(" a ", None, "b\n")], "x string, y string, z string")
    assert row.select(tx.compose_text("x", "y", "z")).first()[0] == "a  b"


@pytest.mark.parametrize(
    "raw, want",
    [("a\r\nb<br />c  d ", "a b c d"), (None, ""), ("  ", "")],
)
def test_breaks(spark, raw, want):
    assert one(spark, raw, tx.normalise_breaks("t")) == want


def test_latex_and_blank_lines(spark):
    assert one(spark, r"We prove $x^2$ that \emph{all} \alpha  hold.", tx.strip_latex("t")) == "We prove that hold."
    assert one(spark, "a\n\n\n\nb   c \n", tx.collapse_blank_lines("t")) == "a\n\nb c"


@pytest.mark.parametrize(
    "raw, want",
    [("math-ph cs.LG", "arxiv_math"), ("q-bio.NC", "arxiv_qbio"), ("hep-th", None), ("stat.ML cs.LG", "arxiv_stat"), ("", None)],
)
def test_prefixes(spark, raw, want):
    assert one(spark, raw, tx.classify_by_prefix("t", cp.ARXIV_PREFIXES)) == want


def test_keywords_take_the_first_bucket_and_literal_text(spark):
    buckets = {"a": ["hip-hop", "c++"], "b": ["rock", "(x)"]}
    rule = lambda title: tx.classify_by_keywords(F.lit(title), F.col("t"), buckets)
    assert one(spark, "rock and Hip-Hop", rule("")) == "a"
    assert one(spark, "see (X)", rule("")) == "b"
    assert one(spark, "ccc", rule("C++")) == "a"
    assert one(spark, "z" * 500 + " rock", rule("")) is None


@pytest.mark.parametrize("raw, want", [("!!!", []), ("", [""]), (" Aa b-b! ", ["", "aa", "b", "b"]), ("x", ["x"])])
def test_words(spark, raw, want):
    assert one(spark, raw, tx.split_words("t")) == want


def test_cap_takes_input_order_and_skips_are_counted(spark):
    df = spark.createDataFrame([(i, "x" * (40 + 10 * (i % 3)), "c" if i % 2 else "d") for i in range(20)], "id long, t string, c string")
    assert sorted(r.id for r in cp.cap_per_bucket(df, "c", "id", 2).collect()) == [0, 1, 2, 3]
    assert tuple(cp.skipped_short(df, "t", 50).first()) == (13, 7)


def test_unmapped_labels_go(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (9,), (None,)], "label int")
    assert sorted(r.category for r in cp.map_label(df, "label", cp.AGNEWS_LABELS).collect()) == ["agnews_scitech", "agnews_world"]


def test_bad_json_lines_go(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("{oops",), ("[]",), ('{"a": 2, "b": 3}',)], "value string")
    assert sorted(r.a for r in cp.parse_or_skip(lines, "a long").collect() if r.a is not None) == [1, 2]
