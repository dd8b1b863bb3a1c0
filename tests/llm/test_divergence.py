from __future__ import annotations

import random

import duckdb
import numpy as np

from driftloom.llm import divergence, term_fst
from driftloom.llm.queries import OP11_SQL
from tests.llm.conftest import ODD


def walk(machine, strings):
    data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    lengths = np.array([len(s) for s in strings])
    return machine.ordinals(data, np.cumsum(lengths) - lengths, lengths).tolist()


def test_ordinals_of_a_sorted_list():
    rng = random.Random(3)
    for alphabet, most in ((b"ab", 9), (b"abc\xc3\xa9\xff", 5), (bytes(range(97, 123)), 4)):
        every = {bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, most))) for _ in range(1_500)}
        kept = sorted(s for s in every if rng.random() < 0.6)
        machine = term_fst.build(kept)
        place = {s: k for k, s in enumerate(kept)}
        asked = [*every, b"", b"zzzzzzzzzzzzzzz"]
        assert walk(machine, asked) == [place.get(s, -1) for s in asked]
    assert walk(term_fst.build([]), [b"a", b""]) == [-1, -1]
    assert walk(term_fst.build([b""]), [b"a"]) == [-1]


def test_equal_endings_share_states():
    stems = sorted(f"{a}{b}{end}".encode() for a in "abcdefgh" for b in "xyz" for end in ("tion", "tions", "ing"))
    prefixes = {s[:k] for s in stems for k in range(len(s) + 1)}
    residues = {frozenset(s[len(p) :] for s in stems if s.startswith(p)) for p in prefixes}
    assert len(term_fst.build(stems).final) == len(residues) < len(prefixes)  # minimal


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    return sorted(con.execute(OP11_SQL).fetchall())


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def some_documents(spark):
    rng = random.Random(11)
    words = ["Über", "naïve", "don't", "a1b2", "x", "Ünï", "THE", "the", "Kelvin", "ſ", "日本 語", *[f"w{'abcdefgh'[k % 8] * (k % 5 + 1)}" for k in range(60)]]
    made = []
    for k in range(700):
        lang = rng.choice(["en", "en", "de", None, "zz"])
        source = rng.choice(["hot", "hot", "hot", "b", None, "Ä", *[f"s{i}" for i in range(70)]]) if lang == "en" else rng.choice(["hot", "q"])
        text = " ".join(rng.choice(words[: 70 if source == "hot" else 20]) for _ in range(rng.randrange(40)))
        made.append((k, text if lang != "zz" else "only " + str(k), lang, source, 7))
    made += [(i, t, "odd", "odd", 1) for i, t in ODD] + [(5, "the the", "one", "alone", 1)] * 12
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, ordinal int")


def test_equal_to_sql(spark):
    docs = some_documents(spark)
    want = by_sql(docs)
    assert rows(divergence.source_divergence(docs)) == want
    # volumes of eight terms, three of them in a pass: the same counts from many transducers
    assert rows(divergence.source_divergence(docs, bits=3, pass_volumes=3)) == want
    assert {r[2] for r in want} == {"pair", "term"} and len({r[1] for r in want if r[0] == "en"}) > divergence.TILE


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.source_divergence(empty).collect() == []
    assert divergence.source_divergence(spark.createDataFrame([(1, None, None, None), (2, "a", "", "s")], empty.schema)).count() == 2
