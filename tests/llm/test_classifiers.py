from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import language, quality, toxicity
from driftloom.llm.queries import op1_toxicity, op8_language, op10_quality
from tests.llm.conftest import ODD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term("moron", False, 0.9), toxicity.Term("pathetic", False, 1.0), toxicity.Term("bad", False, 0.8), toxicity.Term("scumbag", True, 0.7)]
    matcher, rng = toxicity.Matcher(terms), random.Random(2)

    def plain(word):
        best = 0.0
        for t in terms:
            ends = range(len(word) + 1) if t.stem else [len(word)]
            edits = min(distance(word[:e], t.text) for e in ends)
            if edits <= toxicity.edits_allowed(t):
                best = max(best, t.weight * toxicity.EDIT**edits)
        return best

    for _ in range(3000):
        word = list(rng.choice(terms).text)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choices("abmorscu1", k=rng.randint(0, 2))
        word = "".join(word)
        assert matcher.credit(word) == pytest.approx(plain(word)), word


def test_quotation_counts_less_than_abuse():
    matcher = toxicity.Matcher([toxicity.Term("moron", False, 1.0)], frozenset({"maron"}))
    best = {t: toxicity.features(t, matcher, {})[0][0] for t in ("you moron", 'they said "moron" there', "you mor0n", "a maron tree", "the word “moron” is rude")}
    assert best["you moron"] == 1 and best["you mor0n"] == toxicity.EDIT and best["a maron tree"] == 0
    assert max(best['they said "moron" there'], best["the word “moron” is rude"]) <= 0.4


def test_toxic_terms_are_learnt(spark, documents, labels):
    rng = random.Random(1)
    words = ["".join(rng.choices("thernoa", k=rng.randint(2, 6))) for _ in range(80)]
    rows, marks = [], []
    for i in range(300):
        text = rng.choices(words, k=30)
        if i % 5 == 0:
            text[rng.randrange(30)] = rng.choice(["wretch", "scoundrel", "kloon" + "".join(rng.choices("aeiou", k=3))])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(i % 5 == 0)))
    model = toxicity.learn(documents(rows), labels([*marks, (7, 1, None), (None, 1, 1)]), F.col("doc_id") % 7 != 0)
    assert {"wretch", "scoundrel"} <= {t.text for t in model.terms} and any(t.stem and "kloon".startswith(t.text[:4]) for t in model.terms)
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(documents([*rows, (900, "a scoundrell here"), (901, None), (902, "")]), model).collect()}
    wrong = sum((out[i] >= 0.5) != bool(t) for i, _, t in marks)
    assert wrong <= 6 and out[900] >= 0.5 and out[901] == out[902] < 0.5


def test_rare_toxic_terms_are_learnt_among_many_harmless_ones(spark, documents, labels):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(3500)})
    mixed = lambda: rng.sample(words, len(words))
    rows = [(i, " ".join(mixed())) for i in range(6)] + [(10 + i, " ".join([*mixed(), "vermin"] if i < 3 else mixed())) for i in range(6)] + [(100 + i, f"calm {i}") for i in range(60)]
    model = toxicity.learn(documents(rows), labels([(i, 1, int(10 <= i < 20)) for i, _ in rows]), F.lit(True))
    assert {t.text for t in model.terms} == {"vermin"}


def test_without_labels_and_odd_rows(spark, documents, labels):
    docs, none = documents(ODD), labels([])
    tox = toxicity.score_toxicity(docs, toxicity.learn(docs, none, F.lit(True))).collect()
    qua = quality.score_quality(docs, quality.learn(docs, none, F.lit(True))).collect()
    lan = language.predict_language(docs, language.learn(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))).collect()
    assert len(tox) == len(qua) == len(lan) == len(ODD)
    assert {r.score for r in qua} == {0.5} and {r.lang_pred for r in lan} == {"und"} and max(r.score for r in tox) < 1e-9
    empty = documents([])
    assert toxicity.score_toxicity(empty, toxicity.learn(empty, none, F.lit(True))).count() == 0


def prose_and_boilerplate(rng):
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    prose = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    chrome = lambda: " | ".join(word().upper() for _ in range(4)) + " >> " + str(rng.randint(10, 99))
    return prose, chrome


def test_lines_of_one_text_are_told_apart(documents, labels):
    rng = random.Random(8)
    prose, chrome = prose_and_boilerplate(rng)
    rows, marks = [], []
    for i in range(240):
        # a good text has a line in six of the other kind, a bad one two
        kinds = [i % 2 == 0] * 5 + [i % 2 == 1] if i % 3 else [i % 2 == 0] * 4 + [i % 2 == 1] * 2
        rng.shuffle(kinds)
        rows.append((i, "\n".join(prose() if good else chrome() for good in kinds)))
        marks.append((i, int(i % 2 == 0), 0))
    model = quality.learn(documents(rows), labels(marks), F.lit(True))
    truth, texts = [], []
    for k in range(40):
        halves = [True] * 6 + [False] * 6 if k % 2 else [False] * 6 + [True] * 6
        truth += halves
        texts.append("\n".join(prose() if good else chrome() for good in halves))
    p, _, lengths = quality.good_lines(texts, model)
    assert lengths.tolist() == [12] * 40 and np.mean((p >= 0.5) == np.array(truth)) >= 0.95
    share = np.add.reduceat(p >= 0.5, np.arange(0, len(p), 12))
    assert all(4 <= n <= 8 for n in share)
    extra = [(500, texts[0]), (501, "\n\n\n"), (502, "a\n" * 50_000)]
    out = {r.doc_id: r for r in quality.score_quality(documents([*ODD, *extra]), model).collect() if r.doc_id is not None}
    assert all(0 <= r.score <= 1 for r in out.values())
    assert 4 <= out[500].good_lines <= 8 and out[501].good_lines == 0 and out[501].score == model.prior


def test_chain_equals_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4, 2])
    emission, step = rng.normal(size=(10, 2)), rng.normal(size=(2, 2))
    p, pairs = quality.forward_backward(emission, lengths, step)
    expected, expected_pairs, at = np.zeros((10, 2)), np.zeros((2, 2)), 0
    for n in lengths:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([np.exp(sum(emission[at + t, y] for t, y in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path))) for path in paths])
        for path, w in zip(paths, weight / weight.sum(), strict=True):
            for t, y in enumerate(path):
                expected[at + t, y] += w
            for a, b in itertools.pairwise(path):
                expected_pairs[a, b] += w
        at += n
    assert np.allclose(p, expected) and np.allclose(pairs, expected_pairs)


def test_document_frequencies_count_texts(documents):
    texts = ["abc abc", "abc", "", None, "xyz"]
    counts, n = language.document_frequencies(documents(list(enumerate(texts))))
    plain = np.zeros(language.DIMENSIONS)
    for t in texts:
        plain[np.unique(language.grams([t or ""])[0])] += 1
    assert n == 5 and (counts == plain).all()


def test_grams_do_not_cross_texts():
    together, owner, letters = language.grams(["ab1", "", "cd e"])
    for k, t in enumerate(["ab1", "", "cd e"]):
        assert sorted(together[owner == k]) == sorted(language.grams([t])[0])
    assert letters.tolist() == [2, 0, 3]


def test_every_language_is_learnt_and_odd_rows_have_a_result(spark, documents):
    rng = random.Random(3)
    alphabets = {f"l{k:03d}": [chr(0x4E00 + 8 * k + j) for j in range(8)] for k in range(210)}
    rows = [(i, "".join(rng.choices(a, k=40)), lang, "src", 1, 0.0, "", 0.0) for lang, a in alphabets.items() for i in (int(lang[1:]), 1000 + int(lang[1:]))]
    rows += [(5, "repeated id", "l005", "src", 1, 0.0, "", 0.0)] * 50
    model = language.learn(spark.createDataFrame(rows, documents([]).schema), F.col("doc_id") >= 0)
    assert model.languages == sorted(alphabets)
    out = language.predict_language(documents([*ODD, (99, "".join(alphabets["l207"])), (98, "12 34!")]), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD) + 2 and by[99].lang_pred == "l207"
    assert {by[i].lang_pred for i in (1, 2, 3, 8, 98)} == {"und"} and {by[i].score for i in (1, 2, 3, 8, 98)} == {0.0}
    assert all(0 <= r.score <= 1 for r in out)


def held_out(spark, sf, rows, column):
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/{'labels' if column != 'lang' else 'documents'}.parquet").collect()}
    return [(truth[r.doc_id], r) for r in rows if r.held_out and r.doc_id in truth]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    for query, column in ((op1_toxicity, "toxic"), (op10_quality, "quality")):
        rows = query(spark, sf).collect()
        pairs = held_out(spark, sf, rows, column)
        assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
        assert np.mean([y == r.predicted for y, r in pairs]) >= 0.9
    pairs = held_out(spark, sf, op8_language(spark, sf).collect(), "lang")
    assert np.mean([y == r.lang_pred for y, r in pairs]) >= 0.97
