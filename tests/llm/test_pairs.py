from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom import storage
from driftloom.llm import bpe, decontaminate, jaccard, shards, topk
from driftloom.llm.common import held
from driftloom.llm.groups import components
from driftloom.llm.queries import op2_top_products, op3_shards, op9_decontaminate
from tests.llm.conftest import ODD


def family(rng, n, words=60, edits=2):
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = "".join(rng.choices("xyz", k=5))
        out.append(" ".join(text))
    return out


def plain_links(texts):
    sets = [set(jaccard.shingles(t or "").tolist()) for t in texts]
    links = defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            both = len(sets[i] & sets[j])
            if same or both and both * 10 >= 8 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


def check_links(documents, rows):
    out = jaccard.near_duplicates(documents(rows)).collect()
    links = plain_links([t for _, t in rows])
    part = list(range(len(rows)))
    for i in links:
        for j in links[i]:
            a, b = part[i], part[j]
            part = [a if p == b else p for p in part]
    name = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in part}
    expected = [(rows[i][0], name[part[i]], len(links[i])) for i in range(len(rows))]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.class_id, r.n_links)) for r in out)


def test_links_equal_brute_force(documents):
    rng = random.Random(8)
    texts = [t for n in (12, 5, 3, 1) for t in family(rng, n)] + family(rng, 6, words=7, edits=1)
    passage = " ".join(family(rng, 1, words=40))
    texts += [passage + " " + " ".join("".join(rng.choices("klmnop", k=6)) for _ in range(80)) for _ in range(12)]
    check_links(documents, [*enumerate(texts, 100), *ODD, (50, texts[0]), (51, "one two"), (52, "One  TWO!"), (53, "!!"), (54, "??")])


def test_blocks_give_the_same_links(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    check_links(documents, list(enumerate(family(random.Random(9), 30))))


def test_one_of_each(documents):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, None), (10, ""), (4, "else here now")]
    docs = documents(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 9]
    assert jaccard.one_of_each(documents([])).count() == 0


def test_one_of_each_with_null_and_repeated_ids(documents):
    rng = random.Random(21)
    hidden, shared, apart = (family(rng, n, words=250) for n in (4, 3, 2))
    rows = [(None, t) for t in hidden] + [(None, hidden[0])] + [(7, shared[0]), (7, shared[1]), (8, shared[2])]
    rows += [(3, apart[0]), (None, apart[1]), (7, "quite another text")]
    kept = jaccard.one_of_each(documents(rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "7", "7", "None"]
    assert {r.text for r in kept if r.doc_id == 3} == {apart[0]} and "quite another text" in {r.text for r in kept}


def test_few_edges_go_to_few_files(spark, monkeypatch):
    """Each file of a checkpoint costs its executor a process or two, however few rows it has."""
    sizes = []
    monkeypatch.setattr("driftloom.llm.groups.cut", lambda df, rows=None, cut=storage.cut: (out := cut(df, rows), sizes.append(out.rdd.getNumPartitions()))[0])
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "30"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(40).where("id % 10 < 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = {r.node: r.component for r in components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i // 10 * 10 for i in range(40)}
    assert len(sizes) > 5 and sizes[1:] == [1] * (len(sizes) - 1)


def test_a_worker_keeps_the_memory_of_one_operator():
    jaccard.shingles("one two three")
    assert held(jaccard.__name__)["words"]
    held(bpe.__name__)["words"] = "kept"
    held(bpe.__name__)
    assert held(bpe.__name__) == {"words": "kept"}
    assert held(jaccard.__name__) == {} and held(bpe.__name__) == {}


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_and_rows(0.8, 0.9999)
    p = 0.8**rows
    assert 1 - (1 - p) ** bands - bands * p * (1 - p) ** (bands - 1) >= 0.9999 and bands * rows <= jaccard.HASHES


def test_passages_with_replaced_words(spark, documents):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=4)) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate((40, 30, 20, 8, 5, 3))] + [(90, None), (91, "")]
    changed = items[0][1].split()
    changed[7] = changed[19] = changed[33] = "zzzz"
    rows = [
        (1, " ".join([*words(50), *changed, *words(20)])),
        (2, "x " + items[1][1].upper().replace(" ", ", ") + " y"),
        (3, " ".join([*words(9), items[3][1], *words(9)])),
        (4, items[4][1]),
        (5, " ".join(words(200))),
        (9, f"so so {items[5][1]} {items[5][1].replace(' ', ' and ')} it {items[5][1]}"),
        (6, " ".join(items[0][1].split()[:10])),
        (2, "x " + items[1][1].upper().replace(" ", ", ") + " y"),
        *ODD,
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    found = decontaminate.find_passages(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.matched, r.at) for r in found.collect()) == [(1, 0, 37, 50), (2, 1, 30, 1), (3, 3, 8, 9), (4, 4, 5, 0), (9, 5, 3, 2)]
    kept = decontaminate.without_passages(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 6
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0 and decontaminate.find_passages(documents([]), bench).count() == 0


def test_excerpts_and_cut_items_are_found(spark, documents):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    long, longest, broken, short, third = (words(n) for n in (64, 500, 45, 20, 64))
    weak = [w if i in (0, 1, 3, 4, 6, 7, 9, 11) else "zz" for i, w in enumerate(short[:12])]
    rows = [
        (1, [*words(30), *long[20:45], *words(30)]),
        (2, [*words(30), *longest[100:250], *words(30)]),
        (3, [*words(9), *broken[:15], "xx", *broken[15:30], "yy", *broken[30:], *words(9)]),
        (4, [*words(20), *weak, *words(20)]),
        (5, [*words(20), *(w if i % 5 else "zz" for i, w in enumerate(third)), *words(20)]),
        (6, [*words(20), *long[:8], *words(20)]),
        (7, [*words(20), *broken[:10], "xx", *broken[11:14], *words(20), *broken[20:33], *words(20)]),
    ]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((long, longest, broken, short, third))], "item_id long, text string")
    found = decontaminate.find_passages(documents([(i, " ".join(w)) for i, w in rows]), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.matched, r.at) for r in found) == [(1, 0, 25, 10), (2, 1, 150, -70), (3, 2, 45, 9), (5, 4, 51, 20), (7, 2, 26, 20)]


@pytest.mark.parametrize("most", [0, decontaminate.BROADCAST_SEEDS])
def test_items_by_their_words(spark, documents, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    a, b, c = words(20), words(30), words(25)
    bench = spark.createDataFrame([(1, a), (1, b), (None, c), (4, "unlikely"), (5, "two words"), (6, a)], "item_id long, text string")
    rows = [(1, words(9) + " " + a), (2, b), (None, c), (None, c), (4, "an Unlikely end"), (5, "of two words"), (6, "of two of words")]
    found = decontaminate.find_passages(documents(rows), bench).collect()
    expected = [(1, 1, 20, 9), (1, 6, 20, 9), (2, 1, 30, 0), (None, None, 25, 0), (4, 4, 1, 1), (5, 5, 2, 1)]
    assert sorted(map(str, ((r.doc_id, r.item_id, r.matched, r.at) for r in found))) == sorted(map(str, expected))
    assert decontaminate.without_passages(documents([*rows, *rows]), bench).count() == 2


def test_seeds_join_without_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert [r.matched for r in decontaminate.find_passages(documents([(1, text), (2, "no")]), bench).collect()] == [14]


def test_words_of_texts_are_made_once(spark, documents):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = decontaminate.find_passages(documents([(1, text), (2, "no"), (3, None)]), bench)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # no filter on their number below the projection that makes them, no second hash to see that it is not null
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract_all" in x and ">= 12" in x]
    assert "isnotnull(CASE" not in plan
    assert [(r.doc_id, r.matched) for r in found.collect()] == [(1, 14)]


def test_texts_are_not_moved_to_drop_some(spark, documents, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = documents([(1, text), (1, text), (None, "x " + text), (2, "no"), (None, "no"), (2, "no"), (3, None), (4, "")])
    kept = decontaminate.without_passages(docs, bench)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    rows = sorted(map(str, kept.collect()))
    assert len(rows) == 5
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    assert sorted(map(str, decontaminate.without_passages(docs, bench).collect())) == rows


def test_planted_passages_on_given_documents(spark, sf):
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    bench = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    whole = {(d.doc_id, i) for d in docs for i, t in bench if t in norm(d.text)}
    assert {(r.doc_id, r.item_id) for r in op9_decontaminate(spark, sf).collect()} == whole


@pytest.mark.parametrize("scale", [1, 10_000_000_000])
def test_top_products_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = random.Random(6)
    rows = [(i, [rng.randint(-9, 9) * scale * (1 + i % 4) for _ in range(5)]) for i in range(120)]
    rows += [(i, rows[0][1]) for i in range(200, 240)]  # one very common vector
    rows += [(300, [1, 2]), (301, []), (302, None), (None, [1, 1, 1, 1, 1]), (40, rows[40][1])]
    out = topk.top_products(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 7)
    usable = {i: v for i, v in rows if i is not None and v is not None}
    expected = []
    for q in (i for i in usable if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=False)), i) for i, v in usable.items() if i != q)
        expected += [(q, k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(scores[:7], 1)]
    got = [tuple(r) for r in out.collect()]
    if scale == 1:
        assert sorted(got) == sorted(expected)
    else:  # products that do not fit are all the largest number: ids decide among them
        assert {(q, k) for q, k, _, _ in got} == {(q, k) for q, k, _, _ in expected} and max(s for *_, s in got) == 2**63 - 1


def test_quantised(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [])]
    out = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding"), 64).alias("v"))
    assert {r.vec_id: r.v for r in out.collect()} == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_top_products_of_nothing(spark):
    assert topk.top_products(spark.createDataFrame([], "vec_id long, v array<long>"), F.lit(True), 3).count() == 0
    assert op2_top_products(spark, "/root/testdata/sf0.001").count() == 500


def test_shards_are_even_and_keep_groups(documents):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(10**9)}") for i in range(300)]
    rows += [(1000 + i, f"copy {i % 40}") for i in range(120)] + [(2000 + i, "hot") for i in range(200)] + ODD
    out = shards.assign_shards(documents(rows), 16).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    where = {r.doc_id: r.shard for r in out}
    split = sum(len({where[1000 + i] for i in range(k, 120, 40)}) > 1 for k in range(40))
    assert split <= 20  # nearly all of them when drawn by a hash
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in out}
    assert sizes[1] == sizes[2] == (1, 0) and sizes[7][0] == 100_001
    assert shards.assign_shards(documents([])).count() == 0


def test_large_groups_lie_in_few_shards(documents):
    # two groups that fit one shard each, one that fills several, and pairs
    rows = [(i, f"only {i}") for i in range(1500)] + [(10_000 + i, "first") for i in range(240)] + [(20_000 + i, "second") for i in range(200)]
    rows += [(30_000 + i, None) for i in range(1300)] + [(40_000 + i, f"pair {i % 400}") for i in range(800)]
    out = shards.assign_shards(documents(rows), 16)
    found = out.collect()
    counts = np.bincount([r.shard for r in found], minlength=16)
    assert len(found) == len(rows) and counts.max() - counts.min() <= 1
    room, where = len(rows) / 16, {r.doc_id: r.shard for r in found}
    for start, n in ((10_000, 240), (20_000, 200), (30_000, 1300)):
        assert len({where[start + i] for i in range(n)}) <= -(-n // room) + 1
    by_hash = out.withColumn("shard", F.expr("pmod(xxhash64(doc_id, 5), 16)"))
    (now,), (hashed,) = shards.cut_links(out).collect(), shards.cut_links(by_hash).collect()
    # no placement keeps a group together that is larger than a shard
    least = 1300 - room
    assert now.links == hashed.links and now.cut - least <= 150 and now.cut - least < (hashed.cut - least) / 4


def test_parts_follow_the_larger_side_under_quotas(spark):
    nodes = spark.createDataFrame([(i, 10, "k", i) for i in range(40)], "node long, weight long, key string, part long")
    links = shards.tree_links(nodes, 4)
    pairs = {(r.a, r.b) for r in links.collect()}
    assert pairs == {(i, (i - 1) // 4) for i in range(1, 40)}
    labels = shards.propagate(nodes, links, 4, 1600).collect()
    assert sorted(r.node for r in labels) == list(range(40)) and sum(r.weight for r in labels) == 400
    where = {r.node: r.shard for r in labels}
    before = {r.node: r.shard for r in shards.propagate(nodes, links, 4, 1600, rounds=0).collect()}
    split = lambda w: sum(w[a] != w[b] for a, b in pairs)
    assert split(where) < split(before) / 2


def test_texts_of_few_copies_take_part_in_propagation(documents):
    rows = [(i, f"only {i}") for i in range(400)] + [(1000 + i, f"text {i % 100}") for i in range(500)] + [(3000 + i, "more") for i in range(50)]
    parts = shards.parts_of_texts(shards.numbered(documents(rows)))
    nodes = shards.weighted_nodes(parts)
    by = defaultdict(list)
    for r in nodes.collect():
        by[r.key].append(r.weight)
    assert sorted(sum(w) for w in by.values()) == [5] * 100 + [50] and all(len(w) > 1 for w in by.values())
    links = shards.tree_links(nodes).collect()
    assert len(links) == sum(len(w) - 1 for w in by.values())
    # what the rounds find decides where a text lies
    start, end = ({r.doc_id: r.shard for r in shards.assign_shards(documents(rows), 16, rounds=n).collect()} for n in (0, 10))
    assert start != end


def test_quota_is_kept():
    demand = {(a, b): 50 for a in range(4) for b in range(4) if a != b} | {(0, 1): 500}
    sizes = dict.fromkeys(range(4), 600)
    share = shards._granted(demand, sizes, 630)
    for s in range(4):
        after = sizes[s] + sum(n * share[a, b] * ((b == s) - (a == s)) for (a, b), n in demand.items())
        assert after <= 631


def test_shards_on_given_documents(spark, sf):
    out = op3_shards(spark, sf).collect()
    counts = np.bincount([r.shard for r in out], minlength=16)
    assert counts.max() - counts.min() <= 1 and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
