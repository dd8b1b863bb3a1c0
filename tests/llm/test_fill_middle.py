from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import fill_middle
from driftloom.llm.fill_middle import ChunkCache, Measured, chunk_ends, rearranged, rolling
from tests.llm.conftest import ODD


def plain_form(text, digest):
    """The rule by slices of the text."""
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", i, j - i, f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}"
    return n, "psm", i, j - i, f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"


def random_texts(count=150):
    rng = random.Random(5)
    shared = ["".join(rng.choice("abé😀ß <P") for _ in range(3_000)) for _ in range(3)]
    for i in range(count):
        text = "".join(rng.choice(["x", "é", "😀", "word ", *shared]) for _ in range(rng.randrange(12)))
        yield text + "<P>" * (i % 10 == 0) + "<M" * (i % 7 == 0)


def test_cuts_equal_slices_with_any_cache():
    for most in (0, 5_000, 16_000_000):
        cache = ChunkCache(most)
        for k, text in enumerate(random_texts()):
            digest = hashlib.sha256(str(k).encode()).hexdigest()
            n, form, p, m, out = rearranged(text.encode(), digest, cache)
            assert (n, form, p, m, out.decode()) == plain_form(text, digest)
        assert cache.held <= max(most, 8_192)
    assert cache.hits > 100  # shared passages are met again


def test_rolling_hash_sees_its_window_only():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(3_000)), np.uint8)
    assert (rolling(data)[500:] == rolling(data[400:])[100:]).all()
    shifted = set(chunk_ends(data[700:]))
    assert len([e for e in chunk_ends(data) if e - 700 in shifted]) >= 1


def test_markers_across_borders():
    for at in range(8_180, 8_200):  # one long chunk ends at 8,192
        assert Measured(b"a" * at + b"<S>" + b"a" * 50, ChunkCache()).marked
    assert not Measured(b"a" * 8_191 + b"<S" + b"a" * 50, ChunkCache()).marked


def test_a_key_that_collides_is_not_believed():
    cache = ChunkCache()
    cache.look(b"abc")
    (key,) = cache.known
    cache.known = {key: fill_middle.summary("é".encode() + b"z")}
    assert cache.look(b"abc").count == 3


def test_odd_rows_and_restoring(documents):
    docs = documents([*ODD, (9, "a <S> b"), (10, "<"), (11, "<P" + "é" * 70), *[(k, "née <M à" * k) for k in range(20, 60)]])
    out = fill_middle.fill_in_middle(docs, F.concat(F.lit("1:"), F.col("doc_id").cast("string")))
    rows = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), *map(str, plain_form(t or "", hashlib.sha256(b"" if i is None else f"1:{i}".encode()).hexdigest())), t or "") for i, t in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(documents):
    assert fill_middle.fill_in_middle(documents([]), F.lit("k"), ("doc_id", "source")).collect() == []
