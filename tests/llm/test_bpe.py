from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from driftloom.llm import bpe
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def merges():
    with open(PATH, "rb") as file:
        return bpe.Merges(file.read())


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_merges(merges, library):
    machine, rng = bpe.Transducer(merges), random.Random(3)
    letters = ["a", "e", "th", "ing", "er", " ", "=", "--", "1", "ñ", "😀", "the", "Z", "\n"]
    tokens = list(merges.ranks)
    cases = ["".join(rng.choices(letters, k=rng.randint(1, 40))).encode() for _ in range(1500)]
    cases += [b"".join(rng.choices(tokens, k=rng.randint(1, 6))) for _ in range(1500)]
    cases += [rng.randbytes(rng.randint(1, 30)) for _ in range(300)]
    cases += [b"ab" * 6000 + b"the" * 4000, b"x" * 9001 + b"thing" * 2000]
    for case in cases:
        if case not in merges.ranks:
            assert machine.encode(case) == library._encode_single_piece(case)


def test_blocks_are_settled_early(merges):
    machine = bpe.Transducer(merges)
    blocks = list(machine.blocks(b"thing" * 10_000))
    assert len(blocks) > 5 and [t for b in blocks for t in b] == machine.encode(b"thing" * 10_000)


def test_words_cut_at_spaces_give_the_same_ids(merges, library):
    words = bpe.Words(bpe.Pieces(merges), regex.compile(public_tokenizers.PATTERN).findall)
    rng = random.Random(4)
    for _ in range(800):
        text = "".join(rng.choices(["a", "don't", "word", " ", "  ", "\n", " \n ", "\t", " ", "'s", ".", "12", "ö", ", "], k=rng.randint(0, 25)))
        assert np.frombuffer(words.encode(text), np.int32).tolist() == library.encode_ordinary(text), text


def test_memories_may_overflow(merges, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    words = bpe.Words(bpe.Pieces(merges), regex.compile(public_tokenizers.PATTERN).findall)
    text = " ".join(f"w{i % 7}or{i % 11}" for i in range(300))
    assert np.frombuffer(words.encode(text), np.int32).tolist() == library.encode_ordinary(text)


def test_utf8_machine_equals_one_decode():
    rng = random.Random(5)
    for _ in range(2000):
        data = b"".join(rng.choice(["é".encode(), "😀".encode(), b"a", b"\xff", b"\xe2\x82", b"\xf0\x9f", b"\xed\xa0\x80", b"\x80"]) for _ in range(rng.randint(0, 8)))
        machine, out, at = bpe.Utf8(), "", 0
        while at < len(data):
            step = rng.randint(1, 3)
            out += machine.feed(data[at : at + step])
            assert len(machine.open) <= 3
            at += step
        assert out + machine.close() == data.decode("utf-8", "replace")


def test_round_trip_of_odd_rows(spark, documents, library):
    docs = documents(ODD)
    out = bpe.decode(spark, bpe.encode(spark, docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in out) == sorted((i or -1, t or "") for i, t in ODD)
    for row in out:
        assert row.token_ids == library.encode_ordinary(row.decoded)
    assert bpe.encode(spark, documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_on_given_documents(spark, sf, library):
    import hashlib

    from driftloom.llm.queries import op7_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pieces_in_step_equal_the_merges(merges, library, monkeypatch):
    rng, tokens = random.Random(6), list(merges.ranks)
    letters = ["a", "e", "th", "ing", "er", " ", "=", "--", "1", "ñ", "😀", "the", "Z", "\n"]
    cases = ["".join(rng.choices(letters, k=rng.randint(1, 50))).encode() for _ in range(1500)]
    cases += [b"".join(rng.choices(tokens, k=rng.randint(1, 6))) for _ in range(1500)] + [rng.randbytes(rng.randint(1, 70)) for _ in range(300)]
    cases += [b"ab" * 3000, b"x" * 64, b"x" * 65, b"\0", b""]
    expected = [np.array(library._encode_single_piece(c), np.int32).tobytes() if c else b"" for c in cases]
    assert bpe.Lockstep(bpe.Transducer(merges)).encode(cases) == expected
    # few places for joins, states beyond the table, small groups
    for name, value in {"PLACES": 64, "STATES": 100, "TOGETHER": 50}.items():
        monkeypatch.setattr(bpe.Lockstep, name, value)
        machine = bpe.Lockstep(bpe.Transducer(merges))
        assert machine.encode(cases) == expected and machine.encode(cases[::-1]) == expected[::-1]
    assert bpe.Lockstep(bpe.Transducer(merges)).encode([]) == []


def test_words_of_a_batch_go_through_the_machine_together(merges, library, monkeypatch):
    calls = []
    encode = bpe.Lockstep.encode
    monkeypatch.setattr(bpe.Lockstep, "encode", lambda self, pieces: (calls.append(len(pieces)), encode(self, pieces))[1])
    words = bpe.Words(bpe.Pieces(merges), regex.compile(public_tokenizers.PATTERN).findall)
    draws = [random.Random(k) for k in range(30)]
    texts = [" ".join("".join(rng.choices("qzxvwkjy", k=8)) + ", x" for _ in range(40)) for rng in draws]
    ids, lengths = words.encode_all(pa.array(texts))
    assert len(calls) <= 2 and sum(calls) > 1000
    assert np.split(ids, np.cumsum(lengths)[:-1])[7].tolist() == library.encode_ordinary(texts[7])
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
