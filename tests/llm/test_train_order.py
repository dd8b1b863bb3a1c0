from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from driftloom.llm import bpe, train_order
from driftloom.llm.queries import RANKS, op5_train_order
from tests.llm.conftest import ODD


def test_permutation_and_its_inverse():
    for total in (1, 2, 3, 5, 16, 17, 1000, 4097):
        for key in (0, 1, 2**63):
            slots = train_order.feistel_slots(np.arange(total), total, key)
            assert sorted(slots) == list(range(total))
            assert (train_order.feistel_numbers(slots, total, key) == np.arange(total)).all()
    a, b = (train_order.feistel_slots(np.arange(1000), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9


def pieced(index, read, stride):
    """Bytes of each text, put together from the files by the index, in the order of their starts."""
    found = {}
    for r in index:
        data = read[r.slot]
        at = r.offset % stride
        for doc, start, length in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            found.setdefault(doc, []).append((start, data[at : at + length * r.width]))
            at += length * r.width
        assert r.crc32 == zlib.crc32(data[r.offset % stride : at]) and at <= len(data)
    return found


class Row:
    def __init__(self, row, width):
        self.__dict__.update(row.asDict(), width=width)


def test_files_hold_every_sequence_in_order(spark, documents, tmp_path):
    rows = [*((i, f"text {i} " * (i % 9)) for i in range(60, 120)), *ODD[:4], *ODD[6:]]
    path = str(tmp_path / "docs")
    documents(rows).repartition(3).write.parquet(path)
    docs, folder = spark.read.parquet(path), f"file://{tmp_path}/out"
    index = [Row(r, 1) for r in sorted(train_order.write_shards(docs, folder, key=5, stride=64, per_shard=100).collect(), key=lambda r: (r.slot, r.offset))]
    total = -(-sum(len((t or "").encode()) + 1 for _, t in rows) // 64)
    assert sorted({r.slot for r in index}) == list(range(total)) and len(index) <= total + 3
    read = list(train_order.read_sequences(folder, 0, total, 64, 100))
    assert all(len(d) == 64 for d in read) and b"".join(read).count(b"\xff") < 64  # filling at the very end only
    assert all((r.shard, r.offset // 64) == (r.slot // 100, r.slot % 100) for r in index)
    texts = {i: (t or "").encode() + b"\xfe" for i, t in rows}
    assert {i: b"".join(d for _, d in sorted(p)) for i, p in pieced(index, read, 64).items()} == texts
    assert list(train_order.read_sequences(folder, 250, 30, 64, 100)) == read[250:280]


def test_repeated_rows_have_places_of_their_own(spark, documents, tmp_path):
    documents([(5, "same")] * 3 + [(None, "x"), (None, None)]).write.parquet(f"{tmp_path}/docs")
    index = train_order.write_shards(spark.read.parquet(f"{tmp_path}/docs"), f"file://{tmp_path}/out", key=1, stride=4).collect()
    assert sorted(str(d) for r in index for d, s in zip(r.doc_ids, r.starts, strict=True) if s == 0) == ["5", "5", "5", "None", "None"]
    assert sum(r.n_tokens for r in index) == 3 * 5 + 2 + 1


def test_shards_that_are_there_are_left(spark, documents, tmp_path):
    path, out = str(tmp_path / "docs"), tmp_path / "out"
    documents([(i, "x" * 100) for i in range(50)]).write.parquet(path)
    run = lambda: sorted(map(tuple, train_order.write_shards(spark.read.parquet(path), f"file://{out}", key=1, stride=32, per_shard=64).collect()))
    first = run()
    files = sorted(os.listdir(out))
    kept = {f: os.stat(out / f).st_mtime_ns for f in files[1:]}
    os.truncate(out / files[0], 10)  # a shard that is not whole is written again
    assert run() == first and sorted(os.listdir(out)) == files
    assert {f: os.stat(out / f).st_mtime_ns for f in files[1:]} == kept and os.stat(out / files[0]).st_size == 64 * 32


def test_ids_travel_as_one_compressed_row_for_each_task_and_shard(spark, documents, tmp_path):
    documents([(i, f"text {i % 7} " * 40) for i in range(400)]).coalesce(2).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").coalesce(2)
    rows, total, ids = train_order.sequences(docs, key=3, stride=32, per_shard=1500)
    rows = rows.collect()
    shards, parts = -(-total // 1500), docs.rdd.getNumPartitions()
    assert len(rows) <= shards * parts and {r.shard for r in rows} == set(range(shards))
    assert sum(len(r.slots) for r in rows) <= total + parts and sum(map(sum, (r.n_tokens for r in rows))) == ids
    assert sum(len(r.tokens) for r in rows) < 0.5 * ids


def test_no_rows(spark, documents, tmp_path):
    path = str(tmp_path / "docs")
    documents([]).write.parquet(path)
    assert train_order.write_shards(spark.read.parquet(path), f"file://{tmp_path}/out", key=1).count() == 0


def test_odd_rows_as_ids_of_a_vocabulary(spark, documents, tmp_path):
    docs = documents([r for r in ODD if r[0] != 5])
    encoded = bpe.encode(spark, docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    train_order.packed_ids(encoded).write.parquet(f"{tmp_path}/ids")
    index = [Row(r, 2) for r in train_order.write_shards(spark.read.parquet(f"{tmp_path}/ids"), f"file://{tmp_path}/out", key=9, stride=16).collect()]
    read = dict(enumerate(train_order.read_sequences(f"file://{tmp_path}/out", 0, len({r.slot for r in index}), 32)))
    found = {i: np.frombuffer(b"".join(d for _, d in sorted(p)), "<u2").tolist() for i, p in pieced(index, read, 32).items()}
    assert found == {r.doc_id: [*r.token_ids, train_order.SEPARATOR] for r in encoded.collect()}


def test_ids_are_packed_in_the_task_that_makes_them(spark, documents):
    docs = documents(ODD)
    one = bpe.encode(spark, docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, into=train_order.PACKED)
    two = train_order.packed_ids(bpe.encode(spark, docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = pa.array([[1, 65_533], None, [], [7]], pa.list_(pa.int32()))
    assert train_order.pack(rows).to_pylist() == [b"\x01\x00\xfd\xff", b"", b"", b"\x07\x00"]
    assert train_order.pack(rows.slice(1)).to_pylist() == [b"", b"", b"\x07\x00"]
    with pytest.raises(ValueError):
        train_order.pack(pa.array([[train_order.SEPARATOR]]))


def test_query_writes_ids_of_the_vocabulary(spark, sf):
    index = [Row(r, 2) for r in op5_train_order(spark, sf).collect()]
    root = os.path.join(spark.conf.get("spark.checkpoint.dir"), "train_order")
    folder = os.path.join(root, max(os.listdir(root), key=lambda f: os.stat(os.path.join(root, f)).st_mtime), "shards")
    encoded = bpe.encode(spark, spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    stride = 2 * train_order.STRIDE
    read = list(train_order.read_sequences(f"file://{folder}", 0, len({r.slot for r in index}), stride))
    found = {i: np.frombuffer(b"".join(d for _, d in sorted(p)), "<u2").tolist() for i, p in pieced(index, read, stride).items()}
    assert found == {r.doc_id: [*r.token_ids, train_order.SEPARATOR] for r in encoded.collect()}
