"""Token sequences in training order: binary shards of fixed stride in a keyed random order.

Token ids of a vocabulary, two bytes each (little-endian), are taken from a column ``tokens``
(:func:`packed_ids`). Texts are laid end to end, each followed by a separator, which is no id, and cut into
sequences of a fixed length; only the very last one is filled up. Tables without that column
have the UTF-8 bytes of ``text`` as ids, one byte each. Sequences are numbered in the order of the table, and a
keyed permutation gives each number its global slot: a Feistel network over the next even power of two,
walked along its cycle until it lands below the number of sequences. The permutation needs no state, can
be undone, and costs the same on any slice.

What a task cuts for one shard travels as one compressed row for every 16 MB of ids it has read. One task a shard
puts the sequences in their places; a shard is a file in
which sequence ``s`` begins at byte ``(s - first) * stride``. A shard is written to a name of its own attempt and
renamed when whole, so a lost executor leaves nothing half done and a second attempt writes the same
bytes. A shard that is already there in its full size is not written again. The index names the pieces of
texts that a sequence is made of; a sequence that two partitions of the table share has two rows.

Null and empty texts are a separator only, so that every row has a place. Long texts run over as many
sequences as they need. Repeated rows have places of their own. An empty table gives no rows and no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import _slices, map_batches

#: Ids of a sequence, and sequences of a shard (32 MB for each byte of an id).
STRIDE, PER_SHARD = 512, 65_536
#: Bytes of a vocabulary's id, the number behind each text, and the one that fills up the last sequence.
ID_BYTES, SEPARATOR, PAD = 2, 0xFFFE, 0xFFFF
ROUNDS = 4


def feistel_slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot of each number below ``total``: a permutation of 0 .. total - 1 chosen by ``key``."""
    half = _half_bits(total)
    out = _encipher(numbers.astype(np.uint64), half, key)
    while (outside := out >= np.uint64(total)).any():
        out[outside] = _encipher(out[outside], half, key)
    return out.astype(np.int64)


def feistel_numbers(slots: np.ndarray, total: int, key: int) -> np.ndarray:
    """The number that each slot came from."""
    half = _half_bits(total)
    out = _decipher(slots.astype(np.uint64), half, key)
    while (outside := out >= np.uint64(total)).any():
        out[outside] = _decipher(out[outside], half, key)
    return out.astype(np.int64)


def _half_bits(total: int) -> int:
    return max(1, ((max(2, total) - 1).bit_length() + 1) // 2)


def _round(value: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    x = value + np.uint64((key * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def _encipher(x: np.ndarray, half: int, key: int) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for number in range(ROUNDS):
        left, right = right, left ^ _round(right, key, number, mask)
    return left << shift | right


def _decipher(x: np.ndarray, half: int, key: int) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for number in reversed(range(ROUNDS)):
        left, right = right ^ _round(left, key, number, mask), left
    return left << shift | right


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    if "tokens" in batch.schema.names:
        return [t or b"" for t in batch.column("tokens").to_pylist()]
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def id_bytes(docs: DataFrame) -> int:
    return ID_BYTES if "tokens" in docs.columns else 1


def pack(token_ids: pa.ListArray) -> pa.Array:
    """Ids of each row as little-endian numbers of two bytes, none for null; larger ids are an error."""
    found = token_ids.flatten().to_numpy(zero_copy_only=False)
    if len(found) and not 0 <= found.min() <= found.max() < SEPARATOR:
        raise ValueError(f"ids of {ID_BYTES} bytes must be below {SEPARATOR}")
    lengths = pc.fill_null(pc.list_value_length(token_ids), 0).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths * ID_BYTES)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(token_ids), [None, pa.py_buffer(ends), pa.py_buffer(found.astype("<u2"))])


#: For ``bpe.encode``: ids packed in the task that makes them.
PACKED = ("tokens", "binary", pack)


def packed_ids(encoded: DataFrame) -> DataFrame:
    """(doc_id, tokens): ``token_ids`` packed (:func:`pack`)."""

    def work():
        return lambda batch: {"doc_id": batch.column("doc_id"), "tokens": pack(batch.column("token_ids"))}

    return map_batches(encoded, ["doc_id", "token_ids"], f"doc_id {dict(encoded.dtypes)['doc_id']}, tokens binary", work)


def _separator(width: int) -> bytes:
    return (SEPARATOR & (1 << 8 * width) - 1).to_bytes(width, "little")  # 0xFE and 0xFF are no bytes of UTF-8


#: Bytes of ids that a task holds before it deals them to their shards.
BUNDLE_BYTES = 16_000_000
#: What one task has for one shard: its stretches of sequences, the pieces of texts in each, and their ids laid end to end.
BUNDLE = (
    "shard bigint, slots array<bigint>, at array<bigint>, n_tokens array<bigint>, pieces array<bigint>, "
    "doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>, size bigint, tokens binary"
)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values, pa.int64()))


def _bundles(stream: bytes, at: int, docs: pa.Array, begins: np.ndarray, width: int, stride: int, total: int, key: int, per_shard: int) -> pa.RecordBatch:
    """:data:`BUNDLE` rows for the ids ``at ..`` of the whole table, cut at the borders of sequences.

    ``begins`` says where the texts ``docs`` begin in ``stream``, the first perhaps before it.
    """
    n = len(stream) // width
    edges = np.unique(np.concatenate([[0], np.arange(-at % stride, n, stride)]))
    cuts = np.unique(np.concatenate([edges, begins[(begins > 0) & (begins < n)]]))
    owner, part = np.searchsorted(begins, cuts, "right") - 1, np.searchsorted(edges, cuts, "right") - 1
    sizes = np.diff(np.append(edges, n))
    slots = feistel_slots((at + edges) // stride, total, key)
    order = np.argsort(slots // per_shard, kind="stable")
    shards = (slots // per_shard)[order]
    borders = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
    # the pieces of texts in the order of their stretches
    pieces = np.bincount(part, minlength=len(edges))
    by_part = _lists(np.arange(len(cuts)), np.concatenate([[0], np.cumsum(pieces)])).take(pa.array(order)).flatten().to_numpy()
    piece_borders = np.concatenate([[0], np.cumsum(pieces[order])])[borders]
    view, codec = memoryview(stream), _codec()
    taken = [view[a * width : z * width] for a, z in zip(edges[order].tolist(), (edges + sizes)[order].tolist(), strict=True)]
    joined = [b"".join(taken[a:z]) for a, z in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
    columns = {
        "shard": pa.array(shards[borders[:-1]], pa.int64()),
        "slots": _lists(slots[order], borders),
        "at": _lists(((at + edges) % stride)[order], borders),
        "n_tokens": _lists(sizes[order], borders),
        "pieces": _lists(pieces[order], borders),
        "doc_ids": _lists(docs.take(pa.array(owner[by_part])), piece_borders),
        "starts": _lists((cuts - begins[owner])[by_part], piece_borders),
        "lengths": _lists(np.diff(np.append(cuts, n))[by_part], piece_borders),
        "size": pa.array([len(data) for data in joined], pa.int64()),
        "tokens": pa.array([codec.compress(data, asbytes=True) for data in joined], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sequences(docs: DataFrame, key: int, stride: int = STRIDE, per_shard: int = PER_SHARD) -> tuple[DataFrame, int, int]:
    """Rows of :data:`BUNDLE`, the number of sequences and that of ids, separators included.

    ``docs`` must give the same rows in the same partitions each time it is read, as a written table
    does: the first pass counts the ids of each partition, the second numbers them from there.
    ``stride``, ``at`` and ``n_tokens`` count ids; ``starts`` and ``lengths`` are those of the pieces in their
    texts, where the separator stands behind the last id.
    """
    kind = dict(docs.dtypes)["doc_id"]
    width = id_bytes(docs)
    separator = _separator(width)
    texts = docs.select("doc_id", "tokens" if width > 1 else "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            n += int((lengths // width + 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["p", "n"])

    # one number for each partition of the table, as many as Spark's own list of its tasks; the plan below reads the
    # same columns in the same way, so that its partitions are the same
    found = dict(texts.mapInArrow(count, "p bigint, n bigint").collect())
    sizes = np.zeros(max(found, default=-1) + 2, np.int64)
    for p, n in found.items():
        sizes[p + 1] = n
    firsts = docs.sparkSession.sparkContext.broadcast(np.cumsum(sizes))
    ids = int(sizes.sum())
    total = -(-ids // stride)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream, docs_here, begins = int(firsts.value[TaskContext.get().partitionId()]), b"", None, np.zeros(0, np.int64)
        for batch in (part for b in batches for part in _slices(b)):
            data, names = _raw(batch), batch.column("doc_id")
            lengths = np.array([len(d) // width + 1 for d in data], np.int64)
            begins = np.concatenate([begins, len(stream) // width + np.cumsum(lengths) - lengths])
            docs_here = names if docs_here is None else pa.concat_arrays([docs_here, names])
            stream += b"".join(x for d in data for x in (d, separator))
            n = len(stream) // width
            whole = (at + n) // stride * stride - at  # what is left goes with the next batch
            if whole > 0 and len(stream) >= BUNDLE_BYTES:
                yield _bundles(stream[: whole * width], at, docs_here, begins, width, stride, total, key, per_shard)
                keep = int(np.searchsorted(begins, whole, "right")) - 1 if whole < n else len(docs_here)
                docs_here, begins = docs_here[keep:], begins[keep:] - whole
                stream, at = stream[whole * width :], at + whole
        if stream:
            yield _bundles(stream, at, docs_here, begins, width, stride, total, key, per_shard)

    return texts.mapInArrow(cut_up, BUNDLE.format(kind=kind)), total, ids


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(docs: DataFrame, folder: str, key: int, stride: int = STRIDE, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes the shards below ``folder``, which all executors reach, and gives their index.

    Index: slot, shard, offset (bytes), n_tokens, the pieces' doc_ids, starts and lengths, crc32 of the bytes. The
    files are there once the index has been computed; computing it again finds them and does not write.
    """
    rows, total, _ = sequences(docs, key, stride, per_shard)
    width = id_bytes(docs)
    stride *= width
    shards = max(1, -(-total // per_shard))
    dealt = rows.repartitionById(shards, F.col("shard").cast("int"))
    kind = dict(docs.dtypes)["doc_id"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, image, parts, codec = None, bytearray(), [], _codec()
        for batch in batches:
            for row in range(batch.num_rows):
                bundle = {c: batch.column(c)[row] for c in batch.schema.names}
                if shard is None:
                    shard = bundle["shard"].as_py()
                    # what no id falls on, the end of the last sequence, stays filled up
                    image = bytearray(b"\xff") * (min(per_shard, total - shard * per_shard) * stride)
                elif bundle["shard"].as_py() != shard:
                    raise ValueError("a partition must hold one shard")
                parts.append(_placed(bundle, image, codec, shard * per_shard, stride, width))
        if shard is None:
            return
        _written(folder, shard, image)
        index = pa.concat_tables(parts).combine_chunks()
        index = index.append_column("shard", pa.array(np.full(index.num_rows, shard))).select(names)
        index = index.take(pa.array(np.lexsort([index.column("offset").to_numpy()])))
        yield from index.to_batches(max_chunksize=10_000)

    names = ["slot", "shard", "offset", "n_tokens", "doc_ids", "starts", "lengths", "crc32"]
    return dealt.mapInArrow(write, f"slot bigint, shard bigint, offset bigint, n_tokens bigint, doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>, crc32 bigint")


def _placed(bundle: dict[str, pa.Scalar], image: bytearray, codec: pa.Codec, first: int, stride: int, width: int) -> pa.Table:
    """Puts a bundle's ids in their places in the shard's ``image``; the index of its stretches without the shard."""
    slots, at, n_tokens, pieces = (bundle[c].values.to_numpy() for c in ("slots", "at", "n_tokens", "pieces"))
    data = memoryview(codec.decompress(bundle["tokens"].as_buffer(), bundle["size"].as_py(), asbytes=True))
    offsets, ends = (slots - first) * stride + at * width, np.cumsum(n_tokens * width)
    sums = []
    for to, a, z in zip(offsets.tolist(), (ends - n_tokens * width).tolist(), ends.tolist(), strict=True):
        image[to : to + z - a] = data[a:z]
        sums.append(zlib.crc32(data[a:z]))
    borders = np.concatenate([[0], np.cumsum(pieces)])
    lists = {c: _lists(bundle[c].values, borders) for c in ("doc_ids", "starts", "lengths")}
    return pa.table({"slot": slots, "offset": offsets, "n_tokens": n_tokens, "crc32": pa.array(sums, pa.int64()), **lists})


def _written(folder: str, shard: int, image: bytearray) -> None:
    """Writes a shard and renames it, unless it is there in its full size."""
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    there = files.get_file_info(f"{root}/{shard_name(shard)}")
    if there.type == pyarrow.fs.FileType.File and there.size == len(image):
        return
    temporary = f"{root}/.{shard_name(shard)}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as stream:
        stream.write(image)
    files.move(temporary, f"{root}/{shard_name(shard)}")


def read_sequences(folder: str, first: int, count: int, stride: int = STRIDE, per_shard: int = PER_SHARD) -> Iterator[bytes]:
    """``count`` sequences of ``stride`` bytes from slot ``first`` on, as a trainer resumes: a seek, then sequential reads."""
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    while count > 0:
        shard, at = divmod(first, per_shard)
        take = min(count, per_shard - at)
        with files.open_input_file(f"{root}/{shard_name(shard)}") as stream:
            stream.seek(at * stride)
            for _ in range(take):
                yield stream.read(stride)
        first, count = first + take, count - take
