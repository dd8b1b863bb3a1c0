"""Join of texts whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Equal texts are one class; MinHash signatures are cut into bands. Band and row counts are chosen so
   that a pair at the threshold shares two bands or more with the target probability.
2. Shuffle on band hashes. Texts that meet in a bucket and share two bands are candidates; a bucket gives
   only as many edges as connect them. Sharing two bands is rare for texts that merely have a passage in
   common, so the candidates' components stay small.
3. Inside a component all pairs are verified on full n-gram sets: the sizes of all intersections are a
   matrix product over the n-grams that at least two of its texts have.

A bucket or component too large for a task is cut into blocks, and tasks take pairs of blocks. Pairs of
texts are never written out: a task gives the number of links of each text and edges that connect what
is linked. So neither many copies nor a large family of near copies multiplies rows.

Words are runs of letters, digits and underscores, in lower case. A text of fewer words than an n-gram
counts as one n-gram of all its words. Texts without words, null included as empty, are linked to equal
texts only. A null id takes part, but never names a class that has another id. Repeated rows count as
copies. An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import held, map_batches, texts_of
from driftloom.llm.groups import components, map_groups, stars
from driftloom.storage import cut

WORD = re.compile(r"\w+")
N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Hash functions of a signature, at most; more rows in a band mean fewer false candidates.
HASHES = 240
#: Texts in a block of a bucket or component.
BLOCK = 1024
#: Bytes of n-gram hashes in a block.
BLOCK_BYTES = 32_000_000


def bands_and_rows(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """The most rows, and with them the fewest bands, for which two bands are shared with ``recall``."""
    for rows in range(hashes, 0, -1):
        p = threshold**rows
        bands = next((b for b in range(2, hashes // rows + 1) if 1 - (1 - p) ** b - b * p * (1 - p) ** (b - 1) >= recall), None)
        if bands:
            return bands, rows
    raise ValueError("more hash functions are needed for this recall")


class _WordHashes(dict):
    """Hash of each word, for words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes (64 bits) of the text's word n-grams."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    memory = held(__name__)
    hashes = memory["words"] if "words" in memory else memory.setdefault("words", _WordHashes())
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(codes))
    out = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ codes[i : len(codes) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


@cache
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20240229).integers(0, 1 << 32, (2, count), dtype=np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of the MinHash signature."""
    factor, shift = _functions(bands * rows)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for part in np.split(short, range(1024, len(short), 1024)):
        mixed = part[:, None] * factor + shift
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, mixed.min(axis=0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _classes(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """One row for each different text: key, least id, copies, and its bands as bytes (null without words)."""
    kind = dict(docs.dtypes)["doc_id"]

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            grams = [shingles(t, n) for t in texts_of(batch)]
            found = [band_hashes(g, bands, rows).tobytes() if len(g) else None for g in grams]
            sizes = pa.array([len(g) for g in grams], pa.int64())
            return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "bands": pa.array(found, pa.binary()), "grams": sizes}

        return step

    signed = map_batches(docs.select("doc_id", "text", text_key().alias("key")), ["key", "doc_id", "text"], f"key binary, doc_id {kind}, bands binary, grams bigint", work)
    return signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("grams").alias("grams"))


def _in_blocks(rows: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block (``mine``) is part of: (i, j), i <= j."""
    dealt = rows.withColumn("mine", F.expr(f"cast(pmod(xxhash64(key), {blocks}) as int)"))
    return (
        dealt.withColumn("other", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .drop("other", blocks)
    )


def _candidates(classes: DataFrame, bands: int) -> DataFrame:
    """Edges (a, b) that connect all texts sharing two bands."""

    def split():
        def step(batch: pa.RecordBatch) -> dict:
            hashes = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            return {"bucket": pa.array(hashes), "key": keys}

        return step

    rows = map_batches(classes.where("bands is not null"), ["key", "bands"], "bucket bigint, key binary", split)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = rows.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK)).drop("size")
    met = met.join(classes.select("key", "bands"), "key")

    def meet(table: pa.Table, starts: np.ndarray) -> dict:
        keys = table.column("key").to_pylist()
        signs = np.frombuffer(b"".join(table.column("bands").to_pylist()), np.int64).reshape(-1, bands)
        mine, i, j = (table.column(c).to_numpy() for c in ("mine", "i", "j"))
        a, b = [], []
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            if end - start < 2:
                continue
            part = signs[start:end]
            shared = np.zeros((end - start, end - start), np.int16)
            for column in part.T:
                shared += column[:, None] == column[None, :]
            linked = np.triu(shared >= 2, 1)
            if i[start] != j[start]:
                linked &= mine[start:end, None] != mine[None, start:end]
            left, right = np.nonzero(linked)
            for least, other in stars(end - start, left, right):
                a.append(keys[start + least])
                b.append(keys[start + other])
        return {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}

    return map_groups(_in_blocks(met, "blocks"), ["bucket", "i", "j"], "a binary, b binary", meet, ("key",)).distinct()


def _verified(docs: DataFrame, classes: DataFrame, members: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links inside components of candidates: (a, null, links of a) and connecting edges (a, b, 0)."""
    texts = docs.select(text_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    known = members.join(classes.select("key", "copies"), "key").join(texts, "key")

    def sets():
        def step(batch: pa.RecordBatch) -> dict:
            found = [shingles(t, n).tobytes() for t in texts_of(batch)]
            return {c: batch.column(c) for c in ("component", "key", "copies", "blocks")} | {"grams": pa.array(found, pa.binary())}

        return step

    full = map_batches(known, ["component", "key", "copies", "blocks", "text"], "component binary, key binary, copies bigint, blocks bigint, grams binary", sets)
    full = full.withColumn("group", F.xxhash64("component"))

    def verify(table: pa.Table, starts: np.ndarray) -> dict:
        keys, raw = table.column("key").to_pylist(), table.column("grams").to_pylist()
        copies, mine, i, j = (table.column(c).to_numpy() for c in ("copies", "mine", "i", "j"))
        a, b, links = [], [], []
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            sizes = np.array([len(r) // 8 for r in raw[start:end]], np.int64)
            common = intersections([np.frombuffer(r, np.uint64) for r in raw[start:end]])
            union = sizes[:, None] + sizes[None, :] - common
            # in whole numbers, so that a pair exactly at the threshold is in
            linked = common * 10_000 >= union * round(threshold * 10_000)
            np.fill_diagonal(linked, False)
            if i[start] != j[start]:
                linked &= mine[start:end, None] != mine[None, start:end]
            counts = linked @ copies[start:end]
            left, right = np.nonzero(np.triu(linked, 1))
            kept = stars(end - start, left, right)
            a += [*keys[start:end], *(keys[start + least] for least, _ in kept)]
            b += [*([None] * (end - start)), *(keys[start + other] for _, other in kept)]
            links += [*counts.tolist(), *([0] * len(kept))]
        return {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array(links, pa.int64())}

    return map_groups(_in_blocks(full, "blocks"), ["group", "i", "j"], "a binary, b binary, links bigint", verify, ("key",))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by a product over the hashes that two sets or more have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    borders = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else -1) + width + 1, width))
    for first, last in zip(borders[:-1], borders[1:], strict=True):
        block = np.zeros((len(sets), width), np.float32)
        block[owner[first:last], code[first:last] % width] = 1
        out += block @ block.T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the least id of its component and its number of links.

    Links to copies count too. Copies are not expanded into pairs.
    """
    named = _components_of_texts(docs, threshold, n, recall)
    names = named.groupBy("component").agg(F.min("least").alias("class_id"))
    per_text = named.join(names, "component").select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return docs.select("doc_id", text_key().alias("key")).join(per_text, "key").select("doc_id", "class_id", "n_links")


def _components_of_texts(docs: DataFrame, threshold: float, n: int, recall: float) -> DataFrame:
    """(key, least, copies, links, component) of each different text; links to other texts only."""
    docs = docs.select("doc_id", "text")
    bands, rows = bands_and_rows(threshold, recall)
    classes = cut(_classes(docs, bands, rows, n))
    near = components(_candidates(classes, bands))
    n_near = near.count()
    near = near.withColumnRenamed("node", "key").join(classes.select("key", "grams"), "key")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("grams") * 8 / BLOCK_BYTES))
    members = cut(near.join(near.groupBy("component").agg(blocks.alias("blocks")), "component").select("key", "component", "blocks"), n_near)
    verified = cut(_verified(docs, classes, members, threshold, n))
    links = verified.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(verified.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    named = classes.join(links, "key", "left").join(joined, "key", "left")
    return named.select("key", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document of the least id stays.

    A null id is greater than any other; of equal ids the text with the least hash stays. Rows that repeat id
    and text become one.
    """
    named = _components_of_texts(docs, threshold, n, recall)
    order = F.struct(F.col("least").isNull(), "least", "key")
    stays = named.groupBy("component").agg(F.min(order).alias("kept")).select(F.col("kept.least").alias("_kept_id"), F.col("kept.key").alias("_kept_key"))
    keyed = docs.withColumn("_text_key", text_key())
    kept = keyed.join(stays, (F.col("_text_key") == F.col("_kept_key")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    return kept.drop("_text_key").dropDuplicates(["doc_id", "text"])
