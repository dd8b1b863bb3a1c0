"""Embeddings, stream positions, reference windows and trigger batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.hashing import hash60
from driftloom.operators.ordered import dense_position, top_n
from driftloom.storage import cut

# Reference size, store size, trigger sizes and warm-up text shape.
REFERENCE_SIZE = 100
STORE_SIZE = 200
TRIGGER_N = 100
MIN_TRIGGER = 10
MODEL_BATCH = 64
NOISE_WORDS = 20
NOISE_SEED = 42

Encoder = Callable[[list[str]], np.ndarray]


def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """Loader of the built-in model: signed token counts in ``dim`` hashed slots, not normalised."""

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            tokens = [t.split() for t in texts]
            row = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
            codes, words = pd.factorize(np.array(list(chain.from_iterable(tokens)), dtype=object))
            hashed = np.fromiter(map(_token_hash, words), dtype=np.int64, count=len(words))[codes]
            cells = row * dim + (hashed >> 1) % dim
            signs = np.where(hashed & 1, 1.0, -1.0)
            flat = np.bincount(cells, weights=signs, minlength=len(texts) * dim)
            return flat.reshape(len(texts), dim).astype(np.float32)

        return encode

    return load


def embed(
    df: DataFrame, text: str, loader: Callable[[], Encoder], into: str = "vec", batch: int = MODEL_BATCH, parts: int | None = None
) -> DataFrame:
    """Vectors of the non-blank texts; the model is loaded once per Python worker and partition.

    ``parts`` deals the rows anew, for tables of few files; without it they stay as they are read.

    The function is declared non-deterministic so that no later filter or explosion makes Spark
    evaluate it, or the text it reads, a second time.
    """

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = loader()
        for texts in series:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            filled = np.flatnonzero(texts.fillna("").str.strip().to_numpy() != "")
            for at in range(0, len(filled), batch):
                some = filled[at : at + batch]
                vectors = np.asarray(encode(texts.iloc[some].tolist()), dtype=np.float32)
                for i, vector in zip(some, vectors):
                    out.iat[i] = vector
            yield out

    spread = df.repartition(parts) if parts else df
    return spread.withColumn(into, run.asNondeterministic()(text)).where(F.col(into).isNotNull())


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Distinct words with a dense 0-based rank in hash order (no global sort).

    The words are cut off: ranking reads them several times, and the texts are read and cleaned once.
    """
    words = df.select(F.explode(F.split(F.col(text), " ")).alias("word")).where("word <> ''").distinct()
    hashed = cut(words.withColumns({"_h": hash60("vocabulary", F.col("word")), "_one": F.lit(1)}))
    ranked = dense_position(hashed, ["_one"], "_h", "word_rank", tiebreak=["word"])
    return ranked.select("word_rank", "word")


def noise_documents(vocab: DataFrame, n: int = REFERENCE_SIZE, words: int = NOISE_WORDS, seed: int = NOISE_SEED) -> DataFrame:
    """``n`` documents of ``words`` random vocabulary words each, drawn with replacement."""
    size = vocab.agg(F.count(F.lit(1))).scalar()
    slots = vocab.sparkSession.range(n * words).select(
        F.floor(F.col("id") / words).alias("noise_id"), (F.col("id") % words).alias("slot")
    )
    drawn = slots.withColumn("word_rank", hash60(seed, F.col("noise_id"), F.col("slot")) % size)
    chosen = drawn.join(vocab, "word_rank")
    listed = F.array_sort(F.collect_list(F.struct("slot", "word")))
    texts = chosen.groupBy("noise_id").agg(listed.alias("_w"))
    return texts.select("noise_id", F.array_join(F.transform("_w", lambda x: x.word), " ").alias("text"))


def reference_window(positioned: DataFrame, n: int = REFERENCE_SIZE) -> DataFrame:
    return positioned.where(F.col("pos") < n)


def bounded_store(df: DataFrame, keys: list[str], seq: str, size: int = STORE_SIZE) -> DataFrame:
    """The latest ``size`` rows of each stream."""
    return top_n(df, keys, [F.col(seq).desc()], size, [seq], rank="age")


def trigger_batches(positioned: DataFrame, n: int = TRIGGER_N, reference: int = REFERENCE_SIZE, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Rows after the reference in blocks of ``n``; an incomplete last block is not emitted."""
    if n < MIN_TRIGGER:
        return positioned.withColumn("batch_no", F.lit(None).cast("long")).where(F.lit(False))
    blocks = positioned.where(F.col("pos") >= reference).withColumn(
        "batch_no", F.floor((F.col("pos") - reference) / n)
    )
    # a group of the window is one block: at most n rows
    whole = Window.partitionBy(*keys, "batch_no")
    counted = blocks.withColumn("_rows", F.count(F.lit(1)).over(whole))
    return counted.where(F.col("_rows") == n).drop("_rows")
