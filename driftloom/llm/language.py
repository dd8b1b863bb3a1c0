"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters in lower case, everything between two letters one blank; n-grams of one to three
characters, hashed. TF is the share of the text's n-grams, IDF comes from all texts that may be learnt
from. Training: follow the regularised leader, one text at a time, with elastic-net penalties, on a
bounded sample with as many texts of each language as its share of the bound, at least one of every
language; of a repeated id the least text counts. A temperature, fitted on
texts of the sample that training left out, calibrates the probabilities. The model has 65,536 rows and a
column for each language (256 KB of it on a worker, 1 MB on the driver while it is fitted).

A null text and one without a letter get ``und`` and score 0. Texts are read whole. Rows are predicted
one by one, so repeated rows and ids need no rule; equal scores go to the language first in the
alphabet. Without rows to learn from every text gets ``und`` and score 0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import _slices, map_batches, texts_of
from driftloom.operators.ordered import top_n

GRAMS = (1, 2, 3)
DIMENSIONS = 1 << 16
#: Texts used for fitting, at most, over all languages.
FIT_ROWS = 3_000
SCALE = 100.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
EPOCHS = 3

_LETTER = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-grams, index of the text of each, letters per text)."""
    lows = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lows), dtype=np.int32), [len(t) for t in lows])
    letter = _LETTER[codes]
    letters = np.bincount(owner[letter], minlength=len(lows))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # the first of a run of others stands for a blank
    codes, owner = np.where(letter, codes, np.uint32(32))[keep], owner[keep]
    out, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        hashed = np.full(len(codes) - n + 1, 0x27D4EB2F * n & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            hashed ^= codes[i : len(codes) - n + 1 + i] * _FACTORS[i]
            hashed *= np.uint32(0x01000193)
        whole = owner[: len(codes) - n + 1] == owner[n - 1 :]
        out.append((hashed >> np.uint32(16))[whole].astype(np.int32))
        owners.append(owner[: len(codes) - n + 1][whole])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), letters
    return np.concatenate(out), np.concatenate(owners), letters


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # IDF times weight, by n-gram and language
    bias: np.ndarray
    temperature: float


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram occurs; each task counts its own part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(DIMENSIONS, np.int64), 0
        flags = np.zeros(DIMENSIONS, bool)
        for batch in (part for b in batches for part in _slices(b)):
            hashed, owner, letters = grams(texts_of(batch))
            order = np.argsort(owner, kind="stable")
            ends = np.cumsum(np.bincount(owner, minlength=len(letters)))
            for part in np.split(hashed[order], ends[:-1]):
                flags[part] = True
                counts += flags
                flags[part] = False
            rows += len(letters)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*seen.tolist(), -1], pa.int32()), pa.array([*counts[seen].tolist(), rows], pa.int64())], names=["gram", "n"])

    out = np.zeros(DIMENSIONS + 1)
    for row in docs.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n
    return out[:-1], int(out[-1])


def learn(docs: DataFrame, learn_from: Column, rows: int = FIT_ROWS) -> Model:
    """IDF from all rows to learn from; weights from at most ``rows`` of them."""
    usable = docs.where(learn_from & F.col("lang").isNotNull())
    languages = sorted(r.lang for r in usable.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), 1.0)
    frequency, n = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    each = max(1, rows // len(languages))
    known = usable.where(F.col("doc_id").isNotNull()).select("doc_id", "lang")
    chosen = top_n(known, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], each, ["doc_id"])
    # bounded by ``rows``, or one for each language: 40 bytes each
    sample = usable.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def sparse():
        def step(batch: pa.RecordBatch) -> dict:
            hashed, owner, letters = grams(texts_of(batch))
            order = np.argsort(owner, kind="stable")
            ends = np.cumsum(np.bincount(owner, minlength=len(letters)))
            index, value = [], []
            for part in np.split(hashed[order], ends[:-1]):
                found, counts = np.unique(part, return_counts=True)
                index.append(found.astype(np.uint16).tobytes())
                value.append((counts / max(1, len(part))).astype(np.float32).tobytes())
            return {"lang": batch.column("lang"), "key": batch.column("key"), "grams": pa.array(index, pa.binary()), "shares": pa.array(value, pa.binary())}

        return step

    shaped = map_batches(sample.select("lang", "text", F.xxhash64("doc_id", F.lit(7)).alias("key")), ["lang", "key", "text"], "lang string, key bigint, grams binary, shares binary", sparse)
    data = sorted((r.key, r.lang, bytes(r.grams), bytes(r.shares)) for r in shaped.collect())
    items = [(languages.index(lang), np.frombuffer(index, np.uint16).astype(np.int64), np.frombuffer(value, np.float32) * SCALE) for _, lang, index, value in data if index]
    items = [(y, index, value * idf[index]) for y, index, value in items]
    held = items[::5] if len(items) >= 50 else items
    weights, bias = follow_the_leader([x for i, x in enumerate(items) if len(items) < 50 or i % 5], len(languages))
    logits = np.array([value @ weights[index] + bias for _, index, value in held]).reshape(-1, len(languages))
    temperature = calibrate(logits, np.array([y for y, _, _ in held], int))
    return Model(languages, (idf[:, None] * weights).astype(np.float32), bias, temperature)


def follow_the_leader(items: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n-gram by class) and bias. L1 keeps weights at zero, L2 and the rates shrink the rest."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, index, value in items:
            at, x = np.append(index, DIMENSIONS), np.append(value, 1.0)
            w = weights(at)
            p = _softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the smallest log loss on a grid of ratios."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.2, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict_language(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score``, its calibrated probability."""

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch)
            hashed, owner, letters = grams(texts)
            size = np.maximum(1, np.bincount(owner, minlength=len(texts)))
            columns = [np.bincount(owner, weights=model.table[hashed, k], minlength=len(texts)) for k in range(len(model.languages))]
            if not columns:
                best, score, known = [0] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            else:
                p = _softmax((np.stack(columns, axis=1) * (SCALE / size)[:, None] + model.bias) / model.temperature)
                best, known = p.argmax(axis=1), letters > 0
                score = np.where(known, p.max(axis=1), 0.0)
            names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            return {c: batch.column(c) for c in keep} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())}

        return step

    kinds = dict(docs.dtypes)
    return map_batches(docs, [*keep, "text"], ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double", work)
