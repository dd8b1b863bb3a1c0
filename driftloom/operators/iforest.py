"""Isolation forest on the bounded reference set of a stream.

Every random choice is a counter hash of seed, stream, tree and node, so a forest does not depend on where or when
it is grown. Forests are fitted once into a table of models (:func:`fit_models`), one row for each stream, which
scorers read, and which :func:`refit_models` renews where a reference has changed its size enough.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.hashing import PRIME, key31, mix31
from driftloom.operators.ordered import fresh
from driftloom.storage import cut

# Forest size, sub-sample, guards, distance of the threshold from the mean.
N_TREES = 100
MAX_SAMPLES = 256
MIN_CURRENT = 5
MIN_REFERENCE = 20
SIGMAS = 3.0
REFIT_SHARE = 0.1
EULER_GAMMA = 0.5772156649015329


@dataclass(frozen=True)
class ForestParams:
    n_trees: int = N_TREES
    max_samples: int = MAX_SAMPLES
    seed: int = 42


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1.0, 0.0, np.where(n <= 2.0, 1.0, long))


#: Counters of the draws for nodes begin here; those below draw the sub-sample.
_NODE_DRAWS = 1_000_000


def grow_tree(rows: np.ndarray, key: int, max_samples: int = MAX_SAMPLES):
    """Split feature (-1 at a leaf, -2 where there is no node), split value, left child, path length, by node.

    Nodes are numbered as in a heap: the children of ``k`` are ``2k + 1`` and ``2k + 2``. A split takes one of the
    features that are not constant in the node and a cut in its range, both drawn by the key and the node.
    """
    size = min(max_samples, len(rows))
    order = np.lexsort((np.arange(len(rows)), mix31(key, np.arange(len(rows)))))
    picked = rows[np.sort(order[:size])]
    limit = int(np.ceil(np.log2(max(size, 2))))
    width = (1 << (limit + 1)) - 1
    draws = mix31(key, _NODE_DRAWS + np.arange(2 * width))
    feature, cut, path = np.full(width, -2, np.int32), np.zeros(width), np.zeros(width)
    left = np.where(np.arange(width) < width // 2, 2 * np.arange(width) + 1, -1)
    pending = [(0, np.arange(size), 0)]
    while pending:
        node, members, depth = pending.pop()
        low, high = picked[members].min(axis=0), picked[members].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or not open_features.size:
            feature[node], left[node], path[node] = -1, -1, depth + float(mean_path(len(members)))
            continue
        f = int(open_features[draws[2 * node] % len(open_features)])
        at = low[f] + draws[2 * node + 1] / PRIME * (high[f] - low[f])
        feature[node], cut[node] = f, at
        right = picked[members, f] > at
        pending += [(2 * node + 1, members[~right], depth + 1), (2 * node + 2, members[right], depth + 1)]
    return feature, cut, left, path


def score_samples(forest: list, rows: np.ndarray, reference_size: int, max_samples: int = MAX_SAMPLES) -> np.ndarray:
    """Negative anomaly score of each row: near -1 abnormal, near 0 normal."""
    depth = np.zeros(len(rows))
    for feature, cut, left, path in forest:
        node = np.zeros(len(rows), dtype=int)
        active = feature[node] >= 0
        while active.any():
            at = node[active]
            node[active] = left[at] + (rows[active, feature[at]] > cut[at])
            active = feature[node] >= 0
        depth += path[node]
    denominator = len(forest) * float(mean_path(min(max_samples, reference_size)))
    return -np.power(2.0, -depth / denominator)


def grow(reference: np.ndarray, p: ForestParams, stream: str = "") -> list:
    return [grow_tree(reference, key31(p.seed, "tree", stream, t), p.max_samples) for t in range(p.n_trees)]


@lru_cache(maxsize=64)
def _fitted(p: ForestParams, stream: str, size: int, content: bytes) -> tuple[list, float]:
    reference = np.frombuffer(content).reshape(size, -1)
    forest = grow(reference, p, stream)
    own = score_samples(forest, reference, size, p.max_samples)
    return forest, float(own.mean() - SIGMAS * own.std())


def fitted(p: ForestParams, stream: str, reference: np.ndarray) -> tuple[list, float]:
    """Forest and threshold (mean minus three deviations of the reference scores) of a stream.

    A worker keeps the latest 64: later chunks and micro-batches with the same reference do not grow it again.
    """
    return _fitted(p, stream, len(reference), np.ascontiguousarray(reference, np.float64).tobytes())


def score_chunk(p: ForestParams, stream: str, reference: np.ndarray, batches: list[tuple[int, np.ndarray]]):
    """Mean score of each batch, and the threshold of the stream."""
    if len(reference) < MIN_REFERENCE:
        return
    forest, threshold = fitted(p, stream, reference)
    for number, rows in batches:
        if len(rows) < MIN_CURRENT:
            continue
        scores = score_samples(forest, rows.astype(np.float64), len(reference), p.max_samples)
        yield number, float(scores.mean()), threshold


MODEL = "stream_id string, fitted_size long, threshold double, feature array<array<int>>, cut array<array<double>>, path array<array<double>>"


def fit_models(references: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """One model for each stream: the size it was fitted on, its threshold, and its trees as flat arrays by node.

    ``references`` holds the bounded reference rows ``(stream_id, pos, vec)``; streams with fewer than
    twenty of them get none.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < MIN_REFERENCE:
            return pd.DataFrame(columns=["stream_id", "fitted_size", "threshold", "feature", "cut", "path"])
        stream = rows.stream_id.iloc[0]
        forest, threshold = fitted(p, stream, np.stack(rows.sort_values("pos").vec))
        feature, cut, _, path = zip(*forest, strict=True)
        return pd.DataFrame({"stream_id": [stream], "fitted_size": [len(rows)], "threshold": [threshold], "feature": [feature], "cut": [cut], "path": [path]})

    return references.select("stream_id", "pos", "vec").groupBy("stream_id").applyInPandas(one, MODEL)


def forest_of(model) -> list:
    """The trees of a row of the table of models, for :func:`score_samples`."""
    trees = zip(model.feature, model.cut, model.path, strict=True)
    return [(np.asarray(f), np.asarray(c), 2 * np.arange(len(f)) + 1, np.asarray(q)) for f, c, q in trees]


def fit_forest(references: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """Node table ``(stream_id, tree, node, feature, cut, left_child, path)`` of the models."""
    trees = fit_models(references, p).select("stream_id", F.posexplode(F.arrays_zip("feature", "cut", "path")).alias("tree", "t"))
    nodes = trees.select("stream_id", "tree", F.posexplode(F.arrays_zip("t.feature", "t.cut", "t.path")).alias("node", "n"))
    left = F.when(F.col("n.feature") >= 0, 2 * F.col("node") + 1).otherwise(-1)
    return nodes.where("n.feature > -2").select("stream_id", "tree", "node", "n.feature", "n.cut", left.alias("left_child"), "n.path")


def refit_models(models: DataFrame, references: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """The table of models for the references of now: streams whose reference has changed enough, and new ones,
    are fitted again, the others keep their model."""
    sizes = references.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_size"))
    sized = sizes.join(models.select("stream_id", F.col("fitted_size").alias("_fitted")), "stream_id", "left")
    due = cut(sized.where(needs_refit(F.col("_size"), F.col("_fitted"))).select("stream_id"))
    renewed = fit_models(references.join(due, "stream_id", "left_semi"), p)
    return models.join(fresh(renewed.select("stream_id")), "stream_id", "left_anti").unionByName(renewed)


def needs_refit(current: Column, fitted: Column) -> Column:
    """A reference that changed its size by more than a tenth calls for a new forest."""
    return fitted.isNull() | (F.abs(current - fitted) > current * REFIT_SHARE)
