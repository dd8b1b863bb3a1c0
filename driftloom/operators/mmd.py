"""Kernel two-sample distance between a trigger batch and the reference."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftloom.functions.hashing import key31, mix31

# Smallest threshold, sample size, guards, bandwidth factors and safety factors.
THRESHOLD = 0.05
SAMPLE_SIZE = 200
MIN_CURRENT = 10
MIN_REFERENCE = 20
BANDWIDTH_FACTORS = (0.1, 0.5, 1.0, 2.0, 10.0)
CALIBRATION_FACTOR = 5.0
STREAM_FACTOR = 1.2


@dataclass(frozen=True)
class MmdParams:
    threshold: float = THRESHOLD
    sample_size: int = SAMPLE_SIZE
    noise_warmup: bool = False
    seed: int = 42


def sq_distances(z: np.ndarray) -> np.ndarray:
    """All squared distances by one matrix product; near-zero ones again from the differences.

    The product form loses digits where points coincide, and the bandwidth below depends on which
    distances are exactly zero.
    """
    norms = np.einsum("ij,ij->i", z, z)
    d2 = np.maximum(norms[:, None] + norms[None, :] - 2.0 * (z @ z.T), 0.0)
    i, j = np.nonzero(d2 <= 1e-6 * (norms[:, None] + norms[None, :]))
    gap = z[i] - z[j]
    d2[i, j] = np.einsum("ij,ij->i", gap, gap)
    return d2


def median_bandwidth(d2: np.ndarray) -> float:
    """Exact median of the positive squared distances; NaN when all points coincide."""
    positive = d2[d2 > 0]
    return float(np.median(positive)) if positive.size else float("nan")


def mmd2(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Unbiased multi-bandwidth MMD² (not clamped) and the median bandwidth."""
    n, m = len(x), len(y)
    d2 = sq_distances(np.vstack([x, y]).astype(np.float64))
    base = median_bandwidth(d2)
    total = 0.0
    for factor in BANDWIDTH_FACTORS:
        kernel = np.exp(-d2 / (2.0 * base * factor))
        np.fill_diagonal(kernel, 0.0)
        within_x = kernel[:n, :n].sum() / (n * (n - 1))
        within_y = kernel[n:, n:].sum() / (m * (m - 1))
        total += within_x + within_y - 2.0 * kernel[:n, n:].mean()
    return total, base


def score(x: np.ndarray, y: np.ndarray) -> float:
    value, _ = mmd2(x, y)
    return value if np.isnan(value) else float(np.sqrt(max(value, 0.0)))


def seeded_order(n: int, *key: object) -> np.ndarray:
    """A permutation that depends on the key alone."""
    return np.argsort(mix31(key31(*key), np.arange(n)), kind="stable")


def sample(rows: np.ndarray, size: int, *key: object) -> np.ndarray:
    """``size`` rows without replacement; all of them, in order, when there are no more."""
    return rows if len(rows) <= size else rows[seeded_order(len(rows), *key)[:size]]


def calibrated_threshold(stream: str, reference: np.ndarray, p: MmdParams) -> float:
    """A multiple of the score between two random halves of the reference, at least the default."""
    order = seeded_order(len(reference), p.seed, "halves", stream)
    cut = len(reference) // 2
    a = sample(reference[order[:cut]], p.sample_size, p.seed, "half", stream, 0)
    b = sample(reference[order[cut:]], p.sample_size, p.seed, "half", stream, 1)
    null_score = score(a, b)
    return null_score if np.isnan(null_score) else max(null_score * CALIBRATION_FACTOR, p.threshold)


def score_chunk(p: MmdParams, stream: str, reference: np.ndarray, batches: list[tuple[int, np.ndarray]]):
    """Score every batch of a chunk; the threshold depends on the reference alone.

    In noise warm-up the threshold comes from the first batch of the stream and is filled in
    afterwards, because that batch may lie in another chunk.
    """
    if len(reference) < MIN_REFERENCE:
        return
    threshold = None if p.noise_warmup else calibrated_threshold(stream, reference, p)
    y = sample(reference, p.sample_size, p.seed, "reference", stream)
    for number, rows in batches:
        if len(rows) < MIN_CURRENT:
            continue
        value = score(sample(rows, p.sample_size, p.seed, "batch", stream, number), y)
        yield number, value, threshold
