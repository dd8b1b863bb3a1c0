"""Quality of a text: a linear-chain conditional random field labels its lines good or bad.

Every line is described by shares of character classes, repetition, length and the like, and by the same
of the lines before and after it; values are cut into bins. The chain has two labels, a weight for each
bin and label, and weights for the four transitions. It is trained on a bounded sample of labelled
texts. Labels of lines are hidden: the label of a text is what its lines show through a channel that lets
a share of ``NOISE`` of them be of the other kind. So a line that good and bad texts have alike is not
forced to the label of its text. Forward-backward gives each line the probability to be
good; their mean, weighted by length, is the quality of the text, and a logistic curve fitted on the
sample turns it into a score.

A null or empty text, and one of blank lines only, gets the share of good texts in the sample. Texts are
read whole. Rows are scored one by one, so repeated rows and ids need no rule; if a labelled id has
several labels, the largest counts. Without labelled rows the score is 0.5.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from driftloom.llm.common import fit_logistic, labelled_sample, list_column, map_batches, sigmoid, texts_of

#: Labelled rows used for fitting, at most.
FIT_ROWS = 3_000
BINS = 8
STEPS, RATE, RIDGE = 120, 0.3, 2e-3
#: Share of lines of a text that may be of the other label than the text.
NOISE = 0.2
#: Steps before the transitions move: contrasts between lines alone.
CONTRAST_STEPS = 40

NAMES = ("upper", "digit", "punctuation", "symbol", "bar", "distinct", "word_length", "length", "repeated", "bad_end")
NEIGHBOURS = ("upper", "symbol", "bar", "distinct", "length")
_NEAR = [NAMES.index(n) for n in NEIGHBOURS]
WIDTH = len(NAMES) + 2 * len(NEIGHBOURS)

_OTHER, _UPPER, _DIGIT, _SPACE, _PUNCTUATION, _SYMBOL, _BAR = range(7)


def _character_class(c: str) -> int:
    if c == "|":
        return _BAR
    if c.isalpha():
        return _UPPER if c.isupper() else _OTHER
    if c.isdigit():
        return _DIGIT
    if c.isspace():
        return _SPACE
    return _PUNCTUATION if c in ".,;:?'\"-()’“”«»¿¡…" else _SYMBOL


_CLASS = np.array([_character_class(chr(c)) for c in range(sys.maxunicode + 1)], np.int64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, length of each line, number of lines of each text)."""
    split = [t.split("\n") for t in texts]
    lines = [line for part in split for line in part]
    sizes = np.array([len(line) for line in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(np.repeat(np.arange(len(lines)) * 7, sizes) + _CLASS[codes], minlength=7 * len(lines)).reshape(-1, 7)
    out = np.zeros((len(lines), WIDTH), np.float32)
    size = np.maximum(1, sizes - counts[:, _SPACE])
    for column, kind in enumerate((_UPPER, _DIGIT, _PUNCTUATION, _SYMBOL, _BAR)):
        out[:, column] = counts[:, kind] / size
    words = [line.split() for line in lines]
    n = np.array([len(w) for w in words])
    out[:, 5] = np.array([len(set(w)) for w in words]) / np.maximum(1, n)
    out[:, 6] = size / np.maximum(1, n)
    out[:, 7] = np.log1p(sizes)
    out[:, 8] = [c[line] > 1 if line else 0 for part in split for c in (Counter(part),) for line in part]
    out[:, 9] = [bool(line) and line.rstrip()[-1:] not in ".!?:;\"'”»)" for line in lines]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in split])
    same = owner[1:] == owner[:-1]
    k = len(NEIGHBOURS)
    out[:, len(NAMES) :] = -1  # no such line
    out[1:, len(NAMES) : len(NAMES) + k][same] = out[:-1, _NEAR][same]
    out[:-1, len(NAMES) + k :][same] = out[1:, _NEAR][same]
    return out, sizes, np.array([len(p) for p in split])


@dataclass
class Model:
    edges: np.ndarray | None  # inner borders of the bins of each feature
    weights: np.ndarray | None  # by feature, bin and label (bad, good)
    transitions: np.ndarray | None  # from label, to label
    curve: np.ndarray | None  # slope, intercept
    prior: float


def binned(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], features[:, j], side="left") for j in range(features.shape[1])], axis=1)


def potentials(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log potential of both labels for each line."""
    return weights[np.arange(bins.shape[1]), bins].sum(axis=1)


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of both labels for each line, and summed over all texts for each transition.

    All texts move along their lines together, so the work is one step for the first lines, one for the
    second lines and so on; sums are rescaled at each line and cannot overflow.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    forward, backward = np.zeros_like(local), np.zeros_like(local)
    pairs = np.zeros((2, 2))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts with at least so many lines
    for t in range(longest):
        at = starts[: active[t]] + t
        value = local[at] if t == 0 else local[at] * (forward[at - 1] @ step)
        forward[at] = value / value.sum(axis=1, keepdims=True)
    for t in range(longest - 1, -1, -1):
        at = starts[: active[t]] + t
        value = np.ones((len(at), 2))
        more = active[t + 1] if t + 1 < longest else 0
        if more:
            ahead = local[at[:more] + 1] * backward[at[:more] + 1]
            value[:more] = ahead @ step.T
            joint = forward[at[:more]][:, :, None] * step[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at] = value / value.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300), pairs


def train(bins: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by adaptive gradient steps on the likelihood of the texts' labels.

    With the hidden labels of lines summed out, the gradient is what the chain expects given the label
    of the text less what it expects without it.
    """
    weights, transitions = np.zeros((bins.shape[1], BINS, 2)), np.zeros((2, 2))
    y = np.repeat(labels, lengths)
    seen = np.log(np.where(np.eye(2)[y] == 1, 1 - NOISE, NOISE))
    columns = np.arange(bins.shape[1])
    flat = (columns * BINS + bins).ravel()
    squares = [np.full(weights.shape, 1e-8), np.full(transitions.shape, 1e-8)]
    # both classes weigh the same
    share = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)]) * len(labels)
    for number in range(STEPS):
        emission = potentials(bins, weights)
        free, free_pairs = forward_backward(emission, lengths, transitions)
        given, given_pairs = forward_backward(emission + seen, lengths, transitions)
        gap = (given - free) * share[y][:, None]
        gradient = np.stack([np.bincount(flat, weights=np.repeat(gap[:, k], bins.shape[1]), minlength=bins.shape[1] * BINS) for k in (0, 1)], axis=1)
        gradient = gradient.reshape(bins.shape[1], BINS, 2) / len(y) - RIDGE * weights
        between = (given_pairs - free_pairs) / len(y) - RIDGE * transitions
        moves = [(weights, gradient, squares[0])] + [(transitions, between, squares[1])] * (number >= CONTRAST_STEPS)
        for value, change, square in moves:
            square += change**2
            value += RATE * change / np.sqrt(square)
    return weights, transitions


def text_quality(good: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean probability of good lines weighted by length; NaN for texts of empty lines only."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(owner, weights=sizes, minlength=len(lengths))
    weighted = np.bincount(owner, weights=good * sizes, minlength=len(lengths))
    return np.where(total > 0, weighted / np.maximum(total, 1), np.nan)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = FIT_ROWS) -> Model:
    """The chain and the curve from at most ``rows`` labelled documents."""
    sample = labelled_sample(docs, labels, "quality", learn_from, rows)

    def described():
        def step(batch: pa.RecordBatch) -> dict:
            features, sizes, lengths = line_features(texts_of(batch))
            ends = np.cumsum(lengths)
            return {
                "label": batch.column("label"),
                "doc_id": batch.column("doc_id"),
                "features": pa.array([f.tobytes() for f in np.split(features, ends[:-1])], pa.binary()),
                "sizes": list_column(sizes, lengths.tolist(), pa.int64()),
            }

        return step

    kind = dict(docs.dtypes)["doc_id"]
    found = map_batches(sample, ["doc_id", "label", "text"], f"label int, doc_id {kind}, features binary, sizes array<bigint>", described).collect()
    found.sort(key=lambda r: (r.doc_id, r.label, bytes(r.features)))
    found = [r for r in found if sum(r.sizes)]
    y = np.array([r.label == 1 for r in found], int)
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, None, float(y.mean()) if len(y) else 0.5)
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, WIDTH) for r in found])
    sizes = np.concatenate([np.array(r.sizes) for r in found])
    lengths = np.array([len(r.sizes) for r in found])
    edges = np.quantile(features[sizes > 0], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    bins = binned(features, edges)
    weights, transitions = train(bins, lengths, y)
    p, _ = forward_backward(potentials(bins, weights), lengths, transitions)
    curve = fit_logistic(text_quality(p[:, 1], sizes, lengths)[:, None], y.astype(float), ridge=0.1)
    return Model(edges, weights, transitions, curve, float(y.mean()))


def good_lines(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each line to be good, length of each line, number of lines of each text)."""
    features, sizes, lengths = line_features(texts)
    p, _ = forward_backward(potentials(binned(features, model.edges), model.weights), lengths, model.transitions)
    return p[:, 1], sizes, lengths


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``score``, and ``good_lines``: the lines likelier good than bad."""

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch)
            if model.weights is None:
                score, good = np.full(len(texts), model.prior), np.zeros(len(texts), np.int64)
            else:
                p, sizes, lengths = good_lines(texts, model)
                quality = text_quality(p, sizes, lengths)
                score = np.where(np.isnan(quality), model.prior, sigmoid(np.nan_to_num(quality) * model.curve[0] + model.curve[1]))
                good = np.bincount(np.repeat(np.arange(len(texts)), lengths), weights=(p >= 0.5) & (sizes > 0), minlength=len(texts)).astype(np.int64)
            return {c: batch.column(c) for c in keep} | {"score": pa.array(score, pa.float64()), "good_lines": pa.array(good, pa.int64())}

        return step

    kinds = dict(docs.dtypes)
    return map_batches(docs, [*keep, "text"], ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, good_lines bigint", work)
