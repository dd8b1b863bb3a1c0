"""Main text of web pages: a linear-chain conditional random field labels their leaf blocks.

A block is described by the elements around it, the words of their classes and ids, and by its text: length,
share of links, ending, words of short texts, and how much text stands in the same container. The chain has two
labels (main text or not) and two sets of transitions, for blocks of the same container and of different ones.
It is trained on labelled pages (see ``page_layouts``: 1,500 drawn layouts, a parameter), with the penalised
likelihood by adaptive gradient steps, and decoded by Viterbi's algorithm, for all pages of a batch in step.

References are decoded and white space (any, as Unicode has it) is put together; blocks of main text are joined by
one space. A null or empty page, one without text, and one whose blocks are all labelled otherwise give an empty
text. Pages may end anywhere, also within a tag. Pages are read whole, one by one: repeated rows and ids
need no rule. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm.common import map_batches
from driftloom.llm.html_blocks import Block, leaf_blocks
from driftloom.llm.page_layouts import labelled_pages

#: Labelled pages that must have a feature.
LEAST_PAGES = 4
STEPS, RATE, RIDGE = 120, 0.3, 3e-5
_WORD = re.compile(r"[^\W\d_]+")


def block_features(blocks: list[Block], title: str) -> list[tuple[frozenset[str], list[str]]]:
    """For each block the marks around it, and its own features."""
    in_container: Counter[int] = Counter()
    for b in blocks:
        in_container[b.container] += max(0, len(b.text) - b.linked)
    longest, seen, out = max(in_container.values(), default=0), 0, []
    total = sum(len(b.text) for b in blocks)
    for k, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.split(None, 8)
        own = [
            f"own:{b.tag}",
            f"long:{size.bit_length()}",
            f"links:{min(4, 5 * b.linked // (size + 1))}",
            f"together:{in_container[b.container].bit_length()}",
            f"end:{b.text[-1] if not b.text[-1].isalnum() else 'a' if b.text[-1].isalpha() else '0'}",
            f"place:{4 * seen // max(1, total)}",
        ]
        own += [f"near {m}" for m in b.near]
        if in_container[b.container] == longest:
            own.append("most text")
        if k == 0:
            own.append("first")
        if k == len(blocks) - 1:
            own.append("last")
        if b.text == title:
            own.append(f"title:{b.tag}")
        if len(words) <= 8:
            own += [f"word:{w.lower()}" for w in _WORD.findall(b.text)]
        if "©" in b.text:
            own.append("rights")
        seen += size
        out.append((b.marks, own))
    return out


@dataclass
class Model:
    features: dict[str, int]
    marks: frozenset[str]
    weights: np.ndarray  # log odds of main text, by feature
    steps: np.ndarray  # by container (other, same), from label, to label


@dataclass
class Chains:
    """Blocks of many pages end to end: features of each, length of each page, and whether a block's container is the one before's."""

    ids: np.ndarray
    counts: np.ndarray
    lengths: np.ndarray
    same: np.ndarray

    def log_odds(self, weights: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        return np.bincount(owner, weights=weights[self.ids], minlength=len(self.counts))

    def steps(self) -> Iterable[tuple[int, np.ndarray]]:
        """For each place in a page the blocks that stand there, longest pages first."""
        order = np.argsort(-self.lengths, kind="stable")
        starts, sizes = (np.cumsum(self.lengths) - self.lengths)[order], self.lengths[order]
        for t in range(int(sizes[0]) if len(sizes) else 0):
            yield t, starts[: np.searchsorted(-sizes, -t, side="left")] + t


def chains(pages: Iterable[tuple[list[Block], list[tuple[frozenset[str], list[str]]]]], features: dict[str, int]) -> Chains:
    ids: list[int] = []
    counts, lengths, same = [], [], []
    known: dict[frozenset[str], list[int]] = {}
    for blocks, described in pages:
        before = None
        for b, (marks, own) in zip(blocks, described, strict=True):
            around = known.get(marks)
            if around is None:
                around = known[marks] = [features[m] for m in marks if m in features]
            mine = [features[f] for f in own if f in features]
            ids += around
            ids += mine
            counts.append(len(around) + len(mine))
            same.append(b.container == before)
            before = b.container
        lengths.append(len(blocks))
    return Chains(np.array(ids, np.int64), np.array(counts, np.int64), np.array(lengths, np.int64), np.array(same, np.int64))


def marginals(c: Chains, odds: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of main text for each block, and expected transitions by container, from and to label."""
    local = np.exp(np.stack([np.minimum(0, -odds), np.minimum(0, odds)], axis=1))
    move = np.exp(steps - steps.max())
    forward, backward = np.zeros_like(local), np.ones_like(local)
    pairs = np.zeros_like(steps)
    places = list(c.steps())
    for t, at in places:
        value = local[at] if t == 0 else local[at] * np.einsum("ki,kij->kj", forward[at - 1], move[c.same[at]])
        forward[at] = value / value.sum(axis=1, keepdims=True)
    for t, at in reversed(places[1:]):
        ahead = local[at] * backward[at]
        value = np.einsum("kij,kj->ki", move[c.same[at]], ahead)
        joint = forward[at - 1][:, :, None] * move[c.same[at]] * ahead[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        for kind in (0, 1):
            pairs[kind] += joint[c.same[at] == kind].sum(axis=0)
        backward[at - 1] = value / value.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


def viterbi(c: Chains, odds: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The likeliest labels of each page; of equal ones those that are not main text."""
    local = np.stack([np.zeros(len(odds)), odds], axis=1)
    score, back = np.zeros_like(local), np.zeros(local.shape, np.int8)
    label = np.zeros(len(odds), np.int8)
    places = list(c.steps())
    for t, at in places:
        if t == 0:
            score[at] = local[at]
            continue
        reached = score[at - 1][:, :, None] + steps[c.same[at]]
        back[at] = reached.argmax(axis=1)
        score[at] = reached.max(axis=1) + local[at]
        score[at] -= score[at].max(axis=1, keepdims=True)
    ends = np.cumsum(c.lengths)[c.lengths > 0] - 1
    label[ends] = score[ends, 1] > score[ends, 0]
    for _, at in reversed(places[1:]):
        label[at - 1] = back[at, label[at]]
    return label == 1


def train(pages: Iterable[str], steps: int = STEPS) -> Model:
    """Weights from pages whose main text is labelled in their markup."""
    parsed = [leaf_blocks(p) for p in pages]
    described = [(blocks, block_features(blocks, title)) for blocks, title in parsed if blocks]
    support: Counter[str] = Counter()
    for _, page in described:
        support.update({f for marks, own in page for f in (*marks, *own)})
    kept = sorted(f for f, n in support.items() if n >= LEAST_PAGES)
    features = {f: k for k, f in enumerate(kept)}
    model = Model(features, frozenset(f for f in kept if f.startswith(("in:", "c:", "hidden"))), np.zeros(len(kept)), np.zeros((2, 2, 2)))
    c = chains(described, features)
    y = np.array([b.main for blocks, _ in described for b in blocks], np.int64)
    if not len(y):
        return model
    first = np.zeros(len(y), bool)
    first[np.cumsum(c.lengths) - c.lengths] = True
    observed = np.zeros((2, 2, 2))
    np.add.at(observed, (c.same[~first], y[:-1][~first[1:]], y[~first]), 1)
    owner = np.repeat(np.arange(len(y)), c.counts)
    squares = [np.full(len(kept), 1e-8), np.full((2, 2, 2), 1e-8)]
    for _ in range(steps):
        p, pairs = marginals(c, c.log_odds(model.weights), model.steps)
        gradient = np.bincount(c.ids, weights=(y - p)[owner], minlength=len(kept)) / len(y) - RIDGE * model.weights
        between = (observed - pairs) / len(y) - RIDGE * model.steps
        for value, change, square in ((model.weights, gradient, squares[0]), (model.steps, between, squares[1])):
            square += change**2
            value += RATE * change / np.sqrt(square)
    return model


@lru_cache(maxsize=2)
def default_model() -> Model:
    return train(labelled_pages())


def main_texts(pages: list[str], model: Model) -> list[str]:
    """Main text of each page."""
    parsed = [leaf_blocks(p, model.marks) for p in pages]
    described = [(blocks, block_features(blocks, title)) for blocks, title in parsed]
    c = chains(described, model.features)
    chosen = viterbi(c, c.log_odds(model.weights), model.steps).tolist() if len(c.counts) else []
    out, at = [], 0
    for blocks, _ in parsed:
        out.append(" ".join(b.text for b, main in zip(blocks, chosen[at : at + len(blocks)], strict=True) if main))
        at += len(blocks)
    return out


def extract_main(pages: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and ``text``, the main text of the column ``html``. ``keep`` must not name ``text`` or ``html``."""
    model = model or default_model()

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            texts = main_texts([h or "" for h in batch.column("html").to_pylist()], model)
            return {c: batch.column(c) for c in keep} | {"text": pa.array(texts, pa.string())}

        return step

    kinds = dict(pages.dtypes)
    return map_batches(pages, [*[f"`{c}`" for c in keep], "html"], ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string", work)
