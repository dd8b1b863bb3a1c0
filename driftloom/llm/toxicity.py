"""Toxicity: a lexicon learnt from labels, matched with misspellings, weighed by context.

Learning (on a bounded sample of labelled rows): terms are whole words and word stems. A term's support
is the number of different words it follows in toxic texts, so that copies of one text count once. Terms
far more frequent in toxic than in other texts make the lexicon.

Matching: the lexicon is a trie. The Levenshtein automaton of up to two edits runs over it: a state is the
set of (trie node, edits so far) that a word's letters can lead to, and the steps between such sets are
computed when first met. So a word is read once, whatever the size of the lexicon. Near spellings that
the sample's clean texts use are no match.

Context: a match in quotation marks or beside a word of reporting counts for a fraction. A logistic
regression on what is left gives the score.

Null and empty texts match nothing and get the score of a text without matches. Texts are read whole.
Rows are scored one by one, so ties, repeated rows and ids need no rule; if a labelled id has several
labels, the largest counts. Without any labelled row the score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import fit_logistic, labelled_sample, map_batches, sigmoid, texts_of
from driftloom.storage import cut

WORD = re.compile(r"[^\W_]+(?:[@$!*]+[^\W_]+)*")
#: Labelled rows used for fitting, at most.
FIT_ROWS = 30_000
#: Terms this many times as frequent in toxic as in other texts make the lexicon.
LIFT = 20
STEM = (4, 7)

# fixed values: words that report what others said
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes according reported claims claimed told word term phrase "
    "dijo dice escribió llamó según palabra "
    "sagte sagt schrieb nannte laut zitat wort "
    "dit écrit appelé selon citation mot".split()
)
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’"}
WINDOW = 8
IN_QUOTES, REPORTED, EDIT = 0.4, 0.6, 0.75


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


def edits_allowed(term: Term) -> int:
    """Long words may differ more; a stem is followed by anything, so short ones must be exact."""
    size = len(term.text) - (2 if term.stem else 0)
    return 0 if size < 5 else 1 if size < 8 else 2


class Matcher:
    """Words against the lexicon; :meth:`credit` is the weight of the best term, less for each edit."""

    def __init__(self, terms: list[Term], clean: frozenset[str] = frozenset()):
        self.clean = clean
        self.children: list[dict[str, int]] = []
        self.end: list[tuple[float, float]] = []  # weight as a whole word, as a stem
        self.limit: list[int] = []
        starts = {}
        for term in sorted(terms, key=lambda t: (t.text, t.stem)):
            k = edits_allowed(term)
            node = starts[k] = starts[k] if k in starts else self._node(k)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = self._node(k)
                node = self.children[node][letter]
            whole, stem = self.end[node]
            self.end[node] = (whole, max(stem, term.weight)) if term.stem else (max(whole, term.weight), stem)
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.credits: list[float] = []
        self.exact: list[bool] = []
        self.start = self._number(self._closed({start: 0 for start in starts.values()}, 0.0, False))

    def _node(self, limit: int) -> int:
        self.children.append({})
        self.end.append((0.0, 0.0))
        self.limit.append(limit)
        return len(self.children) - 1

    def _closed(self, nodes: dict[int, int], stem: float, exact: bool) -> tuple:
        """With letters of the term left out (an edit each); stems that end here hold for all that follows."""
        queue = list(nodes)
        while queue:
            node = queue.pop()
            edits = nodes[node]
            if edits < self.limit[node]:
                for child in self.children[node].values():
                    if nodes.get(child, 99) > edits + 1:
                        nodes[child] = edits + 1
                        queue.append(child)
        for node, edits in nodes.items():
            credit = self.end[node][1] * EDIT**edits
            if credit > stem:
                stem, exact = credit, edits == 0
        return tuple(sorted(nodes.items())), stem, exact

    def _number(self, closed: tuple) -> int:
        if closed not in self.numbers:
            self.numbers[closed] = len(self.sets)
            self.sets.append(closed)
            self.steps.append({})
            nodes, credit, exact = closed
            for node, edits in nodes:
                if self.end[node][0] * EDIT**edits > credit:
                    credit, exact = self.end[node][0] * EDIT**edits, edits == 0
            self.credits.append(credit)
            self.exact.append(exact)
        return self.numbers[closed]

    def _step(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        known, stem, exact = self.sets[state]
        for node, edits in known:
            child = self.children[node].get(letter)
            if child is not None:
                nodes[child] = min(edits, nodes.get(child, 99))
            if edits < self.limit[node]:
                nodes[node] = min(edits + 1, nodes.get(node, 99))  # a letter too many
                for other in self.children[node].values():  # another letter
                    nodes[other] = min(edits + 1, nodes.get(other, 99))
        self.steps[state][letter] = found = self._number(self._closed(nodes, stem, exact))
        return found

    def read(self, word: str) -> tuple[float, bool]:
        """(credit, whether without edits); credit 0 is no match."""
        state, steps, sets = self.start, self.steps, self.sets
        for letter in word:
            row = steps[state]
            state = row[letter] if letter in row else self._step(state, letter)
            nodes, stem, _ = sets[state]
            if not nodes:
                break
        if len(self.sets) > 200_000:  # bounded; made again as needed
            credit, exact = self.credits[state], self.exact[state]
            self._forget()
            return credit, exact
        return self.credits[state], self.exact[state]

    def _forget(self) -> None:
        first = self.sets[self.start]
        self.numbers, self.sets, self.steps, self.credits, self.exact = {}, [], [], [], []
        self.start = self._number(first)

    def credit(self, word: str) -> float:
        credit, exact = self.read(word)
        return credit if exact or word not in self.clean else 0.0


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    clean: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 0.0, -35.0]))


FEATURES = 4


def features(text: str, matcher: Matcher, known: dict[str, float]) -> tuple[list[float], int, int]:
    """What the regression sees, the number of matches, and how many of them are quoted or reported."""
    low = text.lower()
    words = WORD.findall(low)
    hits = False
    for word in set(words):
        credit = known.get(word)
        if credit is None:
            credit = matcher.credit(word)
            if len(known) < 200_000:
                known[word] = credit
        if credit:
            hits = True
    if not hits:
        return [0.0] * FEATURES, 0, 0
    best = total = 0.0
    n = quoted = 0
    spans = [m.span() for m in WORD.finditer(low)]
    for at, word in enumerate(words):
        credit = known[word] if word in known else matcher.credit(word)
        if credit:
            inside = in_quotes(low, *spans[at])
            reported = not REPORTING.isdisjoint(words[max(0, at - WINDOW) : at + WINDOW + 1])
            credit *= (IN_QUOTES if inside else 1.0) * (REPORTED if reported else 1.0)
            best, total, n, quoted = max(best, credit), total + credit, n + 1, quoted + (inside or reported)
    return [best, math.log1p(total), math.log1p(quoted), min(3.0, 100 * total / len(words))], n, quoted


def in_quotes(text: str, start: int, end: int) -> bool:
    """Whether a quotation mark opens before the word and closes after it, on the same line."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    before, after = text[line:start], text[end : stop if stop >= 0 else len(text)]
    for opening, closing in QUOTES.items():
        if opening == closing:
            if before.count(opening) % 2 and opening in after:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in after:
            return True
    return False


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled documents."""
    sample = cut(labelled_sample(docs, labels, "toxic", learn_from, rows).dropDuplicates(["text", "label"]))
    sizes = dict(sample.groupBy("label").count().collect())
    toxic, others = sizes.get(1, 0), sum(n for label, n in sizes.items() if label != 1)
    if not toxic or not others:
        return Model(weights=np.array([0.0] * FEATURES + [35.0 if toxic else -35.0]))
    terms = _lexicon(sample, toxic, others)
    matcher = Matcher(terms)

    def near_spellings():
        def step(batch: pa.RecordBatch) -> dict:
            words = set().union(*(WORD.findall(t.lower()) for t in texts_of(batch)))
            found = []
            for word in words:
                credit, exact = matcher.read(word)
                if credit and not exact:
                    found.append(word)
            return {"word": pa.array(found, pa.string())}

        return step

    clean = frozenset(r.word for r in map_batches(sample.where("label = 0"), ["text"], "word string", near_spellings).distinct().collect())
    model = Model(terms, clean)
    seen = _featured(sample, model, ("label",)).drop("n_matches", "n_quoted").toPandas()
    x = seen[[f"f{i}" for i in range(FEATURES)]].to_numpy()
    model.weights = fit_logistic(x, (seen["label"] == 1).to_numpy().astype(float), ridge=0.5)
    return model


def _lexicon(sample: DataFrame, toxic: int, others: int) -> list[Term]:
    def contexts():
        def step(batch: pa.RecordBatch) -> dict:
            rows = set()
            for text in texts_of(batch):
                left = ""
                for word in WORD.findall(text.lower()):
                    if len(word) >= STEM[0]:
                        rows.add((word, False, left, word))
                        rows.update((word[:k], True, left, word) for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1))
                    left = word
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return {n: pa.array(list(c), t) for n, c, t in zip(("term", "stem", "left", "word"), columns, (pa.string(), pa.bool_(), pa.string(), pa.string()), strict=True)}

        return step

    support = (
        map_batches(sample.where("label = 1"), ["text"], "term string, stem boolean, left string, word string", contexts)
        .groupBy("term", "stem")
        .agg(F.countDistinct("left").alias("support"), F.countDistinct("word").alias("words"))
    )
    least = max(3, round(0.005 * toxic))
    candidates = support.where((F.col("support") >= least) & (~F.col("stem") | ((F.col("words") >= 5) & (F.col("words") >= 0.1 * F.col("support")))))

    def uses():
        def step(batch: pa.RecordBatch) -> dict:
            counts: dict[tuple[str, bool], int] = {}
            for text in texts_of(batch):
                for word, n in Counter(w for w in WORD.findall(text.lower()) if len(w) >= STEM[0]).items():
                    counts[word, False] = counts.get((word, False), 0) + n
                    for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1):
                        counts[word[:k], True] = counts.get((word[:k], True), 0) + n
            return {"term": pa.array([t for t, _ in counts], pa.string()), "stem": pa.array([s for _, s in counts], pa.bool_()), "n": pa.array(list(counts.values()), pa.int64())}

        return step

    used = map_batches(sample.where("label <> 1"), ["text"], "term string, stem boolean, n bigint", uses).groupBy("term", "stem").agg(F.sum("n").alias("n"))
    value = (F.col("support") / toxic) / ((F.coalesce("n", F.lit(0)) + 0.5) / others)
    # terms of a bounded sample, and of those only what the lexicon may take
    lifted = candidates.join(used, ["term", "stem"], "left").withColumn("lift", value).where(F.col("lift") >= LIFT).select("term", "stem", "lift").collect()
    chosen: list[Term] = []
    stems: set[str] = set()
    for r in sorted(lifted, key=lambda r: (len(r.term), not r.stem, r.term)):
        if stems.isdisjoint(r.term[:k] for k in range(STEM[0], STEM[1] + 1)):
            chosen.append(Term(r.term, r.stem, min(1.0, math.log(r.lift) / math.log(300))))
            if r.stem:
                stems.add(r.term)
    return chosen


def _featured(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    def work():
        matcher, known = Matcher(model.terms, model.clean), {}

        def step(batch: pa.RecordBatch) -> dict:
            rows = [features(t, matcher, known) for t in texts_of(batch)]
            out = {f"f{i}": pa.array([r[0][i] for r in rows], pa.float64()) for i in range(FEATURES)}
            out |= {"n_matches": pa.array([r[1] for r in rows], pa.int64()), "n_quoted": pa.array([r[2] for r in rows], pa.int64())}
            return {c: batch.column(c) for c in keep} | out

        return step

    kinds = dict(docs.dtypes)
    schema = [f"`{c}` {kinds[c]}" for c in keep] + [f"f{i} double" for i in range(FEATURES)] + ["n_matches bigint", "n_quoted bigint"]
    return map_batches(docs, [*keep, *(["text"] if "text" not in keep else [])], ", ".join(schema), work)


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, ``score``, ``n_matches`` and ``n_quoted``."""
    weights = model.weights
    linear = sum((F.col(f"f{i}") * float(w) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), linear))))
    if not model.terms:
        score = F.lit(float(sigmoid(weights[-1])))
    return _featured(docs, model, keep).select(*keep, score.alias("score"), "n_matches", "n_quoted")
