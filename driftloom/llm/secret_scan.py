"""Secrets in texts: fixed shapes, and windows of high entropy.

Shapes (assignments to a credential's name, access keys, long hexadecimal strings) give the base spans.
The entropy method adds others: every candidate string is put into a character class, a window slides
over it, and the Shannon entropy of the window is kept up by counts of what enters and leaves. Windows
at or above the class's threshold give a span, unless the allow-list knows the whole string: words, names
of words and numbers, UUIDs, runs of the alphabet, hosts and mail addresses. What assignments and access
keys leave of a candidate is scanned like any other; one that holds a hexadecimal string and more is
scanned whole, so its span may overlap the base span. Letters of one case count as words up to
``LONGEST_WORD``, so a secret of such letters alone is found only beyond that length.

A null text counts as empty and has no spans. Texts are scanned whole, of any length, in linear time;
positions are in code points, the end is exclusive. Repeated rows and ids give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm.common import map_batches, texts_of

KINDS = ("assign", "access", "hex", "entropy")
# fixed values: the shapes of base spans
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = ("passw", "secret", "token", "api")
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
SHORTEST = 20


class Window(NamedTuple):
    size: int
    bits: float


#: Per character class: window length and the entropy a window must reach. Uniformly drawn characters
#: stay above it in nearly all windows of that length; words, counters and dates stay below.
CLASSES = {
    "hexadecimal": Window(24, 3.0),
    "letters of one case": Window(28, 3.75),
    "one case and digits": Window(20, 3.35),
    "letters": Window(20, 3.55),
    "letters and digits": Window(20, 3.5),
    "base64": Window(20, 3.6),
}

LONGEST_WORD = 24
SEPARATORS = re.compile(r"[-_/+=]+")
#: A part of a name: a word, words in camel case, a number, each with a little of the other.
NAME_PART = re.compile(
    rf"[A-Z]?[a-z]{{1,{LONGEST_WORD}}}[0-9]{{0,8}}|[A-Z]{{1,{LONGEST_WORD}}}[0-9]{{0,8}}|[0-9]{{1,8}}[a-z]{{0,3}}|[0-9]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{{2,}})+[0-9]{{0,4}}"
)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
RUNS = ("0123456789abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789")
#: What stands before the @ of an address with a scheme, which may be a credential; and a mail domain.
USER_INFO = re.compile(r"://([^\s/@]+)@")
MAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+\.[A-Za-z]")


def character_class(candidate: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate):
        return "hexadecimal"
    if not candidate.isalnum():
        return "base64"
    one_case = candidate in (candidate.lower(), candidate.upper())
    if candidate.isalpha():
        return "letters of one case" if one_case else "letters"
    return "one case and digits" if one_case else "letters and digits"


def allowed(candidate: str) -> bool:
    if UUID.fullmatch(candidate) or all(NAME_PART.fullmatch(part) for part in SEPARATORS.split(candidate) if part):
        return True
    low = candidate.lower()
    return any(run[i : i + 16] in low for run in RUNS for i in range(0, len(run) - 15, 4))


def entropy_span(candidate: str, window: Window) -> tuple[int, int] | None:
    """From the first to the last window that reaches the threshold."""
    size = min(window.size, len(candidate))
    counts = Counter(candidate[:size])
    # entropy = log2(size) - sum(c log2 c) / size; only the sum changes as the window slides
    total = sum(_weighted(c) for c in counts.values())
    most = (math.log2(size) - window.bits) * size + 1e-9
    first = last = None
    for start in range(len(candidate) - size + 1):
        if start:
            for character, change in ((candidate[start - 1], -1), (candidate[start + size - 1], 1)):
                count = counts[character]
                total += _weighted(count + change) - _weighted(count)
                counts[character] = count + change
        if total <= most:
            first, last = start if first is None else first, start
    return None if first is None else (first, last + size)


def _weighted(count: int) -> float:
    return count * math.log2(count) if count > 1 else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if has_long_word(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return found


def has_long_word(text: str) -> bool:
    """Whether a stretch without white space is as long as the shortest candidate, which none else can hold."""
    return any(len(word) >= SHORTEST for word in text.split())


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind in the order of :data:`KINDS`."""
    found = base_spans(text)
    if has_long_word(text):
        found += [(start, end, "entropy") for start, end in _entropy_spans(text, found)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _entropy_spans(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    named = _Forward((s, e) for s, e, kind in base if kind != "hex")
    hexes = _Forward((s, e) for s, e, kind in base if kind == "hex")
    credentials = _Forward(m.span(1) for m in USER_INFO.finditer(text)) if "://" in text else _Forward(())
    for match in CANDIDATE.finditer(text):
        start, end = match.span()
        if end - start < SHORTEST:
            continue
        for low, high in _outside(start, end, named.meeting(start, end)):
            if text.startswith("//", low) and text[low - 1 : low] == ":":
                # a host ends at the next slash; before an @ there is no host yet
                host = low + 2 if text[high : high + 1] == "@" else text.find("/", low + 2, high)
                low = high if host < 0 else host
            elif high == end and MAIL_DOMAIN.match(text, high) and not credentials.meeting(low, high):
                continue
            word = text[low:high]
            if len(word) < SHORTEST or allowed(word):
                continue
            # nothing but a base span and words around it
            known = hexes.meeting(low, high)
            if known and all(e - s < 4 or allowed(text[s:e]) for s, e in _outside(low, high, known)):
                continue
            span = entropy_span(word, CLASSES[character_class(word)])
            if span:
                yield low + span[0], low + span[1]


class _Forward:
    """Spans that are asked for from left to right, each passed once."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.spans, self.at = sorted(spans), 0

    def meeting(self, start: int, end: int) -> list[tuple[int, int]]:
        while self.at < len(self.spans) and self.spans[self.at][1] <= start:
            self.at += 1
        last = self.at
        while last < len(self.spans) and self.spans[last][0] < end:
            last += 1
        return self.spans[self.at : last]


def _outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for s, e in spans:
        if s > start:
            out.append((start, s))
        start = max(start, e)
    return [*out, (start, end)] if start < end else out


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``spans``: kind, start and end of every secret in ``text``."""

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t)] for t in texts_of(batch)]
            return {c: batch.column(c) for c in keep} | {"spans": pa.array(spans, _SPANS)}

        return step

    kinds = dict(docs.dtypes)
    return map_batches(docs, [*keep, "text"], ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", spans {SPANS}", work)


def redacted(text: str) -> str:
    """The text with each secret replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    spans = scan(text)
    for i, (start, end, kind) in enumerate(spans):
        if start < at:  # inside or reaching on from the one before
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns; ``text`` without its secrets, ``n_chars`` its new length. A null text stays null."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    sized = "n_chars" in docs.columns
    kinds = dict(docs.dtypes)

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [t if t is None else redacted(t) for t in batch.column("text").to_pylist()]
            out = {c: batch.column(c) for c in others} | {"text": pa.array(texts, pa.string())}
            return out | ({"n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())} if sized else {})

        return step

    schema = [f"`{c}` {kinds[c]}" for c in others] + ["text string"] + ["n_chars bigint"] * sized
    return map_batches(docs, [*others, "text"], ", ".join(schema), work).select(*docs.columns)
