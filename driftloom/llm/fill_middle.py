"""Fill-in-the-middle: texts are cut in three at two drawn code points and written in another order.

A text is read as UTF-8 bytes and cut into chunks where a rolling hash of the last 32 bytes has ten zero bits,
so that equal passages give equal chunks wherever they stand. A cache keeps what is known of a chunk: the code
points that begin in it, whether it holds a marker, and its first and last two bytes. It is looked up by length
and checksum and believed only if the content is equal. Counts of chunks are added up to the length of the text
and to find the chunk of a cut; only that chunk is scanned. Edges of neighbours are read together, for markers
that lie across a border. The cache is bounded and changes no result.

The key of a row is a text expression; groups of its SHA-256 draw both cuts, whether the text stays plain and
the order of the parts. A null text counts as empty; an empty text, and one that holds a marker, stays plain.
A null key counts as empty. Rows are treated one by one, so repeated rows and ids give equal results.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import map_batches

# The three markers, and the shares of plain and of suffix-first texts in hundredths.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
CUT_BELOW, SUFFIX_FIRST_BELOW = 90, 20

WINDOW = 32
LEAST, MOST = 64, 8_192
MASK = np.uint32((1 << 10) - 1) << np.uint32(20)
BLOCK = 1 << 20
CACHE_BYTES = 16_000_000


def _gears() -> np.ndarray:
    """One 32-bit number for each byte value, by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEARS = _gears()


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each byte: the numbers of the bytes, each shifted by its distance.

    Windows of 1, 2, 4, ... bytes are put together from halves, so there are five steps for all bytes at once.
    """
    out = _GEARS[data]
    span = 1
    while span < WINDOW:
        out[span:] += out[:-span] << np.uint32(span)
        span *= 2
    return out


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text; they hold 64 to 8,192 bytes, the last one any number."""
    found = []
    for start in range(0, len(data), BLOCK):
        lead = min(start, WINDOW - 1)
        hashes = rolling(data[start - lead : start + BLOCK])[lead:]
        found.append(np.flatnonzero((hashes & MASK) == 0) + start + 1)
    borders = np.concatenate(found).tolist() if found else []
    ends, at = [], 0
    while at < len(data):
        k = bisect_left(borders, at + LEAST)
        at = min(borders[k] if k < len(borders) else len(data), at + MOST, len(data))
        ends.append(at)
    return ends


@dataclass(frozen=True)
class Summary:
    content: bytes
    count: int  # code points that begin here
    marked: bool
    head: bytes
    tail: bytes


def summary(chunk: bytes) -> Summary:
    begins = np.frombuffer(chunk, np.uint8) & 0xC0 != 0x80
    return Summary(chunk, int(np.count_nonzero(begins)), any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:])


class ChunkCache:
    """Summaries of the chunks that a task has seen, emptied when their content passes a bound."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held, self.hits = most, 0, 0
        self.known: dict[tuple[int, int], Summary] = {}

    def look(self, chunk: bytes) -> Summary:
        key = (len(chunk), zlib.crc32(chunk))
        found = self.known.get(key)
        if found is not None and found.content == chunk:
            self.hits += 1
            return found
        made = summary(chunk)
        if self.held + len(chunk) > self.most:
            self.known.clear()
            self.held = 0
        self.held += len(chunk) * (found is None)  # equal keys have equal lengths
        self.known[key] = made
        return made


class Measured:
    """A text as chunks: its number of code points, whether it holds a marker, and where code points begin."""

    def __init__(self, text: bytes, cache: ChunkCache):
        self.text = text
        ends = chunk_ends(np.frombuffer(text, np.uint8))
        self.starts = [0, *ends]
        self.before = [0]
        self.marked, tail = False, b""
        for start, end in zip(self.starts, ends, strict=False):
            part = cache.look(text[start:end])
            self.before.append(self.before[-1] + part.count)
            self.marked = self.marked or part.marked or any(m in tail + part.head for m in MARKERS)
            tail = part.tail
        self.n = self.before[-1]

    def offset(self, place: int) -> int:
        """Byte at which the code point number ``place`` begins; the end of the text for the number after the last."""
        if place >= self.n:
            return len(self.text)
        k = bisect_right(self.before, place) - 1
        chunk = np.frombuffer(self.text, np.uint8, self.starts[k + 1] - self.starts[k], self.starts[k])
        return self.starts[k] + int(np.flatnonzero(chunk & 0xC0 != 0x80)[place - self.before[k]])


def rearranged(text: bytes, digest: str, cache: ChunkCache) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and of middle, output) of a text under a key's SHA-256."""
    draws = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    m = Measured(text, cache)
    if not text or m.marked or draws[2] % 100 >= CUT_BELOW:
        return m.n, "plain", None, None, text
    first, last = sorted((draws[0] % (m.n + 1), draws[1] % (m.n + 1)))
    i, j = m.offset(first), m.offset(last)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if draws[3] % 100 < SUFFIX_FIRST_BELOW:
        return m.n, "spm", first, last - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return m.n, "psm", first, last - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, key: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``n`` code points, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain), ``output``.

    ``keep`` must not name these or ``text`` and ``_draws``.
    """

    def work():
        cache = ChunkCache()

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [rearranged(t or b"", d, cache) for t, d in zip(texts, batch.column("_draws").to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            return {c: batch.column(c) for c in keep} | {
                "n": pa.array(n, pa.int64()),
                "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(prefix, pa.int64()),
                "middle_chars": pa.array(middle, pa.int64()),
                "output": pa.array(output, pa.binary()).cast(pa.string()),
            }

        return step

    draws = F.sha2(F.coalesce(key.cast("string"), F.lit("")).cast("binary"), 256)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_batches(docs.select(*[f"`{c}`" for c in keep], "text", draws.alias("_draws")), [*[f"`{c}`" for c in keep], "text", "_draws"], schema, work)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. A text with a marker is plain, so each marker stands once."""
    first, second = F.when(form == "psm", SUFFIX.decode()).otherwise(PREFIX.decode()), F.lit(MIDDLE.decode())
    a, b = F.instr(output, first), F.instr(output, second)
    one, two, rest = output.substr(F.lit(4), a - 4), output.substr(a + 3, b - a - 3), output.substr(b + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, rest, two)).otherwise(F.concat(two, rest, one))
