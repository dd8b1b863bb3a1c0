"""How far the sources of a language differ in the terms they use, in exact whole numbers.

A term is a run of letters A-Z, a-z (lower-cased) and characters beyond ASCII. Each language keeps the terms of
at least ten of its documents. Kept terms are sorted and numbered within their language, and every
131,072 of them become a minimal acyclic transducer (a volume). The texts then stream through the volumes,
all terms of a batch in step, which counts the kept terms of each source by number. A number stands for its
term in all later steps: ties go to the smaller number, which is the smaller term in UTF-8. A pass over the
texts takes the next 64 volumes (8.4 million terms, about 150 MB of tables at most, the bound of what is sent
to the executors) and reads only texts of their languages; most corpora need one pass.

A group is a (language, source); ``count`` is a term's number of occurrences in it, ``N`` the sum over the V kept
terms and ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``. Two rates differ by ``floor((p - q)^2 / (p + q))``.
Sources are compared in blocks of 64 x 64 sources and 4,096 terms, with rows of all groups in each block.

Null text, language and source count as empty. Every row is a document of its own, repeated rows too. Groups
without terms, languages without kept terms (V = 0: values are 0) and single sources take part. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm import term_fst
from driftloom.llm.common import map_batches
from driftloom.llm.groups import map_groups
from driftloom.operators.ordered import top_n
from driftloom.storage import cut

# Fixed values of the measure.
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10

VOLUME_BITS = 17
PASS_VOLUMES = 64
TILE = 64
BLOCK = 4_096

#: Letters of ASCII and all bytes of characters beyond it.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def document_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of a language that hold a term, added up for each batch."""

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                seen[lang].update(set(TERM.findall(text.lower())))
            terms = [t for c in seen.values() for t in c]
            return {
                "lang": pa.array([lang for lang, c in seen.items() for _ in c], pa.string()),
                "term": pa.array(terms, pa.binary()).cast(pa.string()),
                "n": pa.array([n for c in seen.values() for n in c.values()], pa.int64()),
            }

        return step

    return map_batches(docs, ["lang", "text"], "lang string, term string, n bigint", work)


def numbered(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct (key, value) rows with their place among the values of their key, from 0, smallest first.

    Range partitions are sorted and written once; what comes before a partition is added to the place in
    it, which is known from one row for each partition and key in it.
    """
    placed = cut(df.repartitionByRange(key, value).sortWithinPartitions(key, value)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33).alias("_part")
    parts = placed.groupBy(key, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    with_part = placed.withColumn("_part", F.shiftright("_at", 33))
    return with_part.join(shifts, [key, "_part"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def volumes(terms: DataFrame, bits: int = VOLUME_BITS) -> DataFrame:
    """(lang, volume, first, last, body): a transducer of each ``2^bits`` successive terms of a language."""
    at = terms.select("lang", "term", "ordinal", F.shiftright("ordinal", bits).alias("volume"), F.xxhash64("lang").alias("_lang"))

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        found = []
        names = table.column("term").cast(pa.binary())
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            strings = names.slice(a, b - a).to_pylist()
            found.append((table.column("lang")[a].as_py(), table.column("volume")[a].as_py(), strings[0], strings[-1], pickle.dumps(term_fst.build(strings))))
        lang, volume, first, last, body = zip(*found, strict=True)
        return {"lang": pa.array(lang), "volume": pa.array(volume, pa.int64()), "first": pa.array(first), "last": pa.array(last), "body": pa.array(body, pa.binary())}

    return map_groups(at, ["_lang", "volume"], "lang string, volume bigint, first binary, last binary, body binary", work, ("ordinal",))


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return data[at].astype(np.int64) * 256 + data[at + 1]


def recount(docs: DataFrame, stored: DataFrame, bits: int = VOLUME_BITS, pass_volumes: int = PASS_VOLUMES) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms in each group, for terms that occur in it."""
    directory = [(r.lang, r.volume) for r in stored.select("lang", "volume").orderBy("lang", "volume").collect()]
    counted = []
    for at in range(0, len(directory), pass_volumes):
        chosen: dict[str, list[int]] = defaultdict(list)
        for lang, volume in directory[at : at + pass_volumes]:
            chosen[lang].append(volume)
        # volumes of a language follow each other
        wanted = reduce(or_, [(F.col("lang") == lang) & F.col("volume").between(v[0], v[-1]) for lang, v in chosen.items()])
        held: dict[str, list] = defaultdict(list)
        for r in stored.where(wanted).toLocalIterator():
            held[r.lang].append((r.volume, bytes(r.first), bytes(r.last), pickle.loads(r.body)))
        sent = docs.sparkSession.sparkContext.broadcast(dict(held))
        pass_docs = docs.where(F.col("lang").isin(*chosen))
        counted.append(cut(_stream(pass_docs, sent, bits).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))))
        sent.destroy()
    none = docs.sparkSession.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    return reduce(DataFrame.unionByName, counted) if counted else none


def _stream(docs: DataFrame, sent, bits: int) -> DataFrame:
    def work():
        held = sent.value

        def step(batch: pa.RecordBatch) -> dict:
            rows = pa.Table.from_batches([batch])
            groups = rows.select(["lang", "source"]).group_by(["lang", "source"]).aggregate([])
            names = {g: k for k, g in enumerate(zip(groups.column("lang").to_pylist(), groups.column("source").to_pylist(), strict=True))}
            owner = np.array([names[g] for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            by_lang: dict[str, list[int]] = defaultdict(list)
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                by_lang[lang].append(k)
            column = batch.column("text").cast(pa.binary())
            for lang, picked in by_lang.items():
                texts = [column[k].as_py() for k in picked]
                data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n\n", np.uint8)]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], _IS_TERM[data]]).astype(np.int8)))
                starts, stops = edges[::2], edges[1::2]
                ends = np.cumsum([len(t) + 1 for t in texts])
                mine = owner[picked][np.searchsorted(ends, starts, side="right")]
                lead = _lead(data, starts)
                lead[stops - starts == 1] &= ~255
                for volume, first, last, machine in held[lang]:
                    low, high = (int.from_bytes((b + b"\0")[:2]) for b in (first, last))
                    near = np.flatnonzero((lead >= low) & (lead <= high))
                    ordinal = machine.ordinals(data, starts[near], stops[near] - starts[near])
                    ok = ordinal >= 0
                    key, n = np.unique(mine[near][ok] * (1 << bits) + ordinal[ok], return_counts=True)
                    found.append((volume, key, n))
            group = np.concatenate([k >> bits for _, k, _ in found]) if found else np.zeros(0, np.int64)
            ordinal = np.concatenate([(k & ((1 << bits) - 1)) + (v << bits) for v, k, _ in found]) if found else group
            n = np.concatenate([n for _, _, n in found]) if found else group
            return {
                "lang": groups.column("lang").combine_chunks().take(pa.array(group)),
                "source": groups.column("source").combine_chunks().take(pa.array(group)),
                "ordinal": pa.array(ordinal, pa.int64()),
                "n": pa.array(n, pa.int64()),
            }

        return step

    return map_batches(docs, ["lang", "source", "text"], "lang string, source string, ordinal bigint, n bigint", work)


def _rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)); 1 where no term is kept."""
    over = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(11,0)")
    under = total.cast("decimal(20,0)") + 2 * kept.cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", over, under)).otherwise(F.lit(1)).cast("long")


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, bits: int = VOLUME_BITS, pass_volumes: int = PASS_VOLUMES) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources of the same language by distance (``pair``, all ranks)
    and terms that a source uses more than its language (``term``, ten ranks)."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = document_terms(plain).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")
    terms = cut(numbered(kept, "lang", "term", "ordinal"))
    counts = recount(plain, cut(volumes(terms, bits)), bits, pass_volumes)

    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    places = cut(numbered(plain.select("lang", "source").distinct(), "lang", "source", "place"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = places.join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"), (F.floor(F.max("place") / TILE) + 1).alias("tiles"))
    groups = cut(groups.join(langs, "lang").join(sizes, "lang", "left").fillna(0, ["kept"]))
    rated = cut(counts.join(groups, ["lang", "source"]).withColumn("p", _rate(F.col("n"), F.col("total"), F.col("kept"))))
    return _pairs(groups, rated).unionByName(_terms(rated, terms))


def _pairs(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """Distances of all sources of a language: sums over blocks of terms, for blocks of sources."""
    cell = ["place", "p", "kept", "tiles"]
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK)) - 1)
    # what a source has for the terms that it lacks, once for each block, so that each block knows all sources
    heads = groups.withColumn("p", _rate(F.lit(0), F.col("total"), F.col("kept"))).select("lang", *cell, F.lit(-1).cast("long").alias("ordinal"), F.explode(blocks).alias("block"))
    body = rated.select("lang", *cell, "ordinal", F.floor(F.col("ordinal") / BLOCK).alias("block"))
    rows = heads.unionByName(body).withColumn("tile", F.floor(F.col("place") / TILE))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    dealt = rows.select(F.xxhash64("lang").alias("_lang"), "lang", "block", "i", "j", *cell, "ordinal")

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        found = []
        column = {n: table.column(n).to_numpy() for n in ("block", "i", "j", "place", "p", "kept", "ordinal")}
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            c = {n: v[a:b] for n, v in column.items()}
            base = int(c["block"][0]) * BLOCK
            width = max(0, min(BLOCK, int(c["kept"][0]) - base))
            head = c["ordinal"] < 0
            places, row = np.unique(c["place"], return_inverse=True)
            rates = np.zeros((len(places), width), np.int64)
            rates[row[head]] = c["p"][head][:, None]
            rates[row[~head], c["ordinal"][~head] - base] = c["p"][~head]
            for k, p in enumerate(rates):
                # of a tile with itself each pair once
                if c["i"][0] == c["j"][0]:
                    lot = np.arange(k + 1, len(places))
                else:
                    lot = np.flatnonzero(places // TILE == c["j"][0]) if places[k] // TILE == c["i"][0] else []
                if len(lot):
                    gap = p - rates[lot]
                    value = (gap * gap // (p + rates[lot])).sum(axis=1) if width else np.zeros(len(lot), np.int64)
                    found += [(a, places[k], q, v) for q, v in zip(places[lot].tolist(), value.tolist(), strict=True)]
        at, x, y, v = (np.array(n, np.int64) for n in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        return {"lang": table.column("lang").combine_chunks().take(pa.array(at)), "x": pa.array(x), "y": pa.array(y), "value": pa.array(v)}

    parts = map_groups(dealt, ["_lang", "block", "i", "j"], "lang string, x bigint, y bigint, value bigint", work)
    summed = cut(parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value")))
    both = summed.unionByName(summed.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    name = groups.select("lang", F.col("place").alias("x"), "source")
    item = groups.select("lang", F.col("place").alias("y"), F.col("source").alias("item"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.join(name, ["lang", "x"]).join(item, ["lang", "y"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(rated: DataFrame, terms: DataFrame) -> DataFrame:
    """The ten terms of each source that stand out most against its language; ties go to the smaller number."""
    common = rated.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"), F.max("all").alias("all"), F.max("kept").alias("kept"))
    common = common.select("lang", "ordinal", _rate(F.col("n"), F.col("all"), F.col("kept")).alias("q"))
    above = rated.select("lang", "source", "ordinal", "p").join(common, ["lang", "ordinal"]).where("p > q")
    valued = above.select("lang", "source", "ordinal", _distance(F.col("p"), F.col("q")).alias("value"))
    best = top_n(valued, ["lang", "source"], [F.desc("value"), F.col("ordinal")], TOP_TERMS, ["ordinal"])
    return best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
