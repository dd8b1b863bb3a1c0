"""Parallel-activation drift test: bootstrap t-tests on the outputs of a fixed random network.

The test needs, for each batch, the activations of its history. Within a stream that history
depends on earlier verdicts (a quiet batch is appended, an alert starts anew), which looks like one
long sequential loop. But the history before a batch is always its last ``age`` batches, where
``age`` counts from the last alert and stops growing at the history limit. So a stretch of batches
is a function from ``age`` before it to ``age`` after it, stretches are evaluated in parallel, and
the functions are composed. See :func:`sequential`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.hashing import key31, mix31
from driftloom.functions.student import critical, two_sided_p

# Network widths, scale and seed; test sizes; limits.
NECK = 10
HIDDEN = 32
INIT_SCALE = 0.1
SEED = 42
ALPHA = 0.07
THETA = 0.10
REPLICATIONS = 12
SAMPLE_SIZE = 50
MAX_HISTORY = 5000
INACTIVE_VARIANCE = 1e-8
INACTIVE_SHARE = 0.30


@dataclass(frozen=True)
class PaddParams:
    """Test and network settings; ``network`` is ``two_layer``, ``one_layer`` or ``softmax``."""

    hidden: int = HIDDEN
    neck: int = NECK
    alpha: float = ALPHA
    theta: float = THETA
    replications: int = REPLICATIONS
    sample_size: int = SAMPLE_SIZE
    max_history: int = MAX_HISTORY
    seed: int = SEED
    scale: float = INIT_SCALE
    network: str = "two_layer"
    welch: bool = False
    round_threshold: bool = True
    min_current: int = 1
    min_reference: int = 1

    @property
    def tests(self) -> int:
        return self.hidden * self.replications

    @property
    def most_rejections(self) -> float:
        """More rejections than this are an alert (Python rounds halves to even)."""
        limit = self.theta * self.tests
        return round(limit) if self.round_threshold else limit


WELCH = PaddParams(
    theta=0.20, network="one_layer", welch=True, round_threshold=False, min_current=10, min_reference=SAMPLE_SIZE
)
SOFTMAX = PaddParams(
    hidden=30,
    alpha=0.05,
    theta=0.17,
    replications=35,
    sample_size=75,
    network="softmax",
    round_threshold=False,
    min_current=10,
    min_reference=75,
)


@lru_cache(maxsize=16)
def weights(p: PaddParams, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Both weight matrices (or weights and bias of the one-layer form), from the seed alone."""
    rng = np.random.default_rng(p.seed)
    shapes = {
        "two_layer": ((dim + 1, p.neck), (p.neck + 1, p.hidden)),
        "softmax": ((dim + 1, p.neck), (p.neck, p.hidden)),
        "one_layer": ((dim, p.hidden), (p.hidden,)),
    }[p.network]
    first = rng.normal(0.0, p.scale, shapes[0])
    return first, rng.normal(0.0, p.scale, shapes[1])


def activate(x: np.ndarray, p: PaddParams) -> np.ndarray:
    """Network outputs, one row for each input row."""
    x = x.astype(np.float64)
    first, second = weights(p, x.shape[1])
    if p.network == "one_layer":
        return np.maximum(0.0, x @ first + second)
    neck = np.maximum(0.0, x @ first[:-1] + first[-1])
    if p.network == "two_layer":
        return np.maximum(0.0, neck @ second[:-1] + second[-1])
    out = np.maximum(0.0, neck @ second)
    e = np.exp(out - out.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def draws(p: PaddParams, stream: str, batch: int) -> np.ndarray:
    """Raw bootstrap draws of a batch, shape (history or batch, neuron, replication, draw)."""
    shape = (2, p.hidden, p.replications, p.sample_size)
    return mix31(key31(p.seed, stream, batch), np.arange(int(np.prod(shape)))).reshape(shape)


def rejections(history: np.ndarray, current: np.ndarray, raw: np.ndarray, p: PaddParams) -> int:
    """How many bootstrap t-tests reject equal means.

    0/0 is no evidence (not rejected); a difference without any spread is (rejected).
    """
    neuron = np.arange(p.hidden)[:, None, None]
    a = history[raw[0] % len(history), neuron]
    b = current[raw[1] % len(current), neuron]
    s = p.sample_size
    gap = np.abs(a.mean(axis=-1) - b.mean(axis=-1))
    va, vb = a.var(axis=-1, ddof=1) / s, b.var(axis=-1, ddof=1) / s
    spread = np.sqrt(va + vb)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(spread > 0, gap / spread, np.where(gap > 0, np.inf, 0.0))
        if not p.welch:
            return int(np.count_nonzero(t > critical(p.alpha, 2 * s - 2)))
        df = np.where(spread > 0, (va + vb) ** 2 / ((va**2 + vb**2) / (s - 1)), 2 * s - 2)
    return int(np.count_nonzero(two_sided_p(t, df) < p.alpha))


def score_chunk(p: PaddParams, stream: str, reference: np.ndarray, batches: list[tuple[int, np.ndarray]]):
    """Test every batch against the frozen reference: no history, fully parallel."""
    if len(reference) < p.min_reference:
        return
    history = activate(reference, p)
    for number, rows in batches:
        if len(rows) >= p.min_current:
            count = rejections(history, activate(rows, p), draws(p, stream, number), p)
            yield number, count / p.tests, p.theta


def activations(df: DataFrame, vec: str, p: PaddParams = PaddParams(), into: str = "act") -> DataFrame:
    """Activations of each vector: one matrix product for each Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(activate(np.stack(vectors), p)), index=vectors.index) if len(vectors) else vectors

    return df.withColumn(into, run(vec))


def inactive_neurons(acts: DataFrame, keys: list[str], act: str = "act") -> DataFrame:
    """Share of neurons with next to no variance in each batch, and whether that is a warning."""
    cells = acts.select(*keys, F.posexplode(act).alias("neuron", "a"))
    spread = cells.groupBy(*keys, "neuron").agg(F.var_pop("a").alias("v"))
    share = F.avg(F.when(F.col("v") < INACTIVE_VARIANCE, 1.0).otherwise(0.0))
    return spread.groupBy(*keys).agg(share.alias("inactive_share")).withColumn(
        "is_warning", F.col("inactive_share") > INACTIVE_SHARE
    )


# ---------------------------------------------------------------------------------------------
# The history that follows the verdicts
# ---------------------------------------------------------------------------------------------

_BLOCK = "stream_id string, block long, n int, acts array<double>"
_VERDICT = "stream_id string, batch_no long, score double, threshold double, is_alert boolean, age int"


def _blocks(pdf: pd.DataFrame, p: PaddParams) -> dict[int, np.ndarray]:
    return {int(b): np.asarray(a).reshape(-1, p.hidden) for b, a in zip(pdf["block"], pdf["acts"])}


def _verdict(blocks: dict[int, np.ndarray], block: int, age: int, raw: np.ndarray, p: PaddParams) -> int:
    history = np.concatenate([blocks[b] for b in range(max(block - age, 0), block)])[-p.max_history :]
    return rejections(history, blocks[block], raw, p)


def sequential(positioned: DataFrame, n: int, reference: int, p: PaddParams = PaddParams(), segment: int = 256) -> DataFrame:
    """Verdicts with the history kept as the verdicts say, in parallel within a stream.

    Block 0 is the reference; the first batch only initialises and has no verdict, so blocks
    1, 2, ... are the batches 1, 2, .... A segment of ``segment`` blocks arrives together with the
    ``K`` blocks before it, ``K`` being the age from which a history no longer changes. Every age at
    the entry of a segment is followed through it; after ``K`` blocks they have met, so a segment
    costs little more than one pass. Groups hold at most ``segment + K`` blocks; composition runs
    on one small array for each segment, in two levels.
    """
    k = max(1, -(-p.max_history // n))
    width = max(segment, k)
    fan = 1024
    pos, stream = F.col("pos"), "stream_id"
    block = F.when(pos < reference, F.lit(0).cast("long")).otherwise(F.floor((pos - reference) / n))
    rows = activations(positioned.where(F.col("vec").isNotNull()), "vec", p).select(stream, "pos", "act", block.alias("block"))
    rows = rows.where((pos < reference) | (pos >= reference + n))
    packed = rows.groupBy(stream, "block").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "act"))).alias("_a")
    )
    packed = packed.select(stream, "block", "n", F.flatten(F.transform("_a", lambda x: x.act)).alias("acts"))
    packed = packed.where((F.col("block") == 0) | (F.col("n") == n))
    own = F.floor((F.col("block") - 1) / width)
    near = F.floor((F.col("block") - 1 + k) / width)
    member = F.explode(F.sequence(F.greatest(own, F.lit(0).cast("long")), F.greatest(near, F.lit(0).cast("long"))))
    spread = packed.withColumn("segment", member)

    def follow(pdf: pd.DataFrame, ages: list[int], emit: list | None = None) -> list[int] | None:
        blocks = _blocks(pdf, p)
        seg, name = int(pdf["segment"].iloc[0]), pdf[stream].iloc[0]
        now = list(ages)
        first, last = seg * width + 1, (seg + 1) * width
        if not any(first <= b <= last for b in blocks):
            return None
        for b in range(first, last + 1):
            if b not in blocks:
                if any(b < later <= last for later in blocks):
                    raise ValueError(f"batch {b} of stream {name!r} is missing, so the verdicts after it have no history")
                break
            raw = draws(p, name, b)
            counts = {age: _verdict(blocks, b, age, raw, p) for age in set(now)}
            if emit is not None:
                c = counts[now[0]]
                emit.append((name, b, c / p.tests, p.theta, c > p.most_rejections, now[0]))
            now = [1 if counts[a] > p.most_rejections else min(a + 1, k) for a in now]
        return now

    def as_map(pdf: pd.DataFrame) -> pd.DataFrame:
        seg = int(pdf["segment"].iloc[0])
        ages = [1] * k if seg == 0 else list(range(1, k + 1))
        out = follow(pdf, ages)
        held = [] if out is None else [(pdf[stream].iloc[0], seg, seg // fan, out)]
        return pd.DataFrame(held, columns=[stream, "segment", "super", "out"])

    maps = spread.groupBy(stream, "segment").applyInPandas(
        as_map, "stream_id string, segment long, super long, out array<int>"
    )

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        ages = np.arange(1, k + 1)
        for out in pdf.sort_values("segment")["out"]:
            ages = np.asarray(out)[ages - 1]
        return pd.DataFrame([(pdf[stream].iloc[0], pdf["super"].iloc[0], ages.tolist())], columns=[stream, "super", "out"])

    supers = maps.groupBy(stream, "super").applyInPandas(compose, "stream_id string, super long, out array<int>")

    def enter(pdf: pd.DataFrame, key: str, age: int) -> pd.DataFrame:
        ordered = pdf.sort_values(key)
        ages = []
        for out in ordered["out"]:
            ages.append(age)
            age = int(out[age - 1])
        return ordered[[stream, key]].assign(age=ages)

    at_super = supers.groupBy(stream).applyInPandas(
        lambda pdf: enter(pdf, "super", 1), "stream_id string, super long, age int"
    )
    at_segment = (
        maps.join(at_super, [stream, "super"])
        .groupBy(stream, "super")
        .applyInPandas(lambda pdf: enter(pdf, "segment", int(pdf["age"].iloc[0])), "stream_id string, segment long, age int")
    )

    def decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(left) and len(right):
            follow(left, [int(right["age"].iloc[0])], found)
        return pd.DataFrame(found, columns=[f.split()[0] for f in _VERDICT.split(", ")])

    return (
        spread.groupBy(stream, "segment").cogroup(at_segment.groupBy(stream, "segment")).applyInPandas(decide, _VERDICT)
    )
