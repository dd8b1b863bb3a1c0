"""Detector registry and the job that scores all trigger batches of all streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.hashing import hash60
from driftloom.operators import iforest, mmd, padd
from driftloom.operators.assemble import explode_range
from driftloom.operators.embed import MIN_TRIGGER, REFERENCE_SIZE, TRIGGER_N
from driftloom.operators.ordered import dense_position, fresh
from driftloom.storage import cut

DEFAULT_DETECTORS = ("mmd", "padd")
SCORES = (
    "stream_id string, batch_no long, detector string, score double, threshold double, is_alert boolean, "
    "doc_count int, last_seq long"
)


@dataclass(frozen=True)
class Detector:
    """A detector: ``scorer(params, stream, reference, batches)`` yields (batch, score, threshold).

    ``above`` tells whether a high score is an alert. A detector whose history follows its own
    verdicts has no scorer and is run by ``padd.sequential``.
    """

    name: str
    params: Any
    scorer: Callable | None
    above: bool = True


REGISTRY: dict[str, Callable[..., Detector]] = {
    "mmd": lambda **kw: Detector("mmd", mmd.MmdParams(**kw), mmd.score_chunk),
    "padd": lambda **kw: Detector("padd", padd.PaddParams(**kw), None),
    "isolation_forest": lambda **kw: Detector(
        "isolation_forest", iforest.ForestParams(**kw), iforest.score_chunk, above=False
    ),
    "padd_frozen": lambda **kw: Detector("padd_frozen", padd.PaddParams(**kw), padd.score_chunk),
    "padd_welch": lambda **kw: Detector("padd_welch", replace(padd.WELCH, **kw), padd.score_chunk),
    "padd_softmax": lambda **kw: Detector("padd_softmax", replace(padd.SOFTMAX, **kw), padd.score_chunk),
}


def load_detectors(names: Iterable[str], **params: dict) -> list[Detector]:
    """Detectors by name, in order; settings by detector name.

    Names without a detector, settings for detectors that are not asked for, and settings that a
    detector does not have are errors.
    """
    wanted = list(names)
    if strange := sorted({*wanted, *params} - REGISTRY.keys()):
        raise ValueError(f"no detector is called {', '.join(strange)}; there are {', '.join(sorted(REGISTRY))}")
    if unused := sorted(params.keys() - set(wanted)):
        raise ValueError(f"settings without their detector: {', '.join(unused)}")
    return [REGISTRY[name](**params.get(name, {})) for name in wanted]


Emit = Callable[[str, np.ndarray, list[tuple[int, np.ndarray]], dict[int, int]], Iterable[tuple]]


def per_batch(docs: DataFrame, refs: DataFrame, n: int, emit: Emit, schema: str) -> DataFrame:
    """Rows that ``emit(stream, reference, batches, last sequence numbers)`` yields for each chunk."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(left) and len(right):
            reference = np.stack(right.sort_values("pos")["vec"])
            left = left.sort_values(["batch_no", "pos"])
            vectors, seqs = np.stack(left["vec"]), left["seq"].to_numpy()
            numbers, starts = np.unique(left["batch_no"].to_numpy(), return_index=True)
            ends = np.append(starts[1:], len(left))
            whole = [(int(b), s, e) for b, s, e in zip(numbers, starts, ends) if e - s == n]
            last = {b: int(seqs[e - 1]) for b, s, e in whole}
            rows.extend(emit(left["stream_id"].iloc[0], reference, [(b, vectors[s:e]) for b, s, e in whole], last))
        return pd.DataFrame(rows, columns=names)

    return docs.groupBy("stream_id", "chunk").cogroup(refs.groupBy("stream_id", "chunk")).applyInPandas(run, schema)


def chunked(
    positioned: DataFrame, n: int, reference: int, reference_rows: DataFrame | None = None, chunk_rows: int = 6400
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trigger documents by chunk, the reference once for each chunk, and the plain reference.

    A chunk is a run of whole batches with at most ``chunk_rows`` vectors (or one batch).
    """
    pos = F.col("pos")
    skip = reference if reference_rows is None else 0
    per_chunk = max(1, chunk_rows // n)
    batch = F.floor((pos - skip) / n)
    docs = positioned.where(pos >= skip).select(
        "stream_id", "pos", "seq", "vec", batch.alias("batch_no"), F.floor(batch / per_chunk).alias("chunk")
    )
    head = positioned.where(pos < reference) if reference_rows is None else reference_rows
    head = head.select("stream_id", "pos", "vec")
    lengths = positioned.groupBy("stream_id").agg(
        F.floor(((F.max("pos") + 1 - skip) / n - 1) / per_chunk + 1).alias("_chunks")
    )
    refs = fresh(explode_range(head.join(lengths, "stream_id"), F.col("_chunks"), "chunk", ["stream_id"]))
    return docs, refs, head


def _is_alert(d: Detector, score: float, threshold: float | None, limits: dict) -> bool | None:
    if limits[d.name] is not None:
        return round(score * d.params.tests) > limits[d.name]
    if threshold is None:
        return None
    return bool(score > threshold) if d.above else bool(score < threshold)


def detect(
    positioned: DataFrame,
    detectors: Iterable[Detector],
    n: int = TRIGGER_N,
    reference: int = REFERENCE_SIZE,
    reference_rows: DataFrame | None = None,
    chunk_rows: int = 6400,
) -> DataFrame:
    """One row for each stream, complete trigger batch and detector, with its verdict.

    ``positioned`` holds ``(stream_id, pos, seq, vec)`` with dense positions. One exchange brings
    vectors together by (stream, chunk of batches); a chunk has at most ``chunk_rows`` vectors, so
    a hot stream spreads over many tasks. The reference (at most ``reference`` vectors of a stream)
    goes once to each chunk and all detectors share the pass. ``reference_rows`` replaces the head
    of the stream by other reference vectors (noise warm-up): then every document is a trigger one.
    """
    if n < MIN_TRIGGER:
        return positioned.sparkSession.createDataFrame([], SCORES)
    detectors = list(detectors)
    docs, refs, head = chunked(positioned, n, reference, reference_rows, chunk_rows)
    parts = []
    scored = [d for d in detectors if d.scorer]
    limits = {d.name: getattr(d.params, "most_rejections", None) for d in detectors}

    def verdicts(stream, ref, batches, last):
        for d in scored:
            for b, score, threshold in d.scorer(d.params, stream, ref, batches):
                yield stream, b, d.name, score, threshold, _is_alert(d, score, threshold, limits), n, last[b]

    if scored:
        parts.append(_finish_noise(per_batch(docs, refs, n, verdicts, SCORES), scored))
    for d in detectors:
        if d.scorer is None:
            source = positioned
            if reference_rows is not None:
                shifted = positioned.withColumn("pos", F.col("pos") + reference)
                source = shifted.unionByName(head.withColumn("seq", F.lit(-1).cast("long")), allowMissingColumns=True)
            parts.append(_with_last(padd.sequential(source, n, reference, d.params), docs, d.name, n))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_last(verdicts: DataFrame, docs: DataFrame, name: str, n: int) -> DataFrame:
    ends = docs.groupBy("stream_id", "batch_no").agg(F.max("seq").alias("last_seq"))
    joined = verdicts.join(ends, ["stream_id", "batch_no"])
    return joined.select(
        "stream_id",
        "batch_no",
        F.lit(name).alias("detector"),
        "score",
        "threshold",
        "is_alert",
        F.lit(n).alias("doc_count"),
        "last_seq",
    )


def _finish_noise(scores: DataFrame, detectors: list[Detector]) -> DataFrame:
    """Noise warm-up: the first batch of a stream sets the threshold and has no verdict."""
    warm = [d.name for d in detectors if getattr(d.params, "noise_warmup", False)]
    if not warm:
        return scores
    first = scores.where(F.col("detector").isin(warm) & (F.col("batch_no") == 0))
    limits = first.select("stream_id", "detector", (F.col("score") * mmd.STREAM_FACTOR).alias("_limit"))
    rest = scores.join(limits, ["stream_id", "detector"], "left").where(F.col("_limit").isNull() | (F.col("batch_no") > 0))
    threshold = F.coalesce(F.col("threshold"), F.col("_limit"))
    verdict = F.coalesce(F.col("is_alert"), F.col("score") > threshold)
    return rest.withColumns({"threshold": threshold, "is_alert": verdict}).drop("_limit")


def shared_reference(streams: DataFrame, reference: DataFrame) -> DataFrame:
    """The same reference rows ``(pos, vec)`` for every stream, as for noise warm-up.

    The reference has a fixed, small number of vectors: it is folded to one value, attached to each
    stream and unfolded there.
    """
    rows = cut(reference).agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "vec"))).scalar()
    return streams.select("stream_id", F.inline(rows))


def mmd_statistics(positioned: DataFrame, n: int = TRIGGER_N, reference: int = REFERENCE_SIZE) -> DataFrame:
    """Parts of the two-sample distance of each batch: distances, median bandwidth, MMD² and score."""
    schema = (
        "stream_id string, batch_no long, n_positive long, sum_sq_distance double, median_sq_distance double, "
        "mmd2 double, score double"
    )

    def parts(stream, ref, batches, last):
        for b, rows in batches:
            d2 = np.triu(mmd.sq_distances(np.vstack([rows, ref]).astype(np.float64)), 1)
            value, base = mmd.mmd2(rows, ref)
            score = float(np.sqrt(max(value, 0.0))) if value == value else None
            yield stream, b, int((d2 > 0).sum()), float(d2.sum()), base, value, score

    docs, refs, _ = chunked(positioned, n, reference)
    return per_batch(docs, refs, n, parts, schema)


def forest_scores(positioned: DataFrame, reference: int = REFERENCE_SIZE, models: DataFrame | None = None) -> DataFrame:
    """Forest score of each vector, those of the reference included (``is_reference``).

    ``models`` is the table of :func:`driftloom.operators.iforest.fit_models`, by default fitted on the reference; a model goes
    once to each chunk of 6,400 vectors, and streams without one are left out.
    """
    if models is None:
        models = iforest.fit_models(positioned.where(F.col("pos") < reference))

    def scores(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(model):
            return pd.DataFrame(columns=["stream_id", "pos", "seq", "is_reference", "score"])
        (row,) = model.itertuples()
        found = iforest.score_samples(iforest.forest_of(row), np.stack(pdf["vec"]).astype(np.float64), row.fitted_size)
        return pdf[["stream_id", "pos", "seq"]].assign(is_reference=pdf["pos"] < reference, score=found)

    rows = positioned.withColumn("chunk", F.floor(F.col("pos") / 6400))
    lengths = positioned.groupBy("stream_id").agg(F.floor(F.max("pos") / 6400 + 1).alias("_chunks"))
    each = fresh(explode_range(models.join(lengths, "stream_id"), F.col("_chunks"), "chunk", ["stream_id"]))
    pair = rows.groupBy("stream_id", "chunk").cogroup(each.groupBy("stream_id", "chunk"))
    return pair.applyInPandas(scores, "stream_id string, pos long, seq long, is_reference boolean, score double")


def forest_threshold(scores: DataFrame) -> DataFrame:
    """Mean minus three population deviations of the reference scores of each stream."""
    own = scores.where("is_reference").groupBy("stream_id")
    return own.agg((F.avg("score") - iforest.SIGMAS * F.stddev_pop("score")).alias("threshold"))


def enrich_alerts(alerts: DataFrame, doc_windows: DataFrame, detected_at) -> DataFrame:
    """Alerts with the window batch whose arrival completed the trigger.

    ``doc_windows`` has one row for each document: ``(stream_id, seq, window_type, window_start,
    window_end, doc_count)`` of the batch that first brought it. ``detected_at`` is a time
    expression in milliseconds, so results can be repeated.
    """
    fields = ["window_type", "window_start", "window_end"]
    batch = doc_windows.select("stream_id", F.col("seq").alias("last_seq"), *fields, F.col("doc_count").alias("_docs"))
    hits = alerts.where("is_alert").join(batch, ["stream_id", "last_seq"])
    return hits.withColumns({"doc_count": F.col("_docs"), "detected_at": detected_at}).drop("_docs")


def positions_by(df: DataFrame, stream: str, order, vec: str, seq: str) -> DataFrame:
    """The input of :func:`detect`: dense positions of vectors in stream order."""
    slim = df.select(
        F.col(stream).cast("string").alias("stream_id"), order.alias("_o"), F.col(seq).cast("long").alias("seq"), F.col(vec).alias("vec")
    )
    return dense_position(slim, ["stream_id"], "_o").drop("_o")


def null_trials(df: DataFrame, vec: str, key: str, reference: int, current: int, seed: int = 12345) -> DataFrame:
    """Every vector once, in hash order, cut into trials of a reference and a batch: no drift."""
    hashed = df.select(F.col(key).cast("long").alias("seq"), F.col(vec).alias("vec"), hash60(seed, F.col(key)).alias("_h"), F.lit(0).alias("_one"))
    placed = dense_position(hashed, ["_one"], "_h", "_p", tiebreak=["seq"])
    size = reference + current
    return placed.select(
        F.floor(F.col("_p") / size).cast("string").alias("stream_id"), (F.col("_p") % size).alias("pos"), "seq", "vec"
    )


def false_alarm_rate(scores: DataFrame) -> DataFrame:
    """Share of null trials with an alert, by detector."""
    return scores.groupBy("detector").agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if("is_alert").alias("n_alarms"),
        F.avg(F.col("is_alert").cast("double")).alias("alarm_rate"),
    )
