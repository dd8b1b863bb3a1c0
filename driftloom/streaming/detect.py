"""Detection on a stream of vectors: bounded state for each stream key.

State of a key: its reference vectors, the vectors of the open trigger batch, counters, thresholds
found in noise warm-up, and for the activation test its history (at most 5000 short rows). Verdicts come from the same scorers as in
the batch job. A stream's order is the sequence number within a micro-batch and arrival across
micro-batches; one key is advanced by one task, as its verdicts depend on one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftloom.operators import mmd, padd
from driftloom.operators.detect import SCORES, Detector, _is_alert
from driftloom.operators.embed import REFERENCE_SIZE, STORE_SIZE, TRIGGER_N

_STATE = "dim int, batch_no long, reference binary, open binary, history binary, thresholds binary"
_COLUMNS = {"stream_id": str, "batch_no": "int64", "detector": str, "score": float, "threshold": float, "is_alert": object, "doc_count": "int32", "last_seq": "int64"}


def detect_stream(
    docs: DataFrame, detectors: list[Detector], n: int = TRIGGER_N, reference: int = REFERENCE_SIZE, reference_rows: np.ndarray | None = None
) -> DataFrame:
    """Verdicts for a stream of ``(stream_id, seq, vec)`` rows, as trigger batches complete.

    ``reference_rows`` (a matrix of fixed, small size) is a reference given for all streams, as for
    noise warm-up; then no document goes into it. In noise warm-up the first batch of a stream sets
    the threshold and has no verdict, as in the batch job. Each detector scores all batches that a
    micro-batch completes in one call.
    """
    given = None if reference_rows is None else np.asarray(reference_rows, np.float32)
    warm = [d.name for d in detectors if getattr(d.params, "noise_warmup", False)]
    limits = {d.name: getattr(d.params, "most_rejections", None) for d in detectors}
    folding = next((d for d in detectors if d.scorer is None), None)
    hidden = folding.params.hidden if folding else 1

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(parts)).sort_values("seq")
        fresh = np.stack(arrived["vec"]).astype(np.float32)
        seqs = arrived["seq"].to_numpy()
        dim, number, ref, buffered, past = fresh.shape[1], 0, fresh[:0], fresh[:0], np.zeros((0, hidden))
        thresholds = np.full(len(warm), np.nan)
        if state.exists:
            dim, number, *raw = state.get
            ref, buffered = (np.frombuffer(r, np.float32).reshape(-1, dim) for r in raw[:2])
            past = np.frombuffer(raw[2], np.float64).reshape(-1, hidden)
            thresholds = np.frombuffer(raw[3], np.float64).copy()
        take = min(max(reference - len(ref), 0), len(fresh)) if given is None else 0
        ref, rest = (np.vstack([ref, fresh[:take]]) if given is None else given), fresh[take:]
        pending = np.vstack([buffered, rest])
        # the last document of a batch arrived now: earlier ones may lie in the buffer
        shift = take - len(buffered)
        complete, last = [], {}
        while len(pending) >= n:
            complete.append((number, pending[:n]))
            last[number] = int(seqs[shift + n - 1])
            pending, shift, number = pending[n:], shift + n, number + 1
        rows = []
        for d in detectors if complete else ():
            if d.scorer is not None:
                found = list(d.scorer(d.params, name[0], ref, complete))
            else:
                found = []
                for at, batch in complete:
                    verdict, past = _fold(d, name[0], ref, at, batch, past)
                    found += verdict
            for b, score, threshold in found:
                if d.name in warm:
                    if b == 0:
                        thresholds[warm.index(d.name)] = score * mmd.STREAM_FACTOR
                        continue
                    threshold = float(thresholds[warm.index(d.name)])
                rows.append((name[0], b, d.name, score, threshold, _is_alert(d, score, threshold, limits), n, last[b]))
        held = ref if given is None else ref[:0]
        state.update((dim, number, held.tobytes(), pending.tobytes(), past.tobytes(), thresholds.tobytes()))
        yield pd.DataFrame(sorted(rows, key=lambda r: (r[1], r[2])), columns=list(_COLUMNS)).astype(_COLUMNS)

    slim = docs.select("stream_id", "seq", "vec")
    return slim.groupBy("stream_id").applyInPandasWithState(step, SCORES, _STATE, "append", GroupStateTimeout.NoTimeout)


def _fold(d: Detector, stream: str, ref: np.ndarray, number: int, batch: np.ndarray, past: np.ndarray):
    """One step of the activation test: the first batch initialises, later ones test and move on."""
    if number == 0:
        return [], padd.activate(ref, d.params)
    now = padd.activate(batch, d.params)
    count = padd.rejections(past, now, padd.draws(d.params, stream, number), d.params)
    found = [(number, count / d.params.tests, d.params.theta)]
    if count > d.params.most_rejections:
        return found, now
    return found, np.concatenate([past, now])[-d.params.max_history :]


def latest_vectors(docs: DataFrame, size: int = STORE_SIZE) -> DataFrame:
    """The latest ``size`` vectors of each stream that a micro-batch touches, ``age`` 1 the latest.

    Run it with output mode ``update``: the rows of a stream replace those it sent before. State of a key is
    the store itself. What arrives is merged piece by piece, so a large micro-batch of one key is never held whole;
    rows may come in any order.
    """

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, vectors = np.zeros(0, np.int64), None
        if state.exists:
            dim, *raw = state.get
            seqs, vectors = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.float32).reshape(-1, dim)
        for part in parts:
            fresh = np.stack(part["vec"]).astype(np.float32)
            seqs = np.concatenate([seqs, part["seq"].to_numpy(np.int64)])
            vectors = fresh if vectors is None else np.vstack([vectors, fresh])
            kept = np.argsort(-seqs, kind="stable")[:size]
            seqs, vectors = seqs[kept], vectors[kept]
        state.update((vectors.shape[1], seqs.tobytes(), vectors.tobytes()))
        yield pd.DataFrame({"stream_id": name[0], "seq": seqs, "age": np.arange(1, len(seqs) + 1), "vec": list(vectors)})

    slim = docs.select("stream_id", "seq", "vec").where("seq is not null and vec is not null")
    out = "stream_id string, seq long, age long, vec array<float>"
    return slim.groupBy("stream_id").applyInPandasWithState(step, out, "dim int, seqs binary, vectors binary", "update", GroupStateTimeout.NoTimeout)
