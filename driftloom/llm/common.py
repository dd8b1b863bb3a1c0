"""Small helpers shared by the operators on training data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What the module ``owner`` keeps in a worker process from task to task; what others have kept there goes.

    A worker runs one task at a time and outlives the stage: the memories of all operators would add up in it.
    """
    for other in [name for name in _held if name != owner]:
        del _held[other]
    return _held.setdefault(owner, {})


def map_batches(df: DataFrame, columns: list[str], schema: str, work: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``work()`` is called once a task and gives a function from an Arrow batch to output columns.

    A batch of rows with very long texts is cut into slices of at most :data:`SLICE_BYTES`, so that
    what a task holds does not grow with the number of long texts that meet in one batch.
    """
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(work.__module__)
        step = work()
        for batch in batches:
            for part in _slices(batch):
                out = step(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


SLICE_BYTES = 8_000_000


def _slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= most or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from _slices(batch.slice(0, half), most)
    yield from _slices(batch.slice(half), most)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def list_column(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """An Arrow list array from its values laid end to end and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, for fitting a classifier.

    ``rows`` is a documented parameter of the caller, so the ids may be broadcast: 16 bytes each. The
    choice goes by a hash of the id and does not depend on partitions. A document with several
    labels takes the largest; a null label is none. Repeated ids in ``docs`` are all kept.
    """
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(target)), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton steps; the bias is not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
