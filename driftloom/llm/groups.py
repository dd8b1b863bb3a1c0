"""Groups that stream through a task, and components of a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import held
from driftloom.storage import cut

#: A table of whole groups, and where each starts; the last entry is the table's length.
Groups = tuple[pa.Table, np.ndarray]


def map_groups(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], dict], order: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt and sorted by ``keys`` (integers); ``work`` gets tables of whole groups as they pass.

    Rows of a group come in the order of the columns ``order``.

    Unlike a call for each group this costs little for many small ones. A group must be bounded by
    the caller; a task holds the rows of one group and one batch at most.
    """
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(work.__module__)
        for table, starts in _whole_groups(batches, keys):
            out = work(table, starts)
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[Groups]:
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        changes = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
        if held and (columns[:, 0] != last).any():
            yield _closed(held, keys)
            held = []
        if len(changes):  # all but the last group of this batch are complete
            yield _closed([*held, batch.slice(0, changes[-1])], keys)
            held = [batch.slice(changes[-1])]
        else:
            held.append(batch)
        last = columns[:, -1]
    if held:
        yield _closed(held, keys)


def _closed(parts: list[pa.RecordBatch], keys: list[str]) -> Groups:
    table = pa.Table.from_batches(parts).combine_chunks()
    columns = np.stack([table.column(k).to_numpy() for k in keys])
    changes = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
    return table, np.concatenate([[0], changes, [table.num_rows]])


def stars(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (least, other) that connect what the pairs (left, right) connect: a star for each part.

    Stars around the least of each part are often the same for overlapping sets of rows, chains are not.
    """
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    open_parts = n - 1
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            open_parts -= 1
            if not open_parts:
                break
    return [(root(x), x) for x in range(n) if root(x) != x]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its least node.

    In every round each node hooks onto its least neighbour, if that is smaller, and on to where that one
    hooks. Nodes that share a hook become one, so the edges that are left between different ones, and with
    them the work of a round, shrink quickly. Each round is written to the shared folder, in as many files as its
    edges need, and starts there.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct())
    all_edges = n_edges = both.count()
    found = cut(both.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct(), all_edges)
    while n_edges:
        hooks = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("hook")), n_edges)
        onward = hooks.select(F.col("u").alias("hook"), F.col("hook").alias("next"))
        hooks = cut(hooks.join(onward, "hook").select("u", F.col("next").alias("hook")), n_edges)
        found = cut(
            found.join(hooks.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("hook", "component").alias("component")),
            all_edges,
        )
        left = both.join(hooks, "u").select(F.col("hook").alias("a"), "v")
        right = hooks.select(F.col("u").alias("v"), F.col("hook").alias("b"))
        both = cut(left.join(right, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), n_edges)
        n_edges = both.count()
    return found
