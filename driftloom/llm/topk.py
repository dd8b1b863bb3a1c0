"""Exact search for the largest inner products, over buckets of vectors of about one length.

Vectors are put into buckets by length and packed into blocks (a bucket of many vectors is split by a
hash, so equal vectors spread). The blocks of the longest vectors give each query a score that its k-th
result reaches at least. For any other block that score divided by both lengths is the cosine that a
vector must reach to matter: above one, the block is skipped for the query; if it is high, vectors are
pruned by the query's largest coordinate, whose value a vector of that cosine cannot miss by much;
otherwise by length. What is left is verified with exact products. Pruning never loses a result.

Blocks of queries meet blocks of candidates; no pair of vectors is a row before it is among the k best
of its two blocks.

Vectors that are null or hold a null or a number that is not finite take no part, nor do rows without an
id. Shorter vectors count as continued with zeros. Repeated rows of one id count once; an id with
several vectors has the least of them. Ties go to the smaller id. Products beyond 64 bits become the
largest or smallest number that fits. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import map_batches
from driftloom.llm.groups import map_groups
from driftloom.storage import cut

BLOCK, QUERIES = 2048, 512
#: Ratio of lengths within a bucket.
RATIO = 1.05
#: Blocks of the longest vectors that give the first thresholds.
SEEDS = 4
#: Cosine from which the coordinate prunes more than the length.
STEEP = 0.8


def quantised(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a block: its ids in order and its vectors as a matrix of the smallest integer type."""

    def pack(table: pa.Table, starts: np.ndarray) -> dict:
        out: dict[str, list] = {n: [] for n in (*keys, "n", "longest", "dim", "kind", "ids", "matrix")}
        ids, vectors = table.column("vec_id").to_numpy(), table.column("v").combine_chunks()
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            order = np.argsort(ids[start:end], kind="stable")
            parts = [vectors[start + int(i)].values.to_numpy() for i in order]
            dim = max(map(len, parts))
            matrix = np.zeros((end - start, dim), np.int64)
            for row, part in zip(matrix, parts, strict=True):
                row[: len(part)] = part
            kind = next(k for k in ("int16", "int32", "int64") if not matrix.size or (matrix.min() >= np.iinfo(k).min and matrix.max() <= np.iinfo(k).max))
            for key in keys:
                out[key].append(table.column(key)[start].as_py())
            length = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
            for name, value in (("n", end - start), ("longest", length.max()), ("dim", dim), ("kind", kind), ("ids", ids[start:end][order].astype(np.int64).tobytes()), ("matrix", matrix.astype(kind).tobytes())):
                out[name].append(value)
        kinds = {k: pa.int64() for k in keys} | {"n": pa.int64(), "longest": pa.float64(), "dim": pa.int64(), "kind": pa.string(), "ids": pa.binary(), "matrix": pa.binary()}
        return {name: pa.array(values, kinds[name]) for name, values in out.items()}

    schema = ", ".join(f"{k} bigint" for k in keys) + ", n bigint, longest double, dim bigint, kind string, ids binary, matrix binary"
    return map_groups(rows, keys, schema, pack)


def _matrix(row: dict, prefix: str) -> np.ndarray:
    return np.frombuffer(row[f"{prefix}matrix"], row[f"{prefix}kind"]).reshape(row[f"{prefix}n"], row[f"{prefix}dim"])


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products, as 64-bit integers."""
    dim = min(left.shape[1], right.shape[1])
    left, right = left[:, :dim], right[:, :dim]
    if not dim or not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    largest = float(np.abs(left.astype(float)).max()) * float(np.abs(right.astype(float)).max()) * dim
    if largest < 2**53:  # every sum is a whole number that a double holds
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    exact = left.astype(object) @ right.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of at least ``least`` and their ids, ties to smaller ids, without the own id."""
    usable = (ids != own) & (scores >= least)
    scores, ids = scores[usable], ids[usable]
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        reach = scores >= bar
        scores, ids = scores[reach], ids[reach]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(row: dict, k: int) -> tuple[list[int], list[int], list[int]]:
    queries, candidates = _matrix(row, "q_"), _matrix(row, "")
    query_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    bars = np.frombuffer(row["bars"], np.float64) if row.get("bars") is not None else np.full(len(queries), -np.inf)
    q_length, c_length = (np.sqrt((m.astype(float) ** 2).sum(axis=1)) for m in (queries, candidates))
    longest = c_length.max()
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(bars > 0, bars / (q_length * longest), 0.0)  # cosine that matters
        shortest = np.where(bars > 0, bars / q_length, 0.0) * (1 - 1e-9)
    reach = np.nan_to_num(reach, nan=0.0, posinf=2.0) * (1 - 1e-9)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])

    def keep(query: int, scores: np.ndarray, found: np.ndarray) -> None:
        s, i = best(scores, found, query_ids[query], k, bars[query])
        out[0].extend([int(query_ids[query])] * len(s))
        out[1].extend(i.tolist())
        out[2].extend(s.tolist())

    by_length = np.flatnonzero(reach < STEEP)
    if len(by_length):
        open_to = np.flatnonzero(c_length >= shortest[by_length].min())
        scores = products(queries[by_length], candidates[open_to])
        for at, query in enumerate(by_length):
            keep(query, scores[at], ids[open_to])
    unit = candidates / np.where(c_length > 0, c_length, 1)[:, None]
    for query in np.flatnonzero((reach >= STEEP) & (reach <= 1)):
        cosine = bars[query] / (q_length[query] * np.where(c_length > 0, c_length, np.inf)) * (1 - 1e-9)
        q = queries[query] / q_length[query]
        focus = int(np.abs(q).argmax())
        if focus >= candidates.shape[1]:
            survive = c_length >= shortest[query]
        else:
            slack = np.sqrt(np.clip(1 - cosine**2, 0, None) * (1 - q[focus] ** 2)) + 1e-9
            survive = (cosine <= 1) & (np.abs(unit[:, focus] - q[focus] * cosine) <= slack + np.abs(q[focus]) * np.clip(1 - cosine, 0, None))
        if survive.any():
            keep(query, products(queries[query : query + 1], candidates[survive])[0], ids[survive])
    return out


_FOUND = "query_id bigint, vec_id bigint, score bigint"
_SIDES = ["q_n", "q_dim", "q_kind", "q_ids", "q_matrix", "n", "dim", "kind", "ids", "matrix"]


def _pairs(pairs: DataFrame, k: int, bars: bool) -> DataFrame:
    columns = [*_SIDES, *(["bars"] if bars else [])]

    def work():
        def step(batch: pa.RecordBatch) -> dict:
            found = ([], [], [])
            for row in batch.to_pylist():
                for whole, part in zip(found, _search(row, k), strict=True):
                    whole.extend(part)
            return {n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found, strict=True)}

        return step

    return map_batches(pairs, columns, _FOUND, work)


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows but its own for each row where ``queries`` holds.

    ``vectors`` has ``vec_id`` and ``v``, an array of whole numbers or null.
    """
    spark = vectors.sparkSession
    usable = vectors.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    step = float(np.log(RATIO))
    rows = cut(usable.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.floor(F.log(length + 1) / step).alias("bucket"), queries.alias("asks")))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))
    asked = rows.where("asks")
    many = int(np.ceil(asked.count() / QUERIES))
    salted = rows.join(F.broadcast(sizes), "bucket").withColumn("salt", F.expr(f"pmod(xxhash64(vec_id), ceil(size / {BLOCK}))"))
    blocks = cut(_packed(salted.select("bucket", "salt", "vec_id", "v"), ["bucket", "salt"]))
    asking = cut(_packed(asked.select(F.expr(f"pmod(xxhash64(vec_id, 1), {max(1, many)})").alias("ask"), "vec_id", "v"), ["ask"]))
    asking = asking.select("ask", "longest", *(F.col(c).alias(f"q_{c}") for c in ("n", "dim", "kind", "ids", "matrix"))).withColumnRenamed("longest", "q_longest")
    # first thresholds: a few blocks (at most SEEDS of BLOCK vectors) go to every block of queries
    seeds = blocks.orderBy(F.desc("bucket"), "salt").limit(SEEDS).withColumn("one", F.lit(1))
    first = _top(_pairs(asking.withColumn("one", F.lit(1)).join(F.broadcast(seeds), "one"), k, False), k)
    bars = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("bar")).where(F.col("found") == k)
    asking = cut(_with_bars(asking, bars, rows, many))
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.withColumn("g", F.expr(f"pmod(xxhash64(bucket, salt), {groups})"))
    spread = asking.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("g", F.col("g").cast("long"))
    reachable = F.col("q_longest") * F.col("longest") * (1 + 1e-9) >= F.col("least")
    pairs = spread.join(dealt, "g").where(reachable)
    return _top(_pairs(pairs, k, True), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_bars(asking: DataFrame, bars: DataFrame, rows: DataFrame, many: int) -> DataFrame:
    """The blocks of queries with the thresholds of their rows (in the order of ids), and the least of them."""
    ask = F.expr(f"pmod(xxhash64(query_id, 1), {max(1, many)})")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"))
    per = asked.join(bars, "query_id", "left").select(ask.alias("ask"), "query_id", F.coalesce(F.col("bar").cast("double"), F.lit(float("-inf"))).alias("bar"))

    def lay(table: pa.Table, starts: np.ndarray) -> dict:
        ids, values, keys = (table.column(c).to_numpy() for c in ("query_id", "bar", "ask"))
        parts = [(int(keys[s]), values[s:e][np.argsort(ids[s:e], kind="stable")]) for s, e in zip(starts[:-1], starts[1:], strict=True)]
        return {"ask": pa.array([k for k, _ in parts], pa.int64()), "bars": pa.array([v.tobytes() for _, v in parts], pa.binary()), "least": pa.array([float(v.min()) for _, v in parts], pa.float64())}

    return asking.join(map_groups(per, ["ask"], "ask bigint, bars binary, least double", lay), "ask")
