"""Ordered operators that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(seq)`` sorts every row of a key in one task, so a
stream holding a third of all rows becomes one straggler. Here a large key is cut into ranges of its
order column at borders taken from a sample, about as many ranges as there are shuffle partitions in
all, each key as many as its share. Each range is scanned on its own, in one exchange, and what its key
has gathered before it is carried over: one row for each range, sent to all tasks. Borders decide where
a row is worked on and never what it gets. Rows of one key and equal order stay together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Sampled rows for each range; the ranges of a key are even to about one in the root of this.
OVERSAMPLE = 20
_ORD, _BORDERS, _RANGE = "_ord", "_borders", "_range"
_PLACE = "_place"
_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "since": F.max}


def _combined(fold: str, before: Column, here: Column) -> Column:
    if fold == "since":
        shift = F.coalesce(F.col(f"_c_{_PLACE}"), F.lit(0))
        return shift + F.col(_PLACE) - F.coalesce(shift + here, before)
    if fold == "sum":
        return F.coalesce(before + here, before, here)
    return F.greatest(before, here) if fold == "max" else F.least(before, here)


def _with(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join with a small table by keys that may be null; its key columns go."""
    small = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(F.broadcast(small), same, how).drop(*[f"_of_{k}" for k in keys])


def range_borders(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame | None:
    """(keys, borders): where the ranges of large keys begin; None if no key is cut.

    Reads the keys and the order column twice, to count and to sample. The borders number about
    ``spark.sql.shuffle.partitions`` over all keys, and so do the rows of this table at most.
    """
    spark, slim = df.sparkSession, df.select(*keys, order)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = wanted * OVERSAMPLE / max(1, slim.count())
    sampled: dict[tuple, list[int]] = defaultdict(list)
    for row in (slim if share >= 1 else slim.where(F.rand(17) < share)).where(F.col(order).isNotNull()).collect():
        sampled[tuple(row[:-1])].append(row[-1])
    step = max(1, sum(map(len, sampled.values())) // wanted)
    rows = [(*key, sorted({sorted(seen)[k] for k in range(step, len(seen), step)})) for key, seen in sampled.items() if len(seen) > step]
    if not rows:
        return None
    kinds = [StructField(k, df.schema[k].dataType) for k in keys]
    return spark.createDataFrame(rows, StructType([*kinds, StructField(_BORDERS, ArrayType(LongType()))]))


def _range_of(order: Column, borders: Column, most: int) -> Column:
    """How many of at most ``most`` borders lie at or below ``order``, by halving steps; 0 without borders."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    ahead = lambda at, step: (at + step <= F.size(borders)) & (F.get(borders, at + step - 1) <= order)
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))
    return F.when(borders.isNull(), 0).otherwise(found)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Column,
    values: dict[str, tuple[str, Column]],
    *,
    tiebreak: Sequence[str] = (),
    inclusive: bool = True,
    peers: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``since`` per key in the order of a long column, several in one pass.

    ``values`` maps an output name to ``(fold, expression)``. ``max`` over a struct that starts with
    the order column gives "last known value"; ``since`` counts the rows after the last one for which
    a condition holds, null before the first, and needs an order without peers or exclusion.
    With ``peers`` rows of equal order see each other. The plan reads ``df`` once and exchanges it once; the
    sums of the ranges are made before, from the keys that are cut and the columns they need.
    """
    keys, spark = list(keys), df.sparkSession
    ordc = F.col(order) if isinstance(order, str) else order
    ordc = (-ordc if descending else ordc).cast("long")
    tagged = df.withColumns({_ORD: ordc, **{f"_v_{n}": c for n, (_, c) in values.items()}})
    borders = range_borders(tagged, keys, _ORD)
    spec = Window.partitionBy(*keys, _RANGE).orderBy(_ORD, *([] if peers else tiebreak))
    counted = any(f == "since" for f, _ in values.values())
    # a condition becomes the number, within the range, of the row where it holds
    place = {_PLACE: F.row_number().over(spec).cast("long")} if counted else {}
    placed = {f"_v_{n}": F.when(F.col(f"_v_{n}"), F.col(_PLACE)) for n, (f, _) in values.items() if f == "since"}
    rows = tagged.withColumn(_RANGE, F.lit(0))
    before = None
    if borders is not None:
        # a step of range_borders is at least half of an even share, so no key has more than twice as many
        at = _range_of(F.col(_ORD), F.col(_BORDERS), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).alias(_RANGE)
        rows = _with(tagged, borders, keys, "left").select(*tagged.columns, at)
        cut_keys = _with(tagged.select(*keys, _ORD, *[f"_v_{n}" for n in values], *tiebreak), borders, keys, "inner").withColumn(_RANGE, at)
        before = _carried(cut_keys.withColumns(place).withColumns(placed), keys, values, counted)
        before = spark.createDataFrame(before.collect(), before.schema)  # no more rows than there are borders
    rows = rows.withColumns(place).withColumns(placed)
    first = Window.unboundedPreceding
    frame = spec.rangeBetween(first, 0) if peers else spec.rowsBetween(first, 0 if inclusive else -1)
    out = rows.withColumns({n: _FOLDS[f](f"_v_{n}").over(frame) for n, (f, _) in values.items()})
    if before is not None:
        out = _with(out, before, [*keys, _RANGE], "left")
    else:
        out = out.withColumns({f"_c_{n}": F.lit(None) for n in (*values, _PLACE)})
    out = out.withColumns({n: _combined(f, F.col(f"_c_{n}"), F.col(n)) for n, (f, _) in values.items()})
    return out.select(*[c for c in df.columns if c not in values], *values)


def _carried(rows: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], counted: bool) -> DataFrame:
    """For each range but the first of a key what the ranges before it have gathered."""
    size = [F.count(F.lit(1)).alias(_PLACE)] if counted else []
    totals = rows.groupBy(*keys, _RANGE).agg(*size, *[_FOLDS[f](f"_v_{n}").alias(f"_v_{n}") for n, (f, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    if counted:
        totals = totals.withColumn(f"_c_{_PLACE}", F.coalesce(F.sum(_PLACE).over(earlier), F.lit(0).cast("long")))
        totals = totals.withColumns({f"_v_{n}": F.col(f"_c_{_PLACE}") + F.col(f"_v_{n}") for n, (f, _) in values.items() if f == "since"})
    gathered = [_FOLDS[f](f"_v_{n}").over(earlier).alias(f"_c_{n}") for n, (f, _) in values.items()]
    return totals.select(*keys, _RANGE, *([f"_c_{_PLACE}"] if counted else []), *gathered).where(F.col(_RANGE) > 0)


def dense_position(
    df: DataFrame, keys: Sequence[str], order: str | Column, name: str = "pos", **options
) -> DataFrame:
    """0-based position of each row within its key."""
    counted = running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, **options)
    return counted.withColumn(name, F.col(name) - 1)


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """The first ``n`` rows of each key with their 1-based rank.

    Ranked inside salted parts first (``spread`` names columns that tell rows apart), so that no
    task sees more than ``n * salts`` rows of a key in the end; before each exchange Spark's window
    group limit keeps ``n`` rows of a group in each task.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= n).drop("_r", "_salt")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for joins of a table with its own derivative."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
