"""Labelled streams: which document stands at sequence k of a drift schedule, and its label."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.hashing import hash60, uniform
from driftloom.operators.ordered import dense_position, fresh, top_n
from driftloom.storage import cut

# The drift plan of one run (sequence numbers, documents, milliseconds).
DEFAULT_LENGTH = 4500
DECLARED_STARTS = (1000, 2000, 3200)
GRADUAL_WINDOW = 200
RECURRING_PERIOD = 150
RECURRING_PAUSE = 200
RATE_MS = 100
SUBSET_SIZE = 2000
# Initial, sudden, gradual and recurring category of each known data set.
CATEGORY_PLANS = {
    "newsgroups": ("sci.space", "talk.politics.guns", "sci.med", "sci.space"),
    "agnews": ("agnews_world", "agnews_sports", "agnews_scitech", "agnews_world"),
    "yahoo": ("yahoo_science", "yahoo_relationships", "yahoo_politics", "yahoo_science"),
}

_END = (1 << 63) - 1
_SEGMENT = (
    "schedule string, start_seq long, end_seq long, kind string, base string, target string, "
    "declared_start long, span long"
)


@dataclass(frozen=True)
class Segment:
    """Documents ``start_seq <= seq < end_seq`` of one regime; ``kind`` is null outside drift."""

    start_seq: int
    end_seq: int
    kind: str | None
    base: str
    target: str | None = None
    declared_start: int | None = None
    span: int | None = None


def plan_segments(
    categories: tuple[str, str, str, str],
    starts: tuple[int, int, int],
    declared: tuple[int, int, int] | None = None,
    gradual_window: int = GRADUAL_WINDOW,
    recurring_period: int = RECURRING_PERIOD,
) -> list[Segment]:
    """Segments of the usual plan: base, sudden, gradual, settled, recurring.

    A sudden drift lasts until the next one and changes the base; a gradual drift changes the base
    when its window completes; a recurring drift returns to the base again and again.
    """
    initial, sudden, gradual, recurring = categories
    s1, s2, s3 = starts
    d1, d2, d3 = declared or starts
    settled = s2 + gradual_window <= s3
    turn = min(s2 + gradual_window, s3)
    last_base = gradual if settled else sudden
    plan = [
        Segment(0, s1, None, initial),
        Segment(s1, s2, "sudden", initial, sudden, d1),
        Segment(s2, turn, "gradual", sudden, gradual, d2, gradual_window),
        Segment(turn, s3, None, last_base),
        Segment(s3, _END, "recurring", last_base, recurring, d3, recurring_period),
    ]
    return [s for s in plan if s.start_seq < s.end_seq]


def preset(dataset: str) -> list[Segment]:
    """The plan of a known data set; an unknown name means newsgroups.

    The recurring drift starts 400 documents after the gradual one, yet is declared at 3200.
    """
    s1, s2, d3 = DECLARED_STARTS
    starts = (s1, s2, s2 + GRADUAL_WINDOW + RECURRING_PAUSE)
    return plan_segments(CATEGORY_PLANS.get(dataset, CATEGORY_PLANS["newsgroups"]), starts, (s1, s2, d3))


def schedule_frame(spark: SparkSession, plans: dict[str, list[Segment]]) -> DataFrame:
    rows = [{"schedule": name, **asdict(s)} for name, plan in plans.items() for s in plan]
    names = [part.split()[0] for part in _SEGMENT.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], _SEGMENT)


def subsample(
    df: DataFrame, keys: list[str], doc: str, n: int, seed: Column | int, rank: str = "draw_rank"
) -> DataFrame:
    """At most ``n`` documents of each key in seeded random order (1-based ``rank``)."""
    hashed = df.withColumn("_h", hash60(seed, F.col(doc)))
    return top_n(hashed, keys, [F.col("_h"), F.col(doc)], n, [doc], rank=rank).drop("_h")


def categories_in_group(df: DataFrame, category: str, group: str) -> DataFrame:
    """Documents whose category is the group or lies below it."""
    c = F.col(category)
    return df.where((c == group) | c.startswith(group + "."))


#: Segments of all plans together up to which they are broadcast (about 100 bytes each).
BROADCAST_SEGMENTS = 100_000


def schedule_categories(seqs: DataFrame, schedule: DataFrame, seed: Column | int) -> DataFrame:
    """Category and drift labels for rows ``(schedule, seq)``.

    The schedule comes from parameters, not from data: a handful of segments for each plan, so it
    is joined as a broadcast on the plan name with the segment bounds as residual condition. More
    than ``BROADCAST_SEGMENTS`` are joined by an exchange on the plan name.
    """
    few = schedule.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS
    joined = seqs.join(
        (F.broadcast if few else fresh)(schedule.withColumnRenamed("schedule", "_plan")),
        (F.col("schedule") == F.col("_plan")) & (F.col("seq") >= F.col("start_seq")) & (F.col("seq") < F.col("end_seq")),
    )
    p = F.col("seq") - F.col("start_seq")
    completes = p >= F.col("span") - 1
    on_gradual = completes | (uniform(seed, F.col("seq")) < p / F.col("span"))
    on_recurring = F.floor(p / F.col("span")) % 2 == 0
    kind = F.col("kind")
    category = (
        F.when(kind.isNull(), F.col("base"))
        .when(kind == "sudden", F.col("target"))
        .when(kind == "gradual", F.when(on_gradual, F.col("target")).otherwise(F.col("base")))
        .otherwise(F.when(on_recurring, F.col("target")).otherwise(F.col("base")))
    )
    labelled = kind.isNotNull() & ~((kind == "gradual") & completes)
    return joined.select(
        *[F.col(c) for c in seqs.columns],
        category.alias("category"),
        F.coalesce(labelled, F.lit(False)).alias("drift_label"),
        F.when(labelled, kind).alias("drift_type"),
        F.when(labelled, F.col("declared_start")).alias("drift_start"),
    )


def explode_range(df: DataFrame, n: Column, name: str, keys: list[str], width: int = 1 << 12) -> DataFrame:
    """One row for each of ``0 .. n - 1``; the first explosion is spread before the second one."""
    coarse = df.withColumn("_n", n.cast("long")).where("_n > 0")
    coarse = coarse.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / width))))
    spread = coarse.repartition(*keys, "_hi")
    low = F.least(F.lit(width - 1).cast("long"), F.col("_n") - 1 - F.col("_hi") * width)
    fine = spread.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), low)))
    return fine.withColumn(name, F.col("_hi") * width + F.col("_lo")).drop("_n", "_hi", "_lo")


def cyclic_draw(requests: DataFrame, pool: DataFrame, seed: Column | int, run: str = "run_id") -> DataFrame:
    """The j-th request of a category gets pool document j; each further pass is reshuffled.

    ``requests`` has ``(run_id, category, seq)``, ``pool`` has ``(run_id, category, doc_key)`` with
    keys in load order. The pool is expanded only for the passes that are drawn, so the work is
    linear in requests plus pool, and ``(run, category, pass, position)`` is unique on both sides of
    the join, however often a category is asked for. Only keys travel here, no texts.
    """
    keys = [run, "category"]
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    asked = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("_asked"))
    unknown = asked.join(fresh(sizes), keys, "left_anti").first()
    if unknown:
        raise ValueError(f"nothing to draw from in category {unknown['category']!r}")
    size = F.col("_size")
    counted = dense_position(requests, keys, "seq", "_j").join(sizes, keys)
    placed = counted.withColumn("draw_pass", F.floor(F.col("_j") / size)).withColumn(
        "draw_pos", F.col("_j") - F.col("draw_pass") * size
    )
    first = dense_position(pool, keys, "doc_key", "draw_pos").withColumn("draw_pass", F.lit(0).cast("long"))
    passes = F.floor((F.col("_asked") - 1) / F.col("_size")).alias("_passes")
    later = fresh(asked.join(fresh(sizes), keys).select(*keys, passes))
    again = explode_range(pool.join(later, keys), F.col("_passes"), "draw_pass", [*keys, "doc_key"])
    again = again.withColumn("draw_pass", F.col("draw_pass") + 1).withColumn(
        "_h", hash60(seed, F.col("category"), F.col("draw_pass"), F.col("doc_key"))
    )
    shuffled = dense_position(
        again, [*keys, "draw_pass"], "_h", "draw_pos", tiebreak=["doc_key"]
    )
    seat = [*keys, "draw_pass", "draw_pos"]
    deck = first.select(*seat, "doc_key").unionByName(shuffled.select(*seat, "doc_key"))
    return placed.drop("_j", "_size").join(fresh(deck), seat)


def assemble_ids(
    corpus: DataFrame,
    schedule: DataFrame,
    runs: DataFrame,
    n: int,
    t0_ms: int = 0,
    rate_ms: int = RATE_MS,
    subset_size: int | None = None,
) -> DataFrame:
    """Labelled streams as :func:`assemble_streams` gives them, with ``doc_id``, the corpus key of each document, for its text.

    A stream shows a document of its pool again and again; work on texts is done once for each of them.
    """
    parts = schedule.select("schedule", F.explode(F.array("base", "target")).alias("category"))
    wanted = runs.join(parts.where("category is not null").distinct(), "schedule").select("run_id", "seed", "category")
    ids = corpus.select("category", F.col("doc_key").alias("doc_id"))
    pool = ids.join(wanted, "category").withColumn("doc_key", F.col("doc_id"))
    if subset_size is not None:
        drawn = subsample(pool, ["run_id", "category"], "doc_id", subset_size, F.col("seed"))
        pool = drawn.withColumn("doc_key", F.col("draw_rank").cast("long"))
    pool = cut(pool.select("run_id", "category", "seed", "doc_key", "doc_id"))
    seqs = explode_range(runs, F.lit(n), "seq", ["run_id"])
    labelled = cut(schedule_categories(seqs, schedule, F.col("seed")))
    drawn = cyclic_draw(labelled, pool.select("run_id", "category", "seed", "doc_key"), F.col("seed"))
    chosen = drawn.join(fresh(pool.drop("seed")), ["run_id", "category", "doc_key"])
    return chosen.select(
        "run_id",
        F.concat_ws("-", "run_id", "seq").alias("docId"),
        (F.lit(t0_ms) + F.col("seq") * rate_ms).cast("long").alias("timestamp"),
        "doc_id",
        F.col("category").alias("sourceCategory"),
        F.col("seq").alias("sequenceNumber"),
        F.col("drift_label").alias("driftLabel"),
        F.col("drift_type").alias("driftType"),
        F.col("drift_start").alias("driftStartTs"),
    )


#: Documents of a stream up to which their ids are sent to all texts (8 bytes each); beyond that both are exchanged.
BROADCAST_DOCUMENTS = 100_000


def texts_of(streams: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the corpus documents that stand in ``streams``, read once; other texts are not moved."""
    ids = cut(streams.select("doc_id").distinct())
    few = ids.count() <= BROADCAST_DOCUMENTS
    texts = corpus.select(F.col("doc_key").alias("doc_id"), "text")
    return texts.join((F.broadcast if few else fresh)(ids), "doc_id", "left_semi")


def assemble_streams(
    corpus: DataFrame,
    schedule: DataFrame,
    runs: DataFrame,
    n: int,
    t0_ms: int = 0,
    rate_ms: int = RATE_MS,
    subset_size: int | None = None,
) -> DataFrame:
    """Labelled streams of ``n`` documents, one for each row ``(run_id, schedule, seed)`` of ``runs``.

    ``corpus`` has ``(doc_key, text, category)``. With ``subset_size`` each run draws from its own
    seeded sub-sample of every category; use it for grids, because otherwise a pool is the corpus.
    """
    streams = cut(assemble_ids(corpus, schedule, runs, n, t0_ms, rate_ms, subset_size))
    names = ["text" if c == "doc_id" else c for c in streams.columns]
    return streams.join(fresh(texts_of(streams, corpus)), "doc_id").select(*names)
