"""Labelled streams on ``documents`` and ``events``; windows on ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import table
from checks.corpus_checks import sql_clean
from driftloom.functions.timecols import epoch_ms
from driftloom.operators import assemble as am
from driftloom.operators import evaluate as ev
from driftloom.operators import windows as wn

HOUR = 3_600_000
SIZE, ADVANCE = 6 * HOUR, 6 * HOUR // 4
LANGS = {"click": "en", "view": "fr", "purchase": "de", "signup": "es", "error": "es"}
_LANG_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGS.items()) + " END"
_PLANS = {
    "sudden": [am.Segment(0, 1000, None, "a"), am.Segment(1000, am._END, "sudden", "a", "b", 1000)],
    "gradual": [
        am.Segment(0, 500, None, "a"),
        am.Segment(500, 700, "gradual", "a", "b", 500, 200),
        am.Segment(700, am._END, None, "b"),
    ],
    "recurring": [am.Segment(0, 300, None, "a"), am.Segment(300, am._END, "recurring", "a", "b", 900, 150)],
}


def hash60_sql(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


def uniform_sql(*parts: str) -> str:
    return f"({hash60_sql(*parts)})::DOUBLE / {float(1 << 60)!r}"


# ---- assembly --------------------------------------------------------------------------------


def d1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    drawn = am.subsample(docs, ["source"], "doc_id", 10, 7)
    return drawn.select("doc_id", "source", F.col("draw_rank").cast("long").alias("draw_rank"))


def d2(spark, sf):
    below = F.concat("source", F.lit("."), "lang")
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(below).alias("category"))
    return am.categories_in_group(docs, "category", "src1")


def d3(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])
    one = F.lit("r").alias("run_id")
    requests = table(spark, sf, "events").select(one, F.col("event_id").alias("seq"), names[F.col("event_type")].alias("category"))
    pool = table(spark, sf, "documents").select(one, F.col("lang").alias("category"), F.col("doc_id").alias("doc_key"))
    return am.cyclic_draw(requests, pool, 5).drop("run_id")


def _scheduled(plan):
    def query(spark, sf):
        seqs = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.lit(plan).alias("schedule"))
        return am.schedule_categories(seqs, am.schedule_frame(spark, {plan: _PLANS[plan]}), 3).drop("schedule")

    return query


def d7(spark, sf):
    labelled = _scheduled("gradual")(spark, sf)
    return labelled.groupBy("drift_label", "drift_type", "drift_start").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


_NAMES = ("newsgroups", "agnews", "yahoo", "arxiv")


def d8(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("user_id") % 4 + 1).cast("int"))
    seqs = table(spark, sf, "events").select(F.col("event_id").alias("seq"), name.alias("schedule"))
    return am.schedule_categories(seqs, am.schedule_frame(spark, {n: am.preset(n) for n in _NAMES}), 11)


def d9_corpus(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"), "text", F.col("lang").alias("category"))


def d9_streams(spark, sf, subset=100, assemble=am.assemble_streams):
    """Two runs as long as the corpus, with the drifts at fixed shares of it."""
    docs = table(spark, sf, "documents")
    n = docs.count()
    plan = am.plan_segments(("en", "fr", "de", "es"), (n // 4, n // 2, 3 * n // 4), gradual_window=n // 10, recurring_period=n // 25)
    runs = spark.createDataFrame([("r1", "docs", 1), ("r2", "docs", 2)], "run_id string, schedule string, seed long")
    return assemble(d9_corpus(spark, sf), am.schedule_frame(spark, {"docs": plan}), runs, n, rate_ms=am.RATE_MS, subset_size=subset)


def d9(spark, sf):
    out = d9_streams(spark, sf)
    return out.select(
        "run_id", F.col("docId").alias("doc_name"), F.col("timestamp").alias("ts_ms"), F.md5("text").alias("text_md5"),
        F.col("sourceCategory").alias("category"), F.col("sequenceNumber").alias("seq"), F.col("driftLabel").alias("drift_label"),
        F.col("driftType").alias("drift_type"), F.col("driftStartTs").alias("drift_start"),
    )


# ---- windows ---------------------------------------------------------------------------------


def events_ms(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", "event_type", "value", epoch_ms(events, "ts").alias("ms"))


def hopped(spark, sf, size=SIZE, advance=ADVANCE):
    return wn.hopping(events_ms(spark, sf), "ms", size, advance)


KEY = ["event_type"]


def w1(spark, sf):
    out = wn.window_batches(hopped(spark, sf, wn.SIZE_MS, wn.ADVANCE_MS), KEY, 1, seq="event_id")
    return out.drop("batch_id", "window_type")


def w1_long(spark, sf):
    return wn.window_batches(hopped(spark, sf), KEY, 1, seq="event_id").drop("batch_id", "window_type")


def w2(spark, sf):
    late = F.col("event_id") % 10 == 0
    arrival = (F.col("event_id") + F.when(late, 500).otherwise(0)) * 2 + F.when(late, 1).otherwise(0)
    kept = wn.drop_late(hopped(spark, sf).withColumn("arrival", arrival), KEY, "arrival", "ms")
    return kept.groupBy("event_type", "event_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min("window_start").alias("first_window"))


def w3(spark, sf):
    return wn.window_versions(hopped(spark, sf), KEY, "event_id").select(*KEY, *wn.WINDOW, "event_id", "document_count")


def w6(spark, sf):
    """The documents of each batch; one that was sent in several messages is put together again."""
    sent = wn.batch_messages(hopped(spark, sf), KEY, "event_id", ["event_id", "ms"])
    ids = F.array_join(F.transform("documents", lambda d: d.event_id.cast("string")), ",")
    parts = F.array_sort(F.collect_list(F.struct("firstIndex", ids.alias("ids"))))
    whole = sent.groupBy("event_type", "batchId", "windowStart", "documentCount").agg(parts.alias("_parts"))
    return whole.select(
        "event_type", F.col("windowStart").alias("window_start"), F.col("documentCount").cast("long").alias("document_count"),
        F.array_join(F.transform("_parts", lambda p: p.ids), ",").alias("ids"),
    )


def w7(spark, sf):
    sent = wn.window_batches(hopped(spark, sf), KEY, seq="event_id").withColumn("arrival", F.col("window_end"))
    return wn.new_documents_high_water(sent, KEY, "arrival").select("event_type", "arrival", "document_count", "first_index", "n_new")


def w7_split(spark, sf):
    """The documents that the rule lets through when most windows are sent in several messages."""
    sent = wn.batch_messages(hopped(spark, sf), KEY, "event_id", ["event_id", "ms"], chunk=7).withColumn("arrival", F.col("windowEnd"))
    new = wn.new_documents_high_water(sent, KEY, "arrival", "documentCount", batch="batchId")
    return new.select("event_type", "arrival", F.inline("documents")).select("event_type", "arrival", "event_id")


def v3_split(spark, sf):
    """The last sequence number of each window, from the messages it was sent in."""
    sent = wn.batch_messages(hopped(spark, sf), KEY, "event_id", ["event_id", "ms"], chunk=7)
    rows = sent.select(
        F.col("event_type").alias("run_id"), F.col("windowEnd").alias("window_end"), F.col("documentCount").cast("long").alias("doc_count"),
        (F.col("windowEnd") * 1000 + F.col("part")).alias("arrival"), F.col("batchId").alias("batch_id"), F.inline("documents"),
    ).withColumnRenamed("event_id", "seq")
    ends = ev.batch_ends(rows, "arrival", "batch_id")
    alerts = rows.select("run_id", "window_end", (F.col("doc_count") + F.col("window_end") % 2).alias("doc_count")).distinct()
    return ev.window_end_seq(alerts, ends, "arrival").select("run_id", "window_end", F.col("window_end_seq").alias("max_seq"))


def w8(spark, sf):
    return wn.new_documents_exact(hopped(spark, sf), ["event_type", "event_id"]).select("event_type", "event_id", "ms")


def w9(spark, sf):
    return wn.window_batches(wn.tumbling(events_ms(spark, sf), "ms", SIZE), KEY, 1, "tumbling", "event_id").drop("batch_id")


QUERIES = {
    "d1_subsample": d1,
    "d2_categories_in_group": d2,
    "d3_cyclic_draw": d3,
    "d4_sudden": _scheduled("sudden"),
    "d5_gradual": _scheduled("gradual"),
    "d6_recurring": _scheduled("recurring"),
    "d7_annotate": d7,
    "d8_schedule_presets": d8,
    "d9_assemble_stream": d9,
    "w1_sliding_batches": w1,
    "w1_sliding_batches_long": w1_long,
    "w2_drop_late": w2,
    "w3_window_versions": w3,
    "w4_min_batch": lambda s, d: wn.window_batches(hopped(s, d), KEY, 5).drop("batch_id", "window_type"),
    "w5_batch_envelope": lambda s, d: wn.window_batches(hopped(s, d), KEY, 5),
    "w6_batch_documents": w6,
    "w7_new_documents_high_water": w7,
    "w7_split_windows": w7_split,
    "v3_split_windows": v3_split,
    "w8_new_documents_exact": w8,
    "w9_tumbling": w9,
}

# ---- SQL -------------------------------------------------------------------------------------

EVENTS_SQL = "SELECT event_id, event_type, user_id, value, epoch_us(ts) // 1000 AS ms FROM events"


def hop_sql(source: str, size: int = SIZE, advance: int = ADVANCE) -> str:
    return f"""SELECT *, w * {advance} AS window_start, w * {advance} + {size} AS window_end FROM (
  SELECT *, unnest(range(greatest(0, ms - {size} + {advance}) // {advance}, ms // {advance} + 1)) AS w FROM ({source}))"""


def batches_sql(low: int, size: int = SIZE, advance: int = ADVANCE, extra: str = "") -> str:
    return f"""SELECT event_type, window_start, window_end, count(*) AS document_count{extra}
FROM ({hop_sql(EVENTS_SQL, size, advance)}) GROUP BY ALL HAVING count(*) >= {low}"""


_MAX_SEQ = ", max(event_id) AS max_seq"
_HIGH_WATER = f"""SELECT *, document_count - first_index AS n_new FROM (SELECT event_type, window_end AS arrival, document_count,
  coalesce(max(document_count) OVER (PARTITION BY event_type ORDER BY window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_index
  FROM ({batches_sql(5)})) WHERE document_count > first_index"""


def schedule_sql(source: str, segments: str, seed: str) -> str:
    """``source`` has seq and schedule; ``segments`` is a VALUES list in the order of Segment."""
    return f"""SELECT q.*, CASE WHEN kind IS NULL THEN base WHEN kind = 'sudden' THEN target
    WHEN kind = 'gradual' THEN CASE WHEN p >= span - 1 OR u < p / span THEN target ELSE base END
    ELSE CASE WHEN (p // span) % 2 = 0 THEN target ELSE base END END AS category,
  lab AS drift_label, CASE WHEN lab THEN kind END AS drift_type, CASE WHEN lab THEN declared END AS drift_start
FROM (SELECT s.*, g.kind, g.base, g.target, g.declared, g.span, seq - lo AS p, {uniform_sql(seed, 'seq')} AS u,
    g.kind IS NOT NULL AND NOT (g.kind = 'gradual' AND seq - lo >= g.span - 1) AS lab
  FROM ({source}) s JOIN (VALUES {segments}) g(plan, lo, hi, kind, base, target, declared, span)
    ON s.schedule = g.plan AND seq >= lo AND seq < hi) q"""


def values_sql(plans: dict) -> str:
    lit = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT")
    return ", ".join(
        "(" + ", ".join(lit(v) for v in (n, s.start_seq, s.end_seq, s.kind, s.base, s.target, s.declared_start, s.span)) + ")"
        for n, plan in plans.items()
        for s in plan
    )


_KEEP = "seq, category, drift_label, drift_type, drift_start"


def _plan_sql(plan: str) -> str:
    source = f"SELECT event_id AS seq, '{plan}' AS schedule FROM events"
    return f"SELECT {_KEEP} FROM ({schedule_sql(source, values_sql({plan: _PLANS[plan]}), '3')})"


def draw_sql(requests: str, pool: str, seed: str) -> str:
    """``requests``: run_id, category, seq, ...; ``pool``: run_id, category, doc_key (, seed)."""
    return f"""SELECT r.*, d.doc_key FROM (
  SELECT r0.*, j // size AS draw_pass, j % size AS draw_pos FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY seq) - 1 AS j FROM ({requests})) r0
  JOIN (SELECT run_id, category, count(*) AS size FROM ({pool}) GROUP BY ALL) USING (run_id, category)) r
JOIN (SELECT run_id, category, 0 AS draw_pass, doc_key, row_number() OVER (PARTITION BY run_id, category ORDER BY doc_key) - 1 AS draw_pos FROM ({pool})
  UNION ALL
  SELECT run_id, category, draw_pass, doc_key, row_number() OVER (PARTITION BY run_id, category, draw_pass
    ORDER BY {hash60_sql(seed, 'category', 'draw_pass', 'doc_key')}, doc_key) - 1 AS draw_pos
  FROM (SELECT p.*, unnest(range(1, passes + 1)) AS draw_pass FROM ({pool}) p JOIN (
    SELECT q.run_id, q.category, (count(*) - 1) // any_value(size) AS passes FROM ({requests}) q
    JOIN (SELECT run_id, category, count(*) AS size FROM ({pool}) GROUP BY ALL) USING (run_id, category) GROUP BY ALL) USING (run_id, category))) d
  USING (run_id, category, draw_pass, draw_pos)"""


_D3 = draw_sql(
    f"SELECT 'r' AS run_id, event_id AS seq, {_LANG_SQL} AS category FROM events",
    "SELECT 'r' AS run_id, lang AS category, doc_id AS doc_key FROM documents",
    "5",
)


def d9_sql(subset: int = 100) -> str:
    """CTE ``streams`` with the rows of :func:`d9_streams`."""
    n = "(SELECT count(*) FROM documents)"
    segments = f"""('docs', 0, n // 4, NULL, 'en', NULL, NULL, NULL), ('docs', n // 4, n // 2, 'sudden', 'en', 'fr', n // 4, NULL),
  ('docs', n // 2, n // 2 + n // 10, 'gradual', 'fr', 'de', n // 2, n // 10), ('docs', n // 2 + n // 10, 3 * n // 4, NULL, 'de', NULL, NULL, NULL),
  ('docs', 3 * n // 4, 9223372036854775807, 'recurring', 'de', 'es', 3 * n // 4, n // 25)""".replace("n //", f"{n} //")
    runs = "(VALUES ('r1', 'docs', 1), ('r2', 'docs', 2)) runs(run_id, schedule, seed)"
    requests = schedule_sql(f"SELECT run_id, schedule, seed, seq FROM {runs}, range({n}) t(seq)", segments, "seed")
    ranked = f"""SELECT run_id, category, seed, doc_id, row_number() OVER (PARTITION BY run_id, category
      ORDER BY {hash60_sql('seed', 'doc_id')}, doc_id) AS doc_key FROM (SELECT doc_id, lang AS category FROM documents), {runs}"""
    return f"""requests AS MATERIALIZED ({requests}), pool AS MATERIALIZED (SELECT * FROM ({ranked}) WHERE doc_key <= {subset}),
drawn AS MATERIALIZED ({draw_sql('SELECT * FROM requests', 'SELECT run_id, category, seed, doc_key FROM pool', 'seed')}),
streams AS MATERIALIZED (SELECT run_id, run_id || '-' || seq AS doc_name, seq * 100 AS ts_ms, text, category, seq, drift_label, drift_type, drift_start
  FROM drawn JOIN (SELECT run_id, category, doc_key, doc_id FROM pool) USING (run_id, category, doc_key) JOIN documents USING (doc_id))"""


ORACLE = {
    "d1_subsample": f"SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {hash60_sql('7', 'doc_id')}, doc_id) AS draw_rank FROM documents) WHERE draw_rank <= 10",
    "d2_categories_in_group": "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || '.' || lang END AS category FROM documents) WHERE category = 'src1' OR starts_with(category, 'src1.')",
    "d3_cyclic_draw": f"SELECT seq, category, draw_pass, draw_pos, doc_key FROM ({_D3})",
    "d4_sudden": _plan_sql("sudden"),
    "d5_gradual": _plan_sql("gradual"),
    "d6_recurring": _plan_sql("recurring"),
    "d7_annotate": f"SELECT drift_label, drift_type, drift_start, count(*) AS n, max(seq) AS last_seq FROM ({_plan_sql('gradual')}) GROUP BY ALL",
    "d8_schedule_presets": "SELECT schedule, "
    + _KEEP
    + " FROM ("
    + schedule_sql("SELECT event_id AS seq, ['newsgroups', 'agnews', 'yahoo', 'arxiv'][user_id % 4 + 1] AS schedule FROM events", values_sql({n: am.preset(n) for n in _NAMES}), "11")
    + ")",
    "d9_assemble_stream": f"WITH {d9_sql()} SELECT * EXCLUDE (text), md5(text) AS text_md5 FROM streams",
    "w1_sliding_batches": batches_sql(1, wn.SIZE_MS, wn.ADVANCE_MS, _MAX_SEQ),
    "w1_sliding_batches_long": batches_sql(1, extra=_MAX_SEQ),
    "w2_drop_late": f"""WITH e AS (SELECT *, (event_id + CASE WHEN event_id % 10 = 0 THEN 500 ELSE 0 END) * 2 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS arrival FROM ({EVENTS_SQL})),
c AS (SELECT *, max(ms) OVER (PARTITION BY event_type ORDER BY arrival) AS clock FROM e)
SELECT event_type, event_id, count(*) AS n_windows, min(window_start) AS first_window FROM ({hop_sql('SELECT * FROM c')}) WHERE window_end > clock GROUP BY ALL""",
    "w3_window_versions": f"""SELECT * FROM (SELECT event_type, window_start, window_end, event_id,
  row_number() OVER (PARTITION BY event_type, window_start ORDER BY event_id) AS document_count FROM ({hop_sql(EVENTS_SQL)})) WHERE document_count >= 5""",
    "w4_min_batch": batches_sql(5),
    "w5_batch_envelope": f"SELECT *, md5(concat_ws('|', event_type, window_start, document_count)) AS batch_id, 'sliding' AS window_type FROM ({batches_sql(5)})",
    "w6_batch_documents": f"""SELECT event_type, window_start, count(*) AS document_count, string_agg(event_id, ',' ORDER BY event_id) AS ids
FROM ({hop_sql(EVENTS_SQL)}) GROUP BY ALL HAVING count(*) >= 5""",
    "w7_new_documents_high_water": _HIGH_WATER,
    "w7_split_windows": f"""WITH hw AS ({_HIGH_WATER})
SELECT event_type, arrival, event_id FROM (SELECT event_type, window_end AS arrival, event_id,
  row_number() OVER (PARTITION BY event_type, window_start, window_end ORDER BY event_id) - 1 AS i FROM ({hop_sql(EVENTS_SQL)}))
JOIN hw USING (event_type, arrival) WHERE i >= first_index""",
    "v3_split_windows": f"SELECT event_type AS run_id, window_end, max_seq FROM ({batches_sql(5, extra=_MAX_SEQ)})",
    "w8_new_documents_exact": f"SELECT DISTINCT event_type, event_id, ms FROM ({hop_sql(EVENTS_SQL)})",
    "w9_tumbling": f"SELECT *, 'tumbling' AS window_type FROM ({batches_sql(1, SIZE, SIZE, _MAX_SEQ)})",
}
