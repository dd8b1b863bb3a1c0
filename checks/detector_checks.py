"""Vectors, triggers and detectors on ``embeddings``; text embedding on ``documents``.

Two streams (even and odd ``vec_id``) in the order ``(label, vec_id)``, reference 100, batches of 50.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from checks import table
from checks.corpus_checks import sql_clean
from checks.stream_checks import EVENTS_SQL, SIZE, events_ms, hash60_sql
from driftloom.functions.hashing import PRIME, hash60, mix31_sql
from driftloom.functions.student import critical, two_sided_p
from driftloom.functions.text import clean_text
from driftloom.operators import detect as dt
from driftloom.operators import embed as em
from driftloom.operators import iforest, mmd, padd
from driftloom.operators import windows as wn
from driftloom.operators.ordered import dense_position
from driftloom.storage import cut

N, REF, DIM = 50, 100, 64
P = padd.PaddParams()


def positioned(spark, sf):
    order = F.shiftleft(F.col("label").cast("long"), 32) + F.col("vec_id")
    vectors = table(spark, sf, "embeddings").withColumn("st", F.concat(F.lit("s"), F.col("vec_id") % 2))
    return dt.positions_by(vectors, "st", order, "embedding", "vec_id")


def scores(names, **params):
    def query(spark, sf):
        out = dt.detect(positioned(spark, sf), dt.load_detectors(names, **params), N, REF)
        return out.select(
            "stream_id", "batch_no", "detector", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"),
            "is_alert", F.col("doc_count").cast("long").alias("doc_count"), "last_seq",
        )

    return query


def _embedded(spark, sf, name, key, text):
    docs = table(spark, sf, name).select(*key, clean_text(text).alias("cleaned"))
    vectors = em.embed(docs, "cleaned", em.hashing_encoder(DIM))
    cells = vectors.select(*key, F.posexplode("vec").alias("slot", "v")).where("v <> 0")
    return cells.select(*key, F.col("slot").cast("long").alias("slot"), F.col("v").cast("double").alias("v"))


def vocab(spark, sf):
    return em.vocabulary(table(spark, sf, "documents").select(clean_text("text").alias("cleaned")), "cleaned")


def statistics(*names):
    def query(spark, sf):
        out = dt.mmd_statistics(positioned(spark, sf), N, REF)
        cast = lambda c: F.round(c, 6).alias(c) if c != "n_positive" else F.col(c)
        return out.select("stream_id", "batch_no", *[cast(c) for c in names])

    return query


def m4(spark, sf):
    """The 20 vectors of each batch that sampling keeps, through the scorer's own sampling."""
    import numpy as np

    docs, refs, _ = dt.chunked(positioned(spark, sf), N, REF)

    def kept(stream, ref, batches, last):
        for b, rows in batches:
            for i in mmd.sample(np.arange(len(rows)), 20, 42, "batch", stream, b):
                yield stream, b, int(i)

    return dt.per_batch(docs, refs, N, kept, "stream_id string, batch_no long, in_batch long")


def m6(spark, sf):
    noise = em.noise_documents(vocab(spark, sf))
    vectors = em.embed(noise, "text", em.hashing_encoder(DIM))
    scaled = F.expr("transform(vec, x -> cast(x / 40 as float))").alias("vec")
    pos = positioned(spark, sf)
    ref = dt.shared_reference(pos.select("stream_id").distinct(), vectors.select(F.col("noise_id").alias("pos"), scaled))
    found = dt.detect(pos, dt.load_detectors(["mmd"], mmd={"noise_warmup": True}), N, REF, ref)
    return found.select("stream_id", "batch_no", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "is_alert")


def a1(spark, sf):
    acts = padd.activations(table(spark, sf, "embeddings"), "embedding")
    cells = acts.select("vec_id", F.posexplode("act").alias("neuron", "a"))
    return cells.select("vec_id", F.col("neuron").cast("long").alias("neuron"), F.round("a", 6).alias("a"))


def a2(spark, sf):
    out = dt.detect(positioned(spark, sf), dt.load_detectors(["padd_frozen"]), N, REF)
    return out.select("stream_id", "batch_no", F.round(F.col("score") * P.tests).cast("long").alias("rejections"))


def a6(spark, sf):
    rows = em.trigger_batches(positioned(spark, sf), N, REF)
    out = padd.inactive_neurons(padd.activations(rows, "vec"), ["stream_id", "batch_no"])
    return out.select("stream_id", "batch_no", F.round("inactive_share", 6).alias("inactive_share"), "is_warning")


def a9(spark, sf):
    trials = dt.null_trials(table(spark, sf, "embeddings"), "embedding", "vec_id", 75, 25)
    found = dt.detect(trials, dt.load_detectors(["padd_welch", "padd_softmax"]), 25, 75)
    return dt.false_alarm_rate(found)


def e4_sparse(spark, sf):
    """Positions by a hash: an order with large gaps."""
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("s"), F.col("vec_id") % 2).alias("stream_id"), F.col("vec_id").alias("seq"), hash60("sparse", F.col("vec_id")).alias("_h"))
    return dense_position(rows, ["stream_id"], "_h", tiebreak=["seq"]).select("stream_id", "pos", "seq")


def i1(spark, sf):
    nodes = iforest.fit_forest(em.reference_window(positioned(spark, sf), REF))
    return nodes.withColumns({"cut": F.round("cut", 6), "path": F.round("path", 6)})


def i2(spark, sf):
    return dt.forest_scores(positioned(spark, sf), REF).withColumn("score", F.round("score", 6))


def i3(spark, sf):
    out = dt.forest_threshold(dt.forest_scores(positioned(spark, sf), REF))
    return out.withColumn("threshold", F.round("threshold", 6))


def i5(spark, sf):
    half = F.col("vec_id") % 9 < F.col("label")
    sizes = table(spark, sf, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("size"), F.nullif(F.count_if(half), F.lit(0)).alias("fitted")
    )
    return sizes.withColumn("refit", iforest.needs_refit(F.col("size"), F.col("fitted")))


def i5_job(spark, sf):
    """Models fitted on 100 and 60 vectors meet references of 105 and 100: the second is fitted again."""
    at = positioned(spark, sf)
    sized = lambda first, second: at.where(F.col("pos") < F.when(F.col("stream_id") == "s0", first).otherwise(second))
    stored = cut(iforest.fit_models(sized(REF, 60)))
    return iforest.refit_models(stored, sized(REF + 5, REF)).select("stream_id", "fitted_size", F.round("threshold", 6).alias("threshold"))


def r2(spark, sf):
    rows = em.trigger_batches(positioned(spark, sf), N, REF)
    ends = rows.groupBy("stream_id", "batch_no").agg(F.max_by("seq", "pos").alias("last_seq"))
    alerts = ends.withColumn("is_alert", F.col("batch_no") % 2 == 0)
    windowed = wn.tumbling(events_ms(spark, sf), "ms", SIZE)
    counts = wn.window_batches(windowed, [], 1, "tumbling")
    docs = windowed.join(counts, wn.WINDOW).select(
        F.concat(F.lit("s"), F.col("event_id") % 2).alias("stream_id"), F.col("event_id").alias("seq"), "window_type",
        *wn.WINDOW, F.col("document_count").alias("doc_count"),
    )
    out = dt.enrich_alerts(alerts, docs, F.col("window_end") + 5)
    return out.drop("is_alert")


QUERIES = {
    "e1_embed": lambda s, d: _embedded(s, d, "conversations", ["conv_id", "turn"], "text"),
    "e2_hash_embed": lambda s, d: _embedded(s, d, "documents", ["doc_id"], "text"),
    "e3_vocabulary": vocab,
    "e3_noise_documents": lambda s, d: em.noise_documents(vocab(s, d)),
    "e4_dense_position": lambda s, d: positioned(s, d).select("stream_id", "pos", "seq"),
    "e4_sparse_position": e4_sparse,
    "e5_reference_window": lambda s, d: em.reference_window(positioned(s, d), REF).select("stream_id", "pos", "seq"),
    "e6_bounded_store": lambda s, d: em.bounded_store(positioned(s, d), ["stream_id"], "pos").select("stream_id", "seq", F.col("age").cast("long").alias("age")),
    "e7_trigger_batches": lambda s, d: em.trigger_batches(positioned(s, d), N, REF).select("stream_id", "batch_no", "pos", "seq"),
    "m1_pairwise_sq_distance": statistics("n_positive", "sum_sq_distance"),
    "m2_median_bandwidth": statistics("median_sq_distance"),
    "m3_mmd_score": statistics("mmd2", "score"),
    "m4_sample": m4,
    "m5_calibrated_threshold": lambda s, d: scores(["mmd"])(s, d).groupBy("stream_id").agg(F.max("threshold").alias("threshold")),
    "m6_noise_warmup": m6,
    "m7_mmd_verdict": scores(["mmd"]),
    "a1_activations": a1,
    "a2_bootstrap_rejections": a2,
    "a3_vote": scores(["padd_frozen"]),
    "a4_padd_history": scores(["padd"]),
    "a5_frozen_history": scores(["padd_frozen"], padd_frozen={"seed": 7, "theta": 0.2}),
    "a6_inactive_neurons": a6,
    "a7_padd_welch": scores(["padd_welch"]),
    "a8_padd_softmax": scores(["padd_softmax"]),
    "a9_null_trials": a9,
    "i1_fit_forest": i1,
    "i2_score_samples": i2,
    "i3_forest_threshold": i3,
    "i5_refit_job": i5_job,
    "i4_forest_verdict": scores(["isolation_forest"]),
    "i5_needs_refit": i5,
    "r1_all_detectors": scores(["mmd", "isolation_forest", "padd_frozen"]),
    "r2_enrich_alerts": r2,
}

# ---- SQL -------------------------------------------------------------------------------------


def _embed_sql(name: str, key: str, text: str) -> str:
    return f"""SELECT {key}, (h >> 1) % {DIM} AS slot, sum(CASE WHEN h & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM (
  SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (
    SELECT {key}, unnest(string_split({sql_clean(text)}, ' ')) AS t FROM {name}) WHERE t <> '')
GROUP BY ALL HAVING v <> 0"""


VOCAB_SQL = f"""SELECT word, row_number() OVER (ORDER BY {hash60_sql("'vocabulary'", 'word')}, word) - 1 AS word_rank FROM (
  SELECT DISTINCT unnest(string_split({sql_clean('text')}, ' ')) AS word FROM documents) WHERE word <> ''"""
NOISE_SQL = f"""SELECT noise_id, string_agg(word, ' ' ORDER BY slot) AS text FROM (
  SELECT id // 20 AS noise_id, id % 20 AS slot, {hash60_sql('42', 'id // 20', 'id % 20')} % (SELECT count(*) FROM vocab) AS word_rank
  FROM range(2000) t(id)) JOIN vocab USING (word_rank) GROUP BY noise_id"""

POS = """pos AS MATERIALIZED (SELECT 's' || vec_id % 2 AS stream_id, vec_id AS seq, embedding::DOUBLE[] AS v,
  row_number() OVER (PARTITION BY vec_id % 2 ORDER BY label, vec_id) - 1 AS pos FROM embeddings)"""
TRIG = f"""{POS}, trig AS MATERIALIZED (SELECT *, (pos - {REF}) // {N} AS batch_no, (pos - {REF}) % {N} AS i FROM pos
  WHERE pos >= {REF} QUALIFY count(*) OVER (PARTITION BY stream_id, (pos - {REF}) // {N}) = {N})"""


def _pairs(points: str) -> str:
    """``points``: stream_id, batch_no, side ('x' or 'y'), i, v."""
    return f"""pairs AS MATERIALIZED (SELECT a.stream_id, a.batch_no, a.side || b.side AS sides, list_distance(a.v, b.v) ** 2 AS d
  FROM {points} a JOIN {points} b ON a.stream_id = b.stream_id AND a.batch_no = b.batch_no AND (a.side < b.side OR (a.side = b.side AND a.i < b.i)))"""


_BATCH_POINTS = f"""points AS MATERIALIZED (SELECT stream_id, batch_no, 'x' AS side, i, v FROM trig
  UNION ALL SELECT p.stream_id, b.batch_no, 'y', p.pos, p.v FROM pos p JOIN (SELECT DISTINCT stream_id, batch_no FROM trig) b USING (stream_id) WHERE p.pos < {REF})"""


def _mmd_from_pairs(n: int, m: int) -> str:
    kernel = " + ".join(f"exp(-d / (2 * {f} * base))" for f in mmd.BANDWIDTH_FACTORS)
    return f"""SELECT stream_id, batch_no, base, 2 * sum(k) FILTER (sides = 'xx') / ({n} * {n - 1}.0) + 2 * sum(k) FILTER (sides = 'yy') / ({m} * {m - 1}.0)
    - 2 * sum(k) FILTER (sides = 'xy') / ({n} * {m}.0) AS mmd2
  FROM (SELECT p.*, base, {kernel} AS k FROM pairs p JOIN (SELECT stream_id, batch_no, median(d) FILTER (d > 0) AS base FROM pairs GROUP BY ALL) USING (stream_id, batch_no)) GROUP BY ALL"""


_MMD = f"WITH {TRIG}, {_BATCH_POINTS}, {_pairs('points')}, s AS MATERIALIZED ({_mmd_from_pairs(N, REF)})"
_KEY31 = lambda *parts: f"({hash60_sql(*parts)}) % {PRIME}"
_HALVES = f"""hv AS MATERIALIZED (SELECT stream_id, 0 AS batch_no, v, row_number() OVER (PARTITION BY stream_id ORDER BY {mix31_sql('k', 'pos')}, pos) - 1 AS i
    FROM (SELECT *, {_KEY31("'42'", "'halves'", 'stream_id')} AS k FROM pos WHERE pos < {REF})),
  hpoints AS (SELECT stream_id, batch_no, CASE WHEN i < {REF // 2} THEN 'x' ELSE 'y' END AS side, i, v FROM hv)"""
_LIMIT = f"WITH {POS}, {_HALVES}, {_pairs('hpoints')}, h AS ({_mmd_from_pairs(REF // 2, REF // 2)}) SELECT stream_id, greatest(5 * sqrt(greatest(mmd2, 0)), 0.05) AS threshold FROM h"
_LAST = f"(SELECT stream_id, batch_no, max_by(seq, pos) AS last_seq FROM trig GROUP BY ALL)"
_MMD_ROWS = f"""SELECT stream_id, batch_no, 'mmd' AS detector, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS is_alert,
  {N}::BIGINT AS doc_count, last_seq FROM (SELECT *, sqrt(greatest(mmd2, 0)) AS score FROM s) JOIN ({_LIMIT}) USING (stream_id) JOIN {_LAST} USING (stream_id, batch_no)"""


def _matrix(rows) -> str:
    return ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for i, row in enumerate(rows) for j, w in enumerate(row))


def acts_sql(source: str, p: padd.PaddParams = P) -> str:
    """CTE ``acts(key columns of source, neuron, a)``; ``source`` is a relation with id columns k and v."""
    first, second = padd.weights(p, DIM)
    if p.network == "one_layer":
        return f"""w1(i, j, w) AS (VALUES {_matrix(first)}), w2(i, j, w) AS (VALUES {_matrix([second])}),
xin AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {source}),
acts AS MATERIALIZED (SELECT k, j AS neuron, greatest(0, sum(x * w) + (SELECT w FROM w2 b WHERE b.j = w1.j)) AS a FROM xin JOIN w1 USING (i) GROUP BY k, j)"""
    if p.network == "softmax":
        return f"""w1(i, j, w) AS (VALUES {_matrix(first)}), w2(i, j, w) AS (VALUES {_matrix(second)}),
xin AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {source}),
neck AS (SELECT k, j, greatest(0, sum(x * w) + (SELECT w FROM w1 b WHERE b.i = {DIM} AND b.j = w1.j)) AS x FROM xin JOIN w1 USING (i) GROUP BY k, j),
raised AS (SELECT k, w2.j AS neuron, exp(greatest(0, sum(x * w))) AS e FROM neck JOIN w2 ON neck.j = w2.i GROUP BY k, w2.j),
acts AS MATERIALIZED (SELECT k, neuron, e / sum(e) OVER (PARTITION BY k) AS a FROM raised)"""
    return f"""w1(i, j, w) AS (VALUES {_matrix(first)}), w2(i, j, w) AS (VALUES {_matrix(second)}),
xin AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {source}),
neck AS (SELECT k, j, greatest(0, sum(x * w) + (SELECT w FROM w1 b WHERE b.i = {DIM} AND b.j = w1.j)) AS x FROM xin JOIN w1 USING (i) GROUP BY k, j),
acts AS MATERIALIZED (SELECT k, w2.j AS neuron, greatest(0, sum(x * w) + (SELECT w FROM w2 b WHERE b.i = {p.neck} AND b.j = w2.j)) AS a
  FROM neck JOIN w2 ON neck.j = w2.i GROUP BY k, w2.j)"""


def _critical_values(alpha: float, df: np.ndarray) -> np.ndarray:
    """Two-sided critical values for many degrees of freedom at once, by halving an interval."""
    low, high = np.zeros(len(df)), np.full(len(df), 50.0)
    for _ in range(60):
        middle = (low + high) / 2
        beyond = two_sided_p(middle, df) > alpha
        low, high = np.where(beyond, middle, low), np.where(beyond, high, middle)
    return high


def padd_sql(p: padd.PaddParams, trig: str = TRIG, ref: int = REF, n: int = N) -> str:
    """CTE ``votes(stream_id, batch_no, rejections)`` against the frozen reference."""
    s, r, h = p.sample_size, p.replications, p.hidden
    per_side = h * r * s
    t_crit = repr(critical(p.alpha, 2 * s - 2))
    if p.welch:
        # the critical value is smooth in the degrees of freedom: linear between points of a fine grid
        step = (s - 1) / 400
        grid = "[" + ", ".join(repr(float(c)) for c in _critical_values(p.alpha, s - 1 + step * np.arange(402))) + "]"
        at = f"(((v0 + v1) ** 2 / ((v0 ** 2 + v1 ** 2) / ({s} - 1)) - ({s} - 1)) / {step!r})"
        t_crit = f"({grid}[floor({at})::BIGINT + 1] + ({at} - floor({at})) * ({grid}[floor({at})::BIGINT + 2] - {grid}[floor({at})::BIGINT + 1]))"
    return f"""{trig}, rowsin AS MATERIALIZED (SELECT stream_id || '|' || pos AS k, v FROM pos), {acts_sql('rowsin', p)},
keyed AS (SELECT stream_id, batch_no, {_KEY31(f"'{p.seed}'", 'stream_id', 'batch_no')} AS key FROM (SELECT DISTINCT stream_id, batch_no FROM trig)),
dr AS (SELECT stream_id, batch_no, c // {per_side} AS side, (c // {r * s}) % {h} AS neuron, (c // {s}) % {r} AS rep,
    {mix31_sql('key', 'c')} AS x FROM keyed, range({2 * per_side}) t(c)),
picked AS (SELECT stream_id, batch_no, side, neuron, rep, CASE WHEN side = 0 THEN x % {ref} ELSE {ref} + batch_no * {n} + x % {n} END AS at FROM dr),
means AS (SELECT p.stream_id, batch_no, p.neuron, rep, avg(a) FILTER (side = 0) AS m0, avg(a) FILTER (side = 1) AS m1,
    var_samp(a) FILTER (side = 0) AS v0, var_samp(a) FILTER (side = 1) AS v1
  FROM picked p JOIN acts ON acts.k = p.stream_id || '|' || p.at AND acts.neuron = p.neuron GROUP BY ALL),
votes AS MATERIALIZED (SELECT stream_id, batch_no, count(*) FILTER (CASE WHEN v0 + v1 > 0 THEN abs(m0 - m1) / sqrt((v0 + v1) / {s}) > {t_crit} ELSE m0 <> m1 END) AS rejections
  FROM means GROUP BY ALL)"""


def _vote_rows(p: padd.PaddParams, name: str = "padd_frozen") -> str:
    return f"""WITH {padd_sql(p)} SELECT stream_id, batch_no, '{name}' AS detector, round(rejections / {p.tests}.0, 6) AS score,
  {p.theta}::DOUBLE AS threshold, rejections > {p.most_rejections} AS is_alert, {N}::BIGINT AS doc_count, last_seq FROM votes JOIN {_LAST} USING (stream_id, batch_no)"""


_TRIALS = f"""pos AS MATERIALIZED (SELECT (p // 100)::VARCHAR AS stream_id, vec_id AS seq, embedding::DOUBLE[] AS v, p % 100 AS pos
  FROM (SELECT *, row_number() OVER (ORDER BY {hash60_sql('12345', 'vec_id')}, vec_id) - 1 AS p FROM embeddings)),
trig AS MATERIALIZED (SELECT *, 0 AS batch_no, pos - 75 AS i FROM pos WHERE pos >= 75 QUALIFY count(*) OVER (PARTITION BY stream_id) = 25)"""


def _alarms(p: padd.PaddParams, name: str) -> str:
    return f"""SELECT '{name}' AS detector, count(*) AS n_trials, count(*) FILTER (rejections > {p.most_rejections}) AS n_alarms,
  avg((rejections > {p.most_rejections})::INT) AS alarm_rate FROM (WITH {padd_sql(p, _TRIALS, 75, 25)} SELECT * FROM votes)"""


_STAT = _MMD + " SELECT stream_id, batch_no, {cols} FROM "
_M6 = f"""WITH {POS}, vocab AS MATERIALIZED ({VOCAB_SQL}), noise AS MATERIALIZED ({NOISE_SQL}),
  cells AS (SELECT noise_id, (h >> 1) % {DIM} AS slot, sum(CASE WHEN h & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS s FROM (
    SELECT noise_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM (SELECT noise_id, unnest(string_split(text, ' ')) AS t FROM noise)) GROUP BY ALL),
  nv AS (SELECT noise_id, list((coalesce(s, 0) / 40)::FLOAT::DOUBLE ORDER BY slot) AS v FROM (SELECT noise_id, slot FROM (SELECT noise_id FROM noise), range({DIM}) g(slot)) LEFT JOIN cells USING (noise_id, slot) GROUP BY noise_id),
  trig AS MATERIALIZED (SELECT *, pos // {N} AS batch_no, pos % {N} AS i FROM pos QUALIFY count(*) OVER (PARTITION BY stream_id, pos // {N}) = {N}),
  points AS MATERIALIZED (SELECT stream_id, batch_no, 'x' AS side, i, v FROM trig UNION ALL
    SELECT stream_id, batch_no, 'y', noise_id, v FROM nv, (SELECT DISTINCT stream_id, batch_no FROM trig)),
  {_pairs('points')}, s AS MATERIALIZED (SELECT *, sqrt(greatest(mmd2, 0)) AS score FROM ({_mmd_from_pairs(N, REF)})),
  lim AS (SELECT stream_id, score * 1.2 AS threshold FROM s WHERE batch_no = 0)
SELECT stream_id, batch_no, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS is_alert FROM s JOIN lim USING (stream_id) WHERE batch_no > 0"""

TREES = iforest.N_TREES


def forest_sql() -> str:
    """Forests on the first vectors of each stream, a depth at a time: ``ch`` has the splits, ``leaf`` the leaves."""
    limit = (REF - 1).bit_length()
    mean_path = lambda n: f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1.0) + {iforest.EULER_GAMMA}) - 2 * ({n} - 1.0) / {n} END"
    draw = lambda more: mix31_sql("key", f"1000000 + 2 * node + {more}")
    parts = [POS, f"""cells AS MATERIALIZED (SELECT stream_id, pos, unnest(range({DIM})) AS f, unnest(v) AS x FROM pos),
keyed AS MATERIALIZED (SELECT stream_id, tree, {_KEY31("'42'", "'tree'", 'stream_id', 'tree')} AS key FROM (SELECT DISTINCT stream_id FROM pos), range({TREES}) t(tree)),
a0 AS MATERIALIZED (SELECT stream_id, tree, key, pos, 0::BIGINT AS node FROM pos JOIN keyed USING (stream_id) WHERE pos < {REF})"""]  # fmt: skip
    for d in range(limit + 1):
        if d < limit:
            parts.append(f"""s{d} AS (SELECT stream_id, tree, key, node, f, min(x) AS lo, max(x) AS hi FROM a{d} JOIN cells USING (stream_id, pos) GROUP BY ALL HAVING min(x) < max(x)),
ch{d} AS MATERIALIZED (SELECT stream_id, tree, node, f AS feature, lo + {draw(1)}::DOUBLE / 2147483647.0::DOUBLE * (hi - lo) AS cut FROM (
  SELECT *, row_number() OVER (PARTITION BY stream_id, tree, node ORDER BY f) - 1 AS r, count(*) OVER (PARTITION BY stream_id, tree, node) AS n FROM s{d}) WHERE r = {draw(0)} % n),
a{d + 1} AS MATERIALIZED (SELECT stream_id, tree, key, pos, 2 * node + 1 + (x > cut)::BIGINT AS node FROM a{d} JOIN ch{d} USING (stream_id, tree, node) JOIN cells c USING (stream_id, pos) WHERE c.f = feature)""")
        none = f"ANTI JOIN ch{d} USING (stream_id, tree, node)" if d < limit else ""
        parts.append(f"leaf{d} AS (SELECT stream_id, tree, node, {d} + {mean_path('count(*)')} AS path FROM a{d} {none} GROUP BY ALL)")
    parts.append("ch AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM ch{d}" for d in range(limit)) + ")")
    parts.append("leaf AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM leaf{d}" for d in range(limit + 1)) + ")")
    return ",\n".join(parts)


def forest_scores_sql() -> str:
    """``sc``: the score of each vector, which walks down all trees a depth at a time."""
    limit = (REF - 1).bit_length()
    parts = [forest_sql(), "w0 AS (SELECT stream_id, tree, pos, 0::BIGINT AS node FROM pos JOIN keyed USING (stream_id))"]
    for d in range(limit):
        parts.append(f"w{d + 1} AS MATERIALIZED (SELECT stream_id, tree, pos, 2 * node + 1 + (x > cut)::BIGINT AS node FROM w{d} JOIN ch USING (stream_id, tree, node) JOIN cells c USING (stream_id, pos) WHERE c.f = feature)")
    ends = " UNION ALL ".join(f"SELECT stream_id, pos, path FROM w{d} JOIN leaf USING (stream_id, tree, node)" for d in range(limit + 1))
    whole = 2 * (math.log(REF - 1.0) + iforest.EULER_GAMMA) - 2 * (REF - 1.0) / REF
    parts.append(f"sc AS MATERIALIZED (SELECT stream_id, pos, -pow(2.0, -sum(path) / ({TREES} * {whole!r})) AS score FROM ({ends}) GROUP BY ALL)")
    parts.append(f"lim AS (SELECT stream_id, avg(score) - 3 * stddev_pop(score) AS threshold FROM sc WHERE pos < {REF} GROUP BY ALL)")
    return ",\n".join(parts)


_FOREST_ROWS = f"""SELECT t.stream_id, t.batch_no, 'isolation_forest' AS detector, round(avg(score), 6) AS score, round(any_value(threshold), 6) AS threshold,
  avg(score) < any_value(threshold) AS is_alert, {N}::BIGINT AS doc_count, max_by(t.seq, t.pos) AS last_seq
FROM (SELECT *, (pos - {REF}) // {N} AS batch_no FROM pos WHERE pos >= {REF} QUALIFY count(*) OVER (PARTITION BY stream_id, (pos - {REF}) // {N}) = {N}) t
JOIN sc USING (stream_id, pos) JOIN lim USING (stream_id) GROUP BY t.stream_id, t.batch_no"""
FOREST_ORACLE = {
    "i1_fit_forest": f"""WITH {forest_sql()} SELECT stream_id, tree, node, feature, round(cut, 6) AS cut, 2 * node + 1 AS left_child, 0.0 AS path FROM ch
UNION ALL SELECT stream_id, tree, node, -1, 0.0, -1, round(path, 6) FROM leaf""",
    "i2_score_samples": f"WITH {forest_scores_sql()} SELECT stream_id, pos, seq, pos < {REF} AS is_reference, round(score, 6) AS score FROM sc JOIN pos USING (stream_id, pos)",
    "i3_forest_threshold": f"WITH {forest_scores_sql()} SELECT stream_id, round(threshold, 6) AS threshold FROM lim",
    "i4_forest_verdict": f"WITH {forest_scores_sql()} {_FOREST_ROWS}",
    "i5_refit_job": f"WITH {forest_scores_sql()} SELECT stream_id, {REF}::BIGINT AS fitted_size, round(threshold, 6) AS threshold FROM lim",
}

ORACLE = FOREST_ORACLE | {
    "a9_null_trials": f"{_alarms(padd.WELCH, 'padd_welch')} UNION ALL {_alarms(padd.SOFTMAX, 'padd_softmax')}",
    "a7_padd_welch": _vote_rows(padd.WELCH, "padd_welch"),
    "a8_padd_softmax": _vote_rows(padd.SOFTMAX, "padd_softmax"),
    "e1_embed": _embed_sql("conversations", "conv_id, turn", "text"),
    "e2_hash_embed": _embed_sql("documents", "doc_id", "text"),
    "e3_vocabulary": VOCAB_SQL,
    "e3_noise_documents": f"WITH vocab AS MATERIALIZED ({VOCAB_SQL}) {NOISE_SQL}",
    "e4_dense_position": f"WITH {POS} SELECT stream_id, pos, seq FROM pos",
    "e5_reference_window": f"WITH {POS} SELECT stream_id, pos, seq FROM pos WHERE pos < {REF}",
    "e6_bounded_store": f"WITH {POS} SELECT * FROM (SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY pos DESC) AS age FROM pos) WHERE age <= {em.STORE_SIZE}",
    "e7_trigger_batches": f"WITH {TRIG} SELECT stream_id, batch_no, pos, seq FROM trig",
    "m1_pairwise_sq_distance": _STAT.format(cols="count(*) FILTER (d > 0) AS n_positive, round(sum(d), 6) AS sum_sq_distance") + "pairs GROUP BY ALL",
    "m2_median_bandwidth": _STAT.format(cols="round(base, 6) AS median_sq_distance") + "s",
    "m3_mmd_score": _STAT.format(cols="round(mmd2, 6) AS mmd2, round(sqrt(greatest(mmd2, 0)), 6) AS score") + "s",
    "m4_sample": f"""WITH {TRIG} SELECT stream_id, batch_no, i AS in_batch FROM (SELECT stream_id, batch_no, i,
  row_number() OVER (PARTITION BY stream_id, batch_no ORDER BY {mix31_sql('k', 'i')}, i) AS rn
  FROM (SELECT *, {_KEY31("'42'", "'batch'", 'stream_id', 'batch_no')} AS k FROM trig)) WHERE rn <= 20""",
    "m5_calibrated_threshold": f"SELECT stream_id, round(threshold, 6) AS threshold FROM ({_LIMIT})",
    "m6_noise_warmup": _M6,
    "m7_mmd_verdict": f"{_MMD} {_MMD_ROWS}",
    "a1_activations": f"WITH rowsin AS (SELECT vec_id AS k, embedding::DOUBLE[] AS v FROM embeddings), {acts_sql('rowsin')} SELECT k AS vec_id, neuron::BIGINT AS neuron, round(a, 6) AS a FROM acts",
    "a2_bootstrap_rejections": f"WITH {padd_sql(P)} SELECT * FROM votes",
    "a3_vote": _vote_rows(P),
    "a5_frozen_history": _vote_rows(replace(P, seed=7, theta=0.2)),
    "a6_inactive_neurons": f"""WITH {TRIG}, rowsin AS (SELECT stream_id || '|' || batch_no || '|' || pos AS k, v FROM trig), {acts_sql('rowsin')}
SELECT stream_id, batch_no, round(avg(CASE WHEN s < 1e-8 THEN 1.0 ELSE 0.0 END), 6) AS inactive_share, avg(CASE WHEN s < 1e-8 THEN 1.0 ELSE 0.0 END) > 0.30 AS is_warning
FROM (SELECT split_part(k, '|', 1) AS stream_id, split_part(k, '|', 2)::BIGINT AS batch_no, neuron, var_pop(a) AS s FROM acts GROUP BY ALL) GROUP BY ALL""",
    "e4_sparse_position": f"""SELECT 's' || vec_id % 2 AS stream_id, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY {hash60_sql("'sparse'", 'vec_id')}, vec_id) - 1 AS pos, vec_id AS seq FROM embeddings""",
    "i5_needs_refit": """SELECT label, size, fitted, fitted IS NULL OR abs(size - fitted) > size * 0.1 AS refit FROM (
  SELECT label, count(*) AS size, nullif(count(*) FILTER (vec_id % 9 < label), 0) AS fitted FROM embeddings GROUP BY label)""",
    "r1_all_detectors": f"SELECT * FROM ({_MMD} {_MMD_ROWS}) UNION ALL BY NAME SELECT * FROM ({FOREST_ORACLE['i4_forest_verdict']}) UNION ALL BY NAME SELECT * FROM ({_vote_rows(P)})",
    "r2_enrich_alerts": f"""WITH {TRIG}, ends AS (SELECT stream_id, batch_no, max_by(seq, pos) AS last_seq FROM trig GROUP BY ALL),
w AS (SELECT event_id, ms // {SIZE} * {SIZE} AS window_start FROM ({EVENTS_SQL})), c AS (SELECT window_start, count(*) AS doc_count FROM w GROUP BY ALL)
SELECT stream_id, batch_no, last_seq, 'tumbling' AS window_type, window_start, window_start + {SIZE} AS window_end, doc_count, window_start + {SIZE} + 5 AS detected_at
FROM ends JOIN w ON w.event_id = last_seq AND stream_id = 's' || event_id % 2 JOIN c USING (window_start) WHERE batch_no % 2 = 0""",
}
