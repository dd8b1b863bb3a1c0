"""Corpus preparation and text operators on ``documents``, ``pages``, ``events`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import table
from driftloom.functions import text as tx
from driftloom.functions.timecols import epoch_ms
from driftloom.operators import corpus as cp
from driftloom.operators import windows as wn

KEYWORDS = {
    "ends_tion": ["tion ", "tion.", "tion,"],
    "french": ["eau", "oui", "é"],
    "article": [" the ", " der ", " la "],
    "other_words": ["ing", "und", "que"],
}
PREFIXES = {"th": "b_th", "t": "b_t", "a": "b_a", "e": "b_e", "re": "b_re"}

# ---- SQL pieces ------------------------------------------------------------------------------

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS_CHARS = "||".join(f"chr({ord(c)})" for c in tx.WHITESPACE)


def sql_strip(e: str) -> str:
    return f"trim({e}, {_WS_CHARS})"


def sql_clean(e: str) -> str:
    out = f"lower({e})"
    for pattern in (r"https?://\S+|www\.\S+", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"[^a-z\s]", r"\s+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out})"


def sql_latex(e: str) -> str:
    for pattern in (r"\$[^$]*\$", r"\\[\p{L}\p{N}_]+\{[^}]*\}", r"\\[\p{L}\p{N}_]+"):
        e = f"regexp_replace({e}, '{pattern}', '', 'g')"
    return sql_strip(f"regexp_replace({e}, '[{WS}]{{2,}}', ' ', 'g')")


def sql_breaks(e: str) -> str:
    flat = f"replace(coalesce({e}, ''), '<br />', ' ')"
    return sql_strip(f"regexp_replace({flat}, '[{WS}]+', ' ', 'g')")


def sql_blank_lines(e: str) -> str:
    return sql_strip(f"regexp_replace(regexp_replace({e}, '\\n{{3,}}', chr(10)||chr(10), 'g'), ' {{2,}}', ' ', 'g')")


def sql_case(expr: str, mapping: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items()) + " END"


def sql_prefix(e: str, mapping: dict) -> str:
    first = f"lower(regexp_split_to_array({sql_strip(e)}, '[{WS}]+')[1])"
    return "CASE " + " ".join(f"WHEN starts_with({first}, '{k}') THEN '{v}'" for k, v in mapping.items()) + " END"


def sql_keywords(title: str, body: str, buckets: dict) -> str:
    text = f"lower({title}) || ' ' || lower(substr({body}, 1, 500))"
    whens = (
        "WHEN " + " OR ".join(f"contains({text}, '{k}')" for k in words) + f" THEN '{b}'" for b, words in buckets.items()
    )
    return "CASE " + " ".join(whens) + " END"


def digest(c):
    return [F.md5(c).alias("text_md5"), F.char_length(c).cast("long").alias("n_chars")]


def sql_digest(e: str) -> str:
    return f"md5({e}) AS text_md5, length({e}) AS n_chars"


RAW_SQL = """
SELECT event_id, event_type AS key, epoch_us(ts) // 1000 AS ms,
  CASE WHEN event_id % 11 = 0 THEN '{broken'
       WHEN event_id % 5 = 0 THEN '{"text":"' || event_type || '"}'
       ELSE '{"docId":"d' || event_id || '","timestamp":' || (epoch_us(ts) // 1000) || ',"text":"' || event_type || ' '
            || event_id || '","sequenceNumber":' || event_id || ',"driftLabel":'
            || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"driftStartTs":7}' END AS value
FROM events"""


def raw_records(spark, sf):
    """Events as keyed JSON records; every eleventh is broken, some lack most fields."""
    events = table(spark, sf, "events")
    slim = events.select("event_id", F.col("event_type").alias("key"), epoch_ms(events, "ts").alias("ms"))
    e = F.col("event_id")
    full = F.concat(
        F.lit('{"docId":"d'), e, F.lit('","timestamp":'), F.col("ms"), F.lit(',"text":"'), F.col("key"), F.lit(" "), e,
        F.lit('","sequenceNumber":'), e, F.lit(',"driftLabel":'),
        F.when(e % 2 == 0, "true").otherwise("false"), F.lit(',"driftStartTs":7}'),
    )
    short = F.concat(F.lit('{"text":"'), F.col("key"), F.lit('"}'))
    return slim.withColumn("value", F.when(e % 11 == 0, "{broken").when(e % 5 == 0, short).otherwise(full))


def _documents(spark, sf):
    return table(spark, sf, "documents")


def p1(spark, sf):
    return cp.map_label(table(spark, sf, "embeddings"), "label", cp.AGNEWS_LABELS).select("vec_id", "category")


def p2(spark, sf):
    docs = _documents(spark, sf)
    middle = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return docs.select("doc_id", *digest(tx.compose_text(F.col("source"), middle, F.col("text"))))


def p6(spark, sf):
    docs = _documents(spark, sf).withColumn("clean", tx.collapse_blank_lines("text"))
    return cp.min_length(docs, "clean", 300).select("doc_id", F.char_length("clean").cast("long").alias("n_chars"))


def p8(spark, sf):
    kept = cp.cap_per_bucket(_documents(spark, sf).select("doc_id", "source"), "source", "doc_id", 20)
    return kept.select("doc_id", "source", F.col("bucket_rank").cast("long").alias("bucket_rank"))


def p12(spark, sf):
    e = F.col("event_id")
    lines = table(spark, sf, "events").select(F.when(e % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value"))
    parsed = cp.parse_or_skip(lines, "k long")
    return parsed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def p13(spark, sf):
    return cp.prepare_newsgroups(_documents(spark, sf), "text", "source", "doc_id").select("doc_id", "category", *digest("text"))


def yahoo(spark, sf):
    docs = _documents(spark, sf).withColumn("topic", F.col("doc_id") % 12)
    return cp.prepare_yahoo(docs, "topic", "lang", "source", "text", "doc_id", 30).select("doc_id", "category", *digest("text"))


def agnews(spark, sf):
    docs = _documents(spark, sf).withColumn("label", F.col("doc_id") % 6)
    return cp.prepare_agnews(docs, "label", "source", "text", "doc_id", 60).select("doc_id", "category", *digest("text"))


_ARXIV_TAGS = ("math-ph cs.LG", "q-bio.NC", "hep-th", " stat.ML cs.LG", "CS.CL", "econ.EM", "astro-ph.GA")


def arxiv(spark, sf):
    tag = F.element_at(F.array(*[F.lit(t) for t in _ARXIV_TAGS]), (F.col("doc_id") % len(_ARXIV_TAGS) + 1).cast("int"))
    docs = _documents(spark, sf).withColumn("tags", tag)
    return cp.prepare_arxiv(docs, "text", "tags", "doc_id", 50).select("doc_id", "category", *digest("text"))


def wikipedia(spark, sf):
    out = cp.prepare_wikipedia(_documents(spark, sf), "source", "text", "doc_id", KEYWORDS, 100)
    return out.select("doc_id", "category", *digest("text"))


def x1(spark, sf):
    return _documents(spark, sf).select("doc_id", *digest(tx.clean_text("text")))


def x1_pages(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", *digest(tx.clean_text(F.concat_ws(" ", "url", "html"))))


def x2(spark, sf):
    raw = raw_records(spark, sf)
    docs = wn.parse_raw(raw, record_id=F.col("event_id"), now=F.col("ms"))
    return docs.select(*[F.col(c).alias(c.lower()) for c in docs.columns])


def x3(spark, sf):
    e = F.col("event_id")
    raw = table(spark, sf, "events").select(
        "event_type", F.when(e % 4 == 0, F.concat(e, F.lit(" !"))).otherwise(F.concat("event_type", F.lit(" "), e)).alias("text")
    )
    kept = wn.clean_documents(raw)
    return kept.groupBy("event_type", "cleanedText").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("cleanedText", "cleaned")


QUERIES = {
    "p1_map_label": p1,
    "p2_compose_text": p2,
    "p3_normalise_breaks": lambda s, d: table(s, d, "pages").select("page_id", *digest(tx.normalise_breaks("html"))),
    "p4_strip_latex": lambda s, d: _documents(s, d).select("doc_id", *digest(tx.strip_latex("text"))),
    "p5_collapse_blank_lines": lambda s, d: _documents(s, d).select("doc_id", *digest(tx.collapse_blank_lines("text"))),
    "p6_min_length": p6,
    "p7_truncate": lambda s, d: _documents(s, d).select("doc_id", *digest(cp.truncate("text", 2000))),
    "p8_cap_per_bucket": p8,
    "p9_classify_by_prefix": lambda s, d: _documents(s, d).select("doc_id", tx.classify_by_prefix("text", PREFIXES).alias("bucket")).where("bucket is not null"),
    "p10_classify_by_keywords": lambda s, d: _documents(s, d).select("doc_id", tx.classify_by_keywords("source", "text", KEYWORDS).alias("bucket")).where("bucket is not null"),
    "p11_category_counts": lambda s, d: cp.category_counts(_documents(s, d).withColumnRenamed("lang", "category")),
    "p12_parse_or_skip": p12,
    "p13_strip_and_filter": p13,
    "p13_skipped_short": lambda s, d: cp.skipped_short(_documents(s, d).select(tx.strip("text").alias("t")), "t", 150),
    "p_agnews_corpus": agnews,
    "p_yahoo_corpus": yahoo,
    "p_arxiv_corpus": arxiv,
    "p_wikipedia_corpus": wikipedia,
    "x1_clean_text": x1,
    "x1_clean_pages": x1_pages,
    "x2_parse_raw": x2,
    "x3_drop_blank": x3,
    "x4_word_count": lambda s, d: wn.word_count(_documents(s, d), "text"),
}

_CAPPED = """SELECT doc_id, category, md5(t) AS text_md5, length(t) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rn FROM ({inner}) WHERE category IS NOT NULL AND length(full_t) >= {low}
) WHERE rn <= {cap}"""
_TAG_LIST = "[" + ", ".join(f"'{t}'" for t in _ARXIV_TAGS) + "]"

ORACLE = {
    "p1_map_label": f"SELECT vec_id, category FROM (SELECT vec_id, {sql_case('label', cp.AGNEWS_LABELS)} AS category FROM embeddings) WHERE category IS NOT NULL",
    "p2_compose_text": "SELECT doc_id, "
    + sql_digest(sql_strip(f"{sql_strip('source')} || ' ' || coalesce(CASE WHEN doc_id % 3 <> 0 THEN {sql_strip('lang')} END, '') || ' ' || {sql_strip('text')}"))
    + " FROM documents",
    "p3_normalise_breaks": f"SELECT page_id, {sql_digest('t')} FROM (SELECT page_id, {sql_breaks('html')} AS t FROM pages)",
    "p4_strip_latex": f"SELECT doc_id, {sql_digest('t')} FROM (SELECT doc_id, {sql_latex('text')} AS t FROM documents)",
    "p5_collapse_blank_lines": f"SELECT doc_id, {sql_digest('t')} FROM (SELECT doc_id, {sql_blank_lines('text')} AS t FROM documents)",
    "p6_min_length": f"SELECT doc_id, length(t) AS n_chars FROM (SELECT doc_id, {sql_blank_lines('text')} AS t FROM documents) WHERE length(t) >= 300",
    "p7_truncate": f"SELECT doc_id, {sql_digest('substr(text, 1, 2000)')} FROM documents",
    "p8_cap_per_bucket": "SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS bucket_rank FROM documents) WHERE bucket_rank <= 20",
    "p9_classify_by_prefix": f"SELECT * FROM (SELECT doc_id, {sql_prefix('text', PREFIXES)} AS bucket FROM documents) WHERE bucket IS NOT NULL",
    "p10_classify_by_keywords": f"SELECT * FROM (SELECT doc_id, {sql_keywords('source', 'text', KEYWORDS)} AS bucket FROM documents) WHERE bucket IS NOT NULL",
    "p11_category_counts": "SELECT lang AS category, count(*) AS n_docs FROM documents GROUP BY lang",
    "p12_parse_or_skip": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1",
    "p13_strip_and_filter": f"SELECT doc_id, category, {sql_digest('t')} FROM (SELECT doc_id, source AS category, {sql_strip('text')} AS t FROM documents) WHERE length(t) >= 50",
    "p13_skipped_short": f"SELECT count(*) FILTER (length(t) >= 150) AS n_kept, count(*) FILTER (length(t) < 150) AS n_skipped FROM (SELECT {sql_strip('text')} AS t FROM documents)",
    "p_agnews_corpus": _CAPPED.format(
        inner=f"SELECT *, full_t AS t FROM (SELECT doc_id, {sql_case('doc_id % 6', cp.AGNEWS_LABELS)} AS category, {sql_strip(sql_strip('source') + chr(124) * 2 + repr(' ') + chr(124) * 2 + sql_strip('text'))} AS full_t FROM documents)",
        low=50,
        cap=60,
    ),
    "p_yahoo_corpus": _CAPPED.format(
        inner="SELECT *, substr(full_t, 1, 2000) AS t FROM (SELECT doc_id, "
        + sql_case("doc_id % 12", cp.YAHOO_LABELS)
        + " AS category, "
        + sql_strip(f"{sql_breaks('lang')} || ' ' || {sql_breaks('source')} || ' ' || {sql_breaks('text')}")
        + " AS full_t FROM documents)",
        low=150,
        cap=30,
    ),
    "p_arxiv_corpus": _CAPPED.format(
        inner="SELECT *, full_t AS t FROM (SELECT doc_id, "
        + sql_prefix(f"{_TAG_LIST}[doc_id % {len(_ARXIV_TAGS)} + 1]", cp.ARXIV_PREFIXES)
        + f" AS category, {sql_latex('text')} AS full_t FROM documents)",
        low=100,
        cap=50,
    ),
    "p_wikipedia_corpus": _CAPPED.format(
        inner=f"SELECT *, substr(full_t, 1, 1000) AS t, {sql_keywords('source', 'full_t', KEYWORDS)} AS category FROM (SELECT doc_id, source, {sql_blank_lines('text')} AS full_t FROM documents)",
        low=300,
        cap=100,
    ),
    "x1_clean_text": f"SELECT doc_id, {sql_digest('t')} FROM (SELECT doc_id, {sql_clean('text')} AS t FROM documents)",
    "x1_clean_pages": "SELECT page_id, " + sql_digest("t") + " FROM (SELECT page_id, " + sql_clean("url || ' ' || html") + " AS t FROM pages)",
    "x2_parse_raw": f"""WITH raw AS ({RAW_SQL}), good AS (SELECT *, value::JSON AS j FROM raw WHERE event_id % 11 <> 0)
SELECT coalesce(j->>'$.docId', (('0x' || substr(md5('doc|' || event_id), 1, 15))::BIGINT)::VARCHAR) AS docid,
  coalesce(CAST(j->>'$.timestamp' AS BIGINT), ms) AS "timestamp", coalesce(j->>'$.text', '') AS text, key AS sourcecategory,
  coalesce(CAST(j->>'$.sequenceNumber' AS BIGINT), -1) AS sequencenumber,
  coalesce(CAST(j->>'$.driftLabel' AS BOOLEAN), false) AS driftlabel, j->>'$.driftType' AS drifttype,
  CAST(j->>'$.driftStartTs' AS BIGINT) AS driftstartts FROM good""",
    "x3_drop_blank": f"""SELECT event_type, cleaned, count(*) AS n FROM (
  SELECT event_type, {sql_clean("CASE WHEN event_id % 4 = 0 THEN event_id || ' !' ELSE event_type || ' ' || event_id END")} AS cleaned FROM events)
WHERE cleaned <> '' GROUP BY ALL""",
    "x4_word_count": r"""SELECT word, count(*) AS n FROM (
  SELECT unnest(CASE WHEN len(w) = 2 AND w[1] = '' AND w[2] = '' THEN [] ELSE list_filter(w, lambda t, i: t <> '' OR i = 1) END) AS word
  FROM (SELECT regexp_split_to_array(lower(text), '\W+') AS w FROM documents)) GROUP BY word""",
}
