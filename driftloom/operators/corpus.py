"""Corpus preparation: label maps, length rules, caps per bucket and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import text as tx
from driftloom.operators.ordered import top_n

# Label maps, prefix maps, length limits and bucket caps of the supported corpora.
AGNEWS_LABELS = {1: "agnews_world", 2: "agnews_sports", 3: "agnews_business", 4: "agnews_scitech"}
YAHOO_LABELS = {
    0: "yahoo_society",
    1: "yahoo_science",
    2: "yahoo_health",
    3: "yahoo_education",
    4: "yahoo_computers",
    5: "yahoo_sports",
    6: "yahoo_business",
    7: "yahoo_entertainment",
    8: "yahoo_relationships",
    9: "yahoo_politics",
}
ARXIV_PREFIXES = {
    "cs": "arxiv_cs",
    "math": "arxiv_math",
    "q-bio": "arxiv_qbio",
    "econ": "arxiv_econ",
    "astro-ph": "arxiv_astro",
    "stat": "arxiv_stat",
}
MIN_LENGTH = {"newsgroups": 50, "agnews": 50, "yahoo": 150, "arxiv": 100, "wikipedia": 300}
MAX_LENGTH = {"yahoo": 2000, "wikipedia": 1000}
TARGET_PER_BUCKET = 5000


def map_label(df: DataFrame, label: str, mapping: dict[int, str], into: str = "category") -> DataFrame:
    """Replace a numeric label by its bucket; rows with another label go."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    bucket = F.try_element_at(F.create_map(*pairs), F.col(label).cast("int"))
    return df.withColumn(into, bucket).where(F.col(into).isNotNull())


def min_length(df: DataFrame, c: str, n: int) -> DataFrame:
    return df.where(F.char_length(c) >= n)


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(c, 1, n)


def cap_per_bucket(df: DataFrame, bucket: str, order: str, n: int = TARGET_PER_BUCKET) -> DataFrame:
    """The first ``n`` rows of each bucket in input order."""
    return top_n(df, [bucket], [F.col(order)], n, [order], rank="bucket_rank")


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n_docs")).orderBy(category)


def parse_or_skip(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON lines as columns; a line that is not a JSON object is skipped."""
    parsed = F.from_json(value, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("_doc", parsed).where("_doc is not null and _doc._bad is null")
    return rows.select("_doc.*").drop("_bad")


def skipped_short(df: DataFrame, c: str, n: int) -> DataFrame:
    """How many rows a minimum length keeps and skips, in one pass."""
    short = F.char_length(c) < n
    return df.agg(F.count_if(~short).alias("n_kept"), F.count_if(short).alias("n_skipped"))


def _finish(df: DataFrame, corpus: str, order: str, cap: int) -> DataFrame:
    long_enough = min_length(df, "text", MIN_LENGTH[corpus])
    cut = MAX_LENGTH.get(corpus)
    out = long_enough.withColumn("text", truncate("text", cut)) if cut else long_enough
    capped = cap_per_bucket(out, "category", order, cap)
    return capped.select(order, "text", "category")


def prepare_newsgroups(df: DataFrame, text: str, category: str, order: str) -> DataFrame:
    stripped = df.select(order, tx.strip(text).alias("text"), F.col(category).alias("category"))
    return min_length(stripped, "text", MIN_LENGTH["newsgroups"])


def prepare_agnews(
    df: DataFrame, label: str, title: str, description: str, order: str, cap: int = TARGET_PER_BUCKET
) -> DataFrame:
    mapped = map_label(df, label, AGNEWS_LABELS)
    return _finish(mapped.withColumn("text", tx.compose_text(title, description)), "agnews", order, cap)


def prepare_yahoo(
    df: DataFrame, topic: str, title: str, content: str, answer: str, order: str, cap: int = TARGET_PER_BUCKET
) -> DataFrame:
    mapped = map_label(df, topic, YAHOO_LABELS)
    parts = [tx.normalise_breaks(c) for c in (title, content, answer)]
    return _finish(mapped.withColumn("text", tx.compose_text(*parts)), "yahoo", order, cap)


def prepare_arxiv(
    df: DataFrame, abstract: str, categories: str, order: str, cap: int = TARGET_PER_BUCKET
) -> DataFrame:
    classified = df.withColumns(
        {
            "category": tx.classify_by_prefix(categories, ARXIV_PREFIXES),
            "text": tx.strip_latex(F.coalesce(F.col(abstract), F.lit(""))),
        }
    )
    return _finish(classified.where("category is not null"), "arxiv", order, cap)


def prepare_wikipedia(
    df: DataFrame,
    title: str,
    text: str,
    order: str,
    buckets: dict[str, list[str]],
    cap: int = TARGET_PER_BUCKET,
) -> DataFrame:
    """Articles by topic keywords; ``buckets`` is read with :func:`driftloom.sources.corpus_files.read_keyword_map`."""
    cleaned = df.withColumn("text", tx.collapse_blank_lines(text))
    classified = cleaned.withColumn("category", tx.classify_by_keywords(title, "text", buckets))
    return _finish(classified.where("category is not null"), "wikipedia", order, cap)
