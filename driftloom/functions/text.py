"""Text expressions: all of them are built-in Spark functions, evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space for Unicode-aware trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORD = r"[\p{L}\p{N}_]"

# What text cleaning turns into blanks, in this order: links, addresses, the rest.
CLEANING_PATTERNS = (
    r"https?://\S+|www\.\S+",
    r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    r"[^a-z]+",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


_LOCAL = r"[a-zA-Z0-9._%+\-]"


def _linear(pattern: str) -> str:
    """The same matches in linear time, for a pattern that begins with a run of address characters.

    A search would try every start inside a long run without ``@`` and walk to its end each time. A
    match can only begin where a run begins or where the match before it ended, and giving back
    characters of the run never helps.
    """
    start = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}+"
    return start + pattern[len(_LOCAL) :] if pattern.startswith(_LOCAL + "+") else pattern


def clean_text(c: Column | str) -> Column:
    """Lower-cased ASCII words: links, addresses and everything but letters become blanks."""
    blanked = reduce(
        lambda acc, pattern: F.regexp_replace(acc, _linear(pattern), " "), CLEANING_PATTERNS, F.lower(_col(c))
    )
    return F.coalesce(F.trim(blanked), F.lit(""))


def compose_text(*cols: Column | str) -> Column:
    """Stripped parts joined by one space; an empty inner part still contributes its space."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(" "), F.coalesce(strip(c), F.lit(""))]
    return strip(F.concat(*parts[1:]))


def normalise_breaks(c: Column | str) -> Column:
    """Line breaks (also as HTML) and runs of white space become one space; null becomes ''."""
    flat = F.regexp_replace(_col(c), r"<br />", " ")
    return strip(F.regexp_replace(F.coalesce(flat, F.lit("")), _WS + "+", " "))


def strip_latex(c: Column | str) -> Column:
    """Drop inline formulas, then commands with an argument, then bare commands."""
    no_math = F.regexp_replace(_col(c), r"\$[^$]*\$", "")
    no_args = F.regexp_replace(no_math, r"\\" + _WORD + r"+\{[^}]*\}", "")
    no_cmds = F.regexp_replace(no_args, r"\\" + _WORD + "+", "")
    return strip(F.regexp_replace(no_cmds, _WS + "{2,}", " "))


def collapse_blank_lines(c: Column | str) -> Column:
    """At most one empty line in a row, at most one space in a row."""
    return strip(F.regexp_replace(F.regexp_replace(_col(c), r"\n{3,}", "\n\n"), " {2,}", " "))


def classify_by_prefix(c: Column | str, buckets: dict[str, str]) -> Column:
    """Bucket of the first prefix, in map order, that starts the first token; else null."""
    first = F.lower(F.split(strip(c), _WS + "+").getItem(0))
    return F.coalesce(*[F.when(first.startswith(p), F.lit(b)) for p, b in buckets.items()])


def classify_by_keywords(
    title: Column | str, body: Column | str, buckets: dict[str, list[str]], lead: int = 500
) -> Column:
    """First bucket, in map order, with a keyword inside the title or the lead of the body.

    The lead is part of the rule, not a short cut: only an article's opening decides its topic.
    """
    text = F.concat(
        F.lower(F.coalesce(_col(title), F.lit(""))), F.lit(" "), F.lower(F.coalesce(F.substring(_col(body), 1, lead), F.lit("")))
    )
    branches = [
        F.when(text.rlike("|".join(rf"\Q{k}\E" for k in dict.fromkeys(words))), F.lit(bucket))
        for bucket, words in buckets.items()
    ]
    return F.coalesce(*branches)


def split_words(c: Column | str) -> Column:
    r"""Lower-cased text split on ``\W+``; a leading empty token stays, trailing ones go."""
    tokens = F.split(F.lower(_col(c)), r"\W+")
    trimmed = F.filter(tokens, lambda t, i: (t != "") | (i == 0))
    nothing = (F.size(tokens) == 2) & (F.array_join(tokens, "") == "")
    return F.when(nothing, F.array().cast("array<string>")).otherwise(trimmed)
