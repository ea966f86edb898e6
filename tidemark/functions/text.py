"""Text functions as Column expressions. All stay in the JVM but for html_unescape and ended_entities."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entity with its semicolon.
ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\f <&#;]{1,32});")
#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Words between white space; none for an empty or null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def tokenize(text: Column) -> Column:
    """Lower-case tokens of letters, digits, _, - and dots; everything else parts tokens."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_.\-]+"), "")


def strip(c: Column) -> Column:
    """White space of all kinds removed at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(c, SPACE, " "))


def is_good_text(c: Column, min_chars: int = 50, min_words: int = 5) -> Column:
    """At least 50 characters and 5 different words."""
    return F.coalesce((F.length(c) >= min_chars) & (F.size(F.array_distinct(words(c))) >= min_words), F.lit(False))


def split_semantic(c: Column, min_chars: int = 50) -> Column:
    """Blocks between blank lines, trimmed, longer than 50 characters."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda b: F.length(b) > min_chars)


def break_lines(c: Column) -> Column:
    """<br> in any form becomes a newline."""
    return F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")


def strip_tags(c: Column, by: str = "") -> Column:
    """Tags removed, or replaced."""
    return F.regexp_replace(c, r"<[^>]+>", by)


def html_unescape(c: Column) -> Column:
    """All HTML entities; Spark has no built-in for the full table."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return run(c)


def ended_entities(c: Column) -> Column:
    """HTML entities that end with a semicolon; &amp without one, which html_unescape resolves too, stays as it is."""

    def resolved(found: re.Match) -> str:
        return html.unescape(found[0]) if found[1][0] == "#" or f"{found[1]};" in html5 else found[0]

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: ENTITY.sub(resolved, x), na_action="ignore")

    return run(c)


def clean_html(c: Column, unescape=html_unescape) -> Column:
    """Line breaks kept, tags removed, entities resolved, white space squeezed."""
    return squeeze(unescape(strip_tags(break_lines(c))))


def shorten(c: Column, most: int, mark: str = "...") -> Column:
    """The first characters, with a mark where something was cut off."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(c)


def without_think(c: Column) -> Column:
    """Text without <think>...</think> parts."""
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def row_text(columns: list[str], sep: str = " | ", drop: tuple[str, ...] = ("",), label: bool = True) -> Column:
    """'name: value' of the columns whose trimmed value is not among drop (lower case), joined by sep."""

    def part(name: str) -> Column:
        value = strip(F.col(f"`{name}`").cast("string"))
        return F.when(~F.lower(value).isin(*drop), F.concat(F.lit(f"{name}: "), value) if label else value)

    return F.concat_ws(sep, *[part(c) for c in columns])


def stable_id(*parts: Column) -> Column:
    """MD5 of the parts joined by _: the same on every rebuild."""
    return F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]))


def chunks(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of size characters, each starting size - overlap behind the one before; none for an empty text."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - F.lit(overlap)), F.lit(step))
    return F.when(F.length(c) > 0, F.transform(starts, lambda s: F.substring(c, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def header_name(name: str) -> str:
    """Normalised column name of a table."""
    return name.strip().lower().replace(" ", "_")


def first_column(columns: list[str], part: str, unless: str | None = None) -> str | None:
    """The first column whose name holds part (and not unless)."""
    return next((c for c in columns if part in c and not (unless and unless in c)), None)
