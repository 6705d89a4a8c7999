"""Text functions on columns.  All stay inside the JVM but full_unescape()."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.fixed import GATEWAY_PREFIXES, words

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def escaped(literal: str) -> str:
    """A literal as part of a Java or RE2 pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def any_of(needles: list[str]) -> str:
    return "|".join(escaped(n) for n in needles)


def has_any(text: Column, needles: list[str]) -> Column:
    """Whether text contains one of the needles: one alternation, evaluated once a row."""
    return text.rlike(any_of(needles))


def unescape(text: Column) -> Column:
    """The common character references, without leaving the JVM."""
    for entity, char in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@F.pandas_udf(T.StringType())
def full_unescape(text: pd.Series) -> pd.Series:
    """All of HTML 5's character references."""
    return text.map(html.unescape, na_action="ignore")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normalize_text(text: Column, full: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    return collapse(full_unescape(text) if full else unescape(text))


def clean_cell(cell: Column) -> Column:
    """A table cell without its tags."""
    return normalize_text(F.regexp_replace(F.coalesce(cell, F.lit("")), "<.*?>", ""))


def parse_amount(text: Column) -> Column:
    """The first number of a text, without $ and commas; a leading minus counts; 0 without a number."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,]", ""))
    number = F.regexp_extract(plain, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    value = F.coalesce(number, F.lit(0.0))
    return F.when(plain.startswith("-"), -value).otherwise(value)


def strict_amount(text: Column) -> Column:
    """A number with two decimals once spaces and commas are gone, else null."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s,]", "")
    # one use of the text, which may be costly to come by; what does not match is empty, and no number
    return F.regexp_extract(plain, r"^\d+\.\d{2}$", 0).try_cast("double")


def split_reference(description: Column) -> tuple[Column, Column]:
    """(description, reference): ten or more digits at the end are the reference."""
    text = F.coalesce(description, F.lit(""))
    reference = F.regexp_extract(text, r"(\d{10,})$", 1)
    return F.when(reference != "", F.trim(F.regexp_replace(text, r"\d{10,}$", ""))).otherwise(text), reference


def is_probable_name(text: Column, not_names: list[str] = ()) -> Column:
    """Two to four capitalised alphabetic words of more than one letter each."""
    parts = F.split(F.trim(text), r"\s+")
    return (text == F.upper(text)) & F.size(parts).between(2, 4) & F.forall(parts, lambda w: w.rlike(r"^\p{L}{2,}$")) & ~text.isin(list(not_names) or [""])


def haystack(description: Column) -> Column:
    """The string that merchant aliases are looked up in, from a lower-case normalised description."""
    t = description
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, r"www\.[\w.]+\s*", " ")
    # stripping prefixes until none is left is one repeated group
    t = F.regexp_replace(t, rf"^(?:(?:{any_of(words(GATEWAY_PREFIXES))})\s*)+", "")
    t = F.regexp_replace(t, r"\b\d{10,}\b", " ")
    t = F.regexp_replace(t, r"\b\d{3}-\d{3}-\d{4}\b", " ")
    t = F.regexp_replace(t, r"\s+#\s*\d+(\s+#\d+)*\s*$", "")
    t = F.regexp_replace(t, r"\s+store\s+#?\d+\s*$", "")
    t = F.regexp_replace(t, r"\s+loc(ation)?\s*\d+\s*$", "")
    return collapse(t)


def title_case(text: Column) -> Column:
    """A capital after every character that is not a letter, small letters elsewhere."""
    chars = F.split(text, "")
    before = F.split(F.concat(F.lit(" "), text), "")
    return F.array_join(F.zip_with(chars, before, lambda c, b: F.when(c.isNull(), F.lit("")).when(b.rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")


def dedupe_fingerprint(description: Column) -> Column:
    """A description without page numbers and statement boilerplate, 300 characters at most."""
    t = normalize_text(description)
    for pattern in (r"(?i)\b\d+\s+of\s+\d+\b.*", r"(?i)your \S+ personal banking account statement.*", r"(?i)details of your account activity.*", r"(?i)\bRBPDA[0-9A-Z_-]+\b"):
        t = F.regexp_replace(t, pattern, "")
    return F.substring(collapse(t), 1, 300)


def merge_fingerprint(description: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9]+", ""), 1, 56)


def money_text(amount: Column) -> Column:
    """A two-decimal amount without trailing zeros but one: 12.5, -100.0."""
    return F.regexp_replace(amount.cast("decimal(18,2)").cast("string"), r"(\.\d)0$", "$1")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_file_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), 1, 180)


def url_decode(text: Column) -> Column:
    """Percent-decoding that leaves + alone."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def keyword_suggestion(description: Column) -> Column:
    return F.substring(F.lower(collapse(description)), 1, 48)
