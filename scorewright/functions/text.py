"""String expressions. All are native, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points counted as white space when answers are trimmed.
WHITESPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, WHITESPACE_POINTS))
# Language tags dropped from the first line of a fenced block.
CODE_TAGS = ("python", "py", "sql", "json", "javascript", "js")
# Typographic quotes and the ASCII characters that replace them.
CURLY_QUOTES = "‘’“”"
PLAIN_QUOTES = "''\"\""

FENCE = "```"
NON_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"(?<=[.!?])\s+"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL and for text that holds only white space."""
    return text.isNull() | (strip(text) == "")


def words(text: Column) -> Column:
    """Lower-cased words in text order; everything but letters and digits separates."""
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def sentences(text: Column) -> Column:
    """Sentences with their end mark, trimmed, without empty ones."""
    parts = F.split(text, SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def first_code_block(text: Column) -> Column:
    """Content of the first fenced block; text without a fence comes back unchanged.

    A known language tag on the first line is dropped, an unknown one stays. A fence that is never
    closed takes the rest of the text.
    """
    block = F.get(F.split(text, FENCE), 1)
    tag_line = r"(?i)\A[ \t]*(" + "|".join(CODE_TAGS) + r")?[ \t]*(\n|\z)"
    return F.when(F.contains(text, F.lit(FENCE)), strip(F.regexp_replace(block, tag_line, ""))).otherwise(text)


def fence_tag(text: Column) -> Column:
    """Word after the first fence on the same line, lower-cased; NULL without a fence."""
    first_line = F.get(F.split(F.get(F.split(text, FENCE), 1), "\n"), 0)
    return F.lower(strip(first_line))


def plain_quotes(text: Column) -> Column:
    """Typographic single and double quotes become ASCII ones, so that code parses."""
    return F.translate(text, CURLY_QUOTES, PLAIN_QUOTES)


def signature(message: Column) -> Column:
    """Message with hexadecimal ids and digit runs replaced by ``#``."""
    no_hex = F.regexp_replace(message, r"0x[0-9a-fA-F]+", "#")
    return F.regexp_replace(no_hex, r"[0-9]+", "#")


def contains_any(text: Column, terms: Column) -> Column:
    """Does any of the terms occur in the text, ignoring case?"""
    lowered = F.lower(text)
    return F.exists(terms, lambda term: F.contains(lowered, F.lower(term)))


def count_contained(text: Column, terms: Column) -> Column:
    """How many of the terms occur in the text, ignoring case."""
    lowered = F.lower(text)
    return F.size(F.filter(terms, lambda term: F.contains(lowered, F.lower(term))))


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without port and without a leading ``www.`` or ``m.``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def url_section(url: Column) -> Column:
    """First path segment of a URL, empty when there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
