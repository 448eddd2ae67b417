"""Small column helpers shared by the extraction modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of ``fixed_values.WIDE_SPACE``.
WIDE_SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
ACCENTED, PLAIN = "áéíóúüñ", "aeiouun"


def group1(text: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, or NULL where the pattern does not match or captures nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def grab(text: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, '' where the pattern does not match: ``group1`` for a step whose results the next one reads as columns."""
    return F.regexp_extract(text, pattern, group)


def told(name: str) -> Column:
    """A column that ``grab`` filled; NULL where it found nothing."""
    return F.nullif(F.col(name), F.lit(""))


def first_match(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """The capture of the first pattern (in list order) that matches."""
    return F.coalesce(*[group1(text, p, group) for p in patterns])


def fold(text: Column) -> Column:
    """Lower case without Spanish accents, which are looked for only in a text with more bytes than characters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(F.lower(text), ACCENTED, PLAIN))


def wide_trim(text: Column) -> Column:
    """Trim every kind of white space, not only blanks; looks at the ends alone, however long the text."""
    return F.btrim(text, F.lit(WIDE_SPACES))


def pad2(text: Column) -> Column:
    """Left-pad to two digits; unlike ``lpad`` longer values stay whole."""
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def has_any(text: Column, words: Sequence[str]) -> Column:
    """True where one of the literal words occurs; a byte search, far cheaper than a regex.

    Many words are one expression over an array of them, so that a step with such searches stays short code: Java only
    interprets what is too long for its compiler.
    """
    hits = [F.contains(text, F.lit(word)) for word in words]
    if len(hits) > 2:
        return F.exists(F.array(*map(F.lit, words)), lambda word: F.contains(text, word))
    return hits[0] if len(hits) == 1 else hits[0] | hits[1]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where one of the (lower-case) words occurs in the text, whatever its case."""
    return has_any(F.lower(text), words)
