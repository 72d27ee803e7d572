"""Text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tagtrail.functions.dates import col

# The patterns and length bands the reference data is checked with.
TAG_PREFIX = "^(34|91)"
TAG_LENGTH = (20, 24)
LOOSE_TAG_LENGTH = (11, 39)
REGISTRATION_LOOSE = "^[a-zA-Z]{2}[0-9]{1,2}[A-Z]+[0-9]+$"
REGISTRATION_ANY = "^[a-zA-Z]{2}[0-9]+[A-Z0-9]+$"
REGISTRATION_STRICT = "^[A-Z]{2}[0-9]{2}[A-Z]+[0-9]+$"
MASK = "X"


def full_match(c: Column | str, pattern: str) -> Column:
    """The whole value matches ``pattern``."""
    return col(c).rlike(f"^(?:{pattern})$")


def length_between(c: Column | str, band: tuple[int, int]) -> Column:
    return F.length(col(c)).between(*band)


def clean_tag(c: Column | str, prefix: str = TAG_PREFIX, band: tuple[int, int] = TAG_LENGTH) -> Column:
    return col(c).rlike(prefix) & length_between(c, band)


def unmasked(c: Column | str, mask: str = MASK) -> Column:
    """Something is left after every mask character is removed."""
    return F.translate(col(c), mask, "") != ""


def present(c: Column | str, *blanks: str) -> Column:
    """Not null and none of ``blanks`` (the empty string if none is named)."""
    return col(c).isNotNull() & ~col(c).isin(*(blanks or ("",)))


def words(c: Column | str) -> Column:
    """Upper-cased ``\\W+`` tokens, with an empty one where the text starts or ends with a separator."""
    return F.split(F.upper(col(c)), r"\W+")


def prefix(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def field(c: Column | str, delimiter: str, index: int) -> Column:
    """Field ``index`` of a delimited line, null when the line is too short."""
    return F.get(F.split(col(c), delimiter), index)


def captured_int(c: Column | str, pattern: str, group: int = 1) -> Column:
    """A regex group as an integer, null without a match."""
    return F.regexp_extract(col(c), pattern, group).try_cast("int")


def trimmed_number(c: Column | str, kind: str = "long") -> Column:
    return F.trim(col(c)).try_cast(kind)


def fahrenheit_text(c: Column | str) -> Column:
    return F.format_string("%.2f F", col(c))


def joined_key(*parts: str) -> Column:
    """One key text from several columns, as for a place and its lane."""
    return reduce(lambda a, b: F.concat(a, b), [F.col(p).cast("string") for p in parts])
