"""Text to typed values where a bad value becomes null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd",)
WHITE_SPACE = " \t\n\r\f\x0b"


def strip_space(text: Column) -> Column:
    """Drop white space of any kind at both ends (``trim`` drops blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def unquoted(text: Column) -> Column:
    """Drop the character that a text opens with from both its ends."""
    return F.btrim(text, F.left(text, F.lit(1)))


def blank_to_null(text: Column) -> Column:
    """A stripped key; empty text and the word ``nan`` count as missing."""
    key = strip_space(text)
    return F.when((key != "") & (F.lower(key) != "nan"), key)


def one_line(text: Column) -> Column:
    """Tabs, line ends and pipes become blanks, so the text fits a delimited report.

    Most texts need no change; finding that out is cheaper than rewriting them.
    """
    edited = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n|", "   "))
    odd = text.startswith(" ") | text.endswith(" ")
    for mark in "\t\n|":
        odd = odd | text.contains(mark)
    return F.when(~odd, text).otherwise(edited)


def lenient_double(text: Column) -> Column:
    """A finite number or null. Java's ``1.5d`` spelling isn't a number here."""
    plain = strip_space(text.cast("string"))
    suffixed = F.right(plain, F.lit(1)).isin("d", "D", "f", "F")
    number = F.when(~suffixed, plain.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def lenient_long(text: Column, default: int | None = 0) -> Column:
    """A whole number; decimal text is cut towards zero, missing becomes ``default``."""
    number = lenient_double(text).try_cast("bigint")
    return number if default is None else F.coalesce(number, F.lit(default).cast("bigint"))


def date_prefix(text: Column) -> Column:
    """The first ten characters, which is the day if a time of day follows."""
    return F.left(strip_space(text.cast("string")), F.lit(10))


def lenient_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first of the strict formats that fits the text or its first ten characters, else null."""
    plain, day = strip_space(text.cast("string")), date_prefix(text)
    return F.coalesce(*[F.try_to_date(x, pattern) for pattern in formats for x in (plain, day)])


def year_of_text(text: Column) -> Column:
    """The year in the first four characters of a date text."""
    return F.when(F.length(text) >= 4, F.substring(text, 1, 4).try_cast("int"))
