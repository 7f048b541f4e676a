"""The words that the exact text operators share, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of ASCII letters and digits and of characters beyond ASCII; this is what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_line(text: Column) -> Column:
    """The words of text (A-Z lower-cased; null: empty), one space between two."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is the faster of the two, and the same for texts of ASCII alone
    low = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.trim(F.regexp_replace(low, BETWEEN, " "))


def word_list(text: Column) -> Column:
    """The words of text as an array; empty if it has none."""
    return F.array_remove(F.split(word_line(text), " "), "")


def word_count(line: Column) -> Column:
    """How many words a word_line has."""
    return F.when(line == "", F.lit(0)).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")
