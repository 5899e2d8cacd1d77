"""Text expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_key(db: Column) -> Column:
    """A database name as it is compared: without letter case and surrounding blanks; null stays null."""
    return F.lower(F.regexp_replace(db, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1), F.lower)


def compact(text: Column) -> Column:
    """Text without whitespace, letter case, punctuation and backticks or free accents; a point between two digits stays.

    Other signs, such as those of comparison and currency, count.
    """
    return F.regexp_replace(F.lower(text), r"(?<!\p{Nd})\.|\.(?!\p{Nd})|[\s\p{Z}\p{P}\p{Sk}\p{Cc}&&[^.]]", "")
