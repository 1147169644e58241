"""Text expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters that SQLite's NOCASE and LIKE fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only; every other letter stays."""
    return F.translate(c, UPPER, LOWER)


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_extension(c: Column) -> Column:
    """Lower case, without surrounding blanks and then without leading dots; null or nothing left is null."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"^\.+", ""), F.lit(""))
