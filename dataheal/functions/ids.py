"""Identifier expressions: ``'POL-00001'`` is prefix ``'POL-'``, number 1, width 5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataheal.functions.text import strip

TRAILING_DIGITS = r"^(.*?)(\d+)$"
# Texts that stand for a missing identifier.
MISSING_IDS = ("", "nan", "none", "null", "<na>")


def parse_identifier(col: Column) -> Column:
    """``struct(prefix, number, width)``, null where the text does not end in digits."""
    text = strip(col.cast("string"))
    digits = F.regexp_extract(text, TRAILING_DIGITS, 2)
    parsed = F.struct(
        F.regexp_extract(text, TRAILING_DIGITS, 1).alias("prefix"),
        digits.try_cast("decimal(38,0)").alias("number"),
        F.length(digits).alias("width"),
    )
    return F.when(digits != "", parsed)


def render_identifier(prefix: Column, number: Column, width: Column) -> Column:
    digits = number.cast("string")
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(digits), F.lit(0))), digits)
    return F.concat(prefix, padded)


def is_missing_id(col: Column) -> Column:
    return F.lower(F.coalesce(strip(col.cast("string")), F.lit(""))).isin(*MISSING_IDS)
