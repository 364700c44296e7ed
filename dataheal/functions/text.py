"""Text expressions: trimming, casing, number rendering, money parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataheal.functions.numbers import round_even

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MONEY_MARKS = r"[£$€,]"
MONEY_NOISE = r"[£$€,\s]"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def title_case(col: Column) -> Column:
    """Upper-case each letter that follows a non-letter and lower-case the other letters."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(
        runs,
        lambda run: F.concat(
            F.upper(F.left(run, F.lit(1))), F.lower(run.substr(F.lit(2), F.length(run)))
        ),
    )
    return F.array_join(cased, "")


def apply_casing(col: Column, style: Column) -> Column:
    return (
        F.when(style == "upper", F.upper(col))
        .when(style == "lower", F.lower(col))
        .otherwise(title_case(col))
    )


def to_number(col: Column) -> Column:
    """Plain numeric text to double, anything else to null."""
    text = strip(col)
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def is_marked_money(col: Column) -> Column:
    """Does the text carry a currency symbol or a thousands comma?"""
    return col.rlike(MONEY_MARKS)


def parse_currency(col: Column) -> Column:
    """``'£1,200'`` to ``1200.0``; null where what remains is not a number."""
    return to_number(F.regexp_replace(col.cast("string"), MONEY_NOISE, ""))


def render_double(col: Column) -> Column:
    """A double as text the way a CSV writer shows it: shortest digits, at least one decimal,
    an exponent only from 1e16 up and below 1e-4."""
    text = col.cast("string")
    # Java may print a 17th digit where 16 already give the number back.
    sixteen = F.format_string("%.15e", col)
    shorter = (F.length(text) >= 18) & (sixteen.try_cast("double") == col)
    shown = F.when(shorter, sixteen).otherwise(text)
    size = F.abs(col)
    plain = F.regexp_replace(shown.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_extract(shown, r"^(-?[0-9.]+)[eE]", 1), r"\.?0*$", "")
    power = F.regexp_extract(shown, r"[eE]([+-]?\d+)$", 1).try_cast("int")
    digits = F.abs(power).cast("string")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return (
        F.when(~shown.rlike("[eE]"), shown)
        .when((size >= 1e16) | (size < 1e-4), scientific)
        .otherwise(plain)
    )


def render_compact(col: Column) -> Column:
    """As :func:`render_double`, but whole numbers without ``.0``."""
    whole = (col == F.floor(col)) & (F.abs(col) < 9e18)
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(render_double(col))


def percent(rate: Column, decimals: int) -> Column:
    """``0.0271`` as ``'2.7%'``."""
    return F.format_string(f"%.{decimals}f%%", round_even(rate * 100, decimals))


def words(name: Column) -> Column:
    """A column or file name as a label: no extension, underscores to blanks."""
    return F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" "))
