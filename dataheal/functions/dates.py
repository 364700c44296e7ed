"""Date expressions over text: parsing a fixed set of spellings, ambiguity, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.dataset import Dataset
from dataheal.functions.text import strip

ISO = r"^(\d{4})-(\d{2})-(\d{2})([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
NUMERIC = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
MONTH_FIRST = r"^[A-Za-z]+ \d{1,2},? \d{4}$"
DAY_FIRST = r"^\d{1,2} [A-Za-z]+ \d{4}$"

# Strftime codes and the Spark datetime letters that print the same.
STRFTIME_TO_SPARK = {
    "d": "dd", "m": "MM", "y": "yy", "Y": "yyyy", "H": "HH", "M": "mm", "S": "ss",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSS",
}
# How the four usual date codes are named in explanations.
STRFTIME_LABELS = {"%d": "DD", "%m": "MM", "%Y": "YYYY", "%y": "YY"}


def spark_pattern(strftime: str) -> str:
    """``'%d-%m-%y'`` as ``'dd-MM-yy'``; other letters are quoted."""
    out, i = [], 0
    while i < len(strftime):
        ch = strftime[i]
        if ch == "%" and i + 1 < len(strftime):
            code = strftime[i + 1]
            if code != "%" and code not in STRFTIME_TO_SPARK:
                raise ValueError(f"date format code %{code} is not supported")
            out.append(STRFTIME_TO_SPARK.get(code, "%"))
            i += 2
            continue
        out.append(f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch)
        i += 1
    return "".join(out)


def format_label(strftime: str) -> str:
    for code, label in STRFTIME_LABELS.items():
        strftime = strftime.replace(code, label)
    return strftime


def _numeric_parts(text: Column) -> tuple[Column, Column, Column]:
    part = lambda i: F.regexp_extract(text, NUMERIC, i).try_cast("int")
    return part(1), part(2), part(3)


def parse_date(text: Column) -> Column:
    """Trimmed text to ``timestamp_ntz``; null where it is none of the known spellings.

    Day-month-year numbers are read day first, or month first where only that is a date.
    """
    first, second, year = _numeric_parts(text)
    day = F.when(second > 12, second).otherwise(first)
    month = F.when(second > 12, first).otherwise(second)
    numeric = F.format_string("%04d-%02d-%02d", year, month, day)
    no_comma = F.replace(text, F.lit(","), F.lit(""))

    def long_form(order: str) -> Column:
        return F.coalesce(
            *[
                F.try_to_timestamp(no_comma, F.lit(order.replace("M", letters))).cast("timestamp_ntz")
                for letters in ("MMMM", "MMM")
            ]
        )

    return (
        F.when(text.rlike(ISO), text.try_cast("timestamp_ntz"))
        .when(text.rlike(NUMERIC), numeric.try_cast("timestamp_ntz"))
        .when(text.rlike(MONTH_FIRST), long_form("M d yyyy"))
        .when(text.rlike(DAY_FIRST), long_form("d M yyyy"))
    )


def is_ambiguous(text: Column) -> Column:
    """Would reading day first and reading month first give two different dates?

    Holds for every all-number spelling, ISO included, whose day could be a month.
    """
    first, second, _ = _numeric_parts(text)
    iso_month, iso_day = F.substring(text, 6, 2), F.substring(text, 9, 2)
    return (
        F.when(text.rlike(ISO), (iso_day <= "12") & (iso_day != iso_month))
        .when(text.rlike(NUMERIC), (first <= 12) & (second <= 12) & (first != second))
        .otherwise(F.lit(False))
    )


def date_cell(ds: Dataset, column: str) -> Column:
    """The date a cell holds, as ``timestamp_ntz``; text cells are parsed."""
    if isinstance(ds.dtype(column), T.StringType):
        return parse_date(strip(ds.col(column)))
    return ds.col(column).cast("timestamp_ntz")


def format_date(ts: Column, strftime: str) -> Column:
    return F.date_format(ts, spark_pattern(strftime))


def iso_date(ts: Column) -> Column:
    return ts.cast("date").cast("string")


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
