"""Scalar expressions against plain Python."""

import pytest
from pyspark.sql import functions as F

from dataheal.functions.dates import format_date, is_ambiguous, parse_date, spark_pattern
from dataheal.functions.ids import parse_identifier, render_identifier
from dataheal.functions.numbers import round_even, round_scaled
from dataheal.functions.text import parse_currency, render_compact, render_double, strip, title_case
from dataheal.session import local_frame


def evaluate(spark, values, kind, expression):
    df = local_frame(spark, list(enumerate(values)), f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_and_title_follow_python(spark):
    texts = ["  Motor ", " home ", "non-motor o'neil 3rd", "MIXED case", "", "çELİK x2y", "\t\n a \x1f"]
    assert evaluate(spark, texts, "string", strip) == [t.strip() for t in texts]
    plain = [t for t in texts if "İ" not in t]
    assert evaluate(spark, plain, "string", title_case) == [t.title() for t in plain]


def test_numbers_print_like_python(spark):
    numbers = [0.0, 1.0, -25.5, 1e7, 12345678.9, 475000000.0, 0.001, 0.00012, 1.5e-5, 1e16, 1.25e22, 123456789012345.6]
    assert evaluate(spark, numbers, "double", render_double) == [str(x) for x in numbers]
    assert evaluate(spark, [580.0, 0.5, 2e9], "double", render_compact) == ["580", "0.5", "2000000000"]


def test_rounding_follows_the_stored_value(spark):
    numbers = [k / n for n in (20_000, 40_000, 160_000) for k in range(1, 4_000, 37)]
    numbers += [0.00015, 0.00025, 0.125, 2.675, 1.005, 0.0433, 0.0, 1e15, 123456.78905, -0.00015, -2.5]
    for digits in (0, 1, 2, 4):
        rounded = evaluate(spark, numbers, "double", lambda c: round_even(c, digits))
        assert rounded == [round(x, digits) for x in numbers]
    assert evaluate(spark, [0.125, 2.5, 1.005], "double", lambda c: round_scaled(c, 2)) == [0.12, 2.5, 1.0]


def test_parse_currency(spark):
    texts = ["£1,200", "$500.00", "€ 7", "1200", "-£25.50", "abc", "", "1.2.3", "£"]
    assert evaluate(spark, texts, "string", parse_currency) == [1200.0, 500.0, 7.0, 1200.0, -25.5, None, None, None, None]


def test_dates(spark):
    texts = [
        "2024-01-15", "15/01/2024", "01/15/2024", "03/05/2024", "15-01-2024", "January 5 2024", "5 Jan 2024",
        "2024-01-15 06:30:00", "2024-02-30", "31/02/2024", "soon",
    ]
    shown = evaluate(spark, texts, "string", lambda c: format_date(parse_date(c), "%Y-%m-%d"))
    assert shown == [
        "2024-01-15", "2024-01-15", "2024-01-15", "2024-05-03", "2024-01-15", "2024-01-05", "2024-01-05",
        "2024-01-15", None, None, None,
    ]
    doubtful = evaluate(spark, ["2024-01-05", "2024-01-15", "2024-05-05", "03/05/2024", "15/05/2024", "5 Jan 2024"], "string", is_ambiguous)
    assert doubtful == [True, False, False, True, False, False]


def test_date_format_codes():
    assert spark_pattern("%d-%m-%y") == "dd-MM-yy"
    assert spark_pattern("%d of %B") == "dd 'o''f' MMMM"
    with pytest.raises(ValueError):
        spark_pattern("%Q")


def test_identifiers(spark):
    parsed = evaluate(spark, ["POL-00001", "Q0042", "000999", "A1B", " X9 "], "string", parse_identifier)
    assert [p and (p["prefix"], int(p["number"]), p["width"]) for p in parsed] == [
        ("POL-", 1, 5), ("Q", 42, 4), ("", 999, 6), None, ("X", 9, 1),
    ]
    rendered = evaluate(
        spark, [7, 12345], "int", lambda c: render_identifier(F.lit("P-"), c.cast("decimal(38,0)"), F.lit(4))
    )
    assert rendered == ["P-0007", "P-12345"]
