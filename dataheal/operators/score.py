"""Reliability scoring: every deduction is a row, the score is their sum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.functions.numbers import round_even
from dataheal.functions.text import percent

SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def severity_rank(col: Column) -> Column:
    return reduce(lambda c, kv: c.when(col == kv[0], kv[1]), SEVERITY_ORDER.items(), F).otherwise(9)


def tier_points(rate: Column, tiers: tuple[tuple[float, int], ...]) -> Column:
    """Points of the first tier whose threshold the rate exceeds, else null."""
    return reduce(lambda c, tier: c.when(rate > tier[0], tier[1]), tiers, F)


def tier_penalty(profile: DataFrame, cfg: QualityConfig) -> DataFrame:
    return profile.select("name", "null_pct", tier_points(F.col("null_pct"), cfg.null_tiers).alias("points"))


def _penalty(kind: str, points: Column, severity: Column | str, reason: Column, rate: Column) -> Column:
    """The penalty struct, null where ``points`` is null."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    body = F.struct(
        F.lit(kind).alias("kind"),
        points.cast("double").alias("points_deducted"),
        sev.alias("severity"),
        reason.alias("reason"),
        rate.cast("double").alias("rate"),
    )
    return F.when(points.isNotNull(), body)


def _column_penalties(cfg: QualityConfig) -> list[Column]:
    # The reason texts of the report.
    kind, nulls, pct = F.col("inferred_type"), F.col("null_count"), F.col("null_pct")
    critical = F.col("is_critical_field")
    named = lambda text, *args: F.format_string(f"Column '%s': {text}", F.col("name"), *args)
    no_rate = F.lit(None)
    non_null = F.col("row_count") - nulls
    outlier_rate = F.col("outlier_count") / F.nullif(non_null, F.lit(0))
    formats = F.size("date_formats_detected")
    return [
        _penalty(
            "null",
            tier_points(pct, cfg.null_tiers),
            F.when(critical, "high").otherwise("medium"),
            named("%s of values are null (%d missing).", percent(pct, 1), nulls),
            pct,
        ),
        _penalty(
            "critical_null",
            F.when(critical & (nulls > 0), cfg.critical_null_points),
            "critical",
            F.format_string(
                "Critical field '%s' has %d null value(s) — heavy penalty applied.", F.col("name"), nulls
            ),
            pct,
        ),
        _penalty(
            "casing",
            F.when(
                (kind == "categorical") & (F.col("casing_inconsistency_count") > 0), cfg.casing_points
            ),
            "low",
            named(
                "%d value(s) have inconsistent casing (mixed upper / lower case).",
                F.col("casing_inconsistency_count"),
            ),
            no_rate,
        ),
        _penalty(
            "date_formats",
            F.when((kind == "date") & (formats > 1), cfg.date_formats_points),
            "medium",
            named(
                "%d different date formats detected (%s).",
                formats,
                F.array_join("date_formats_detected", ", "),
            ),
            no_rate,
        ),
        _penalty(
            "invalid_dates",
            F.when((kind == "date") & (F.col("invalid_date_count") > 0), cfg.invalid_date_points),
            "medium",
            named("%d value(s) did not match any recognised date format.", F.col("invalid_date_count")),
            no_rate,
        ),
        _penalty(
            "outliers",
            F.when(
                (kind == "numeric") & (F.col("outlier_count") > 0) & (outlier_rate > cfg.outlier_rate),
                cfg.outlier_points,
            ),
            "low",
            named(
                "%d statistical outlier(s) detected (%s of non-null values).",
                F.col("outlier_count"),
                percent(outlier_rate, 1),
            ),
            outlier_rate,
        ),
    ]


PENALTY_COLUMNS = (
    "dataset", "ordinal", "column", "penalty_order", "kind", "points_deducted", "severity", "reason", "rate",
)


def penalties(profile: DataFrame, rows: DataFrame, cfg: QualityConfig) -> DataFrame:
    """All deductions of one or more profiled datasets.

    ``rows`` holds the dataset profiles (``dataset, duplicate_row_count, duplicate_row_pct``).
    """
    pct, count = F.col("duplicate_row_pct"), F.col("duplicate_row_count")
    duplicate = _penalty(
        "duplicates",
        F.when(count > 0, tier_points(pct, cfg.duplicate_tiers)),
        "high",
        F.format_string("Duplicate rows: %d row(s) (%s) are exact duplicates.", count, percent(pct, 1)),
        pct,
    )
    whole = rows.select(
        "dataset",
        F.lit(-1).alias("ordinal"),
        F.lit(None).cast("string").alias("column"),
        F.lit(0).alias("penalty_order"),
        F.inline(F.array_compact(F.array(duplicate))),
    )
    exploded = profile.select(
        "dataset", "ordinal", F.col("name").alias("column"),
        F.posexplode(F.array(*_column_penalties(cfg))).alias("penalty_order", "p"),
    )
    per_column = exploded.filter("p IS NOT NULL").select(
        "dataset", "ordinal", "column", "penalty_order", "p.*"
    )
    return whole.unionByName(per_column).select(*PENALTY_COLUMNS)


def critical_field_issues(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("is_critical_field") & (F.col("null_count") > 0)).select(
        "dataset",
        "ordinal",
        F.col("name").alias("field"),
        "null_count",
        "null_pct",
        F.format_string(
            "Critical field '%s' has %d null value(s) — heavy penalty applied.",
            F.col("name"),
            F.col("null_count"),
        ).alias("detail"),
    )


def grade(score: Column, green: float, amber: float) -> Column:
    return F.when(score >= green, "Green").when(score >= amber, "Amber").otherwise("Red")


def score_dataset(profile: DataFrame, rows: DataFrame, cfg: QualityConfig) -> DataFrame:
    """One row per dataset: score, grade and a one-line summary."""
    lost = penalties(profile, rows, cfg).groupBy("dataset").agg(
        F.sum("points_deducted").alias("points"),
        F.count("*").alias("issue_count"),
        F.sort_array(
            F.collect_list(F.when(F.col("kind") == "critical_null", F.struct("ordinal", "column")))
        ).alias("critical"),
    )
    points = F.coalesce("points", F.lit(0.0))
    score = F.greatest(F.lit(0.0), round_even(100.0 - points, 1))
    issues = F.coalesce("issue_count", F.lit(0))
    fields = F.array_join(F.transform("critical", lambda c: c["column"]), ", ")
    scored = (
        rows.join(lost, "dataset", "left")
        .withColumn("score", score)
        .withColumn("grade", grade(F.col("score"), cfg.grade_green, cfg.grade_amber))
    )
    return scored.select(
        "dataset",
        "row_count",
        "score",
        "grade",
        issues.alias("issue_count"),
        F.concat(
            F.format_string(
                "Score %.1f/100 (%s). %d issue(s) found, %.1f point(s) deducted.",
                F.col("score"),
                F.col("grade"),
                issues,
                100.0 - F.col("score"),
            ),
            F.when(
                F.size("critical") > 0,
                F.concat(F.lit(" Critical fields with null values: "), fields, F.lit(".")),
            ).otherwise(""),
        ).alias("summary"),
    )


def issues_by_severity(penalty_rows: DataFrame) -> DataFrame:
    return penalty_rows.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "severity_rank", "dataset", "ordinal", "penalty_order"
    )


def session_average_score(scores: DataFrame, cfg: QualityConfig) -> DataFrame:
    mean = scores.agg(F.avg("score").alias("average_score"), F.sum("issue_count").alias("issue_count"))
    return mean.select(
        "average_score",
        grade(F.col("average_score"), cfg.overall_green, cfg.overall_amber).alias("grade"),
        "issue_count",
    )
