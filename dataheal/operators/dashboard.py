"""Executive roll-up of a session. Works on scores, penalties and join reports only, so every
frame here is as small as the list of datasets, columns or dataset pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.functions.numbers import round_even
from dataheal.functions.text import title_case, words
from dataheal.operators.score import grade, severity_rank


def overall_score(scores: DataFrame, cfg: QualityConfig) -> DataFrame:
    """Mean score weighted by rows; the plain mean of an empty session."""
    rows = F.sum("row_count")
    weighted = F.sum(F.col("score") * F.col("row_count")) / F.nullif(rows, F.lit(0))
    mean = scores.agg(F.coalesce(weighted, F.avg("score")).alias("mean"), F.count("*").alias("dataset_count"))
    return mean.select(
        round_even(F.col("mean"), 1).alias("overall_score"),
        grade(F.col("mean"), cfg.overall_green, cfg.overall_amber).alias("grade"),
        "dataset_count",
        F.col("mean").alias("exact_score"),
    )


def rag_summary(scores: DataFrame) -> DataFrame:
    having = lambda g: F.count_if(F.col("grade") == g).alias(g.lower())
    return scores.agg(having("Green"), having("Amber"), having("Red"), F.count("*").alias("total"))


# ── alerts ─────────────────────────────────────────────────────────────────


def alert_text() -> Column:
    """A sentence for a penalty, from ``kind, severity, column, dataset, rate, reason``."""
    column = title_case(F.replace("column", F.lit("_"), F.lit(" ")))
    dataset = title_case(words(F.col("dataset")))
    share = F.format_string("%.0f%%", F.rint(F.col("rate") * 100))
    kind = F.col("kind")
    # The sentences of the report.
    return (
        F.when(
            kind == "critical_field",
            F.format_string(
                "%s has %s missing values in %s — this is a critical insurance field", column, share, dataset
            ),
        )
        .when(
            kind == "critical_null",
            F.format_string(
                "%s has %s missing values in %s — may impact pricing accuracy and regulatory compliance",
                column, share, dataset,
            ),
        )
        .when(kind == "null", F.format_string("%s has %s missing values in %s", column, share, dataset))
        .when(
            kind == "duplicates",
            F.format_string(
                "%s contains duplicate rows — may indicate data entry errors or system duplication", dataset
            ),
        )
        .when(
            kind == "outliers",
            F.format_string(
                "%s in %s has statistical outliers — review for data entry errors or genuine anomalies",
                column, dataset,
            ),
        )
        .when(
            kind == "casing",
            F.format_string(
                "%s in %s has inconsistent text formatting — affects data matching and reporting accuracy",
                column, dataset,
            ),
        )
        .when(
            kind.isin("date_formats", "invalid_dates"),
            F.format_string(
                "Date columns in %s use mixed formats — standardisation required for time-series analysis",
                dataset,
            ),
        )
        .otherwise(F.col("reason"))
    )


def penalty_alerts(penalties: DataFrame) -> DataFrame:
    return penalties.withColumn("alert_text", alert_text())


def critical_alerts(
    penalties: DataFrame, critical_fields: DataFrame, cfg: QualityConfig, order: list[str]
) -> DataFrame:
    """The most urgent alert per dataset and column, at most ``max_alerts`` of them."""
    serious = penalties.filter(F.col("severity").isin("critical", "high")).select(
        "dataset", "column", "kind", "severity", "reason", "rate", "ordinal", "penalty_order",
        F.col("points_deducted").alias("points_impact"),
    )
    fields = critical_fields.select(
        "dataset",
        F.col("field").alias("column"),
        F.lit("critical_field").alias("kind"),
        F.lit("critical").alias("severity"),
        F.col("detail").alias("reason"),
        F.col("null_pct").alias("rate"),
        "ordinal",
        F.lit(99).alias("penalty_order"),
        F.lit(float(cfg.critical_alert_points)).alias("points_impact"),
    )
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("dataset"))
    ranked = serious.unionByName(fields).withColumns(
        {"urgency": severity_rank(F.col("severity")), "place": place}
    )
    tie = [F.asc("urgency"), F.desc("points_impact"), F.asc("place"), F.asc("ordinal"), F.asc("penalty_order")]
    once = Window.partitionBy("dataset", F.coalesce("column", F.lit(""))).orderBy(*tie)
    return (
        ranked.withColumn("_rank", F.row_number().over(once))
        .filter("_rank = 1")
        .orderBy(*tie)
        .limit(cfg.max_alerts if cfg.max_alerts is not None else 2**31 - 1)
        .select(
            "severity", "dataset", F.coalesce("column", F.lit("")).alias("column"),
            alert_text().alias("alert_text"), "points_impact", "urgency", "place", "ordinal",
        )
    )


# ── opportunities ──────────────────────────────────────────────────────────


OPPORTUNITY = (
    "struct<dataset_a:string,dataset_b:string,join_key:string,match_rate:int,insights_count:int,"
    "business_summary:string,top_insights:array<string>>"
)


def join_opportunities(reports: DataFrame, cfg: QualityConfig) -> DataFrame:
    """The most valuable joins: match rate and number of insights, weighted; ties by the pair's place.

    ``total`` counts all opportunities, of which ``max_opportunities`` (``None``: all) are shown.
    """
    insights = F.size("insight_ids")
    most = reports.agg(F.greatest(F.max(F.size("insight_ids")), F.lit(1)))
    value = F.col("match_rate") * cfg.match_weight + insights / most.scalar() * cfg.insight_weight
    a, b = words(F.lower("dataset_a")), words(F.lower("dataset_b"))
    examples = F.array_join(F.transform(F.slice("insight_names", 1, 2), F.lower), " and ")
    text = F.when(
        insights > 0, F.format_string("Combining %s and %s data enables %s", a, b, examples)
    ).otherwise(
        F.format_string(
            "%s and %s records can be linked — %.0f%% of keys match",
            title_case(a), title_case(b), F.rint(F.col("match_rate") * 100),
        )
    )
    ranked = reports.withColumn("value", value).orderBy(F.desc("value"), "pair_order", "dataset_a", "dataset_b")
    if cfg.max_opportunities is not None:
        ranked = ranked.limit(cfg.max_opportunities)
    total = reports.agg(F.count("*").alias("n")).scalar()
    return (
        ranked.select(
            "dataset_a",
            "dataset_b",
            "join_key",
            F.rint(F.col("match_rate") * 100).cast("int").alias("match_rate"),
            insights.alias("insights_count"),
            text.alias("business_summary"),
            F.slice("insight_names", 1, 3).alias("top_insights"),
            "value",
            "pair_order",
            total.alias("total"),
        )
    )


# ── benchmark ──────────────────────────────────────────────────────────────


def benchmark_context(overall: DataFrame, cfg: QualityConfig) -> DataFrame:
    mark = cfg.benchmark_score
    delta = round_even(F.col("exact_score") - mark, 1)
    points = F.format_string("%.0f", F.rint(F.abs(delta)))
    # The three sentences of the report.
    context = (
        F.when(
            delta >= 5,
            F.format_string(
                f"Your data quality is %s points above the industry benchmark of {mark}/100 — maintain "
                "focus on critical field completeness to stay ahead.",
                points,
            ),
        )
        .when(
            delta >= 0,
            f"Your data quality is close to the industry benchmark of {mark}/100. Addressing the critical "
            "alerts above could push you into the Green tier.",
        )
        .otherwise(
            F.format_string(
                f"Your data quality is %s points below the industry benchmark of {mark}/100. Focus on fixing "
                "missing values in critical insurance fields to improve reliability scores.",
                points,
            )
        )
    )
    return overall.select(
        F.col("overall_score").alias("current_score"),
        F.lit(mark).alias("benchmark_score"),
        delta.alias("delta"),
        context.alias("context"),
    )


def dashboard(
    scores: DataFrame,
    penalties: DataFrame,
    critical_fields: DataFrame,
    reports: DataFrame | None,
    cfg: QualityConfig,
    order: list[str],
) -> DataFrame:
    """The whole roll-up as one row; alerts and opportunities are ordered arrays."""
    overall = overall_score(scores, cfg)
    alerts = critical_alerts(penalties, critical_fields, cfg, order)
    packed_alerts = alerts.agg(
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "urgency", (-F.col("points_impact")).alias("most"), "place", "ordinal",
                        "severity", "dataset", "column", "alert_text", "points_impact",
                    )
                )
            ),
            lambda x: F.struct(
                *[x[c].alias(c) for c in ("severity", "dataset", "column", "alert_text", "points_impact")]
            ),
        ).alias("critical_alerts")
    )
    if reports is None:
        opportunities = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast(f"array<{OPPORTUNITY}>").alias("shown"))
    else:
        fields = ("dataset_a", "dataset_b", "join_key", "match_rate", "insights_count", "business_summary", "top_insights")
        best = F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("least"), "pair_order", *fields)))
        shown = F.transform(best, lambda x: F.struct(*[x[f].alias(f) for f in fields])).cast(f"array<{OPPORTUNITY}>")
        packed = join_opportunities(reports, cfg).agg(
            F.struct(F.coalesce(F.max("total"), F.lit(0)).alias("total"), shown.alias("shown")).alias("o")
        )
        opportunities = packed.scalar()
    rag = rag_summary(scores)
    context = benchmark_context(overall, cfg)
    return overall.select(
        "overall_score",
        "grade",
        "dataset_count",
        *[rag.select(c).scalar().alias(c) for c in ("green", "amber", "red", "total")],
        packed_alerts.scalar().alias("critical_alerts"),
        opportunities.alias("join_opportunities"),
        F.lit(cfg.benchmark_score).alias("benchmark_score"),
        context.select("context").scalar().alias("context"),
        F.current_timestamp().alias("generated_at"),
    )
