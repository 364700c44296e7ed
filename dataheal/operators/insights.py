"""Ready-made insights: one grouped aggregation, described by eight catalogue entries.

An insight over two datasets needs their inner join only to weigh groups and measures against
each other. Both sides are therefore summed per key first, and the sums are joined: a key that
holds a third of the rows on both sides becomes one row per group, not a product of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.numbers import exact_sum, round_scaled
from dataheal.functions.text import parse_currency
from dataheal.operators.joins import detect_join_pairs
from dataheal.operators.profile import union_all
from dataheal.session import local_frame


@dataclass(frozen=True)
class Insight:
    id: str
    name: str
    group: str
    measure: str | None
    # Output name -> "mean" | "sum" | "count" (non-null measures) | "rows".
    outputs: dict[str, str]
    # Output column to sort by, descending; the group key sorts otherwise and breaks ties.
    order_by: str | None
    confidence: str
    cross_dataset: bool

    @property
    def explanation(self) -> str:
        """What the insight shows and when it can be made."""
        where = "one row of each dataset joined on their key" if self.cross_dataset else "one dataset"
        figures = ", ".join(name.replace("_", " ") for name in self.outputs)
        return f"By {self.group.replace('_', ' ')}: {figures}, from {where}; needs {' and '.join(self.required)}."

    @property
    def required(self) -> list[str]:
        return sorted({self.group, *([self.measure] if self.measure else [])})


# Insight ids, titles, columns and output names.
INSIGHTS = (
    Insight(
        "avg_claim_by_ncd", "Average claim amount by NCD band", "ncd", "claim_amount",
        {"avg_claim_amount": "mean", "claim_count": "count"}, None, "High", True,
    ),
    Insight(
        "claim_freq_by_product", "Claim frequency by product type", "product_type", "claim_amount",
        {"claim_count": "count", "total_claim_amount": "sum"}, "claim_count", "High", True,
    ),
    Insight(
        "claim_by_postcode", "Claim volume by postcode area", "postcode", "claim_amount",
        {"claim_count": "count", "avg_claim_amount": "mean"}, "claim_count", "Medium", True,
    ),
    Insight(
        "premium_by_postcode", "Average premium by postcode", "postcode", "premium",
        {"avg_premium": "mean", "policy_count": "count"}, "avg_premium", "High", False,
    ),
    Insight(
        "policy_by_product", "Policy count by product type", "product_type", None,
        {"policy_count": "rows"}, "policy_count", "High", False,
    ),
    Insight(
        "avg_premium_by_ncd", "Average premium by NCD band", "ncd", "premium",
        {"avg_premium": "mean", "policy_count": "count"}, None, "High", False,
    ),
    Insight(
        "claims_by_type", "Claim distribution by type", "claim_type", None,
        {"claim_count": "rows"}, "claim_count", "High", False,
    ),
    Insight(
        "avg_claim_by_type", "Average claim cost by type", "claim_type", "claim_amount",
        {"avg_claim_amount": "mean", "claim_count": "count"}, "avg_claim_amount", "High", False,
    ),
)
BY_ID = {i.id: i for i in INSIGHTS}


class InsightError(ValueError):
    """The insight does not exist or its columns are not there."""


def catalogue(spark) -> DataFrame:
    rows = [(n, i.id, i.name, i.required, i.confidence, i.cross_dataset, i.explanation) for n, i in enumerate(INSIGHTS)]
    return local_frame(
        spark,
        rows,
        "place int, id string, name string, required array<string>, confidence string, cross_dataset boolean, explanation string",
    )


def match_insight_rules(columns: DataFrame, cross: bool) -> DataFrame:
    """Insights whose columns are all there.

    ``columns`` has an ``owner`` (a dataset, or a pair) and its ``columns`` in lower case.
    """
    needs = (
        catalogue(columns.sparkSession)
        .filter(F.col("cross_dataset") == cross)
        .withColumn("column", F.explode("required"))
    )
    have = columns.select("owner", F.explode(F.array_distinct("columns")).alias("column"))
    met = have.join(F.broadcast(needs), "column")
    return (
        met.groupBy("owner", "place", "id", "name", "required", "confidence", "explanation")
        .agg(F.count("*").alias("met"))
        .filter(F.col("met") == F.size("required"))
        .drop("met")
    )


def applicable(columns: list[str], cross: bool) -> list[Insight]:
    """As :func:`match_insight_rules`, for one column list at plan time."""
    have = {c.lower() for c in columns}
    return [i for i in INSIGHTS if i.cross_dataset is cross and have.issuperset(i.required)]


# ── joining ────────────────────────────────────────────────────────────────


def insight_join(a: Dataset, b: Dataset, key: str, nullsafe: bool = False) -> DataFrame:
    """Inner join on ``key``; a name on both sides, whatever its case, keeps A's column, B's gets ``_joined``.

    Null keys match only with ``nullsafe``.
    """
    held = {c.lower() for c in a.columns}
    right = b.df.select(
        b.col(key).alias("_right_key"),
        *[b.col(c).alias(f"{c}_joined" if c.lower() in held else c) for c in b.columns if c != key],
    )
    left = a.df.select(*[a.col(c) for c in a.columns])
    of_left = left[f"`{key}`"]
    match = of_left.eqNullSafe(right["_right_key"]) if nullsafe else of_left == right["_right_key"]
    return left.join(right, match).drop("_right_key")


def _find(ds: Dataset, name: str) -> str | None:
    return next((c for c in ds.columns if c.lower() == name), None)


def _measure(ds: Dataset, column: str) -> Column:
    """The measure as a number; money text is read as an amount."""
    if isinstance(ds.dtype(column), T.NumericType):
        return ds.value(column).cast("double")
    return parse_currency(ds.col(column))


def _finish(grouped: DataFrame, insight: Insight) -> DataFrame:
    """``(group, rows, count, sum)`` to the insight's columns and order."""
    total = F.col("_sum").cast("double")
    made = {
        "mean": round_scaled(total / F.nullif(F.col("_count"), F.lit(0)), 2),
        "sum": round_scaled(F.coalesce(total, F.lit(0.0)), 2),
        "count": F.col("_count"),
        "rows": F.col("_rows"),
    }
    table = grouped.filter(F.col("_group").isNotNull()).select(
        F.col("_group").alias(insight.group), *[made[how].alias(out) for out, how in insight.outputs.items()]
    )
    order = [F.desc_nulls_last(insight.order_by)] if insight.order_by else []
    return table.orderBy(*order, insight.group)


def single_insight(ds: Dataset, insight: Insight) -> DataFrame:
    group = _find(ds, insight.group)
    measure = insight.measure and _find(ds, insight.measure)
    if group is None or (insight.measure and measure is None):
        raise InsightError(f"'{ds.name}' lacks a column of {insight.required}")
    value = _measure(ds, measure) if measure else F.lit(None).cast("double")
    grouped = ds.df.select(ds.value(group).alias("_group"), value.alias("_value")).groupBy("_group").agg(
        F.count("*").alias("_rows"), F.count("_value").alias("_count"), exact_sum(F.col("_value")).alias("_sum")
    )
    return _finish(grouped, insight)


def joined_insight(a: Dataset, b: Dataset, key: str, insight: Insight) -> DataFrame:
    """The insight over the inner join of two datasets, from per-key sums of each."""
    if key not in a.columns or key not in b.columns:
        raise InsightError(f"join key '{key}' is not in both datasets")
    group_side = next((d for d in (a, b) if _find(d, insight.group)), None)
    value_side = next((d for d in (a, b) if insight.measure and _find(d, insight.measure)), group_side)
    if group_side is None or (insight.measure and not _find(value_side, insight.measure)):
        raise InsightError(f"neither dataset has the columns {insight.required}")
    other = lambda d: b if d is a else a

    def key_of(ds: Dataset) -> Column:
        return (ds.value(key) if a.dtype(key) == b.dtype(key) else ds.text(key)).alias("_key")

    group = group_side.value(_find(group_side, insight.group)).alias("_group")
    value = (
        _measure(value_side, _find(value_side, insight.measure)) if insight.measure else F.lit(None).cast("double")
    ).alias("_value")
    sums = [F.count("*").alias("_rows"), F.count("_value").alias("_count"), exact_sum(F.col("_value")).alias("_sum")]
    if group_side is value_side:
        grouped = group_side.df.select(key_of(group_side), group, value).groupBy("_key", "_group").agg(*sums)
        weights = other(group_side).df.select(key_of(other(group_side)))
    else:
        grouped = value_side.df.select(key_of(value_side), value).groupBy("_key").agg(*sums)
        weights = group_side.df.select(key_of(group_side), group)
    weight_keys = [c for c in ("_key", "_group") if c in weights.columns]
    weighted = weights.groupBy(*weight_keys).agg(F.count("*").alias("_weight"))
    scaled = lambda c: F.sum(F.col(c) * F.col("_weight")).alias(c)
    return _finish(
        grouped.filter(F.col("_key").isNotNull())
        .join(weighted, "_key")
        .groupBy("_group")
        .agg(scaled("_rows"), scaled("_count"), scaled("_sum")),
        insight,
    )


def generate_insight(
    insight_id: str, a: Dataset, b: Dataset | None = None, key: str | None = None
) -> DataFrame:
    insight = BY_ID.get(insight_id)
    if insight is None:
        raise InsightError(f"There is no insight '{insight_id}'.")
    if not insight.cross_dataset:
        return single_insight(a, insight)
    if b is None or not key:
        raise InsightError("This insight joins two datasets: give the second one and the key.")
    return joined_insight(a, b, key, insight)


# ── the session ────────────────────────────────────────────────────────────


def join_reports(datasets: dict[str, Dataset], cfg: QualityConfig) -> DataFrame | None:
    """Join quality per pair with the insights the pair enables, in catalogue order."""
    reports = detect_join_pairs(datasets, cfg)
    if reports is None:
        return None
    rows = []
    names = list(datasets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            found = applicable(datasets[a].columns + datasets[b].columns, cross=True)
            rows.append((i, a, b, [f.id for f in found], [f.name for f in found]))
    offered = local_frame(
        reports.sparkSession,
        rows,
        "pair_order int, dataset_a string, dataset_b string, insight_ids array<string>, insight_names array<string>",
    )
    return reports.join(F.broadcast(offered), ["dataset_a", "dataset_b"])


def single_dataset_insights(datasets: dict[str, Dataset]) -> DataFrame:
    spark = next(iter(datasets.values())).df.sparkSession
    owned = local_frame(
        spark,
        [(n, [c.lower() for c in d.columns]) for n, d in datasets.items()],
        "owner string, columns array<string>",
    )
    return match_insight_rules(owned, cross=False).withColumnRenamed("owner", "dataset")


def analyse_joins(datasets: dict[str, Dataset], cfg: QualityConfig) -> DataFrame:
    """Every insight a session offers: per joinable pair, and per single dataset."""
    parts = []
    reports = join_reports(datasets, cfg)
    if reports is not None:
        parts.append(
            reports.select(
                F.lit("join").alias("scope"), "dataset_a", "dataset_b", "join_key", "match_rate",
                F.explode_outer("insight_ids").alias("insight_id"),
            )
        )
    none = F.lit(None)
    parts.append(
        single_dataset_insights(datasets).select(
            F.lit("single").alias("scope"), F.col("dataset").alias("dataset_a"),
            none.cast("string").alias("dataset_b"), none.cast("string").alias("join_key"),
            none.cast("double").alias("match_rate"), F.col("id").alias("insight_id"),
        )
    )
    return union_all(parts)
