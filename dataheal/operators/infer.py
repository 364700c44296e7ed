"""Conservative inference from ordered data: annual terms and sequential identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.dates import date_cell, iso_date, iso_timestamp
from dataheal.functions.ids import is_missing_id, parse_identifier, render_identifier
from dataheal.operators.labels import Identifiers, count_identifiers, ordering_column, string_columns
from dataheal.operators.profile import union_all
from dataheal.operators.proposals import INTERPOLATION, build_proposal, no_proposals
from dataheal.sources.positions import with_sorted_positions

ANNUAL_SEQ, SEQUENCE_SEQ = 50, 51


# ── annual terms ───────────────────────────────────────────────────────────


def annual_term_evidence(ds: Dataset, start: str, end: str, cfg: QualityConfig) -> DataFrame:
    """``(both_present, annual_rows, annual_ratio)`` for a pair of date columns."""
    days = F.datediff(date_cell(ds, end).cast("date"), date_cell(ds, start).cast("date"))
    shortest, longest = cfg.annual_days
    counted = ds.df.select(days.alias("days")).agg(
        F.count("days").alias("both_present"),
        F.count_if(F.col("days").between(shortest, longest)).alias("annual_rows"),
    )
    ratio = F.col("annual_rows") / F.nullif(F.col("both_present"), F.lit(0))
    return counted.withColumn("annual_ratio", ratio)


def _annual_pair(
    ds: Dataset, start: str, end: str, cfg: QualityConfig, session_id: str, label: Column
) -> DataFrame:
    evidence = annual_term_evidence(ds, start, end, cfg)
    holds = (F.col("both_present") >= cfg.annual_min_rows) & (F.col("annual_ratio") >= cfg.annual_min_ratio)
    counts = evidence.filter(holds).select(
        F.format_string("%d of %d", F.col("annual_rows"), F.col("both_present"))
    )
    missing = lambda c: ds.text(c).isNull()
    found = (
        ds.df.filter(missing(start) != missing(end))
        .select(
            "row_index",
            label.alias("row_identifier"),
            F.when(missing(end), end).otherwise(start).alias("column"),
            F.when(missing(end), start).otherwise(end).alias("known_column"),
            F.when(missing(end), date_cell(ds, start)).otherwise(date_cell(ds, end)).alias("known"),
            F.when(missing(end), 12).otherwise(-12).alias("months"),
            counts.scalar().alias("evidence"),
        )
        .filter(F.col("known").isNotNull() & F.col("evidence").isNotNull())
    )
    proposed = F.add_months(F.col("known").cast("date"), F.col("months")).cast("string")
    return build_proposal(
        found,
        session_id=session_id,
        proposal_type=INTERPOLATION,
        source_method="date_inference",
        dataset_name=ds.name,
        column_name=F.col("column"),
        original_value=None,
        proposed_value=proposed,
        explanation=F.format_string(
            "'%s' is %s and %s rows with both dates run for a year, so '%s' should be %s.",
            F.col("known_column"), iso_date(F.col("known")), F.col("evidence"), F.col("column"), proposed,
        ),
        confidence=cfg.annual_confidence,
        row_identifier=F.col("row_identifier"),
        seq=ANNUAL_SEQ,
    )


def annual_date_inference(
    ds: Dataset, cfg: QualityConfig, session_id: str = "session", identifiers: Identifiers | None = None
) -> DataFrame:
    """A missing date of a pair is a year from the other, where most rows run for a year."""
    pairs = [(s, e) for s, e in cfg.annual_pairs if s in ds.textual and e in ds.textual]
    if not pairs:
        return no_proposals(ds.df.sparkSession)
    label = (identifiers or count_identifiers(ds, cfg)).label_cell(ds)
    return union_all([_annual_pair(ds, s, e, cfg, session_id, label) for s, e in pairs])


# ── sequential identifiers ─────────────────────────────────────────────────


def identifier_parts(ds: Dataset, column: str) -> DataFrame:
    """``parse_identifier`` over a column: one row per row of the dataset."""
    parsed = parse_identifier(ds.text(column))
    return ds.df.select(
        *ds.row_order,
        ds.col(column).alias("value"),
        parsed["prefix"].alias("prefix"),
        parsed["number"].cast("bigint").alias("number"),
        parsed["width"].alias("width"),
    )


def _in_time_order(ds: Dataset, columns: list[str], ordering: str, label: Column) -> DataFrame:
    """The identifier columns with each row's position in ``(time, row_index)`` order."""
    at = date_cell(ds, ordering)
    ordered = ds.df.select(
        at.isNull().alias("undated"),
        at.alias("at"),
        "row_index",
        label.alias("row_identifier"),
        *[F.when(~is_missing_id(ds.col(c)), ds.col(c)).alias(f"id_{c}") for c in columns],
    )
    return with_sorted_positions(ordered, ["undated", "at", "row_index"], "position")


def _sequence_gaps(placed: DataFrame, column: str) -> DataFrame:
    """Rows without an identifier whose neighbours in time are two apart.

    Each gap meets the rows just before and after it in an equi-join on the position.
    """
    identifier = F.col(f"`id_{column}`")
    gaps = placed.filter(identifier.isNull() & F.col("at").isNotNull())
    sides = gaps.select(
        F.col("position").alias("gap"),
        "row_index",
        "row_identifier",
        F.col("at").alias("gap_at"),
        F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"),
    ).withColumn("position", F.col("gap") + F.col("side"))
    known = placed.filter(identifier.isNotNull()).select("position", identifier.alias("identifier"), "at")
    # Two neighbours per gap at most, put side by side.
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return (
        sides.join(known, "position")
        .groupBy("gap", "row_index", "row_identifier", "gap_at")
        .agg(
            of(-1, "identifier").alias("before"),
            of(1, "identifier").alias("after"),
            of(-1, "at").alias("before_at"),
            of(1, "at").alias("after_at"),
        )
        .filter((F.col("before_at") <= F.col("gap_at")) & (F.col("gap_at") <= F.col("after_at")))
        .withColumn("p", parse_identifier(F.col("before")))
        .withColumn("n", parse_identifier(F.col("after")))
        .filter(
            (F.col("p.prefix") == F.col("n.prefix"))
            & (F.col("p.width") == F.col("n.width"))
            & (F.col("p.number") + 2 == F.col("n.number"))
        )
    )


def sequential_id_inference(
    ds: Dataset, cfg: QualityConfig, session_id: str = "session", identifiers: Identifiers | None = None
) -> DataFrame:
    """A single missing identifier between two that are two apart is the one between them."""
    ordering = ordering_column(ds, cfg)
    if ordering is None:
        return no_proposals(ds.df.sparkSession)
    identifiers = identifiers or count_identifiers(ds, cfg)
    columns = [c for c in identifiers.with_nulls if c in string_columns(ds)]
    if not columns:
        return no_proposals(ds.df.sparkSession)
    placed = _in_time_order(ds, columns, ordering, identifiers.label_cell(ds))

    def one(column: str) -> DataFrame:
        next_number = (F.col("p.number") + 1).cast("decimal(38,0)")
        proposed = render_identifier(F.col("p.prefix"), next_number, F.col("p.width"))
        return build_proposal(
            _sequence_gaps(placed, column),
            session_id=session_id,
            proposal_type=INTERPOLATION,
            source_method="sequential_id_inference",
            dataset_name=ds.name,
            column_name=column,
            original_value=None,
            proposed_value=proposed,
            explanation=F.format_string(
                f"By '{ordering}' the row at %s lies between '%s' (%s) and '%s' (%s), which are two "
                "apart; the one between them is %s.",
                iso_timestamp(F.col("gap_at")), F.col("before"), iso_timestamp(F.col("before_at")),
                F.col("after"), iso_timestamp(F.col("after_at")), proposed,
            ),
            confidence=cfg.sequence_confidence,
            row_identifier=F.col("row_identifier"),
            seq=SEQUENCE_SEQ,
        )

    return union_all([one(c) for c in columns])


def find_interpolation_proposals(
    ds: Dataset, cfg: QualityConfig, session_id: str = "session", identifiers: Identifiers | None = None
) -> DataFrame:
    identifiers = identifiers or count_identifiers(ds, cfg)
    return annual_date_inference(ds, cfg, session_id, identifiers).unionByName(
        sequential_id_inference(ds, cfg, session_id, identifiers)
    )
