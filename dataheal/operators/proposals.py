"""The common proposal record, its summaries and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataheal.session import local_frame

# Proposal types, source methods and review states.
CROSS_DATASET_FILL = "cross_dataset_fill"
INTERPOLATION = "interpolation"
DATA_CORRECTION = "data_correction"
STANDARD_CLEANING = ("format_correction", "date_format_standardisation", "value_cleaning")
PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"

# ``seq`` is the place of the generator in the pipeline; with ``row_index`` it fixes the order
# in which equally confident proposals were made.
PROPOSAL_SCHEMA = (
    "id string, session_id string, proposal_type string, source_method string, "
    "dataset_name string, row_index bigint, row_identifier string, column_name string, "
    "original_value string, proposed_value string, explanation string, confidence double, "
    "status string, source_dataset string, source_column string, join_key string, "
    "join_value string, created_at timestamp, reviewed_at timestamp, user_decision string, seq int"
)


def build_proposal(
    rows: DataFrame,
    *,
    session_id: str,
    proposal_type: str,
    source_method: Column | str,
    dataset_name: Column | str,
    column_name: Column | str,
    original_value: Column | None,
    proposed_value: Column,
    explanation: Column,
    confidence: Column | float,
    row_identifier: Column,
    seq: Column | int = 0,
    source_dataset: Column | str | None = None,
    source_column: Column | str | None = None,
    join_key: Column | str | None = None,
    join_value: Column | None = None,
) -> DataFrame:
    """Project ``rows``, which carry ``row_index``, onto the proposal record."""
    text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    body = rows.select(
        F.lit(session_id).alias("session_id"),
        F.lit(proposal_type).alias("proposal_type"),
        text(source_method).alias("source_method"),
        F.lit(dataset_name).alias("dataset_name"),
        F.col("row_index").cast("bigint").alias("row_index"),
        text(row_identifier).alias("row_identifier"),
        text(column_name).alias("column_name"),
        text(original_value).alias("original_value"),
        text(proposed_value).alias("proposed_value"),
        explanation.alias("explanation"),
        F.round(F.lit(confidence).cast("double"), 3).alias("confidence"),
        F.lit(PENDING).alias("status"),
        text(source_dataset).alias("source_dataset"),
        text(source_column).alias("source_column"),
        text(join_key).alias("join_key"),
        text(join_value).alias("join_value"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.lit(None).cast("string").alias("user_decision"),
        F.lit(seq).cast("int").alias("seq"),
    )
    identity = F.sha2(
        F.concat_ws(
            "\x1f", "session_id", "dataset_name", "column_name", F.col("row_index").cast("string"),
            "source_method", "proposed_value", "explanation",
        ),
        256,
    )
    return body.select(identity.alias("id"), "*")


def no_proposals(spark) -> DataFrame:
    return local_frame(spark, [], PROPOSAL_SCHEMA)


def session_proposals(proposals: DataFrame, session_id: str) -> DataFrame:
    """A session's proposals, most confident first, then in the order they were made."""
    return proposals.filter(F.col("session_id") == session_id).orderBy(
        F.desc("confidence"), "seq", "dataset_name", "row_index", "column_name"
    )


def proposals_summary(proposals: DataFrame) -> DataFrame:
    """Counts per type plus a total row (type null), with confidence bands, in one pass."""
    level = F.col("confidence")
    return (
        proposals.rollup("proposal_type")
        .agg(
            F.count("*").alias("total"),
            F.count_if(level >= 0.80).alias("high"),
            F.count_if((level >= 0.60) & (level < 0.80)).alias("medium"),
            F.count_if(level < 0.60).alias("low"),
        )
        .select(
            F.coalesce("proposal_type", F.lit("all")).alias("proposal_type"), "total", "high", "medium", "low"
        )
    )


def filter_proposals(
    proposals: DataFrame, dataset: str | None = None, type_: str | None = None, status: str | None = None
) -> DataFrame:
    """Rows that meet every given condition; ``status='all'`` is no condition."""
    wanted = {"dataset_name": dataset, "proposal_type": type_, "status": None if status == "all" else status}
    for column, value in wanted.items():
        if value:
            proposals = proposals.filter(F.col(column) == value)
    return proposals


def status_counts(proposals: DataFrame) -> DataFrame:
    by_status = {s: F.count_if(F.col("status") == s).alias(s) for s in (PENDING, APPROVED, REJECTED)}
    return proposals.agg(F.count("*").alias("all"), *by_status.values())


def filter_options(proposals: DataFrame) -> DataFrame:
    """The distinct datasets and types a reviewer can filter by, sorted."""
    pairs = F.array(
        F.struct(F.lit("dataset").alias("option"), F.col("dataset_name").alias("value")),
        F.struct(F.lit("type").alias("option"), F.col("proposal_type").alias("value")),
    )
    return proposals.select(F.inline(pairs)).distinct().orderBy("option", "value")


def is_standard_cleaning() -> Column:
    return F.col("source_method").isin(*STANDARD_CLEANING)


def standard_cleaning_breakdown(proposals: DataFrame) -> DataFrame:
    """Status counts per method; methods outside standard cleaning are reviewed one by one."""
    return (
        proposals.groupBy("source_method")
        .agg(
            F.count("*").alias("total"),
            *[F.count_if(F.col("status") == s).alias(s) for s in (PENDING, APPROVED, REJECTED)],
        )
        .select(
            "source_method",
            F.when(is_standard_cleaning(), "standard_cleaning").otherwise("individual").alias("review"),
            "total",
            PENDING,
            APPROVED,
            REJECTED,
        )
    )
