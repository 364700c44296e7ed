"""Review decisions as set operations on the proposals table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataheal.operators.proposals import APPROVED, PENDING, REJECTED, is_standard_cleaning

DECISION_SCHEMA = "id string, decision string, decided_at timestamp"


def _first_decisions(decisions: DataFrame) -> DataFrame:
    """The earliest valid decision per proposal, one without a time before all others; equally early ones by name.

    Times and flags are kept by decision, since the least pair of a time and a text would be found by sorting.
    """
    made = lambda d: F.col("decision") == d
    at = lambda d: F.min(F.when(made(d), F.col("decided_at")))
    # null where no such decision was made
    undated = lambda d: F.max(F.when(made(d), F.col("decided_at").isNull()))
    found = decisions.groupBy("id").agg(
        at(APPROVED).alias("approved_at"), undated(APPROVED).alias("approved_undated"),
        at(REJECTED).alias("rejected_at"), undated(REJECTED).alias("rejected_undated"),
    )
    approved = (
        F.when(F.col("approved_undated").isNull(), False)
        .when(F.col("rejected_undated").isNull() | F.col("approved_undated"), True)
        .otherwise(~F.col("rejected_undated") & (F.col("approved_at") <= F.col("rejected_at")))
    )
    dated = lambda d: F.when(~F.col(f"{d}_undated"), F.col(f"{d}_at"))
    return found.select(
        "id",
        F.when(approved, dated(APPROVED)).otherwise(dated(REJECTED)).alias("decided_at"),
        F.when(approved, APPROVED).otherwise(REJECTED).alias("decision"),
    )


def apply_decisions(proposals: DataFrame, decisions: DataFrame, one_each: bool = False) -> DataFrame:
    """Proposals after ``decisions (id, decision, decided_at)``.

    Only a pending proposal changes, and only by its first decision. ``one_each`` says that the decisions are first
    ones already, so that they are not searched again.
    """
    valid = decisions.filter(F.col("decision").isin(APPROVED, REJECTED))
    joined = proposals.join(valid if one_each else _first_decisions(valid), "id", "left")
    takes = (F.col("status") == PENDING) & F.col("decision").isNotNull()
    return joined.withColumns(
        {
            "status": F.when(takes, F.col("decision")).otherwise(F.col("status")),
            "user_decision": F.when(takes, F.col("decision")).otherwise(F.col("user_decision")),
            "reviewed_at": F.when(takes, F.col("decided_at")).otherwise(F.col("reviewed_at")),
        }
    ).select(*proposals.columns)


def decision_errors(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decisions that do not take effect, each with its reason.

    ``invalid`` is neither approval nor rejection, ``not_found`` names no proposal, and
    ``conflict`` meets a proposal that was already decided, by the table or an earlier decision.
    """
    valid = F.col("decision").isin(APPROVED, REJECTED)
    first = _first_decisions(decisions.filter(valid)).select(
        "id", F.col("decided_at").alias("first_at"), F.col("decision").alias("first_decision")
    )
    known = proposals.select("id", "status")
    is_first = F.col("decided_at").eqNullSafe(F.col("first_at")) & (
        F.col("decision") == F.col("first_decision")
    )
    now = F.when(F.col("status") != PENDING, F.col("status")).when(~is_first, F.col("first_decision"))
    error = (
        F.when(~valid, "invalid").when(F.col("status").isNull(), "not_found").when(now.isNotNull(), "conflict")
    )
    message = (
        F.when(error == "invalid", F.format_string("'%s' is neither approval nor rejection.", F.col("decision")))
        .when(error == "not_found", F.format_string("There is no proposal '%s'.", F.col("id")))
        .otherwise(
            F.format_string(
                "An earlier review left this proposal '%s'; a decision needs a pending one.",
                now,
            )
        )
    )
    return (
        decisions.join(first, "id", "left")
        .join(known, "id", "left")
        .select("id", "decision", "decided_at", error.alias("error"), message.alias("message"))
        .filter(F.col("error").isNotNull())
    )


def bulk_review_cleaning(proposals: DataFrame, decision: str, session_id: str | None = None) -> DataFrame:
    """Decide every pending formatting proposal of a session at once."""
    if decision not in (APPROVED, REJECTED):
        raise ValueError(f"A review approves or rejects; {decision!r} does neither.")
    takes = (F.col("status") == PENDING) & is_standard_cleaning()
    if session_id is not None:
        takes = takes & (F.col("session_id") == session_id)
    return proposals.withColumns(
        {
            "user_decision": F.when(takes, decision).otherwise(F.col("user_decision")),
            "reviewed_at": F.when(takes, F.current_timestamp()).otherwise(F.col("reviewed_at")),
            "status": F.when(takes, decision).otherwise(F.col("status")),
        }
    ).select(*proposals.columns)


def bulk_review_result(proposals: DataFrame, decision: str, session_id: str | None = None) -> DataFrame:
    """The ids a bulk review changes."""
    if decision not in (APPROVED, REJECTED):
        raise ValueError(f"A review approves or rejects; {decision!r} does neither.")
    takes = (F.col("status") == PENDING) & is_standard_cleaning()
    if session_id is not None:
        takes = takes & (F.col("session_id") == session_id)
    return proposals.filter(takes).select("id", F.lit(decision).alias("decision"))
