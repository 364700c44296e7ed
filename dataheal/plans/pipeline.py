"""A whole session: profile, score, propose, review, export, roll up."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.operators import dashboard as board
from dataheal.operators.apply import LOWEST, MANIFEST_COLUMNS, apply_proposals, with_applied
from dataheal.operators.fill import find_cross_dataset_fills
from dataheal.operators.infer import find_interpolation_proposals
from dataheal.operators.insights import join_reports
from dataheal.operators.labels import profiled_identifiers
from dataheal.operators.profile import duplicate_rows, profile_columns, profile_dataset_row, union_all
from dataheal.operators.proposals import APPROVED, no_proposals, proposals_summary
from dataheal.operators.rules import find_correction_proposals
from dataheal.operators.score import critical_field_issues, penalties, score_dataset
from dataheal.session import local_frame, materialise, shuffles_freed, written
from dataheal.sources.positions import with_sorted_positions
from dataheal.sources.sinks import save_proposals, stored_proposals, write_audit_manifest, write_cleaned

log = logging.getLogger(__name__)
MAX_PARALLEL = 8
#: What an export reads of the proposals.
EXPORTED = ("id", "seq", *MANIFEST_COLUMNS)
DUPLICATES = "dataset string, duplicate_row_count bigint, duplicate_row_pct double"
DATASET_ROW = (
    "dataset string, row_count bigint, column_count bigint, duplicate_row_count bigint, duplicate_row_pct double"
)


class PipelineError(RuntimeError):
    """Profiling or scoring a dataset failed."""


class ExportError(RuntimeError):
    """There is nothing to export."""


@dataclass(frozen=True)
class SessionProfile:
    """Profiles and scores of a session, all as small as its columns and datasets."""

    datasets: dict[str, Dataset]
    columns: DataFrame
    rows: DataFrame
    scores: DataFrame
    penalties: DataFrame
    critical_fields: DataFrame

    def profiled(self, name: str) -> list[Row]:
        return self.columns.filter(F.col("dataset") == name).orderBy("ordinal").collect()


def profile_whole(ds: Dataset, cfg: QualityConfig) -> tuple[DataFrame, DataFrame]:
    """Column profile and dataset row, both held as local frames."""
    with ThreadPoolExecutor(1) as pool:
        counting = pool.submit(duplicate_rows(ds).collect)
        profile = profile_columns(ds, cfg)
    duplicates = local_frame(ds.df.sparkSession, counting.result(), DUPLICATES)
    row = profile_dataset_row(ds, profile, duplicates)
    return profile, local_frame(ds.df.sparkSession, row.collect(), DATASET_ROW)


def profile_columns_of(datasets: dict[str, Dataset], cfg: QualityConfig) -> DataFrame:
    """Column profiles of several datasets, their jobs submitted side by side."""
    with ThreadPoolExecutor(MAX_PARALLEL) as pool:
        return union_all(list(pool.map(lambda ds: profile_columns(ds, cfg), datasets.values())))


def profile_session(
    datasets: dict[str, Dataset], cfg: QualityConfig, skip_failed: bool = False, left_out: list[tuple[str, str]] | None = None
) -> SessionProfile:
    """Profile and score every dataset; a failure is fatal unless ``skip_failed``, and noted in ``left_out`` then."""
    good, columns, rows = {}, [], []
    # The jobs of different datasets are independent, so they are submitted side by side.
    with ThreadPoolExecutor(MAX_PARALLEL) as pool:
        running = {name: pool.submit(profile_whole, ds, cfg) for name, ds in datasets.items()}
    for name, done in running.items():
        try:
            profile, row = done.result()
        except Exception as exc:
            if not skip_failed:
                raise PipelineError(f"Failed to profile '{name}': {exc}") from exc
            log.warning("skipping '%s': %s", name, exc)
            if left_out is not None:
                left_out.append((name, _reason(exc)))
            continue
        good[name] = datasets[name]
        columns.append(profile)
        rows.append(row)
    if not good:
        raise PipelineError("No dataset could be profiled.")
    all_columns, all_rows = union_all(columns), union_all(rows)
    return SessionProfile(
        good,
        all_columns,
        all_rows,
        score_dataset(all_columns, all_rows, cfg),
        penalties(all_columns, all_rows, cfg),
        critical_field_issues(all_columns),
    )


def addressed(ds: Dataset) -> Dataset:
    """The dataset with its rows numbered in its row order, for operators that address rows."""
    if ds.row_order == ("row_index",):
        return ds
    return Dataset(ds.name, with_sorted_positions(ds.df, list(ds.row_order)).drop(*ds.row_order))


def propose(session: SessionProfile, cfg: QualityConfig, session_id: str, left_out: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every proposal for every dataset.

    Each generator's proposals are written when they are made, so one that fails, while it is
    planned or while it runs, takes no other with it; ``left_out`` gets its name and the reason.
    """
    datasets = {n: addressed(d) for n, d in session.datasets.items()}
    batches = []

    def attempt(what: str, make) -> None:
        try:
            batches.append(materialise(make()))
        except Exception as exc:
            log.warning("%s left out: %s", what, exc)
            if left_out is not None:
                left_out.append((what, _reason(exc)))

    if len(datasets) > 1:
        attempt("fills", lambda: find_cross_dataset_fills(datasets, session.columns, cfg, session_id))
    for name, ds in datasets.items():
        identifiers = profiled_identifiers(session.profiled(name))
        attempt(
            f"inference on '{name}'",
            lambda: find_interpolation_proposals(ds, cfg, session_id, identifiers),
        )
        attempt(
            f"corrections on '{name}'",
            lambda: find_correction_proposals(ds, cfg, session_id, identifiers=identifiers),
        )
    return union_all(batches) if batches else no_proposals(session.columns.sparkSession)


LEFT_OUT = "what string, reason string"


def _reason(exc: Exception) -> str:
    """The first line that says something."""
    return next((line for line in str(exc).splitlines() if line.strip()), type(exc).__name__)


@dataclass(frozen=True)
class PipelineResult:
    """``left_out (what, reason)`` names the generators that failed; without rows the proposals are complete."""

    session: SessionProfile
    proposals: DataFrame
    summary: DataFrame
    left_out: DataFrame


def run_pipeline(
    datasets: dict[str, Dataset],
    cfg: QualityConfig,
    session_id: str,
    rules: dict | None = None,
    proposals_path: str | None = None,
) -> PipelineResult:
    """Profile and score (fatal on failure), propose (not fatal), keep the proposals, sum up.

    The proposals are written once, to ``proposals_path`` or the checkpoint folder, so later
    steps read them back and do not repeat the generators. A repeated run of a session replaces the
    proposals that its former run stored.
    """
    cfg = cfg.with_rules(rules)
    session = profile_session(datasets, cfg)
    left_out: list[tuple[str, str]] = []
    made = propose(session, cfg, session_id, left_out)
    if proposals_path:
        save_proposals(made, proposals_path, run="pipeline", sessions=[session_id])
        kept = stored_proposals(session.columns.sparkSession, proposals_path, session_id)
    else:
        kept = materialise(made)
    return PipelineResult(session, kept, proposals_summary(kept), local_frame(session.columns.sparkSession, left_out, LEFT_OUT))


def build_dashboard(datasets: dict[str, Dataset], cfg: QualityConfig, left_out: list[tuple[str, str]] | None = None) -> DataFrame:
    """The executive roll-up; datasets that cannot be profiled are left out, joins are optional.

    ``left_out`` gets what is missing from it, with the reason.
    """
    session = profile_session(datasets, cfg, skip_failed=True, left_out=left_out)
    try:
        reports = materialise(join_reports(session.datasets, cfg))
    except Exception as exc:
        log.warning("join discovery left out: %s", exc)
        if left_out is not None:
            left_out.append(("join discovery", _reason(exc)))
        reports = None
    return board.dashboard(
        session.scores, session.penalties, session.critical_fields, reports, cfg, list(session.datasets)
    )


def export_session(
    spark: SparkSession,
    datasets: dict[str, Dataset],
    proposals: DataFrame,
    folder: str,
    winner: str = LOWEST,
    fmt: str = "csv",
    when_kept: Callable[[], None] | None = None,
) -> dict[str, str]:
    """Write each dataset with approved proposals, cleaned, and the manifest of all proposals.

    What the files need of the proposals is kept for the time of the export, so a review is worked out once; then
    ``when_kept`` is called, as ``proposals`` is not read again. Shuffle files go with each step.
    """
    if not datasets:
        raise ExportError("No dataset was given to export.")
    needed = [c for c in proposals.columns if c in EXPORTED]
    marked = with_applied(proposals.select(*needed), datasets)
    # only changes that are applied are told apart by their ids
    marked = marked.withColumn("id", F.when(F.col("_fits") > 0, F.col("id"))).drop("_fits")
    with shuffles_freed(spark), written(marked) as kept:
        if when_kept:
            when_kept()
        counted = kept.groupBy("dataset_name").agg(
            F.count_if(F.col("status") == APPROVED).alias("approved")
        ).collect()
        if not counted:
            raise ExportError("There are no proposals to export.")
        touched = {r["dataset_name"] for r in counted if r["approved"]}
        if not touched:
            raise ExportError("None of the proposals is approved, so nothing would change.")
        made = {
            name: write_cleaned(apply_proposals(ds, kept, winner), folder, name, fmt)
            for name, ds in datasets.items()
            if name in touched
        }
        made["audit_manifest"] = write_audit_manifest(kept, datasets, folder)
    return made
