"""The registered queries: each operator run over whole tables of the order benchmark."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.numbers import round_even
from dataheal.functions.text import parse_currency
from dataheal.operators import apply as applying
from dataheal.operators import consistency, context, dashboard, fill, infer, insights, joins, labels, profile
from dataheal.operators import proposals as record
from dataheal.operators import review, rules, score
from dataheal.plans import pipeline, views
from dataheal.session import ensure_checkpoint_dir, remove_table, shuffles_freed, write_once
from dataheal.sources import csv, sinks, versions
from dataheal.sources.positions import with_sorted_positions
from dataheal.streaming import corrections, decisions

Query = Callable[[SparkSession, str], DataFrame]
CFG = QualityConfig()
SESSION_ID = "benchmark"
# What a proposal says; its id, wording and timestamps are left out of the comparison.
SAID = (
    "proposal_type", "source_method", "dataset_name", "row_index", "row_identifier", "column_name",
    "original_value", "proposed_value", "confidence",
)


def _shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/dataheal-{what}-{uuid.uuid4().hex}"


def _lineitem(spark: SparkSession, sf: str) -> Dataset:
    return views.generic(spark, sf, "lineitem", "l_orderkey")


def _events(spark: SparkSession, sf: str) -> Dataset:
    numbers = views.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return Dataset("events", numbers.withColumn("row_index", F.col("event_id")))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(*[round_even(F.col(c), digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


# ── sources and sinks ──────────────────────────────────────────────────────


def _policies_csv(spark: SparkSession, sf: str) -> str:
    """The policies written as CSV, timestamps as ISO text."""
    df = views.policies(spark, sf).df.orderBy("row_index").drop("row_index")
    path = _shared_folder(spark, "policies-csv")
    sinks.write_csv(df.withColumn("created_at", F.col("created_at").cast("string")), path)
    return path


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    return csv.scan_csv(spark, _policies_csv(spark, sf), CFG)


def scan_raw_strings(spark: SparkSession, sf: str) -> DataFrame:
    return csv.scan_raw_strings(spark, _policies_csv(spark, sf))


def dataset_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/lineitem.parquet"
    pair = lambda f: F.concat_ws(":", f["name"], f["type"])
    return profile.dataset_metadata(_lineitem(spark, sf), path).select(
        "engine_used", "file_name", "row_count", "column_count",
        F.array_join("columns", ",").alias("columns"),
        F.array_join(F.transform("schema", pair), ",").alias("schema"),
    )


def session_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = _shared_folder(spark, "manifest")
    files = [{"dataset_name": t, "file_path": f"{sf}/{t}.parquet"} for t in ("orders", "lineitem", "customer")]
    sinks.register_session(spark, path, SESSION_ID, files, CFG.rules)
    rows = sinks.session_files(spark, path, SESSION_ID)
    found = profile.union_all(
        [
            views.table(spark, sf, f["dataset_name"]).agg(F.count("*").alias("row_count"))
            .withColumn("dataset_name", F.lit(f["dataset_name"]))
            for f in files
        ]
    )
    file_name = lambda c: F.element_at(F.split(c, "/"), -1).alias(c)
    return rows.join(found, "dataset_name").select(
        "session_id", "dataset_name", file_name("file_path"), file_name("saved_as"), "analyst_rules_json", "row_count"
    )


def row_index(spark: SparkSession, sf: str) -> DataFrame:
    keys = list(views.CLAIM_ORDER)
    return with_sorted_positions(views.claims(spark, sf).df.select(*keys), keys)


def approved_by_row(proposals: DataFrame) -> DataFrame:
    """A review of every proposal that depends on its row: approve, reject or leave."""
    by_row = F.col("row_index") % 3
    decisions = (
        F.when(by_row == 0, F.array(_decision("id", "approved", 1), _decision("id", "rejected", 2)))
        .when(by_row == 1, F.array(_decision("id", "rejected", 1)))
        .when(by_row == 2, F.array(_decision("id", "maybe", 1), _decision(F.concat("id", F.lit("-unknown")), "approved", 1)))
    )
    return proposals.select(F.inline(decisions))


def _decision(id_, decision: str, hour: int):
    return F.struct(
        (F.col(id_) if isinstance(id_, str) else id_).alias("id"),
        F.lit(decision).alias("decision"),
        F.lit(f"2024-06-01 0{hour}:00:00").cast("timestamp").alias("decided_at"),
    )


# ── proposals used by the review queries ───────────────────────────────────


def made_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Fills, inference and corrections for the policies, written once as a proposals table, of which readers take the columns they need."""
    policies, quotes = views.policies(spark, sf), views.quotes(spark, sf)
    identifiers = labels.count_identifiers(policies, CFG)
    fills = fill.cross_dataset_fill(
        policies, quotes, "policy_number", ["ncd", "product_type"], CFG.fill_confidence_primary, SESSION_ID
    )
    return write_once(
        profile.union_all(
            [
                fills,
                infer.find_interpolation_proposals(policies, CFG, SESSION_ID, identifiers),
                rules.find_correction_proposals(policies, CFG, SESSION_ID, identifiers=identifiers),
            ]
        )
    )


def _reviewed(made: DataFrame) -> DataFrame:
    return review.apply_decisions(made, approved_by_row(made))


def write_audit_manifest(spark: SparkSession, sf: str) -> DataFrame:
    folder = _shared_folder(spark, "audit")
    path = sinks.write_audit_manifest(_reviewed(made_proposals(spark, sf)), {"policies": views.policies(spark, sf)}, folder)
    # Only the row number is read back as a number.
    table = spark.read.option("header", True).csv(path).drop("reviewed_at")
    return table.withColumn("row_index", F.col("row_index").cast("bigint"))


def write_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    policies = views.policies(spark, sf)
    approved = review.bulk_review_cleaning(made_proposals(spark, sf), "approved")
    path = sinks.write_cleaned(
        applying.apply_proposals(policies, approved), _shared_folder(spark, "cleaned"), "policies.csv"
    )
    return spark.read.option("header", True).csv(path)


def get_proposals(spark: SparkSession, sf: str) -> DataFrame:
    path = _shared_folder(spark, "proposals")
    sinks.save_proposals(made_proposals(spark, sf), path)
    return sinks.get_proposals(spark, path, SESSION_ID).select(*SAID)


def export_session(spark: SparkSession, sf: str) -> DataFrame:
    policies = views.policies(spark, sf)
    with shuffles_freed(spark):
        made = made_proposals(spark, sf)
    written = pipeline.export_session(
        spark, {"policies": policies}, _reviewed(made), _shared_folder(spark, "export"), when_kept=lambda: remove_table(made)
    )
    counted = [
        spark.read.option("header", True).csv(path).agg(F.count("*").alias("row_count")).withColumn("part", F.lit(name))
        for name, path in written.items()
    ]
    return profile.union_all(counted)


def cast_value(spark: SparkSession, sf: str) -> DataFrame:
    policies, text = views.policies(spark, sf), F.col("proposed_value")
    number = applying.cast_value(text, policies.dtype("ncd"))
    return (
        made_proposals(spark, sf)
        .filter(F.col("column_name").isin("ncd", "premium"))
        .select(
            "row_index", "column_name", "proposed_value",
            F.when(F.col("column_name") == "ncd", number).alias("as_integer"),
            F.when(F.col("column_name") == "premium", text.try_cast("double")).alias("as_double"),
        )
    )


# ── profiles and scores ────────────────────────────────────────────────────


def _policy_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_columns(views.policies(spark, sf), CFG)


def _session_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.profile_columns_of(views.session(spark, sf), CFG)


def profile_dataset(spark: SparkSession, sf: str) -> DataFrame:
    entry = lambda v: F.concat_ws(":", v["value"], v["count"].cast("string"))
    return _policy_profile(spark, sf).select(
        "dataset", "ordinal", "name", "inferred_type", "dtype_raw", "is_critical_field", "row_count",
        "null_count", "null_pct", "unique_count", "uniqueness_ratio", "is_high_cardinality",
        F.array_join(F.transform("top_values", entry), "|").alias("top_values"),
        "min", "max", "mean", "median", "std", "outlier_count", "outlier_pct",
        "casing_inconsistency_count", "invalid_date_count",
        F.array_join("date_formats_detected", ", ").alias("date_formats_detected"),
        F.array_join("issues", " | ").alias("issues"),
    )


def distinct_profile_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the approximate count of each column is within 5 % of the exact one."""
    ds = _lineitem(spark, sf)
    exact = profile.distinct_profile(ds).select("name", F.col("unique_count").alias("exact"))
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.05 * F.col("exact")
    return profile.distinct_profile_approx(ds).join(exact, "name").select("name", "exact", near.alias("near"))


def numeric_stats_null(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of a table one of whose numeric columns has no value."""
    events = _events(spark, sf)
    return _rounded(profile.numeric_stats(Dataset("events", events.df.withColumn("empty", F.lit(None).cast("double")))))


def profile_dataset_row(spark: SparkSession, sf: str) -> DataFrame:
    ds = views.policies_dup(spark, sf)
    return profile.profile_dataset_row(ds, profile.profile_columns(ds, CFG))


def date_format_scan(spark: SparkSession, sf: str) -> DataFrame:
    return profile.date_format_scan(views.policies(spark, sf), CFG).withColumn(
        "date_formats_detected", F.array_join("date_formats_detected", ", ")
    )


def _scored(spark: SparkSession, sf: str) -> pipeline.SessionProfile:
    duplicated = views.policies_dup(spark, sf)
    return pipeline.profile_session({**views.session(spark, sf), duplicated.name: duplicated}, CFG)


def duplicate_rows_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Mostly duplicates: four low-cardinality columns of the line items."""
    narrow = views.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    return profile.duplicate_rows(Dataset("lineitem", narrow, ()))


# ── joins ──────────────────────────────────────────────────────────────────


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return joins.detect_join_pairs(views.session(spark, sf), CFG)


def join_quality_orders_customer(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda t, k: Dataset(t, views.table(spark, sf, t).select(F.col(k).alias("custkey")), ())
    return joins.join_quality(side("orders", "o_custkey"), side("customer", "c_custkey"), "custkey")


def join_candidates(spark: SparkSession, sf: str) -> DataFrame:
    session = views.session(spark, sf)
    return _rounded(joins.join_candidates(joins.session_uniqueness(session), list(session), CFG), 6)


def insight_join_nullsafe(spark: SparkSession, sf: str) -> DataFrame:
    policies, quotes = views.policies(spark, sf), views.quotes(spark, sf)
    joined = insights.insight_join(policies, quotes, "policy_number", nullsafe=True)
    return joined.select("policy_number", "ncd", "ncd_joined", "quote_id")


def _insight(insight_id: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        policies, claims = views.policies(spark, sf), views.claims(spark, sf)
        if insights.BY_ID[insight_id].cross_dataset:
            return insights.generate_insight(insight_id, policies, claims, "policy_number")
        return insights.generate_insight(insight_id, claims if "type" in insight_id else policies)

    return run


def join_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    reports = insights.join_reports(views.session(spark, sf), CFG)
    return dashboard.join_opportunities(reports, CFG).drop("value", "pair_order").withColumn(
        "top_insights", F.array_join("top_insights", ", ")
    )


def session_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    made = pipeline.build_dashboard(views.session(spark, sf), CFG).drop("generated_at")
    return made.withColumns(
        {
            "critical_alerts": F.array_join(F.transform("critical_alerts", lambda a: a["alert_text"]), " | "),
            "join_opportunities": F.array_join(
                F.transform("join_opportunities.shown", lambda o: F.concat_ws(":", o["dataset_a"], o["dataset_b"], o["join_key"], o["business_summary"])), " | "
            ),
            "opportunity_count": F.col("join_opportunities.total"),
        }
    )


def run_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.run_pipeline(_addressed_session(spark, sf), CFG, SESSION_ID).summary


# ── registry ───────────────────────────────────────────────────────────────


def _rule(name: str, **changes) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cfg = CFG.with_rules(changes)
        return rules.find_correction_proposals(views.policies(spark, sf), cfg, SESSION_ID, only=(name,)).select(*SAID)

    return run


def decision_errors(spark: SparkSession, sf: str) -> DataFrame:
    made = made_proposals(spark, sf)
    return review.decision_errors(made, approved_by_row(made)).groupBy("error", "decision").agg(F.count("*").alias("n"))


def row_context(spark: SparkSession, sf: str) -> DataFrame:
    policies = views.policies(spark, sf)
    gaps = infer.sequential_id_inference(policies, CFG, SESSION_ID)
    around = context.row_context(gaps, policies)
    targets = gaps.select(F.col("id").alias("proposal_id"), F.col("row_index").alias("target_index"))
    return around.join(targets, "proposal_id").drop("proposal_id")


def source_context(spark: SparkSession, sf: str) -> DataFrame:
    policies, quotes = views.policies(spark, sf), views.quotes(spark, sf)
    fills = fill.cross_dataset_fill(policies, quotes, "policy_number", ["ncd", "product_type"], 0.9, SESSION_ID)
    return context.source_context(fills, quotes, "policy_number").drop("proposal_id")


def _addressed_session(spark: SparkSession, sf: str) -> dict[str, Dataset]:
    return {**views.session(spark, sf), "claims": views.positioned_claims(spark, sf)}


def _fills(made: DataFrame) -> DataFrame:
    return made.select(
        "dataset_name", "row_index", "row_identifier", "column_name", "proposed_value", "confidence",
        "source_dataset", "source_column", "join_key", "join_value",
    )


def find_cross_dataset_fills(spark: SparkSession, sf: str) -> DataFrame:
    session = _addressed_session(spark, sf)
    profiles = pipeline.profile_columns_of(session, CFG)
    return _fills(fill.find_cross_dataset_fills(session, profiles, CFG, SESSION_ID))


def resolve_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Effect of overridden rules: policies outside the overridden premium bounds."""
    cfg = CFG.with_rules({"minimum_premium": 1000, "max_premium": 400000})
    made = rules.find_correction_proposals(views.policies(spark, sf), cfg, SESSION_ID, only=("premium_threshold",))
    return made.groupBy("proposed_value").agg(F.count("*").alias("n"))


def apply_to_files(spark: SparkSession, sf: str) -> DataFrame:
    """All proposals applied to the policies kept as sorted files, of which only the touched ones are written again."""
    folder = _shared_folder(spark, "policy-files")
    rows = views.policies(spark, sf).df.withColumn("created_at", F.col("created_at").cast("string"))
    rows.repartitionByRange(8, "row_index").sortWithinPartitions("row_index").write.parquet(f"{folder}/data")
    versions.register_files(spark, f"{folder}/data", f"{folder}/manifest")
    approved = made_proposals(spark, sf).withColumn("status", F.lit(record.APPROVED))
    versions.apply_to_files(spark, f"{folder}/manifest", "policies", approved, folder)
    return versions.read_version(spark, f"{folder}/manifest", "policies").df


def stream_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """The policies' rows as a stream of files, corrected as they arrive."""
    learned = corrections.learn(views.policies(spark, sf), CFG)
    # a pattern, as a table may be one file or a folder of them
    arriving = corrections.row_stream(spark, f"{sf}/orders.parquet*", views.table(spark, sf, "orders").schema)
    found = corrections.corrections(views.policies_of(arriving), "policies", CFG, learned, SESSION_ID)
    folder = _shared_folder(spark, "stream-corrections")
    corrections.write_corrections(found, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return corrections.written_corrections(spark, f"{folder}/rows").select(*SAID)


#: Most decisions in one arriving file.
ARRIVING_ROWS = 1_000_000


def _arriving_files(rows: int) -> int:
    """Files for so many decisions: six at least, for several batches, and as many more as keep each file small."""
    return max(6, -(-rows // ARRIVING_ROWS))


def stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The review of all proposals, its decisions arriving in several batches in no order of time."""
    made = made_proposals(spark, sf)
    folder = _shared_folder(spark, "stream-decisions")
    by_chance = F.xxhash64("id", "decision", "decided_at")
    decided = approved_by_row(made)
    # a proposal gets two decisions at most; its table knows its rows
    files = _arriving_files(2 * made.count())
    decided.repartition(files, by_chance).write.parquet(f"{folder}/arriving")
    arriving = decisions.decision_stream(spark, f"{folder}/arriving", files_per_batch=-(-files // 3))
    decisions.write_decisions(arriving, f"{folder}/revisions", f"{folder}/checkpoint").awaitTermination()
    reviewed = review.apply_decisions(made, decisions.current_decisions(spark, f"{folder}/revisions"), one_each=True)
    return reviewed.select(*SAID, "status", "user_decision")


#: What policies and quotes say about one policy agrees in about half of the cells: one of two columns does.
GHOST_AGREEMENT = 0.6


def exact_agreement(spark: SparkSession, sf: str) -> DataFrame:
    session = views.session(spark, sf)
    pairs = joins.detect_join_pairs(session, CFG).select(*consistency.PAIR)
    return _rounded(consistency.exact_agreement(session, pairs))


def all_queries() -> dict[str, Query]:
    on_policies = lambda op, *args: lambda spark, sf: op(views.policies(spark, sf), *args)
    on_profile = lambda op, *args: lambda spark, sf: op(_policy_profile(spark, sf), *args)
    on_lineitem = lambda op, *args: lambda spark, sf: op(_lineitem(spark, sf), *args)
    on_made = lambda op, *args: lambda spark, sf: op(made_proposals(spark, sf), *args)
    on_session = lambda pick: lambda spark, sf: pick(_scored(spark, sf))
    profiles = lambda op: lambda spark, sf: op(_session_profiles(spark, sf), CFG)
    alerts = ("severity", "dataset", "column", "alert_text", "points_impact")
    return {
        # sources and sinks
        "view_policies": lambda spark, sf: views.policies(spark, sf).df,
        "view_quotes": lambda spark, sf: views.quotes(spark, sf).df,
        "view_claims": lambda spark, sf: views.claims(spark, sf).df,
        "view_policies_dup": lambda spark, sf: views.policies_dup(spark, sf).df,
        "row_index": row_index,
        "scan_csv": scan_csv,
        "scan_raw_strings": scan_raw_strings,
        "dataset_metadata": dataset_metadata,
        "row_count": on_lineitem(profile.row_count),
        "session_manifest": session_manifest,
        "write_cleaned": write_cleaned,
        "write_audit_manifest": write_audit_manifest,
        "get_proposals": get_proposals,
        # profiling
        "null_profile": on_policies(profile.null_profile),
        "null_counts": on_policies(profile.null_counts),
        "distinct_profile": on_lineitem(profile.distinct_profile),
        "distinct_profile_approx": distinct_profile_approx,
        "top_values": on_lineitem(profile.top_values, CFG),
        "numeric_stats": lambda spark, sf: _rounded(profile.numeric_stats(_lineitem(spark, sf))),
        "numeric_stats_null": numeric_stats_null,
        "basic_stats": lambda spark, sf: _rounded(
            profile.basic_stats(views.generic(spark, sf, "orders", "o_orderkey"), "o_totalprice")
        ),
        "iqr_outliers": lambda spark, sf: _rounded(profile.iqr_outliers(_events(spark, sf))),
        "outlier_rows": lambda spark, sf: profile.outlier_rows(_events(spark, sf), "value").drop("row_index"),
        "casing_inconsistency": on_policies(profile.casing_inconsistency),
        "value_sample": on_policies(profile.value_sample),
        "date_format_scan": date_format_scan,
        "classify_column": on_profile(profile.classify_column),
        "high_cardinality_flag": on_profile(profile.high_cardinality_flag),
        "duplicate_rows": lambda spark, sf: profile.duplicate_rows(views.policies_dup(spark, sf)),
        "duplicate_rows_wide": duplicate_rows_wide,
        "column_issues": lambda spark, sf: profile.column_issues(_policy_profile(spark, sf)).drop("issue_order"),
        "dataset_issues": on_profile(profile.dataset_issues),
        "profile_dataset": profile_dataset,
        "profile_dataset_row": profile_dataset_row,
        # scoring
        "tier_penalty": on_profile(score.tier_penalty, CFG),
        "penalties": on_session(lambda s: _rounded(s.penalties.drop("ordinal", "penalty_order"), 6)),
        "critical_field_issues": on_session(lambda s: s.critical_fields.drop("ordinal")),
        "score_dataset": on_session(lambda s: s.scores),
        "issues_by_severity": on_session(
            lambda s: score.issues_by_severity(s.penalties).select(
                "dataset", "column", "severity", "severity_rank", "reason"
            )
        ),
        "session_average_score": on_session(lambda s: _rounded(score.session_average_score(s.scores, CFG))),
        # filling
        "find_join_keys": profiles(lambda p, c: fill.find_join_keys(p, c).select("dataset_a", "dataset_b", "name")),
        "select_best_join_key": profiles(
            lambda p, c: fill.select_best_join_key(p, c).select("dataset_a", "dataset_b", F.col("name").alias("join_key"))
        ),
        "fill_confidence": profiles(fill.fill_confidence),
        "find_fillable_columns": profiles(lambda p, c: fill.find_fillable_columns(p, c).drop("confidence")),
        "dedup_lookup": lambda spark, sf: fill.dedup_lookup(
            views.claims(spark, sf), "policy_number", ["claim_amount", "claim_type"]
        ),
        "cross_dataset_fill": lambda spark, sf: _fills(
            fill.cross_dataset_fill(
                views.policies(spark, sf), views.quotes(spark, sf), "policy_number", ["ncd", "product_type"],
                CFG.fill_confidence_primary, SESSION_ID,
            )
        ),
        "find_cross_dataset_fills": find_cross_dataset_fills,
        # inference
        "annual_term_evidence": lambda spark, sf: _rounded(
            infer.annual_term_evidence(views.policies(spark, sf), "inception_date", "expiry_date", CFG), 6
        ),
        "annual_date_inference": lambda spark, sf: infer.annual_date_inference(
            views.policies(spark, sf), CFG, SESSION_ID
        ).select(*SAID),
        "parse_identifier": lambda spark, sf: infer.identifier_parts(
            Dataset("customer", views.table(spark, sf, "customer"), ("c_custkey",)), "c_name"
        ).drop("value"),
        "find_row_label_column": lambda spark, sf: labels.find_row_label_column(_session_profiles(spark, sf)),
        "sequential_id_inference": lambda spark, sf: infer.sequential_id_inference(
            views.policies(spark, sf), CFG, SESSION_ID
        ).select(*SAID),
        "find_interpolation_proposals": lambda spark, sf: infer.find_interpolation_proposals(
            views.policies(spark, sf), CFG, SESSION_ID
        ).select(*SAID),
        # rules
        **{r: _rule(r) for r in rules.RULE_NAMES if r not in ("premium_threshold", "ncd_ceiling")},
        "premium_threshold": _rule("premium_threshold", max_premium=400000),
        "ncd_ceiling": _rule("ncd_ceiling", max_ncd=9),
        "majority_casing": on_policies(rules.majority_casing, "product_type"),
        "parse_currency": lambda spark, sf: views.policies(spark, sf).df.select(
            "row_index", "premium", parse_currency(F.col("premium")).alias("amount")
        ),
        "resolve_rules": resolve_rules,
        "find_correction_proposals": lambda spark, sf: rules.find_correction_proposals(
            views.policies(spark, sf), CFG, SESSION_ID
        ).select(*SAID),
        # proposals, review, application
        "build_proposal": on_made(
            lambda p: p.select(
                *SAID, "seq", "session_id", "status", "source_dataset", "source_column", "join_key", "join_value",
                F.length("id").alias("id_length"),
            )
        ),
        "proposals_summary": on_made(record.proposals_summary),
        "session_proposals": on_made(lambda p: record.session_proposals(p, SESSION_ID).select(*SAID)),
        "filter_proposals": lambda spark, sf: record.filter_proposals(
            _reviewed(made_proposals(spark, sf)), "policies", record.DATA_CORRECTION, record.APPROVED
        ).select(*SAID),
        "status_counts": lambda spark, sf: record.status_counts(_reviewed(made_proposals(spark, sf))),
        "filter_options": on_made(record.filter_options),
        "standard_cleaning_breakdown": lambda spark, sf: record.standard_cleaning_breakdown(_reviewed(made_proposals(spark, sf))),
        "apply_decision": lambda spark, sf: _reviewed(made_proposals(spark, sf)).select(*SAID, "status", "user_decision"),
        "decision_errors": decision_errors,
        "bulk_review_cleaning": on_made(
            lambda p: review.bulk_review_cleaning(p, record.APPROVED, SESSION_ID).select(*SAID, "status")
        ),
        "bulk_review_result": on_made(
            lambda p: review.bulk_review_result(p, record.APPROVED, SESSION_ID).join(p.select("id", *SAID), "id").drop("id")
        ),
        "cast_value": cast_value,
        "apply_proposals": lambda spark, sf: applying.apply_proposals(
            views.policies(spark, sf), made_proposals(spark, sf).withColumn("status", F.lit(record.APPROVED))
        ),
        "apply_to_files": apply_to_files,
        "export_session": export_session,
        "row_context": row_context,
        "source_context": source_context,
        # joins and insights
        "uniqueness_ratio": lambda spark, sf: _rounded(joins.uniqueness_ratio(views.policies(spark, sf)), 6),
        "join_candidates": join_candidates,
        "join_quality": _reports,
        "join_quality_orders_customer": join_quality_orders_customer,
        "unmatched_keys": lambda spark, sf: joins.unmatched_keys(
            views.policies(spark, sf), views.quotes(spark, sf), "policy_number"
        ),
        "base_dataset": lambda spark, sf: _reports(spark, sf).select("dataset_a", "dataset_b", "base_dataset"),
        "match_strength": lambda spark, sf: _reports(spark, sf).select(
            "dataset_a", "dataset_b", "match_rate", joins.match_strength(F.col("match_rate"), CFG).alias("strength")
        ),
        "analyse_joins": lambda spark, sf: insights.analyse_joins(views.session(spark, sf), CFG),
        # streams
        "stream_corrections": stream_corrections,
        "stream_decisions": stream_decisions,
        # keys that contradict themselves
        "entity_mismatch": lambda spark, sf: consistency.entity_mismatch(views.session(spark, sf), "policy_number"),
        "mismatch_summary": lambda spark, sf: consistency.mismatch_summary(
            consistency.entity_mismatch(views.session(spark, sf), "policy_number")
        ),
        "ghost_joins": lambda spark, sf: consistency.ghost_joins(views.session(spark, sf), CFG, most_agreement=GHOST_AGREEMENT),
        "exact_agreement": exact_agreement,
        "duplicate_keys": lambda spark, sf: consistency.duplicate_keys(views.claims(spark, sf), "policy_number"),
        "duplicate_keys_entered": lambda spark, sf: consistency.duplicate_keys(views.policies_dup(spark, sf), "policy_number"),
        "duplicate_keys_pair": lambda spark, sf: consistency.duplicate_keys(_lineitem(spark, sf), ["l_partkey", "l_suppkey"]),
        "insight_join": lambda spark, sf: insights.insight_join(
            views.policies(spark, sf), views.claims(spark, sf), "policy_number"
        ),
        "insight_join_nullsafe": insight_join_nullsafe,
        **{i: _insight(i) for i in insights.BY_ID},
        "generate_insight": lambda spark, sf: insights.generate_insight(
            "claim_freq_by_product", views.quotes(spark, sf), views.claims(spark, sf), "policy_number"
        ),
        # executive roll-up
        "overall_score": on_session(lambda s: dashboard.overall_score(s.scores, CFG).drop("exact_score")),
        "rag_summary": on_session(lambda s: dashboard.rag_summary(s.scores)),
        "alert_text": on_session(
            lambda s: dashboard.penalty_alerts(s.penalties).select("dataset", "column", "kind", "alert_text")
        ),
        "critical_alerts": on_session(
            lambda s: dashboard.critical_alerts(s.penalties, s.critical_fields, CFG, list(s.datasets)).select(*alerts)
        ),
        "join_opportunities": join_opportunities,
        "benchmark_context": on_session(
            lambda s: dashboard.benchmark_context(dashboard.overall_score(s.scores, CFG), CFG)
        ),
        "dashboard": session_dashboard,
        "run_pipeline": run_pipeline,
    }
