"""One DuckDB query per registered Spark query."""

from __future__ import annotations

from checks import consistency as C
from checks import proposals as P
from checks import scoring as S
from checks import views as V
from checks.views import text, with_
from dataheal.operators.insights import BY_ID
from dataheal.plans.queries import GHOST_AGREEMENT

CFG = V.CFG
LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
LINEITEM_NUMERIC = [c for c, t in LINEITEM.items() if t in ("bigint", "int", "double")]


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def sources() -> dict[str, str]:
    views = {
        f"view_{v}": with_(V.view_ctes(v), f"SELECT * FROM {v}") for v in ("policies", "quotes", "claims", "policies_dup")
    }
    scanned = (
        "SELECT row_index, policy_number, customer_id, inception_date, expiry_date, premium, {ncd} AS ncd, postcode, "
        "product_type, status, CAST(created_at AS VARCHAR) AS created_at FROM policies"
    )
    return {
        **views,
        "row_index": with_(
            V.view_ctes("claims"),
            f"SELECT {', '.join(V.ORDER['claims'])}, row_number() OVER (ORDER BY {', '.join(V.ORDER['claims'])}) - 1 AS row_index "
            "FROM claims",
        ),
        "scan_csv": with_(V.view_ctes("policies"), scanned.format(ncd="CAST(ncd AS DOUBLE)")),
        "scan_raw_strings": with_(V.view_ctes("policies"), scanned.format(ncd="CAST(ncd AS VARCHAR)")),
        "dataset_metadata": (
            "SELECT 'spark' AS engine_used, 'lineitem.parquet' AS file_name, count(*) AS row_count, "
            f"{len(LINEITEM)} AS column_count, '{','.join(LINEITEM)}' AS columns, "
            f"'{','.join(f'{c}:{t}' for c, t in LINEITEM.items())}' AS \"schema\" FROM lineitem"
        ),
        "row_count": "SELECT 'lineitem' AS dataset, count(*) AS row_count FROM lineitem",
        "session_manifest": " UNION ALL ".join(
            f"SELECT 'benchmark' AS session_id, '{t}' AS dataset_name, '{t}.parquet' AS file_path, '{t}.parquet' AS saved_as, "
            f"'{CFG.rules.to_json()}' AS analyst_rules_json, count(*) AS row_count FROM {t}" for t in ("orders", "lineitem", "customer")
        ),
    }


def profiling() -> dict[str, str]:
    policies = V.COLUMNS["policies"]
    prof = lambda query: with_(V.profile_ctes("policies"), query)
    on_policies = lambda query: with_(V.view_ctes("policies"), query)
    stats = lambda c, table: (
        f"SELECT '{c}' AS name, CAST(printf('%.4f', CAST(CAST(min({c}) AS DOUBLE) AS DOUBLE)) AS DOUBLE) AS min, CAST(printf('%.4f', CAST(CAST(max({c}) AS DOUBLE) AS DOUBLE)) AS DOUBLE) AS max, "
        f"CAST(printf('%.4f', CAST(avg({c}) AS DOUBLE)) AS DOUBLE) AS mean, CAST(printf('%.4f', CAST(quantile_cont({c}, 0.5) AS DOUBLE)) AS DOUBLE) AS median, CAST(printf('%.4f', CAST(stddev_samp({c}) AS DOUBLE)) AS DOUBLE) AS std"
        + (
            f", CAST(printf('%.4f', CAST(quantile_cont({c}, 0.25) AS DOUBLE)) AS DOUBLE) AS q1, CAST(printf('%.4f', CAST(quantile_cont({c}, 0.75) AS DOUBLE)) AS DOUBLE) AS q3 FROM {table}"
        )
    )
    bounds = (
        "SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM "
        "(SELECT quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.75) AS q3 FROM events)"
    )
    events = ("event_id", "user_id", "value")
    top = lambda c: (
        f"SELECT '{c}' AS name, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, {text('v')} AS value, n AS \"count\" "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)"
    )
    dated = [c for c in policies if V.is_date_name(c)]
    texts = [c for c in policies if c not in V.NUMERIC]
    return {
        "null_profile": on_policies(
            union(
                f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, CAST(printf('%.4f', CAST((count(*) - count({c})) / count(*) AS DOUBLE)) AS DOUBLE) "
                f"AS null_pct FROM policies"
                for c in policies
            )
        ),
        "null_counts": on_policies(
            union(f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count FROM policies" for c in policies)
        ),
        "distinct_profile": union(
            f"SELECT '{c}' AS name, count(DISTINCT {c}) AS unique_count, CAST(printf('%.4f', CAST(count(DISTINCT {c}) / count(*) AS DOUBLE)) AS DOUBLE) "
            "AS uniqueness_ratio FROM lineitem"
            for c in LINEITEM
        ),
        "top_values": f"SELECT * FROM ({union(top(c) for c in LINEITEM)}) WHERE rank <= {CFG.top_k}",
        "distinct_profile_approx": union(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS exact, TRUE AS near FROM lineitem" for c in LINEITEM),
        "numeric_stats_null": union(
            [*(stats(c, "events") for c in events), "SELECT 'empty', NULL, NULL, NULL, NULL, NULL, NULL, NULL"]
        ),
        "numeric_stats": union(stats(c, "lineitem") for c in LINEITEM_NUMERIC),
        "basic_stats": f"SELECT name, min, max, mean, median, std FROM ({stats('o_totalprice', 'orders')})",
        "iqr_outliers": union(
            f"SELECT '{c}' AS name, CAST(printf('%.4f', CAST(lower AS DOUBLE)) AS DOUBLE) AS lower, CAST(printf('%.4f', CAST(upper AS DOUBLE)) AS DOUBLE) AS upper, "
            f"(SELECT count(*) FROM events WHERE {c} < lower OR {c} > upper) AS outlier_count, "
            f"CAST(printf('%.4f', CAST((SELECT count(*) FROM events WHERE {c} < lower OR {c} > upper) / (SELECT count(*) FROM events) AS DOUBLE)) AS DOUBLE) "
            f"AS outlier_pct FROM ({bounds.format(c)})"
            for c in events
        ),
        "outlier_rows": (
            f"SELECT event_id, user_id, event_type, value FROM events, ({bounds.format('value')}) b "
            "WHERE value < b.lower OR value > b.upper"
        ),
        "casing_inconsistency": on_policies(
            union(f"SELECT '{c}' AS name, {V.casing('policies', c)} AS casing_inconsistency_count" for c in texts)
        ),
        "value_sample": on_policies(
            union(f"SELECT '{c}' AS name, value FROM ({V.sample('policies', c)})" for c in texts)
        ),
        "date_format_scan": on_policies(
            union(
                f"SELECT '{c}' AS name, {V.formats('policies', c)} AS date_formats_detected, "
                f"{V.invalid_dates('policies', c)} AS invalid_date_count"
                for c in dated
            )
        ),
        "classify_column": prof("SELECT name, inferred_type FROM prof"),
        "high_cardinality_flag": prof("SELECT name, uniqueness_ratio, is_high_cardinality FROM prof"),
        "duplicate_rows": with_(
            V.view_ctes("policies_dup"),
            f"SELECT dataset, duplicate_row_count, duplicate_row_pct FROM ({V.dataset_rows('policies_dup')})",
        ),
        "duplicate_rows_wide": (
            "SELECT 'lineitem' AS dataset, a.n - b.n AS duplicate_row_count, CAST(printf('%.4f', CAST((a.n - b.n) / a.n AS DOUBLE)) AS DOUBLE) AS duplicate_row_pct "
            "FROM (SELECT count(*) AS n FROM lineitem) a, (SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_quantity, "
            "l_discount, l_returnflag FROM lineitem)) b"
        ),
        "column_issues": with_(
            V.profile_ctes("policies"),
            "SELECT dataset, ordinal, name, issue FROM issue WHERE issue IS NOT NULL",
        ),
        "dataset_issues": with_(
            V.profile_ctes("policies"),
            "SELECT dataset, name AS \"column\", CASE WHEN null_count > 0 THEN 'critical' ELSE 'warning' END AS severity, "
            "issue AS detail FROM issue WHERE issue IS NOT NULL AND is_critical_field",
        ),
        "profile_dataset": with_(
            {
                **V.profile_ctes("policies"),
                "best": union(
                    f"SELECT '{c}' AS name, rn, {text('v')} || ':' || n AS entry FROM (SELECT v, n, row_number() OVER "
                    f"(ORDER BY n DESC, v) AS rn FROM (SELECT {c} AS v, count(*) AS n FROM policies WHERE {c} IS NOT NULL "
                    f"GROUP BY 1)) WHERE rn <= {CFG.top_k}"
                    for c in policies
                ),
            },
            "SELECT dataset, ordinal, name, inferred_type, dtype_raw, is_critical_field, row_count, null_count, null_pct, "
            "unique_count, uniqueness_ratio, is_high_cardinality, (SELECT string_agg(entry, '|' ORDER BY rn) FROM best b "
            "WHERE b.name = prof.name) AS top_values, min, max, mean, median, std, outlier_count, outlier_pct, "
            "casing_inconsistency_count, invalid_date_count, formats AS date_formats_detected, "
            "coalesce((SELECT string_agg(issue, ' | ' ORDER BY place) FROM issue i WHERE i.name = prof.name), '') AS issues FROM prof",
        ),
        "profile_dataset_row": with_(
            V.view_ctes("policies_dup"),
            "SELECT dataset, row_count, CAST(column_count AS BIGINT) AS column_count, duplicate_row_count, duplicate_row_pct "
            f"FROM ({V.dataset_rows('policies_dup')})",
        ),
    }


def scoring() -> dict[str, str]:
    scored = lambda query: with_(S.score_ctes(*S.SCORED), query)
    overall = f"SELECT CAST(printf('%.1f', CAST(mean AS DOUBLE)) AS DOUBLE) AS overall_score, {S.OVERALL_GRADE} AS grade, dataset_count FROM ({S.OVERALL})"
    counted = "count(*) FILTER (WHERE grade = '{0}') AS {1}"
    rag = ", ".join(counted.format(g, g.lower()) for g in ("Green", "Amber", "Red"))
    order = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
    return {
        "tier_penalty": with_(
            V.profile_ctes("policies"),
            "SELECT name, null_pct, CAST(CASE WHEN null_pct > 0.5 THEN 10 WHEN null_pct > 0.2 THEN 5 WHEN null_pct > 0.05 THEN 2 END "
            "AS INTEGER) AS points FROM prof",
        ),
        "penalties": scored("SELECT dataset, \"column\", kind, points_deducted, severity, reason, CAST(printf('%.6f', CAST(rate AS DOUBLE)) AS DOUBLE) AS rate FROM penalty"),
        "critical_field_issues": scored(
            "SELECT dataset, name AS field, null_count, null_pct, 'Critical field ''' || name || ''' has ' || null_count || "
            "' null value(s) — heavy penalty applied.' AS detail FROM prof WHERE is_critical_field AND null_count > 0"
        ),
        "score_dataset": scored(
            f"SELECT dataset, row_count, score, grade, issue_count, {S.SCORE_SUMMARY} AS summary FROM score"
        ),
        "issues_by_severity": scored(
            f"SELECT dataset, \"column\", severity, CAST({order} AS INTEGER) AS severity_rank, reason FROM penalty"
        ),
        "session_average_score": scored(
            "SELECT CAST(printf('%.4f', CAST(avg(score) AS DOUBLE)) AS DOUBLE) AS average_score, CASE WHEN avg(score) >= 75 THEN 'Green' WHEN avg(score) >= 50 THEN 'Amber' "
            "ELSE 'Red' END AS grade, CAST(sum(issue_count) AS BIGINT) AS issue_count FROM score"
        ),
        "overall_score": scored(overall),
        "rag_summary": scored(f"SELECT {rag}, count(*) AS total FROM score"),
        "alert_text": scored(f"SELECT dataset, \"column\", kind, {S.alert_text()} AS alert_text FROM penalty"),
        "critical_alerts": with_(
            S.alert_ctes(*S.SCORED), "SELECT severity, dataset, \"column\", alert_text, points_impact FROM top_alerts"
        ),
        "benchmark_context": scored(
            f"SELECT CAST(printf('%.1f', CAST(mean AS DOUBLE)) AS DOUBLE) AS current_score, 75 AS benchmark_score, CAST(printf('%.1f', CAST(mean - 75 AS DOUBLE)) AS DOUBLE) AS delta, {S.BENCHMARK} AS context "
            f"FROM ({S.OVERALL})"
        ),
        "dashboard": with_(
            {**S.alert_ctes(*V.SESSION), **{k: v for k, v in join_ctes().items() if k not in V.SESSION}},
            f"SELECT CAST(printf('%.1f', CAST(mean AS DOUBLE)) AS DOUBLE) AS overall_score, {S.OVERALL_GRADE} AS grade, dataset_count, "
            + ", ".join(f"(SELECT count(*) FROM score WHERE grade = '{g}') AS {g.lower()}" for g in ("Green", "Amber", "Red"))
            + ", (SELECT count(*) FROM score) AS total, (SELECT string_agg(alert_text, ' | ' ORDER BY urgency, points_impact DESC, "
            "place, ordinal) FROM top_alerts) AS critical_alerts, (SELECT string_agg(concat_ws(':', dataset_a, dataset_b, join_key, business_summary), ' | ' "
            f"ORDER BY value DESC, place) FROM opportunity) AS join_opportunities, CAST((SELECT count(*) FROM quality) AS BIGINT) AS opportunity_count, 75 AS benchmark_score, {S.BENCHMARK} AS context FROM ({S.OVERALL})",
        ),
    }


def filling() -> dict[str, str]:
    shared = {
        **V.profile_ctes(*V.SESSION),
        "shared": (
            "SELECT a.dataset AS dataset_a, b.dataset AS dataset_b, a.name, a.inferred_type AS type_a, b.inferred_type AS type_b, "
            "a.uniqueness_ratio AS u_a, b.uniqueness_ratio AS u_b, a.null_pct AS p_a, b.null_pct AS p_b, a.null_count AS n_a, "
            "b.null_count AS n_b, b.row_count AS rows_b FROM prof a JOIN prof b ON a.name = b.name AND a.dataset <> b.dataset"
        ),
        "keys": (
            "SELECT * FROM shared WHERE (type_a = 'identifier' OR type_b = 'identifier') AND u_a >= 0.8 AND u_b >= 0.8 "
            "AND p_a < 0.1 AND p_b < 0.1"
        ),
        "best": (
            "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_a, dataset_b ORDER BY "
            f"CASE WHEN name IN ({V._listed(CFG.preferred_keys)}) THEN 0 ELSE 1 END, "
            "((u_a + u_b) / 2 - (p_a + p_b) / 2) DESC, name) AS rn FROM keys) WHERE rn = 1"
        ),
    }
    confidence = "CASE WHEN u_a >= 0.95 AND u_b >= 0.95 THEN 0.9 ELSE 0.75 END"
    profile = lambda query: with_(shared, query)
    first = lambda c: (
        f"(SELECT policy_number, {c} FROM (SELECT policy_number, {c}, row_number() OVER (PARTITION BY policy_number ORDER BY "
        f"{', '.join(V.ORDER['claims'])}) AS rn FROM claims WHERE {c} IS NOT NULL) WHERE rn = 1)"
    )
    fills = (
        "SELECT dataset_name, row_index, row_identifier, column_name, proposed_value, confidence, 'quotes' AS source_dataset, "
        f"column_name AS source_column, 'policy_number' AS join_key, row_identifier AS join_value FROM ({P.FILLS})"
    )
    return {
        "find_join_keys": profile("SELECT dataset_a, dataset_b, name FROM keys"),
        "select_best_join_key": profile("SELECT dataset_a, dataset_b, name AS join_key FROM best"),
        "fill_confidence": profile(
            f"SELECT dataset_a, dataset_b, name AS join_key, CAST({confidence} AS DOUBLE) AS confidence FROM best"
        ),
        "find_fillable_columns": profile(
            "SELECT s.dataset_a, s.dataset_b, b.name AS join_key, s.name AS \"column\" FROM shared s JOIN best b "
            "ON s.dataset_a = b.dataset_a AND s.dataset_b = b.dataset_b WHERE s.name <> b.name AND s.name NOT IN "
            f"({V._listed(CFG.fill_exclusions)}) AND s.type_a <> 'identifier' AND s.type_a = s.type_b AND s.n_a > 0 "
            "AND s.rows_b > s.n_b"
        ),
        "dedup_lookup": with_(
            V.view_ctes("claims"),
            "SELECT k.policy_number, a.claim_amount, t.claim_type FROM (SELECT DISTINCT policy_number FROM claims) k "
            f"LEFT JOIN {first('claim_amount')} a ON a.policy_number = k.policy_number "
            f"LEFT JOIN {first('claim_type')} t ON t.policy_number = k.policy_number",
        ),
        "cross_dataset_fill": with_(V.view_ctes("policies", "quotes"), fills),
        "find_cross_dataset_fills": with_(V.view_ctes("policies", "quotes"), fills),
    }


def inference() -> dict[str, str]:
    made = lambda sql: with_(P.rule_ctes(), f"SELECT {P.COLUMNS} FROM ({sql})")
    return {
        "annual_term_evidence": with_(
            P.rule_ctes(), "SELECT both_present, annual_rows, CAST(printf('%.6f', CAST(annual_ratio AS DOUBLE)) AS DOUBLE) AS annual_ratio FROM evidence"
        ),
        "annual_date_inference": made(P.ANNUAL),
        "parse_identifier": (
            "SELECT c_custkey, regexp_extract(c_name, '^(.*?)([0-9]+)$', 1) AS prefix, "
            "CAST(regexp_extract(c_name, '^(.*?)([0-9]+)$', 2) AS BIGINT) AS number, "
            "CAST(length(regexp_extract(c_name, '^(.*?)([0-9]+)$', 2)) AS INTEGER) AS width FROM customer"
        ),
        "find_row_label_column": with_(
            V.profile_ctes(*V.SESSION),
            "SELECT dataset, name AS label_column FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY "
            "uniqueness_ratio DESC, ordinal) AS rn FROM prof WHERE inferred_type = 'identifier' AND null_count = 0) WHERE rn = 1",
        ),
        "sequential_id_inference": made(P.SEQUENCE),
        "find_interpolation_proposals": made(f"{P.ANNUAL} UNION ALL {P.SEQUENCE}"),
    }


def rules() -> dict[str, str]:
    made = lambda sql: with_(P.rule_ctes(), f"SELECT {P.COLUMNS} FROM ({sql})")
    return {
        **{name: made(P.rules_sql(name)) for name in P.RULES if name != "premium_threshold"},
        "premium_threshold": made(f"{P.rules_sql('premium_threshold')} UNION ALL {P.PREMIUM_CEILING}"),
        "majority_casing": with_(
            P.rule_ctes(), "SELECT upper_n AS upper, title_n AS title, lower_n AS lower, style FROM style"
        ),
        "parse_currency": with_(V.view_ctes("policies"), f"SELECT row_index, premium, {P._AMOUNT} AS amount FROM policies"),
        "resolve_rules": with_(
            P.rule_ctes(),
            "SELECT proposed_value, count(*) AS n FROM (SELECT CASE WHEN TRY_CAST(premium AS DOUBLE) < 1000 THEN '1000.0' "
            "WHEN TRY_CAST(premium AS DOUBLE) > 400000 THEN '400000.0' END AS proposed_value FROM policies "
            f"WHERE NOT {P._MARKED}) WHERE proposed_value IS NOT NULL GROUP BY 1",
        ),
        "find_correction_proposals": with_(P.correction_ctes(), f"SELECT {P.COLUMNS} FROM corrections"),
    }


_STANDARD = "source_method IN ('format_correction', 'date_format_standardisation', 'value_cleaning')"
_BANDS = (
    "count(*) AS total, count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.6 AND "
    "confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.6) AS low"
)
_CLEANED = (
    "row_index, policy_number, customer_id, inception_date, expiry_date, premium, ncd, postcode, product_type, status, created_at"
)


def review() -> dict[str, str]:
    on = lambda query: with_(P.proposal_ctes(), query)
    # The decisions the Spark side makes: by the row's remainder modulo 3.
    decided = "CASE row_index % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END"
    states = lambda sql: f"SELECT *, {sql} AS status FROM proposals"
    counts = ", ".join(
        f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "approved", "rejected")
    )
    manifest = (
        "dataset_name, row_index, row_identifier, column_name, original_value, proposed_value, proposal_type, source_method, "
        "confidence, status"
    )
    context = ", ".join(text("d." + c) + f" AS {c}" for c in V.COLUMNS["policies"])
    quote_cells = ", ".join(
        f"{text('d.' + c)} AS {c}" for c in V.COLUMNS["quotes"]
    )
    filled = lambda sql: f"CASE WHEN proposal_type = 'cross_dataset_fill' THEN {sql} END"
    position = "CASE WHEN d.row_index = t.row_index THEN 'target' WHEN d.row_index < t.row_index THEN 'above' ELSE 'below' END"
    return {
        "proposals_summary": on(
            f"SELECT proposal_type, {_BANDS} FROM proposals GROUP BY 1 UNION ALL SELECT 'all', {_BANDS} FROM proposals"
        ),
        "build_proposal": on(
            f"SELECT {P.COLUMNS}, seq, 'benchmark' AS session_id, 'pending' AS status, {filled("'quotes'")} AS source_dataset, "
            f"{filled('column_name')} AS source_column, {filled("'policy_number'")} AS join_key, {filled('row_identifier')} AS join_value, "
            "CAST(64 AS INTEGER) AS id_length FROM proposals"
        ),
        "export_session": on(
            "SELECT 'policies' AS part, count(*) AS row_count FROM policies UNION ALL "
            "SELECT 'audit_manifest', count(*) FROM proposals"
        ),
        "run_pipeline": with_(
            {**V.view_ctes("policies", "quotes", "claims"), **P.proposal_ctes(), "every": f"SELECT proposal_type, confidence FROM proposals UNION ALL {P.CLAIM_DATES}"},
            f"SELECT proposal_type, {_BANDS} FROM every GROUP BY 1 UNION ALL SELECT 'all', {_BANDS} FROM every",
        ),
        "session_proposals": on(f"SELECT {P.COLUMNS} FROM proposals"),
        "get_proposals": on(f"SELECT {P.COLUMNS} FROM proposals"),
        "filter_proposals": on(
            f"SELECT {P.COLUMNS} FROM ({states(decided)}) WHERE dataset_name = 'policies' AND proposal_type = 'data_correction' "
            "AND status = 'approved'"
        ),
        "status_counts": on(f"SELECT count(*) AS \"all\", {counts} FROM ({states(decided)})"),
        "filter_options": on(
            "SELECT DISTINCT 'dataset' AS option, dataset_name AS value FROM proposals UNION ALL "
            "SELECT DISTINCT 'type', proposal_type FROM proposals"
        ),
        "standard_cleaning_breakdown": on(
            f"SELECT source_method, CASE WHEN {_STANDARD} THEN 'standard_cleaning' ELSE 'individual' END AS review, "
            f"count(*) AS total, {counts} FROM ({states(decided)}) GROUP BY 1, 2"
        ),
        "apply_decision": on(
            f"SELECT {P.COLUMNS}, status, CASE WHEN status <> 'pending' THEN status END AS user_decision FROM ({states(decided)})"
        ),
        "decision_errors": on(
            "SELECT 'conflict' AS error, 'rejected' AS decision, count(*) AS n FROM proposals WHERE row_index % 3 = 0 UNION ALL "
            "SELECT 'invalid', 'maybe', count(*) FROM proposals WHERE row_index % 3 = 2 UNION ALL "
            "SELECT 'not_found', 'approved', count(*) FROM proposals WHERE row_index % 3 = 2"
        ),
        "bulk_review_cleaning": on(
            f"SELECT {P.COLUMNS}, CASE WHEN {_STANDARD} THEN 'approved' ELSE 'pending' END AS status FROM proposals"
        ),
        "bulk_review_result": on(f"SELECT 'approved' AS decision, {P.COLUMNS} FROM proposals WHERE {_STANDARD}"),
        "cast_value": on(
            "SELECT row_index, column_name, proposed_value, CASE WHEN column_name = 'ncd' THEN "
            "CAST(CAST(proposed_value AS DOUBLE) AS INTEGER) END AS as_integer, CASE WHEN column_name = 'premium' THEN "
            "CAST(proposed_value AS DOUBLE) END AS as_double FROM proposals WHERE column_name IN ('ncd', 'premium')"
        ),
        "apply_proposals": with_(P.applied_ctes("TRUE"), f"SELECT {_CLEANED} FROM cleaned"),
        "write_cleaned": with_(
            P.applied_ctes(_STANDARD),
            "SELECT policy_number, customer_id, inception_date, expiry_date, premium, CAST(ncd AS VARCHAR) AS ncd, postcode, "
            "product_type, status, created_at FROM cleaned",
        ),
        "write_audit_manifest": on(
            f"SELECT {manifest.replace('confidence, status', 'CAST(confidence AS VARCHAR) AS confidence, status')}, "
            f"CASE WHEN status = 'approved' THEN 'true' ELSE 'false' END AS applied FROM ({states(decided)})"
        ),
        "row_context": with_(
            P.rule_ctes(),
            f"SELECT t.row_index AS target_index, {position} AS _position, d.row_index, t.column_name AS highlighted_column, "
            f"(SELECT count(*) FROM policies) AS total_rows, {context} FROM ({P.SEQUENCE}) t JOIN policies d "
            "ON d.row_index BETWEEN t.row_index - 2 AND t.row_index + 2",
        ),
        "source_context": with_(
            V.view_ctes("policies", "quotes"),
            f"SELECT {position.replace('t.row_index', 't.source_row')} AS _position, d.row_index, t.source_row AS match_row_index, "
            "'policy_number' AS matched_key, t.row_identifier AS matched_value, t.column_name AS highlighted_column, "
            f"(SELECT count(*) FROM quotes) AS total_rows, {quote_cells} FROM (SELECT f.*, (SELECT min(q.row_index) FROM quotes q "
            f"WHERE q.policy_number = f.row_identifier) AS source_row FROM ({P.FILLS}) f) t JOIN quotes d "
            "ON d.row_index BETWEEN t.source_row - 2 AND t.source_row + 2",
        ),
    }


# ── joins and insights ─────────────────────────────────────────────────────


def _quality(a: str, b: str, key: str) -> str:
    keys = lambda v: f"(SELECT DISTINCT {text(key)} AS k FROM {v} WHERE {key} IS NOT NULL)"
    return (
        f"SELECT '{a}' AS dataset_a, '{b}' AS dataset_b, '{key}' AS join_key, count(x.k) FILTER (WHERE y.k IS NOT NULL) AS matched_keys, "
        f"count(x.k) AS total_keys_a, count(y.k) AS total_keys_b, count(x.k) FILTER (WHERE y.k IS NULL) AS unmatched_in_a, "
        f"count(y.k) FILTER (WHERE x.k IS NULL) AS unmatched_in_b FROM {keys(a)} x FULL JOIN {keys(b)} y ON x.k = y.k"
    )


_RATED = (
    "SELECT *, CAST(printf('%.3f', CAST(matched_keys / greatest(total_keys_a, total_keys_b, 1) AS DOUBLE)) AS DOUBLE) AS match_rate, "
    "CASE WHEN total_keys_a >= total_keys_b THEN dataset_a ELSE dataset_b END AS base_dataset FROM ({0})"
)
# In session order; every pair's best key is the policy number, a known key name.
PAIRS = [("policies", "quotes"), ("policies", "claims"), ("quotes", "claims")]
_REQUIRED = {
    "avg_claim_by_ncd": (("claim_amount", "ncd"), True),
    "claim_freq_by_product": (("claim_amount", "product_type"), True),
    "claim_by_postcode": (("claim_amount", "postcode"), True),
    "premium_by_postcode": (("postcode", "premium"), False),
    "policy_by_product": (("product_type",), False),
    "avg_premium_by_ncd": (("ncd", "premium"), False),
    "claims_by_type": (("claim_type",), False),
    "avg_claim_by_type": (("claim_amount", "claim_type"), False),
}
_NAMES = {
    "avg_claim_by_ncd": "average claim amount by ncd band",
    "claim_freq_by_product": "claim frequency by product type",
    "claim_by_postcode": "claim volume by postcode area",
}


def _offered(columns: list[str], cross: bool) -> list[str]:
    return [i for i, (need, x) in _REQUIRED.items() if x is cross and set(need) <= set(columns)]


def join_ctes() -> dict[str, str]:
    offers = []
    for i, (a, b) in enumerate(PAIRS):
        found = _offered(V.COLUMNS[a] + V.COLUMNS[b], True)
        examples = " and ".join(_NAMES[f] for f in found[:2])
        titles = ", ".join(BY_ID[f].name for f in found[:3])
        offers.append(f"({i}, '{a}', '{b}', {len(found)}, '{examples}', '{titles}')")
    return {
        **V.view_ctes(*V.SESSION),
        "quality": _RATED.format(union(_quality(a, b, "policy_number") for a, b in PAIRS)),
        "offer": f"SELECT * FROM (VALUES {', '.join(offers)}) t(place, dataset_a, dataset_b, insights, examples, top_insights)",
        "opportunity": (
            "SELECT q.dataset_a, q.dataset_b, q.join_key, CAST(CAST(printf('%.0f', CAST(q.match_rate * 100 AS DOUBLE)) AS DOUBLE) AS INTEGER) AS match_rate, "
            "o.insights AS insights_count, o.top_insights, o.place, CASE WHEN o.insights > 0 THEN 'Combining ' || q.dataset_a || ' and ' || q.dataset_b || "
            "' data enables ' || o.examples ELSE upper(q.dataset_a[1]) || q.dataset_a[2:] || ' and ' || upper(q.dataset_b[1]) || "
            "q.dataset_b[2:] || ' records can be linked — ' || printf('%.0f%%', CAST(printf('%.0f', CAST(q.match_rate * 100 AS DOUBLE)) AS DOUBLE)) || ' of keys match' END "
            "AS business_summary, q.match_rate * 0.6 + o.insights / (SELECT greatest(max(insights), 1) FROM offer) * 0.4 AS value "
            "FROM quality q JOIN offer o ON q.dataset_a = o.dataset_a AND q.dataset_b = o.dataset_b "
            "ORDER BY value DESC, o.place LIMIT 3"
        ),
    }


_AMOUNT = P._AMOUNT


def _insight(source: str, group: str, measure: str | None, outputs: dict[str, str]) -> str:
    total = f"CAST(sum(CAST({measure} AS DECIMAL(28, 6))) AS DOUBLE)"
    how = {
        "mean": f"round_even({total} / count({measure}), 2)",
        "sum": f"round_even(coalesce({total}, 0.0), 2)",
        "count": f"count({measure})",
        "rows": "count(*)",
    }
    made = ", ".join(f"{how[h]} AS {o}" for o, h in outputs.items())
    return f"SELECT {group}, {made} FROM {source} WHERE {group} IS NOT NULL GROUP BY 1"


def joins() -> dict[str, str]:
    on = lambda query: with_(join_ctes(), query)
    quality_columns = (
        "dataset_a, dataset_b, join_key, match_rate, matched_keys, total_keys_a, total_keys_b, unmatched_in_a, unmatched_in_b, "
        "base_dataset"
    )
    # Inner join of policies and claims; policies' columns win on a shared name.
    joined = (
        "(SELECT p.ncd, p.product_type, p.postcode, c.claim_amount FROM policies p JOIN claims c "
        "ON p.policy_number = c.policy_number)"
    )
    names = [c for cols in (V.COLUMNS[v] for v in V.SESSION) for c in cols]
    unique = lambda v, c: f"(SELECT count(DISTINCT {c}) / count(*) FROM {v})"
    candidates = []
    for a, b in PAIRS:
        for c in sorted(set(V.COLUMNS[a]) & set(V.COLUMNS[b])):
            known = c in CFG.join_key_names
            candidates.append(
                f"SELECT '{a}' AS dataset_a, '{b}' AS dataset_b, '{c}' AS \"column\", {str(known).upper()} AS is_known_key, "
                f"{unique(a, c)} AS u_a, {unique(b, c)} AS u_b"
            )
    known_first = "SELECT dataset_a, dataset_b, \"column\", is_known_key, CAST(printf('%.6f', CAST(u_a AS DOUBLE)) AS DOUBLE) AS uniqueness_a, CAST(printf('%.6f', CAST(u_b AS DOUBLE)) AS DOUBLE) AS uniqueness_b"
    single = union(
        f"SELECT '{v}' AS dataset, '{i}' AS id" for v in V.SESSION for i in _offered(V.COLUMNS[v], False)
    )
    cross = union(
        f"SELECT 'join' AS scope, '{a}' AS dataset_a, '{b}' AS dataset_b, 'policy_number' AS join_key, "
        f"(SELECT match_rate FROM quality WHERE dataset_a = '{a}' AND dataset_b = '{b}') AS match_rate, {i} AS insight_id"
        for a, b in PAIRS
        for i in ([f"'{x}'" for x in _offered(V.COLUMNS[a] + V.COLUMNS[b], True)] or ["CAST(NULL AS VARCHAR)"])
    )
    return {
        "uniqueness_ratio": with_(
            V.view_ctes("policies"),
            union(
                f"SELECT 'policies' AS dataset, '{c}' AS name, CAST(printf('%.6f', CAST(count(DISTINCT {c}) / count(*) AS DOUBLE)) AS DOUBLE) AS uniqueness FROM policies"
                for c in V.COLUMNS["policies"]
            ),
        ),
        "join_candidates": with_(
            V.view_ctes(*V.SESSION),
            f"{known_first} FROM ({union(candidates)}) WHERE is_known_key OR u_a >= 0.4 OR u_b >= 0.4",
        ),
        "join_quality": on(f"SELECT {quality_columns} FROM quality"),
        "join_quality_orders_customer": (
            f"SELECT {quality_columns} FROM ("
            + _RATED.format(
                _quality("(SELECT o_custkey AS custkey FROM orders)", "(SELECT c_custkey AS custkey FROM customer)", "custkey")
                .replace("'(SELECT o_custkey AS custkey FROM orders)'", "'orders'")
                .replace("'(SELECT c_custkey AS custkey FROM customer)'", "'customer'")
            )
            + ")"
        ),
        "unmatched_keys": with_(
            V.view_ctes("policies", "quotes"),
            "SELECT 'policies' AS dataset, policy_number AS key FROM (SELECT DISTINCT policy_number FROM policies WHERE policy_number "
            "IS NOT NULL EXCEPT SELECT policy_number FROM quotes) UNION ALL SELECT 'quotes', policy_number FROM (SELECT DISTINCT "
            "policy_number FROM quotes WHERE policy_number IS NOT NULL EXCEPT SELECT policy_number FROM policies)",
        ),
        "base_dataset": on("SELECT dataset_a, dataset_b, base_dataset FROM quality"),
        "match_strength": on(
            "SELECT dataset_a, dataset_b, match_rate, CASE WHEN floor(match_rate * 100 + 0.5) >= 85 THEN 'Strong' WHEN "
            "floor(match_rate * 100 + 0.5) >= 65 THEN 'Moderate' ELSE 'Weak' END AS strength FROM quality"
        ),
        "analyse_joins": on(
            f"{cross} UNION ALL SELECT 'single', dataset, NULL, NULL, NULL, id FROM ({single})"
        ),
        "insight_join": with_(
            V.view_ctes("policies", "claims"),
            "SELECT p.*  EXCLUDE (row_index), c.claim_date, c.claim_amount, c.claim_type, c.status AS status_joined FROM policies p "
            "JOIN claims c ON p.policy_number = c.policy_number",
        ),
        "insight_join_nullsafe": with_(
            V.view_ctes("policies", "quotes"),
            "SELECT p.policy_number, p.ncd, q.ncd AS ncd_joined, q.quote_id FROM policies p JOIN quotes q "
            "ON p.policy_number IS NOT DISTINCT FROM q.policy_number",
        ),
        "avg_claim_by_ncd": on(_insight(joined, "ncd", "claim_amount", {"avg_claim_amount": "mean", "claim_count": "count"})),
        "claim_freq_by_product": on(
            _insight(joined, "product_type", "claim_amount", {"claim_count": "count", "total_claim_amount": "sum"})
        ),
        "claim_by_postcode": on(_insight(joined, "postcode", "claim_amount", {"claim_count": "count", "avg_claim_amount": "mean"})),
        "premium_by_postcode": on(_insight("policies", "postcode", _AMOUNT, {"avg_premium": "mean", "policy_count": "count"})),
        "policy_by_product": on(_insight("policies", "product_type", None, {"policy_count": "rows"})),
        "avg_premium_by_ncd": on(_insight("policies", "ncd", _AMOUNT, {"avg_premium": "mean", "policy_count": "count"})),
        "claims_by_type": on(_insight("claims", "claim_type", None, {"claim_count": "rows"})),
        "avg_claim_by_type": on(_insight("claims", "claim_type", "claim_amount", {"avg_claim_amount": "mean", "claim_count": "count"})),
        "generate_insight": on(
            _insight(
                "(SELECT q.product_type, c.claim_amount FROM quotes q JOIN claims c ON q.policy_number = c.policy_number)",
                "product_type", "claim_amount", {"claim_count": "count", "total_claim_amount": "sum"},
            )
        ),
        "join_opportunities": on(
            "SELECT dataset_a, dataset_b, join_key, match_rate, insights_count, business_summary, top_insights, "
            "(SELECT count(*) FROM quality) AS total FROM opportunity"
        ),
    }


def all_sql() -> dict[str, str]:
    return {
        **sources(), **profiling(), **scoring(), **filling(), **inference(), **rules(), **review(), **joins(),
        **C.all_consistency(join_ctes(), list(LINEITEM), GHOST_AGREEMENT),
        # streams and rewritten files end with what the batch gives
        "apply_to_files": review()["apply_proposals"],
        "stream_corrections": rules()["find_correction_proposals"],
        "stream_decisions": review()["apply_decision"],
    }
