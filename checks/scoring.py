"""Penalties, scores and the executive roll-up in DuckDB SQL."""

from __future__ import annotations

from checks.views import dataset_rows, percent, profile_ctes

SCORED = ("policies", "quotes", "claims", "policies_dup")

_PENALTIES = [
    (
        0, "null",
        "CASE WHEN null_pct > 0.5 THEN 10 WHEN null_pct > 0.2 THEN 5 WHEN null_pct > 0.05 THEN 2 END",
        "CASE WHEN is_critical_field THEN 'high' ELSE 'medium' END",
        f"'Column ''' || name || ''': ' || {percent('null_pct', 1)} || ' of values are null (' || null_count || ' missing).'",
        "null_pct",
    ),
    (
        1, "critical_null", "CASE WHEN is_critical_field AND null_count > 0 THEN 15 END", "'critical'",
        "'Critical field ''' || name || ''' has ' || null_count || ' null value(s) — heavy penalty applied.'", "null_pct",
    ),
    (
        2, "casing", "CASE WHEN inferred_type = 'categorical' AND casing_inconsistency_count > 0 THEN 3 END", "'low'",
        "'Column ''' || name || ''': ' || casing_inconsistency_count || "
        "' value(s) have inconsistent casing (mixed upper / lower case).'", "NULL",
    ),
    (
        3, "date_formats", "CASE WHEN inferred_type = 'date' AND format_count > 1 THEN 5 END", "'medium'",
        "'Column ''' || name || ''': ' || format_count || ' different date formats detected (' || formats || ').'", "NULL",
    ),
    (
        4, "invalid_dates", "CASE WHEN inferred_type = 'date' AND invalid_date_count > 0 THEN 2 END", "'medium'",
        "'Column ''' || name || ''': ' || invalid_date_count || ' value(s) did not match any recognised date format.'", "NULL",
    ),
    (
        5, "outliers",
        "CASE WHEN inferred_type = 'numeric' AND outlier_count > 0 AND row_count > null_count "
        "AND outlier_count / (row_count - null_count) > 0.05 THEN 3 END", "'low'",
        f"'Column ''' || name || ''': ' || outlier_count || ' statistical outlier(s) detected (' || "
        f"{percent('outlier_count / (row_count - null_count)', 1)} || ' of non-null values).'",
        "outlier_count / (row_count - null_count)",
    ),
]


def score_ctes(*views: str) -> dict[str, str]:
    """Profiles plus ``rows``, ``penalty`` and ``score``."""
    per_column = [
        f"SELECT dataset, ordinal, name AS \"column\", {place} AS penalty_order, '{kind}' AS kind, "
        f"CAST({points} AS DOUBLE) AS points_deducted, {severity} AS severity, {reason} AS reason, "
        f"CAST({rate} AS DOUBLE) AS rate FROM prof WHERE ({points}) IS NOT NULL"
        for place, kind, points, severity, reason, rate in _PENALTIES
    ]
    duplicate = (
        "SELECT dataset, -1 AS ordinal, CAST(NULL AS VARCHAR) AS \"column\", 0 AS penalty_order, 'duplicates' AS kind, "
        "CAST(CASE WHEN duplicate_row_pct > 0.05 THEN 20 ELSE 10 END AS DOUBLE) AS points_deducted, 'high' AS severity, "
        f"'Duplicate rows: ' || duplicate_row_count || ' row(s) (' || {percent('duplicate_row_pct', 1)} || "
        "') are exact duplicates.' AS reason, duplicate_row_pct AS rate FROM rows "
        "WHERE duplicate_row_count > 0 AND duplicate_row_pct > 0.01"
    )
    return {
        **profile_ctes(*views),
        "rows": dataset_rows(*views),
        "penalty": " UNION ALL ".join([duplicate, *per_column]),
        "scored": (
            "SELECT r.dataset, r.row_count, greatest(0.0, CAST(printf('%.1f', CAST(100.0 - coalesce(sum(p.points_deducted), 0) AS DOUBLE)) AS DOUBLE)) AS score, "
            "count(p.kind) AS issue_count, string_agg(CASE WHEN p.kind = 'critical_null' THEN p.\"column\" END, ', ' "
            "ORDER BY p.ordinal) AS fields FROM rows r LEFT JOIN penalty p ON p.dataset = r.dataset GROUP BY 1, 2"
        ),
        "score": (
            "SELECT *, CASE WHEN score >= 80 THEN 'Green' WHEN score >= 60 THEN 'Amber' ELSE 'Red' END AS grade FROM scored"
        ),
    }


SCORE_SUMMARY = (
    "printf('Score %.1f/100 (%s). %d issue(s) found, %.1f point(s) deducted.', CAST(score AS DOUBLE), grade, issue_count, "
    "CAST(100.0 - score AS DOUBLE)) || CASE WHEN fields IS NOT NULL THEN ' Critical fields with null values: ' || fields "
    "|| '.' ELSE '' END"
)


def _label(sql: str) -> str:
    """Underscores to blanks, words capitalised; the names checked here are plain letters."""
    return (
        f"list_reduce(list_transform(string_split(replace({sql}, '_', ' '), ' '), "
        "lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || ' ' || b)"
    )


def alert_text() -> str:
    column, dataset = _label('"column"'), _label("dataset")
    share = "printf('%.0f%%', rate * 100)"
    return (
        f"CASE kind WHEN 'critical_field' THEN {column} || ' has ' || {share} || ' missing values in ' || {dataset} || "
        "' — this is a critical insurance field' "
        f"WHEN 'critical_null' THEN {column} || ' has ' || {share} || ' missing values in ' || {dataset} || "
        "' — may impact pricing accuracy and regulatory compliance' "
        f"WHEN 'null' THEN {column} || ' has ' || {share} || ' missing values in ' || {dataset} "
        f"WHEN 'duplicates' THEN {dataset} || ' contains duplicate rows — may indicate data entry errors or system duplication' "
        f"WHEN 'outliers' THEN {column} || ' in ' || {dataset} || ' has statistical outliers — review for data entry errors or "
        "genuine anomalies' "
        f"WHEN 'casing' THEN {column} || ' in ' || {dataset} || ' has inconsistent text formatting — affects data matching and "
        "reporting accuracy' "
        f"ELSE 'Date columns in ' || {dataset} || ' use mixed formats — standardisation required for time-series analysis' END"
    )


def alert_ctes(*views: str) -> dict[str, str]:
    place = "CASE dataset " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(views)) + " END"
    urgency = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
    tie = "urgency, points_impact DESC, place, ordinal, penalty_order"
    return {
        **score_ctes(*views),
        "alerts": (
            f"SELECT *, {place} AS place, {urgency} AS urgency FROM (SELECT dataset, \"column\", kind, severity, rate, ordinal, "
            "penalty_order, points_deducted AS points_impact FROM penalty WHERE severity IN ('critical', 'high') UNION ALL "
            "SELECT dataset, name, 'critical_field', 'critical', null_pct, ordinal, 99, 20.0 FROM prof "
            "WHERE is_critical_field AND null_count > 0)"
        ),
        "first_alerts": (
            f"SELECT *, row_number() OVER (PARTITION BY dataset, coalesce(\"column\", '') ORDER BY {tie}) AS rn FROM alerts"
        ),
        "top_alerts": (
            f"SELECT severity, dataset, coalesce(\"column\", '') AS \"column\", {alert_text()} AS alert_text, points_impact, "
            f"urgency, place, ordinal FROM first_alerts WHERE rn = 1 ORDER BY {tie} LIMIT 5"
        ),
    }


OVERALL = (
    "SELECT sum(score * row_count) / sum(row_count) AS mean, count(*) AS dataset_count FROM score"
)
OVERALL_GRADE = "CASE WHEN mean >= 75 THEN 'Green' WHEN mean >= 50 THEN 'Amber' ELSE 'Red' END"
BENCHMARK = (
    "CASE WHEN CAST(printf('%.1f', CAST(mean - 75 AS DOUBLE)) AS DOUBLE) >= 5 THEN 'Your data quality is ' || printf('%.0f', CAST(printf('%.0f', CAST(abs(CAST(printf('%.1f', CAST(mean - 75 AS DOUBLE)) AS DOUBLE)) AS DOUBLE)) AS DOUBLE)) || "
    "' points above the industry benchmark of 75/100 — maintain focus on critical field completeness to stay ahead.' "
    "WHEN CAST(printf('%.1f', CAST(mean - 75 AS DOUBLE)) AS DOUBLE) >= 0 THEN 'Your data quality is close to the industry benchmark of 75/100. Addressing the "
    "critical alerts above could push you into the Green tier.' "
    "ELSE 'Your data quality is ' || printf('%.0f', CAST(printf('%.0f', CAST(abs(CAST(printf('%.1f', CAST(mean - 75 AS DOUBLE)) AS DOUBLE)) AS DOUBLE)) AS DOUBLE)) || ' points below the industry "
    "benchmark of 75/100. Focus on fixing missing values in critical insurance fields to improve reliability scores.' END"
)
