"""Proposals on the derived policies, stated in DuckDB SQL."""

from __future__ import annotations

from checks.views import view_ctes

_ID = "customer_id AS row_identifier"


def _row(method: str, seq: int, confidence: float, column: str, original: str, proposed: str, where: str) -> str:
    return (
        f"SELECT 'data_correction' AS proposal_type, '{method}' AS source_method, 'policies' AS dataset_name, row_index, {_ID}, "
        f"'{column}' AS column_name, {original} AS original_value, {proposed} AS proposed_value, "
        f"CAST({confidence} AS DOUBLE) AS confidence, {seq} AS seq FROM policies WHERE {where}"
    )


def to_date(column: str) -> str:
    return (
        f"CASE WHEN {column} LIKE '%/%' THEN CAST(strptime({column}, '%d/%m/%Y') AS DATE) "
        f"ELSE CAST(substr({column}, 1, 10) AS DATE) END"
    )


def unambiguous(column: str) -> str:
    """Day above 12, or equal to the month."""
    slash_day, slash_month = f"substr({column}, 1, 2)", f"substr({column}, 4, 2)"
    iso_day, iso_month = f"substr({column}, 9, 2)", f"substr({column}, 6, 2)"
    return (
        f"CASE WHEN {column} LIKE '%/%' THEN {slash_day} > '12' OR {slash_month} > '12' OR {slash_day} = {slash_month} "
        f"ELSE {iso_day} > '12' OR {iso_day} = {iso_month} END"
    )


_AMOUNT = "TRY_CAST(regexp_replace(premium, '[£$€,\\s]', '', 'g') AS DOUBLE)"
_MARKED = "regexp_matches(premium, '[£$€,]')"
TITLE = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"

STYLE = (
    "SELECT upper_n, title_n, lower_n, CASE WHEN rows_n = 0 THEN 'title' WHEN upper_n >= title_n AND upper_n >= lower_n "
    "THEN 'upper' WHEN title_n >= lower_n THEN 'title' ELSE 'lower' END AS style FROM (SELECT "
    "count(*) FILTER (WHERE product_type = upper(product_type)) AS upper_n, "
    f"count(*) FILTER (WHERE product_type = {TITLE.format('product_type')}) AS title_n, "
    "count(*) FILTER (WHERE product_type = lower(product_type)) AS lower_n, count(product_type) AS rows_n FROM policies)"
)
_STYLED = (
    "(SELECT CASE style WHEN 'upper' THEN upper(trim(product_type)) WHEN 'lower' THEN lower(trim(product_type)) "
    f"ELSE {TITLE.format('trim(product_type)')} END FROM style)"
)


def _dates(column: str, source: str) -> str:
    proposed = f"strftime({to_date(source)}, '%d-%m-%y')"
    return _row(
        "date_format_standardisation", 103, 0.87, column, source, proposed,
        f"{source} IS NOT NULL AND ({unambiguous(source)})",
    )


RULES = {
    "postcode_uppercase": [
        _row("format_correction", 100, 0.92, "postcode", "postcode", "upper(trim(postcode))", "upper(trim(postcode)) <> postcode")
    ],
    "whitespace_trim": [
        _row("format_correction", 101, 0.92, c, c, f"trim({c})", f"trim({c}) <> {c} AND trim({c}) <> ''")
        for c in ("policy_number", "customer_id", "premium", "status")
    ],
    "product_casing": [
        _row("format_correction", 102, 0.82, "product_type", "product_type", _STYLED, f"{_STYLED} <> product_type")
    ],
    "date_standardise": [
        _dates("inception_date", "inception_date"),
        _dates("expiry_date", "expiry_date"),
        _dates("created_at", "CAST(created_at AS VARCHAR)"),
    ],
    "currency_clean": [
        _row("value_cleaning", 104, 0.88, "premium", "trim(premium)", f"CAST({_AMOUNT} AS VARCHAR)", f"{_MARKED} AND {_AMOUNT} IS NOT NULL")
    ],
    "premium_threshold": [
        _row("business_rule", 105, 0.70, "premium", "trim(premium)", "'50.0'", f"NOT {_MARKED} AND TRY_CAST(premium AS DOUBLE) < 50")
    ],
    "negative_premium": [
        _row("business_rule", 106, 0.95, "premium", "trim(premium)", "'0.0'", f"{_AMOUNT} < 0")
    ],
    "ncd_ceiling": [
        _row("business_rule", 107, 0.75, "ncd", "CAST(ncd AS VARCHAR)", "'9.0'", "ncd > 9")
    ],
    "expiry_before_inception": [
        _row(
            "business_rule", 108, 0.80, "expiry_date", "expiry_date", "inception_date",
            f"{to_date('expiry_date')} < {to_date('inception_date')}",
        )
    ],
}
PREMIUM_CEILING = _row(
    "business_rule", 105, 0.70, "premium", "trim(premium)", "'400000.0'",
    f"NOT {_MARKED} AND TRY_CAST(premium AS DOUBLE) > 400000",
)

ANNUAL = (
    "SELECT 'interpolation' AS proposal_type, 'date_inference' AS source_method, 'policies' AS dataset_name, row_index, "
    f"{_ID}, 'expiry_date' AS column_name, CAST(NULL AS VARCHAR) AS original_value, "
    f"CAST(CAST({to_date('inception_date')} + INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS proposed_value, "
    "CAST(0.75 AS DOUBLE) AS confidence, 50 AS seq FROM policies WHERE expiry_date IS NULL AND "
    "(SELECT both_present >= 3 AND annual_ratio >= 0.8 FROM evidence)"
)
EVIDENCE = (
    "SELECT count(days) AS both_present, count(*) FILTER (WHERE days BETWEEN 364 AND 367) AS annual_rows, "
    "count(*) FILTER (WHERE days BETWEEN 364 AND 367) / count(days) AS annual_ratio FROM "
    f"(SELECT datediff('day', {to_date('inception_date')}, {to_date('expiry_date')}) AS days FROM policies)"
)
SEQUENCE = (
    "SELECT 'interpolation' AS proposal_type, 'sequential_id_inference' AS source_method, 'policies' AS dataset_name, row_index, "
    f"{_ID}, 'policy_number' AS column_name, CAST(NULL AS VARCHAR) AS original_value, "
    "regexp_extract(before, '^(.*?)([0-9]+)$', 1) || lpad(CAST(CAST(regexp_extract(before, '^(.*?)([0-9]+)$', 2) AS BIGINT) + 1 "
    "AS VARCHAR), CAST(length(regexp_extract(before, '^(.*?)([0-9]+)$', 2)) AS INTEGER), '0') AS proposed_value, "
    "CAST(0.65 AS DOUBLE) AS confidence, 51 AS seq FROM (SELECT *, lag(policy_number) OVER w AS before, "
    "lead(policy_number) OVER w AS after FROM policies WINDOW w AS (ORDER BY created_at, row_index)) "
    "WHERE policy_number IS NULL AND before IS NOT NULL AND after IS NOT NULL "
    "AND regexp_extract(before, '^(.*?)([0-9]+)$', 1) = regexp_extract(after, '^(.*?)([0-9]+)$', 1) "
    "AND length(before) = length(after) AND CAST(regexp_extract(before, '^(.*?)([0-9]+)$', 2) AS BIGINT) + 2 "
    "= CAST(regexp_extract(after, '^(.*?)([0-9]+)$', 2) AS BIGINT)"
)


def _fill(column: str) -> str:
    return (
        "SELECT 'cross_dataset_fill' AS proposal_type, 'cross_dataset_lookup' AS source_method, 'policies' AS dataset_name, "
        f"p.row_index, p.policy_number AS row_identifier, '{column}' AS column_name, CAST(NULL AS VARCHAR) AS original_value, "
        f"CAST(q.{column} AS VARCHAR) AS proposed_value, CAST(0.9 AS DOUBLE) AS confidence, 0 AS seq "
        f"FROM policies p JOIN quotes q ON p.policy_number = q.policy_number WHERE p.{column} IS NULL AND q.{column} IS NOT NULL"
    )


FILLS = f"{_fill('ncd')} UNION ALL {_fill('product_type')}"
COLUMNS = (
    "proposal_type, source_method, dataset_name, row_index, row_identifier, column_name, original_value, proposed_value, confidence"
)


def rule_ctes() -> dict[str, str]:
    return {**view_ctes("policies"), "style": STYLE, "evidence": EVIDENCE}


def rules_sql(*names: str) -> str:
    return " UNION ALL ".join(sql for n in names for sql in RULES[n])


MADE = [n for n in RULES if n != "ncd_ceiling"]  # no ceiling by default
CLAIM_DATES = (
    "SELECT 'data_correction' AS proposal_type, CAST(0.87 AS DOUBLE) AS confidence FROM claims "
    f"WHERE claim_date IS NOT NULL AND ({unambiguous('claim_date')})"
)


def correction_ctes() -> dict[str, str]:
    """``corrections`` as made by default: every candidate of every rule."""
    return {**rule_ctes(), "corrections": rules_sql(*MADE)}


def proposal_ctes() -> dict[str, str]:
    """``proposals``: fills, inference and corrections on policies."""
    made = correction_ctes()
    return {
        **view_ctes("policies", "quotes"),
        **made,
        "proposals": f"SELECT * FROM corrections UNION ALL {FILLS} UNION ALL {ANNUAL} UNION ALL {SEQUENCE}",
    }


def applied_ctes(status: str) -> dict[str, str]:
    """``cleaned``: policies after the proposals where ``status`` holds, lowest confidence last."""
    columns = (
        "policy_number", "customer_id", "inception_date", "expiry_date", "premium", "ncd", "postcode", "product_type",
        "status", "created_at",
    )
    def cell(c: str) -> str:
        text = f"max(w.proposed_value) FILTER (WHERE w.column_name = '{c}')"
        if c == "ncd":
            text = f"TRY_CAST(trunc(TRY_CAST({text} AS DOUBLE)) AS INTEGER)"
        kept = f"CAST(any_value(p.{c}) AS VARCHAR)" if c == "created_at" else f"any_value(p.{c})"
        return f"coalesce({text}, {kept}) AS {c}"

    return {
        **proposal_ctes(),
        "winners": (
            "SELECT row_index, column_name, proposed_value FROM (SELECT *, row_number() OVER (PARTITION BY row_index, column_name "
            f"ORDER BY confidence, seq DESC) AS rn FROM proposals WHERE {status}) WHERE rn = 1"
        ),
        "cleaned": (
            f"SELECT p.row_index, {', '.join(cell(c) for c in columns)} FROM policies p LEFT JOIN winners w "
            "ON w.row_index = p.row_index GROUP BY p.row_index"
        ),
    }
