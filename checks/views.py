"""The derived datasets and their column profiles as DuckDB common table expressions."""

from __future__ import annotations

from dataheal.config import DATE_PATTERNS, QualityConfig
from dataheal.plans.views import CLAIM_ORDER, CLAIMS, POLICIES, QUOTES

CFG = QualityConfig()


def _select(view: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in view.items()) + f" FROM {table}"


VIEWS = {
    "policies": _select(POLICIES, "orders"),
    "quotes": _select(QUOTES, "orders"),
    "claims": _select(CLAIMS, "lineitem"),
    "policies_dup": (
        "SELECT *, 1 AS entry FROM policies UNION ALL "
        "SELECT *, 2 AS entry FROM policies WHERE row_index % 50 = 7"
    ),
}
ORDER = {
    "policies": ["row_index"],
    "quotes": ["row_index"],
    "claims": list(CLAIM_ORDER),
    "policies_dup": ["row_index", "entry"],
}
NUMERIC = {"ncd", "quoted_premium", "claim_amount"}
TYPES = {"ncd": "int", "quoted_premium": "double", "claim_amount": "double", "created_at": "timestamp"}
COLUMNS = {
    "policies": [c for c in POLICIES if c not in ORDER["policies"]],
    "quotes": [c for c in QUOTES if c not in ORDER["quotes"]],
    "claims": [c for c in CLAIMS if c not in ORDER["claims"]],
}
COLUMNS["policies_dup"] = COLUMNS["policies"]
SESSION = ("policies", "quotes", "claims")


def with_(ctes: dict[str, str], query: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n" + query


def view_ctes(*names: str) -> dict[str, str]:
    wanted = list(names)
    if "policies_dup" in wanted and "policies" not in wanted:
        wanted.insert(0, "policies")
    return {n: VIEWS[n] for n in sorted(wanted, key=list(VIEWS).index)}


def rounded(sql: str, digits: int) -> str:
    """The decimal nearest to the stored double, as ``printf`` writes it."""
    return f"CAST(printf('%.{digits}f', CAST({sql} AS DOUBLE)) AS DOUBLE)"


def text(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def sample(view: str, column: str) -> str:
    """The first 50 values, which is what a value sample shows."""
    return f"{values(view, column)} ORDER BY {', '.join(ORDER[view])} LIMIT 50"


def values(view: str, column: str) -> str:
    return f"SELECT {text(column)} AS value FROM {view} WHERE {column} IS NOT NULL"


def label(value: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({value}, '{pattern}') THEN '{name}'" for name, pattern in DATE_PATTERNS)
    return f"CASE {cases} END"


def is_date_name(column: str) -> bool:
    return any(k in column for k in CFG.date_keywords)


def casing(view: str, column: str) -> str:
    return (
        f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT lower({text(column)}) AS f, "
        f"count(DISTINCT {column}) AS k, count(*) AS n FROM {view} WHERE {column} IS NOT NULL GROUP BY 1) WHERE k > 1)"
    )


def formats(view: str, column: str) -> str:
    return (
        f"(SELECT coalesce(string_agg(label, ', ' ORDER BY label), '') FROM (SELECT DISTINCT {label('trim(value)')} "
        f"AS label FROM ({values(view, column)})) WHERE label IS NOT NULL)"
    )


def format_count(view: str, column: str) -> str:
    return (
        f"(SELECT count(DISTINCT {label('trim(value)')}) FROM ({values(view, column)}))"
    )


def invalid_dates(view: str, column: str) -> str:
    return (
        f"(SELECT count(*) FROM ({values(view, column)}) WHERE {label('trim(value)')} IS NULL AND trim(value) <> '')"
    )


def outliers(view: str, column: str) -> str:
    return (
        f"(SELECT count(*) FROM {view}, (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 "
        f"FROM {view}) b WHERE CAST({column} AS DOUBLE) < b.q1 - 1.5 * (b.q3 - b.q1) "
        f"OR CAST({column} AS DOUBLE) > b.q3 + 1.5 * (b.q3 - b.q1))"
    )


def _measured(view: str, ordinal: int, column: str) -> str:
    number, date = column in NUMERIC, is_date_name(column) and column not in NUMERIC
    null = lambda kind: f"CAST(NULL AS {kind})"
    stat = lambda sql: f"CAST({sql} AS DOUBLE)" if number else null("DOUBLE")
    return (
        f"SELECT '{view}' AS dataset, {ordinal} AS ordinal, '{column}' AS name, '{TYPES.get(column, 'string')}' AS dtype_raw, "
        f"{'TRUE' if number else 'FALSE'} AS is_numeric, count(*) AS row_count, count(*) - count({column}) AS null_count, "
        f"count(DISTINCT {column}) AS unique_count, {stat(f'min({column})')} AS min, {stat(f'max({column})')} AS max, "
        f"{stat(rounded(f'avg({column})', 4))} AS mean, {stat(rounded(f'quantile_cont({column}, 0.5)', 4))} AS median, "
        f"{stat(rounded(f'stddev_samp({column})', 4))} AS std, {stat(f'quantile_cont({column}, 0.25)')} AS q1, "
        f"{stat(f'quantile_cont({column}, 0.75)')} AS q3, "
        f"{outliers(view, column) if number else null('BIGINT')} AS outlier_count, "
        f"{null('BIGINT') if number else casing(view, column)} AS casing_inconsistency_count, "
        f"{formats(view, column) if date else null('VARCHAR')} AS formats, "
        f"{format_count(view, column) if date else null('BIGINT')} AS format_count, "
        f"{invalid_dates(view, column) if date else null('BIGINT')} AS invalid_date_count FROM {view}"
    )


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _kind() -> str:
    dated = " OR ".join(f"name LIKE '%{k}%'" for k in CFG.date_keywords)
    keyed = " OR ".join(f"name LIKE '%{k}'" for k in CFG.identifier_keywords)
    return (
        f"CASE WHEN is_numeric THEN 'numeric' WHEN {dated} THEN 'date' WHEN {keyed} THEN 'identifier' "
        f"WHEN unique_count / greatest(row_count, 1) < {CFG.categorical_max_ratio} THEN 'categorical' ELSE 'text' END"
    )


def percent(rate: str, decimals: int) -> str:
    return f"printf('%.{decimals}f%%', CAST({rate} AS DOUBLE) * 100)"


def _issues() -> list[str]:
    crit = "is_critical_field"
    return [
        f"CASE WHEN null_pct > 0.5 THEN CASE WHEN {crit} THEN 'Critical field: null rate is ' ELSE 'Null rate is ' END "
        f"|| {percent('null_pct', 0)} || ' — over half of values are missing.' "
        f"WHEN null_pct > 0.2 THEN 'High null rate: ' || {percent('null_pct', 0)} || ' of values are missing.' "
        f"WHEN null_pct > 0.05 THEN 'Elevated null rate: ' || {percent('null_pct', 0)} || ' of values are missing.' "
        f"WHEN null_count > 0 AND {crit} THEN 'Critical field has ' || null_count || ' null value(s) (' || "
        f"{percent('null_pct', 1)} || ').' END",
        f"CASE WHEN inferred_type = 'numeric' AND outlier_count > 0 AND outlier_pct > 0.05 THEN 'High outlier rate: ' || "
        f"outlier_count || ' value(s) are statistical outliers (' || {percent('outlier_pct', 0)} || ' of non-null values).' END",
        "CASE WHEN inferred_type = 'categorical' AND casing_inconsistency_count > 0 THEN 'Inconsistent casing: ' || "
        "casing_inconsistency_count || ' value(s) have mixed case variants (e.g. ''Motor'' / ''motor'' / ''MOTOR'').' END",
        "CASE WHEN inferred_type = 'date' AND format_count > 1 THEN 'Multiple date formats detected: ' || formats || '.' END",
        "CASE WHEN inferred_type = 'date' AND invalid_date_count > 0 THEN invalid_date_count || "
        "' value(s) did not match any known date format.' END",
    ]


def profile_ctes(*views: str) -> dict[str, str]:
    """Views plus ``prof``: one row per dataset and column."""
    measured = " UNION ALL ".join(
        _measured(v, i, c) for v in views for i, c in enumerate(COLUMNS[v])
    )
    rate = lambda n: f"CAST(printf('%.4f', CAST({n} / greatest(row_count, 1) AS DOUBLE)) AS DOUBLE)"
    return {
        **view_ctes(*views),
        "measured": measured,
        "typed": (
            f"SELECT *, {_kind()} AS inferred_type, name IN ({_listed(CFG.critical_fields)}) AS is_critical_field, "
            f"{rate('null_count')} AS null_pct, {rate('unique_count')} AS uniqueness_ratio, "
            f"{rate('outlier_count')} AS outlier_pct FROM measured"
        ),
        "prof": (
            "SELECT *, (inferred_type NOT IN ('identifier', 'numeric') AND "
            f"unique_count / greatest(row_count, 1) > {CFG.high_cardinality_ratio}) AS is_high_cardinality FROM typed"
        ),
        "issue": " UNION ALL ".join(
            f"SELECT dataset, ordinal, name, is_critical_field, null_count, {i} AS place, {sql} AS issue FROM prof"
            for i, sql in enumerate(_issues())
        ),
    }


def dataset_rows(*views: str) -> str:
    parts = []
    for v in views:
        cols = ", ".join(COLUMNS[v])
        parts.append(
            f"SELECT '{v}' AS dataset, (SELECT count(*) FROM {v}) AS row_count, {len(COLUMNS[v])} AS column_count, "
            f"(SELECT count(*) FROM {v}) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {v})) AS duplicate_row_count"
        )
    return (
        "SELECT *, CAST(printf('%.4f', CAST(duplicate_row_count / greatest(row_count, 1) AS DOUBLE)) AS DOUBLE) AS duplicate_row_pct FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )
