"""Every threshold, name list and rule setting an operator needs.

All operators take a :class:`QualityConfig`, so the same plans run on tables of
another domain by passing another config.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

# The tokens a headered CSV cell may hold to mean "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Date spellings the profiler recognises, in matching order.
DATE_PATTERNS = (
    ("ISO (YYYY-MM-DD)", r"^\d{4}-\d{2}-\d{2}$"),
    ("Slash (DD/MM/YYYY)", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("Long-form (Month D YYYY)", r"^[A-Za-z]+ \d{1,2} \d{4}$"),
    ("Long-form (D Month YYYY)", r"^\d{1,2} [A-Za-z]+ \d{4}$"),
)


@dataclass(frozen=True)
class Rules:
    """Per-session business-rule settings; ``None`` switches a check off."""

    min_premium: float | None = 50.0
    max_premium: float | None = None
    max_ncd: int | None = None
    date_format: str = "%d-%m-%y"
    currency_symbol: str = "£"

    # Both spellings of each override are accepted.
    _SPELLINGS = {
        "min_premium": "min_premium",
        "minimum_premium": "min_premium",
        "max_premium": "max_premium",
        "maximum_premium": "max_premium",
        "max_ncd": "max_ncd",
        "date_format": "date_format",
        "date_format_standard": "date_format",
        "currency_symbol": "currency_symbol",
    }

    def overlaid(self, overrides: dict | None) -> Rules:
        """These rules with a session's overrides on top; unknown names are ignored."""
        known = {self._SPELLINGS[k]: v for k, v in (overrides or {}).items() if k in self._SPELLINGS}
        return replace(self, **known)

    def to_json(self) -> str:
        return json.dumps(
            {
                "minimum_premium": self.min_premium,
                "maximum_premium": self.max_premium,
                "max_ncd": self.max_ncd,
                "date_format_standard": self.date_format,
                "currency_symbol": self.currency_symbol,
            },
            ensure_ascii=False,
        )


@dataclass(frozen=True)
class QualityConfig:
    # Columns that matter most to the business.
    critical_fields: tuple[str, ...] = (
        "policy_number", "premium", "ncd", "inception_date", "expiry_date",
        "postcode", "product_type", "claim_id", "claim_amount",
    )

    # Name hints for the semantic type of a column.
    date_keywords: tuple[str, ...] = (
        "date", "time", "inception", "expiry", "created", "updated", "issued", "effective",
    )
    identifier_keywords: tuple[str, ...] = ("id", "number", "ref", "code", "key", "no")
    categorical_max_ratio: float = 0.30
    high_cardinality_ratio: float = 0.85
    null_tokens: tuple[str, ...] = NULL_TOKENS
    top_k: int = 5

    # Score deductions. Tiers are (rate to exceed, points), highest first.
    null_tiers: tuple[tuple[float, int], ...] = ((0.50, 10), (0.20, 5), (0.05, 2))
    duplicate_tiers: tuple[tuple[float, int], ...] = ((0.05, 20), (0.01, 10))
    critical_null_points: int = 15
    casing_points: int = 3
    date_formats_points: int = 5
    invalid_date_points: int = 2
    outlier_points: int = 3
    outlier_rate: float = 0.05
    grade_green: float = 80
    grade_amber: float = 60

    # Filling nulls from another dataset.
    fill_exclusions: tuple[str, ...] = ("status", "description", "notes", "comments", "remarks")
    key_min_uniqueness: float = 0.80
    key_max_null_pct: float = 0.10
    key_primary_uniqueness: float = 0.95
    fill_confidence_primary: float = 0.90
    fill_confidence_secondary: float = 0.75
    preferred_keys: tuple[str, ...] = (
        "policy_number", "claim_id", "quote_id", "policy_id", "claim_number", "quote_number",
    )

    # Conservative inference.
    annual_pairs: tuple[tuple[str, str], ...] = (("inception_date", "expiry_date"),)
    annual_min_rows: int = 3
    annual_min_ratio: float = 0.80
    annual_days: tuple[int, int] = (364, 367)
    annual_confidence: float = 0.75
    sequence_confidence: float = 0.65
    ordering_columns: tuple[str, ...] = (
        "timestamp", "created_at", "created", "quote_time", "transaction_time",
        "event_time", "recorded_at", "logged_at", "datetime",
    )

    # Columns the correction rules look for (lower-case names).
    postcode_columns: tuple[str, ...] = ("postcode", "post_code", "zip", "zip_code", "postal_code")
    product_columns: tuple[str, ...] = (
        "product_type", "product", "cover_type", "coverage_type", "policy_type",
    )
    currency_columns: tuple[str, ...] = (
        "premium", "gross_premium", "net_premium", "annual_premium",
        "claim_amount", "amount", "sum_insured",
    )
    premium_columns: tuple[str, ...] = ("premium", "gross_premium", "net_premium", "annual_premium")
    ncd_columns: tuple[str, ...] = (
        "ncd", "ncd_years", "ncb", "ncb_years", "no_claims_discount", "no_claims_bonus",
    )
    rules: Rules = field(default_factory=Rules)

    # Join discovery.
    join_min_uniqueness: float = 0.40
    join_key_names: tuple[str, ...] = (
        "policy_number", "claim_id", "quote_id", "policy_id", "claim_number", "quote_number",
        "customer_id", "client_id", "policyholder_id", "risk_id", "endorsement_id",
    )
    strong_match_pct: int = 85
    moderate_match_pct: int = 65

    # Executive roll-up.
    overall_green: float = 75
    overall_amber: float = 50
    benchmark_score: int = 75
    critical_alert_points: int = 20
    max_alerts: int | None = 5
    max_opportunities: int | None = 3
    match_weight: float = 0.6
    insight_weight: float = 0.4

    def with_rules(self, overrides: dict | None) -> QualityConfig:
        return replace(self, rules=self.rules.overlaid(overrides))
