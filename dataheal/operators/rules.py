"""Correction rules.

Every rule is row-local: it looks at one cell (or a date pair) and yields a candidate or null.
The candidates of all rules and columns of a row come out of one projection, so a dataset is
scanned once for all of them, and every candidate becomes a proposal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.dates import date_cell, format_date, format_label, is_ambiguous
from dataheal.functions.text import (
    apply_casing,
    is_marked_money,
    parse_currency,
    render_double,
    strip,
    title_case,
    to_number,
)
from dataheal.operators.labels import Identifiers, count_identifiers, is_date_name, string_columns
from dataheal.operators.profile import text_histogram
from dataheal.operators.proposals import DATA_CORRECTION, build_proposal, no_proposals


def shown(ds: Dataset, column: str) -> Column:
    """The cell as text, the way a reviewer sees it."""
    if isinstance(ds.dtype(column), (T.DoubleType, T.FloatType)):
        return render_double(ds.value(column).cast("double"))
    return ds.text(column)


@dataclass(frozen=True)
class Candidate:
    """What a rule proposes for one column; ``proposed`` is null where it proposes nothing."""

    column: str
    original: Column
    proposed: Column
    note: Column | None = None


def _named(ds: Dataset, names: tuple[str, ...]) -> list[str]:
    return [c for c in ds.columns if c.lower() in names]


# ── candidates per rule ────────────────────────────────────────────────────


def _postcode_uppercase(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    columns = [c for c in _named(ds, cfg.postcode_columns) if c in string_columns(ds)]
    return [Candidate(c, ds.col(c), F.upper(strip(ds.col(c)))) for c in columns]


def _whitespace_trim(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    skipped = cfg.postcode_columns + cfg.product_columns
    columns = [
        c for c in string_columns(ds) if c.lower() not in skipped and not is_date_name(c, cfg)
    ]
    return [Candidate(c, ds.col(c), F.nullif(strip(ds.col(c)), F.lit(""))) for c in columns]


def majority_casing(ds: Dataset, column: str) -> DataFrame:
    """``(upper, title, lower, style)``: conforming values of a column and the commonest style.

    Styles are tested once per distinct value.
    """
    value, n = F.col("value"), F.col("n")
    rows_like = lambda cased: F.coalesce(F.sum(F.when(value == cased, n)), F.lit(0))
    counts = text_histogram(ds, [column]).agg(
        rows_like(F.upper(value)).alias("upper"),
        rows_like(title_case(value)).alias("title"),
        rows_like(F.lower(value)).alias("lower"),
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
    )
    upper, title, lower = F.col("upper"), F.col("title"), F.col("lower")
    style = (
        F.when(F.col("rows") == 0, "title")
        .when((upper >= title) & (upper >= lower), "upper")
        .when(title >= lower, "title")
        .otherwise("lower")
    )
    return counts.select("upper", "title", "lower", style.alias("style"))


def _product_casing(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    def one(c: str) -> Candidate:
        style = majority_casing(ds, c).select("style").scalar()
        return Candidate(c, ds.col(c), apply_casing(strip(ds.col(c)), style), style)

    return [one(c) for c in _named(ds, cfg.product_columns) if c in string_columns(ds)]


def _date_standardise(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    def one(c: str) -> Candidate:
        text = strip(ds.text(c))
        proposed = F.when(~is_ambiguous(text), format_date(date_cell(ds, c), cfg.rules.date_format))
        return Candidate(c, text, proposed)

    return [one(c) for c in ds.textual if is_date_name(c, cfg)]


def _currency_clean(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    def one(c: str) -> Candidate:
        text = strip(ds.col(c))
        return Candidate(c, text, F.when(is_marked_money(text), render_double(parse_currency(text))))

    return [one(c) for c in _named(ds, cfg.currency_columns) if c in string_columns(ds)]


def _premium_threshold(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    lowest, highest = cfg.rules.min_premium, cfg.rules.max_premium

    def one(c: str) -> Candidate:
        text = strip(shown(ds, c))
        number = F.when(~is_marked_money(text), to_number(text))
        bound = F.lit(None).cast("string")
        if highest is not None:
            bound = F.when(number > highest, str(float(highest))).otherwise(bound)
        if lowest is not None:
            bound = F.when(number < lowest, str(float(lowest))).otherwise(bound)
        return Candidate(c, text, bound)

    if lowest is None and highest is None:
        return []
    return [one(c) for c in _named(ds, cfg.premium_columns)]


def _negative_premium(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    def one(c: str) -> Candidate:
        text = strip(shown(ds, c))
        return Candidate(c, text, F.when(parse_currency(text) < 0, "0.0"))

    return [one(c) for c in _named(ds, cfg.premium_columns)]


def _ncd_ceiling(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    ceiling = cfg.rules.max_ncd

    def one(c: str) -> Candidate:
        text = shown(ds, c)
        return Candidate(c, text, F.when(to_number(text) > ceiling, str(float(ceiling))))

    return [] if ceiling is None else [one(c) for c in _named(ds, cfg.ncd_columns)]


def _expiry_before_inception(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
    def one(start: str, end: str) -> Candidate:
        reversed_ = date_cell(ds, end) < date_cell(ds, start)
        return Candidate(end, ds.text(end), F.when(reversed_, ds.text(start)))

    return [one(s, e) for s, e in cfg.annual_pairs if s in ds.textual and e in ds.textual]


# ── the rules in pipeline order ────────────────────────────────────────────


@dataclass(frozen=True)
class Rule:
    name: str
    source_method: str
    confidence: float
    candidates: Callable[[Dataset, QualityConfig], list[Candidate]]
    # Wording from ``column_name, original_value, proposed_value, note``.
    wording: str
    arguments: tuple[str, ...]


RULES = (
    Rule(
        "postcode_uppercase", "format_correction", 0.92, _postcode_uppercase,
        "Postcode '%s' is not trimmed upper case; '%s' is.", ("original_value", "proposed_value"),
    ),
    Rule(
        "whitespace_trim", "format_correction", 0.92, _whitespace_trim,
        "'%s' holds blanks around '%s', which break joins and filters.", ("column_name", "proposed_value"),
    ),
    Rule(
        "product_casing", "format_correction", 0.82, _product_casing,
        "'%s' value '%s' differs from the column's usual %s casing; proposed '%s'.",
        ("column_name", "original_value", "note", "proposed_value"),
    ),
    Rule(
        "date_standardise", "date_format_standardisation", 0.87, _date_standardise,
        "'%s' value '%s' is the date '%s' in the standard format {date_label}.",
        ("column_name", "original_value", "proposed_value"),
    ),
    Rule(
        "currency_clean", "value_cleaning", 0.88, _currency_clean,
        "'%s' value '%s' carries currency marks; as a number it is '%s'.",
        ("column_name", "original_value", "proposed_value"),
    ),
    Rule(
        "premium_threshold", "business_rule", 0.70, _premium_threshold,
        "'%s' value %s is outside the allowed premium range; the nearest bound is %s.",
        ("column_name", "original_value", "proposed_value"),
    ),
    Rule(
        "negative_premium", "business_rule", 0.95, _negative_premium,
        "'%s' value %s is negative, which no premium can be.", ("column_name", "original_value"),
    ),
    Rule(
        "ncd_ceiling", "business_rule", 0.75, _ncd_ceiling,
        "'%s' value %s is above the maximum of %s years.",
        ("column_name", "original_value", "proposed_value"),
    ),
    Rule(
        "expiry_before_inception", "business_rule", 0.80, _expiry_before_inception,
        "'%s' %s lies before the start date %s, which is proposed in its place.",
        ("column_name", "original_value", "proposed_value"),
    ),
)
RULE_NAMES = tuple(r.name for r in RULES)
FIRST_SEQ = 100  # corrections come after fills and inference


def candidates(ds: Dataset, cfg: QualityConfig, rules: list[Rule], label: Column) -> DataFrame | None:
    """``(row_index, row_identifier, rule, column_name, original_value, proposed_value, note)``."""
    found = [(r.name, c) for r in rules for c in r.candidates(ds, cfg)]
    if not found:
        return None
    # Each value is computed once per row, then packed where it changes the cell.
    values, packed = [], []
    for i, (rule, c) in enumerate(found):
        note = F.lit(None).cast("string") if c.note is None else c.note
        values += [c.original.alias(f"o{i}"), c.proposed.alias(f"p{i}"), note.alias(f"n{i}")]
        cell = F.struct(
            F.lit(rule).alias("rule"),
            F.lit(c.column).alias("column_name"),
            F.col(f"o{i}").alias("original_value"),
            F.col(f"p{i}").alias("proposed_value"),
            F.col(f"n{i}").alias("note"),
        )
        packed.append(F.when(F.col(f"p{i}") != F.col(f"o{i}"), cell))
    return ds.df.select("row_index", label.alias("row_identifier"), *values).select(
        "row_index", "row_identifier", F.inline(F.array_compact(F.array(*packed)))
    )


def _worded(found: DataFrame, rules: list[Rule], ds: Dataset, cfg: QualityConfig, session_id: str) -> DataFrame:
    """Candidates as proposal records; one projection words every rule."""
    date_label = format_label(cfg.rules.date_format).replace("%", "%%")

    def by_rule(pick: Callable[[Rule], Column]) -> Column:
        chosen = F
        for rule in rules:
            chosen = chosen.when(F.col("rule") == rule.name, pick(rule))
        return chosen

    return build_proposal(
        found,
        session_id=session_id,
        proposal_type=DATA_CORRECTION,
        source_method=by_rule(lambda r: F.lit(r.source_method)),
        dataset_name=ds.name,
        column_name=F.col("column_name"),
        original_value=F.col("original_value"),
        proposed_value=F.col("proposed_value"),
        explanation=by_rule(
            lambda r: F.format_string(
                r.wording.replace("{date_label}", date_label), *[F.col(a) for a in r.arguments]
            )
        ),
        confidence=by_rule(lambda r: F.lit(r.confidence)),
        row_identifier=F.col("row_identifier"),
        seq=by_rule(lambda r: F.lit(FIRST_SEQ + RULE_NAMES.index(r.name))),
    )


def proposals_of(ds: Dataset, cfg: QualityConfig, rules: list[Rule], identifiers: Identifiers, session_id: str) -> DataFrame | None:
    """Proposals of some rules; None if none of them fits the columns."""
    found = candidates(ds, cfg, rules, identifiers.label_cell(ds))
    return None if found is None else _worded(found, rules, ds, cfg, session_id)


def find_correction_proposals(
    ds: Dataset,
    cfg: QualityConfig,
    session_id: str = "session",
    only: tuple[str, ...] = RULE_NAMES,
    identifiers: Identifiers | None = None,
) -> DataFrame:
    """Proposals of the rules named in ``only`` for one dataset."""
    rules = [r for r in RULES if r.name in only]
    found = proposals_of(ds, cfg, rules, identifiers or count_identifiers(ds, cfg), session_id)
    return no_proposals(ds.df.sparkSession) if found is None else found
