"""Choices made from column profiles: row labels and ordering columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.operators.profile import text_histogram
from dataheal.session import local_frame


def is_date_name(name: str, cfg: QualityConfig) -> bool:
    return any(k in name.lower() for k in cfg.date_keywords)


def is_identifier_name(name: str, cfg: QualityConfig) -> bool:
    return name.lower().endswith(cfg.identifier_keywords) and not is_date_name(name, cfg)


def string_columns(ds: Dataset) -> list[str]:
    return [f.name for f in ds.fields if isinstance(f.dataType, T.StringType)]


def find_row_label_column(profile: DataFrame) -> DataFrame:
    """The null-free identifier with the highest uniqueness; the first such column on a tie."""
    return (
        profile.filter((F.col("inferred_type") == "identifier") & (F.col("null_count") == 0))
        .groupBy("dataset")
        .agg(F.max_by("name", F.struct("uniqueness_ratio", -F.col("ordinal"))).alias("label_column"))
    )


@dataclass(frozen=True)
class Identifiers:
    """What the row-level operators need to know about a dataset's identifier columns."""

    label: str | None
    with_nulls: tuple[str, ...]

    def label_cell(self, ds: Dataset) -> Column:
        return ds.text(self.label) if self.label else F.lit(None).cast("string")


def _choose(found: list[tuple[str, bool, float]]) -> Identifiers:
    """From ``(name, has nulls, uniqueness)`` in column order; the first wins a tie."""
    full = [(name, ratio) for name, nulls, ratio in found if not nulls]
    best = max(full, key=lambda c: c[1], default=(None, 0.0))
    return Identifiers(best[0], tuple(name for name, nulls, _ in found if nulls))


def profiled_identifiers(profiled: list[Row]) -> Identifiers:
    """From collected profile rows of one dataset."""
    rows = [r for r in profiled if r["inferred_type"] == "identifier"]
    return _choose([(r["name"], r["null_count"] > 0, r["uniqueness_ratio"]) for r in rows])


def count_identifiers(ds: Dataset, cfg: QualityConfig) -> Identifiers:
    """Counts the identifier columns, where no profile is at hand."""
    names = [c for c in ds.columns if c not in ds.numeric and is_identifier_name(c, cfg)]
    if not names:
        return Identifiers(None, ())
    rows = ds.df.agg(F.count("*").alias("n"))
    counted = text_histogram(ds, names).groupBy("name").agg(
        F.count_if(F.col("n") > 0).alias("unique_count"), F.sum("n").alias("non_null")
    )
    got = {r["name"]: r for r in counted.withColumn("rows", rows.scalar()).collect()}
    found = []
    for c in names:
        if c not in got:
            found.append((c, True, 0.0))
        else:
            r = got[c]
            found.append((c, r["non_null"] < r["rows"], round(r["unique_count"] / r["rows"], 4)))
    return _choose(found)


def ordering_column(ds: Dataset, cfg: QualityConfig) -> str | None:
    """The first configured ordering name the dataset has, whatever its case."""
    by_lower = {c.lower(): c for c in ds.columns}
    return next((by_lower[k] for k in cfg.ordering_columns if k in by_lower), None)


def find_ordering_column(ds: Dataset, cfg: QualityConfig) -> DataFrame:
    rows = [(ds.name, ordering_column(ds, cfg))]
    return local_frame(ds.df.sparkSession, rows, "dataset string, ordering_column string")
