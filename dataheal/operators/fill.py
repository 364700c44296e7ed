"""Filling nulls of one dataset from another that shares a key.

Which key and which columns qualify is decided on column profiles, a few rows per dataset.
The data work is one pre-aggregated lookup by dataset and key, and one equi-join that brings the
lookups to the gaps of all pairs.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset, quoted
from dataheal.functions.text import render_compact
from dataheal.operators.profile import union_all
from dataheal.operators.proposals import CROSS_DATASET_FILL, build_proposal, no_proposals
from dataheal.session import local_frame

_SIDES = ("inferred_type", "uniqueness_ratio", "null_pct", "null_count", "row_count")


def _shared_columns(profiles: DataFrame) -> DataFrame:
    """One row per ordered pair of datasets and column name they share."""
    side = lambda s: profiles.select(
        F.col("dataset").alias(f"dataset_{s}"), "name", *[F.col(c).alias(f"{c}_{s}") for c in _SIDES]
    )
    return side("a").join(side("b"), "name").filter("dataset_a <> dataset_b")


def find_join_keys(profiles: DataFrame, cfg: QualityConfig) -> DataFrame:
    """``(dataset_a, dataset_b, name, ...)``: columns fit to look values up by."""
    both = lambda test: test("a") & test("b")
    identifier = (F.col("inferred_type_a") == "identifier") | (F.col("inferred_type_b") == "identifier")
    return _shared_columns(profiles).filter(
        identifier
        & both(lambda s: F.col(f"uniqueness_ratio_{s}") >= cfg.key_min_uniqueness)
        & both(lambda s: F.col(f"null_pct_{s}") < cfg.key_max_null_pct)
    )


def select_best_join_key(profiles: DataFrame, cfg: QualityConfig) -> DataFrame:
    """Per ordered pair: a preferred key before others, then by uniqueness less null share."""
    quality = (
        (F.col("uniqueness_ratio_a") + F.col("uniqueness_ratio_b")) / 2
        - (F.col("null_pct_a") + F.col("null_pct_b")) / 2
    )
    order = Window.partitionBy("dataset_a", "dataset_b").orderBy(
        F.desc(F.col("name").isin(*cfg.preferred_keys)), F.desc("quality"), "name"
    )
    keys = find_join_keys(profiles, cfg).withColumn("quality", quality)
    return keys.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def fill_confidence(profiles: DataFrame, cfg: QualityConfig) -> DataFrame:
    """The best key per pair with the confidence of a fill by it."""
    primary = (F.col("uniqueness_ratio_a") >= cfg.key_primary_uniqueness) & (
        F.col("uniqueness_ratio_b") >= cfg.key_primary_uniqueness
    )
    return select_best_join_key(profiles, cfg).select(
        "dataset_a",
        "dataset_b",
        F.col("name").alias("join_key"),
        F.when(primary, cfg.fill_confidence_primary)
        .otherwise(cfg.fill_confidence_secondary)
        .alias("confidence"),
    )


def find_fillable_columns(profiles: DataFrame, cfg: QualityConfig) -> DataFrame:
    """``(dataset_a, dataset_b, join_key, confidence, column)``: what each pair may fill."""
    return (
        _shared_columns(profiles)
        .join(fill_confidence(profiles, cfg), ["dataset_a", "dataset_b"])
        .filter(
            (F.col("name") != F.col("join_key"))
            & ~F.col("name").isin(*cfg.fill_exclusions)
            & (F.col("inferred_type_a") != "identifier")
            & (F.col("inferred_type_a") == F.col("inferred_type_b"))
            & (F.col("null_count_a") > 0)
            & (F.col("row_count_b") > F.col("null_count_b"))
        )
        .select("dataset_a", "dataset_b", "join_key", "confidence", F.col("name").alias("column"))
    )


def dedup_lookup(source: Dataset, key: str, columns: list[str]) -> DataFrame:
    """Per key the first non-null value of each column in row order.

    Combined before the shuffle, so a key that fills a third of the table is no hot spot.
    """
    order = F.struct(*[source.col(c) for c in source.row_order])
    firsts = [
        F.min_by(source.value(c), F.when(source.value(c).isNotNull(), order)).alias(c) for c in columns
    ]
    return source.df.filter(source.col(key).isNotNull()).groupBy(source.value(key).alias(key)).agg(*firsts)


def _proposed(source: Dataset, column: str):
    """A looked-up value as text; whole floats without ``.0``."""
    if isinstance(source.dtype(column), (T.DoubleType, T.FloatType)):
        return render_compact(F.col(f"lookup.`{column}`").cast("double"))
    return F.col(f"lookup.`{column}`").cast("string")


def cross_dataset_fill(
    target: Dataset,
    source: Dataset,
    key: str,
    columns: list[str],
    confidence: float,
    session_id: str = "session",
    seq: int = 0,
) -> DataFrame:
    """Proposals for the null cells of ``columns`` in ``target`` whose key ``source`` knows."""
    lookup = dedup_lookup(source, key, columns).withColumnRenamed(key, "_key").alias("lookup")
    is_null = lambda c: target.value(c).isNull()
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | is_null(c)
    gaps = target.df.filter(target.col(key).isNotNull() & any_null).select(
        "row_index",
        target.value(key).alias("_target_key"),
        *[is_null(c).alias(f"_gap_{c}") for c in columns],
    )
    # Keys of different kinds are compared as text.
    same_kind = target.dtype(key) == source.dtype(key)
    left, right = F.col("_target_key"), F.col("lookup._key")
    matched = gaps.join(lookup, left == right if same_kind else left.cast("string") == right.cast("string"))
    cells = [
        F.when(
            quoted(f"_gap_{c}") & F.col(f"lookup.`{c}`").isNotNull(),
            F.struct(F.lit(c).alias("column"), _proposed(source, c).alias("proposed")),
        )
        for c in columns
    ]
    found = matched.select(
        "row_index",
        left.cast("string").alias("key_value"),
        F.inline(F.array_compact(F.array(*cells))),
    )
    return build_proposal(
        found,
        session_id=session_id,
        proposal_type=CROSS_DATASET_FILL,
        source_method="cross_dataset_lookup",
        dataset_name=target.name,
        column_name=F.col("column"),
        original_value=None,
        proposed_value=F.col("proposed"),
        explanation=F.format_string(
            f"'{source.name}' holds '%s' in its column '%s' where {key} is '%s'.",
            F.col("proposed"),
            F.col("column"),
            F.col("key_value"),
        ),
        confidence=confidence,
        row_identifier=F.col("key_value"),
        seq=seq,
        source_dataset=source.name,
        source_column=F.col("column"),
        join_key=key,
        join_value=F.col("key_value"),
    )


def _lookups(datasets: dict[str, Dataset], wanted: dict[tuple[str, str], set[str]]) -> DataFrame:
    """``(source, join_key, key, known)``: what each dataset knows about each key, as a map from column to text."""
    sides = []
    for (name, key), columns in sorted(wanted.items()):
        ds, chosen = datasets[name], sorted(columns)
        lookup = dedup_lookup(ds, key, chosen).alias("lookup")
        entries = [
            F.when(F.col(f"lookup.`{c}`").isNotNull(), F.struct(F.lit(c).alias("column"), _proposed(ds, c).alias("value"))) for c in chosen
        ]
        sides.append(lookup.select(
            F.lit(name).alias("source"), F.lit(key).alias("join_key"), F.col(f"lookup.`{key}`").cast("string").alias("key"),
            F.map_from_entries(F.array_compact(F.array(*entries))).alias("known"),
        ))
    return union_all(sides)


def _gaps(datasets: dict[str, Dataset], wanted: dict[tuple[str, str], set[str]]) -> DataFrame:
    """``(target, join_key, key, row_index, gaps)``: the rows with null cells among the wanted columns, by key."""
    sides = []
    for (name, key), columns in sorted(wanted.items()):
        ds = datasets[name]
        empty = F.array_compact(F.array(*[F.when(ds.value(c).isNull(), F.lit(c)) for c in sorted(columns)]))
        rows = ds.df.filter(ds.col(key).isNotNull()).select(
            F.lit(name).alias("target"), F.lit(key).alias("join_key"), ds.value(key).cast("string").alias("key"), "row_index", empty.alias("gaps")
        )
        sides.append(rows.filter(F.size("gaps") > 0))
    return union_all(sides)


def find_cross_dataset_fills(
    datasets: dict[str, Dataset], profiles: DataFrame, cfg: QualityConfig, session_id: str = "session"
) -> DataFrame:
    """Fills over all ordered pairs of a session.

    Every dataset is read once as a source and once as a target for each key it takes part with, whatever the
    number of pairs: one join on (key name, key) brings all sources to all gaps, and a short list
    says which pair may fill which columns. Keys are compared as text.
    """
    spark = profiles.sparkSession
    plan: dict[tuple[str, str], list[Row]] = {}
    for row in find_fillable_columns(profiles, cfg).collect():
        plan.setdefault((row["dataset_a"], row["dataset_b"]), []).append(row)
    pairs, of_source, of_target = [], {}, {}
    for seq, (target, source) in enumerate(permutations(datasets, 2)):
        for row in plan.get((target, source), ()):
            pairs.append((target, source, row["join_key"], row["column"], row["confidence"], seq))
            of_source.setdefault((source, row["join_key"]), set()).add(row["column"])
            of_target.setdefault((target, row["join_key"]), set()).add(row["column"])
    if not pairs:
        return no_proposals(spark)
    allowed = local_frame(spark, pairs, "target string, source string, join_key string, column string, confidence double, seq int")
    met = _gaps(datasets, of_target).join(_lookups(datasets, of_source), ["join_key", "key"]).filter("target <> source")
    cells = met.select("target", "source", "join_key", "key", "row_index", "known", F.explode("gaps").alias("column"))
    found = cells.join(F.broadcast(allowed), ["target", "source", "join_key", "column"]).withColumn("proposed", F.element_at("known", F.col("column")))
    return build_proposal(
        found.filter(F.col("proposed").isNotNull()),
        session_id=session_id,
        proposal_type=CROSS_DATASET_FILL,
        source_method="cross_dataset_lookup",
        dataset_name=F.col("target"),
        column_name=F.col("column"),
        original_value=None,
        proposed_value=F.col("proposed"),
        explanation=F.format_string(
            "'%s' holds '%s' in its column '%s' where %s is '%s'.", "source", "proposed", "column", "join_key", "key"
        ),
        confidence=F.col("confidence"),
        row_identifier=F.col("key"),
        seq=F.col("seq"),
        source_dataset=F.col("source"),
        source_column=F.col("column"),
        join_key=F.col("join_key"),
        join_value=F.col("key"),
    )
