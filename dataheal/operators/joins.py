"""Join discovery: which datasets share a key, and how well it matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.numbers import round_even
from dataheal.operators.profile import distinct_cells, union_all
from dataheal.operators.rules import shown
from dataheal.session import local_frame


def uniqueness_ratio(ds: Dataset) -> DataFrame:
    """``(dataset, name, uniqueness)``: distinct non-null values over rows, not rounded."""
    counted = distinct_cells(ds)
    rows = ds.df.agg(F.count("*").alias("n"))
    ratio = F.col("unique_count") / F.greatest(rows.scalar(), F.lit(1))
    return counted.select(F.lit(ds.name).alias("dataset"), "name", ratio.alias("uniqueness"))


def session_uniqueness(datasets: dict[str, Dataset]) -> DataFrame:
    """Uniqueness of the columns that occur in more than one dataset; no other can be a key."""
    names = [c for ds in datasets.values() for c in ds.columns]
    parts = []
    for ds in datasets.values():
        shared = [c for c in ds.columns if names.count(c) > 1]
        if shared:
            parts.append(uniqueness_ratio(Dataset(ds.name, ds.df.select(*[ds.col(c) for c in (*ds.row_order, *shared)]), ds.row_order)))
    if not parts:
        spark = next(iter(datasets.values())).df.sparkSession
        return local_frame(spark, [], "dataset string, name string, uniqueness double")
    return union_all(parts)


def join_candidates(uniqueness: DataFrame, order: list[str], cfg: QualityConfig) -> DataFrame:
    """Per unordered pair of datasets: shared columns that could be the key, best first.

    ``order`` is the session's dataset order; it says which of a pair is A.
    """
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("dataset"))
    side = lambda s: uniqueness.select(
        F.col("dataset").alias(f"dataset_{s}"),
        place.alias(f"place_{s}"),
        "name",
        F.col("uniqueness").alias(f"uniqueness_{s}"),
    )
    known = F.lower("name").isin(*cfg.join_key_names)
    unique = (F.col("uniqueness_a") >= cfg.join_min_uniqueness) | (
        F.col("uniqueness_b") >= cfg.join_min_uniqueness
    )
    return (
        side("a")
        .join(side("b"), "name")
        .filter("place_a < place_b")
        .filter(known | unique)
        .select(
            "dataset_a", "dataset_b", F.col("name").alias("column"), known.alias("is_known_key"),
            "uniqueness_a", "uniqueness_b",
        )
    )


def best_join_keys(uniqueness: DataFrame, order: list[str], cfg: QualityConfig) -> DataFrame:
    """Known key names first, then alphabetically."""
    rank = F.struct(~F.col("is_known_key"), F.col("column"))
    return (
        join_candidates(uniqueness, order, cfg)
        .groupBy("dataset_a", "dataset_b")
        .agg(F.min_by("column", rank).alias("join_key"))
    )


def _key_sides(a: Dataset, b: Dataset, key: str) -> DataFrame:
    """One row per distinct key, as text, with the sides it occurs on.

    Both sides go through one aggregation on the key, combined before the shuffle, so the full
    outer join of the key sets costs a single exchange and no key is hot.
    """
    side = lambda ds, in_a: ds.df.select(
        shown(ds, key).alias("key"), F.lit(in_a).alias("in_a"), F.lit(1 - in_a).alias("in_b")
    ).filter(F.col("key").isNotNull())
    return (
        side(a, 1)
        .unionByName(side(b, 0))
        .groupBy("key")
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )


def match_rate(matched: Column, total_a: Column, total_b: Column) -> Column:
    return round_even(matched / F.greatest(total_a, total_b, F.lit(1)), 3)


def join_quality(a: Dataset, b: Dataset, key: str) -> DataFrame:
    """Distinct-key overlap of two datasets."""
    both = F.col("in_a") + F.col("in_b") == 2
    counted = _key_sides(a, b, key).agg(
        F.count_if(both).alias("matched_keys"),
        F.count_if(F.col("in_a") == 1).alias("total_keys_a"),
        F.count_if(F.col("in_b") == 1).alias("total_keys_b"),
    )
    matched, total_a, total_b = F.col("matched_keys"), F.col("total_keys_a"), F.col("total_keys_b")
    return counted.select(
        F.lit(a.name).alias("dataset_a"),
        F.lit(b.name).alias("dataset_b"),
        F.lit(key).alias("join_key"),
        match_rate(matched, total_a, total_b).alias("match_rate"),
        "matched_keys",
        "total_keys_a",
        "total_keys_b",
        (total_a - matched).alias("unmatched_in_a"),
        (total_b - matched).alias("unmatched_in_b"),
        base_dataset(total_a, total_b, F.lit(a.name), F.lit(b.name)).alias("base_dataset"),
    )


def base_dataset(total_a: Column, total_b: Column, name_a: Column, name_b: Column) -> Column:
    """The side with more keys; A on a tie."""
    return F.when(total_a >= total_b, name_a).otherwise(name_b)


def unmatched_keys(a: Dataset, b: Dataset, key: str) -> DataFrame:
    """The keys that occur on one side only."""
    return (
        _key_sides(a, b, key)
        .filter(F.col("in_a") + F.col("in_b") == 1)
        .select(F.when(F.col("in_a") == 1, a.name).otherwise(b.name).alias("dataset"), "key")
    )


def match_strength(rate: Column, cfg: QualityConfig) -> Column:
    pct = F.floor(rate * 100 + 0.5)
    return (
        F.when(pct >= cfg.strong_match_pct, "Strong")
        .when(pct >= cfg.moderate_match_pct, "Moderate")
        .otherwise("Weak")
    )


def _key_owners(datasets: dict[str, Dataset], columns: dict[str, list[str]]) -> DataFrame:
    """``(name, owners, n)``: how many keys of a column occur in exactly these datasets, by place.

    Every dataset is read once for all its key columns; equal keys are combined before the
    shuffle, and what is left is as long as the combinations of datasets that occur.
    """
    sides = []
    for place, (name, ds) in enumerate(datasets.items()):
        if columns.get(name):
            cells = [F.struct(F.lit(c).alias("name"), shown(ds, c).alias("key")) for c in columns[name]]
            keys = ds.df.select(F.inline(F.array(*cells))).filter(F.col("key").isNotNull())
            sides.append(keys.withColumn("place", F.lit(place)))
    owned = union_all(sides).groupBy("name", "key").agg(F.array_sort(F.collect_set("place")).alias("owners"))
    return owned.groupBy("name", "owners").agg(F.count("*").alias("n"))


def detect_join_pairs(datasets: dict[str, Dataset], cfg: QualityConfig) -> DataFrame | None:
    """Join quality of every pair that has a usable key; reads grow with the datasets, not with the pairs."""
    order = list(datasets)
    chosen = best_join_keys(session_uniqueness(datasets), order, cfg).collect()
    if not chosen:
        return None
    columns: dict[str, list[str]] = {}
    for r in chosen:
        for name in (r["dataset_a"], r["dataset_b"]):
            if r["join_key"] not in columns.setdefault(name, []):
                columns[name].append(r["join_key"])
    rows = [(r["dataset_a"], r["dataset_b"], r["join_key"], order.index(r["dataset_a"]), order.index(r["dataset_b"])) for r in chosen]
    pairs = local_frame(
        next(iter(datasets.values())).df.sparkSession, rows,
        "dataset_a string, dataset_b string, join_key string, place_a int, place_b int",
    )
    owners = _key_owners(datasets, columns)
    held = owners.join(F.broadcast(pairs), owners["name"] == pairs["join_key"])
    in_a, in_b = F.array_contains("owners", F.col("place_a")), F.array_contains("owners", F.col("place_b"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counted = held.groupBy("dataset_a", "dataset_b", "join_key").agg(
        total(in_a & in_b).alias("matched_keys"), total(in_a).alias("total_keys_a"), total(in_b).alias("total_keys_b")
    )
    # a pair neither of whose sides has a key still is one
    full = pairs.select("dataset_a", "dataset_b", "join_key").join(counted, ["dataset_a", "dataset_b", "join_key"], "left").fillna(0)
    matched, total_a, total_b = F.col("matched_keys"), F.col("total_keys_a"), F.col("total_keys_b")
    return full.select(
        "dataset_a",
        "dataset_b",
        "join_key",
        match_rate(matched, total_a, total_b).alias("match_rate"),
        "matched_keys",
        "total_keys_a",
        "total_keys_b",
        (total_a - matched).alias("unmatched_in_a"),
        (total_b - matched).alias("unmatched_in_b"),
        base_dataset(total_a, total_b, F.col("dataset_a"), F.col("dataset_b")).alias("base_dataset"),
    )
