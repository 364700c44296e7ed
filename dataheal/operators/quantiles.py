"""Exact quantiles of many columns, from a value histogram, with bounded groups.

A mergeable sketch first brackets each quantile between two values a few percent of the rows
apart. Counting the rows below the bracket turns the global rank into a rank inside it. The
bracket is cut into equal-width cells, whose counts locate the cell that holds the rank, and
only that cell's values are ranked one by one. The result is exact and interpolates linearly
between the two neighbouring ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from dataheal.session import local_frame

PROBABILITIES = {"q1": 0.25, "median": 0.50, "q3": 0.75}
SKETCH_K = 2_000  # sketch rank error: about 0.25 % of the rows at 99 % confidence
MARGIN = 0.03  # bracket half-width, twelve times that error
CELLS = 1_024
BRACKETS = "array<struct<lo:double,hi:double>>"


def sketched_brackets(col: Column) -> Column:
    """Aggregate: ``array<struct<lo, hi>>``, one value range around each quantile; null without values."""
    sketch = F.kll_sketch_agg_double(col, SKETCH_K)
    at = lambda rank: F.kll_sketch_get_quantile_double(sketch, F.lit(rank))
    ranges = [F.struct(at(q - MARGIN).alias("lo"), at(q + MARGIN).alias("hi")) for q in PROBABILITIES.values()]
    return F.when(F.count(col) > 0, F.array(*ranges))


def search_frame(spark: SparkSession, columns: list[Row]) -> DataFrame:
    """One row per column and quantile: where to look for it, and its 0-based rank.

    ``columns`` are rows with ``name, non_null, min, max, near``; ``near`` comes from
    :func:`sketched_brackets`.
    """
    rows = []
    for c in columns:
        if not c["non_null"]:
            continue
        for (label, q), near in zip(PROBABILITIES.items(), c["near"]):
            rows.append((c["name"], label, near["lo"], near["hi"], q * (c["non_null"] - 1)))
    return local_frame(spark, rows, "name string, label string, lo double, hi double, rank double")


def _cell() -> Column:
    """Equal-width cell of ``num`` in ``[lo, hi]``, one cell below it and one above.

    A bracket of equal ends is a single cell.
    """
    inside = F.coalesce(F.expr(f"width_bucket(num, lo, hi, {CELLS})"), F.lit(0).cast("bigint"))
    return (
        F.when(F.col("num") < F.col("lo"), F.lit(-1))
        .when(F.col("num") > F.col("hi"), F.lit(CELLS + 2))
        .otherwise(inside)
    )


def _holds(start: Column, size: Column, rank: Column) -> Column:
    return (start <= rank) & (rank < start + size)


def exact_quantiles(hist: DataFrame, searches: DataFrame) -> DataFrame:
    """``(name, q1, median, q3)`` from ``hist (name, num, n)``.

    ``searches`` is a :func:`search_frame`; being as long as the column list it is broadcast.
    """
    low, high = F.floor("rank"), F.ceil("rank")
    key = ["name", "label"]

    # Values outside a bracket only count. Were a rank ever to fall there, that cell would be
    # ranked, so the result is exact whatever the bracket.
    search = F.broadcast(searches)
    placed = hist.join(search, "name").withColumn("cell", _cell())
    sizes = placed.groupBy(*key, "cell").agg(F.sum("n").alias("size"))
    before = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(search, key)
        .filter(_holds(F.col("start"), F.col("size"), low) | _holds(F.col("start"), F.col("size"), high))
        .select(*key, "cell", "start")
    )

    # At most two cells per quantile are left; their values are ranked.
    run = Window.partitionBy(*key, "cell").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(wanted), [*key, "cell"]).withColumn(
        "first", F.col("start") + F.coalesce(F.sum("n").over(run), F.lit(0))
    )
    value_at = lambda q, rank: F.max(
        F.when((F.col("label") == q) & _holds(F.col("first"), F.col("n"), rank), F.col("num"))
    )
    ends = ranked.groupBy("name").agg(
        *[value_at(q, low).alias(f"low_{q}") for q in PROBABILITIES],
        *[value_at(q, high).alias(f"high_{q}") for q in PROBABILITIES],
        *[F.max(F.when(F.col("label") == q, F.col("rank") - low)).alias(f"part_{q}") for q in PROBABILITIES],
    )
    between = lambda q: F.col(f"low_{q}") + (F.col(f"high_{q}") - F.col(f"low_{q}")) * F.col(f"part_{q}")
    return ends.select("name", *[between(q).alias(q) for q in PROBABILITIES])
