"""The rows around a proposed change, for any number of proposals at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataheal.dataset import Dataset
from dataheal.operators.proposals import CROSS_DATASET_FILL
from dataheal.operators.rules import shown

WINDOW = 2


def _display(ds: Dataset, column: str) -> Column:
    """Cell text; an empty cell or the text ``nan`` shows as nothing."""
    text = shown(ds, column)
    return F.when(~text.isin("", "nan"), text)


def _around(targets: DataFrame, ds: Dataset, window: int) -> DataFrame:
    """``targets`` carry ``target_index``; joins the rows at most ``window`` away."""
    total = ds.df.agg(F.count("*").alias("n"))
    wanted = targets.withColumn(
        "row_index",
        F.explode(F.sequence(F.col("target_index") - window, F.col("target_index") + window)),
    )
    data = ds.df.select("row_index", *[_display(ds, c).alias(c) for c in ds.columns])
    position = (
        F.when(F.col("row_index") == F.col("target_index"), "target")
        .when(F.col("row_index") < F.col("target_index"), "above")
        .otherwise("below")
    )
    return (
        wanted.join(data, "row_index")
        .withColumn("_position", position)
        .withColumn("total_rows", total.scalar())
    )


def row_context(proposals: DataFrame, ds: Dataset, window: int = WINDOW) -> DataFrame:
    """Per proposal on ``ds``: its row and up to ``window`` rows on either side."""
    targets = proposals.filter((F.col("dataset_name") == ds.name) & F.col("row_index").isNotNull()).select(
        F.col("id").alias("proposal_id"),
        F.col("row_index").alias("target_index"),
        F.col("column_name").alias("highlighted_column"),
    )
    return _around(targets, ds, window).select(
        "proposal_id", "_position", "row_index", "highlighted_column", "total_rows", *ds.columns
    )


def source_context(proposals: DataFrame, source: Dataset, key: str, window: int = WINDOW) -> DataFrame:
    """Per fill from ``source`` by ``key``: the first row with the key, and the rows around it."""
    fills = proposals.filter(
        (F.col("proposal_type") == CROSS_DATASET_FILL)
        & (F.col("source_dataset") == source.name)
        & (F.col("join_key") == key)
        & F.col("join_value").isNotNull()
    ).select(
        F.col("id").alias("proposal_id"),
        F.col("join_value").alias("matched_value"),
        F.col("source_column").alias("highlighted_column"),
    )
    firsts = source.df.groupBy(shown(source, key).alias("matched_value")).agg(
        F.min("row_index").alias("target_index")
    )
    targets = fills.join(firsts, "matched_value")
    return _around(targets, source, window).select(
        "proposal_id",
        "_position",
        "row_index",
        F.col("target_index").alias("match_row_index"),
        F.lit(key).alias("matched_key"),
        "matched_value",
        "highlighted_column",
        "total_rows",
        *[c for c in source.columns],
    )
