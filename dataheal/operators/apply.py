"""Applying approved proposals to a dataset and recording what was applied."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.dataset import Dataset, quoted
from dataheal.operators.proposals import APPROVED

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
LOWEST, HIGHEST = "lowest_confidence", "highest_confidence"

#: How many applicable proposals have a proposal's id.
APPLIED_BY_ID = "_applied_by_id"

MANIFEST_COLUMNS = (
    "dataset_name", "row_index", "row_identifier", "column_name", "original_value", "proposed_value",
    "proposal_type", "source_method", "confidence", "status", "reviewed_at", "applied",
)


def cast_value(text: Column, dtype: T.DataType) -> Column:
    """Proposed text as a value of the column's type; null where it is not one.

    Whole-number columns take the integer part, so ``'50.0'`` becomes 50. Date and timestamp
    columns count as ISO text, so any text fits them and a cleaned one is text.
    """
    if isinstance(dtype, T.IntegralType):
        whole = F.coalesce(text.try_cast("bigint"), _toward_zero(text.try_cast("double")))
        return whole.try_cast(dtype)
    if isinstance(dtype, (T.StringType, *DATE_TYPES)):
        return text
    return text.try_cast(dtype)


def _toward_zero(number: Column) -> Column:
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("bigint")


def _fits(ds: Dataset) -> Column:
    """Is it an approved proposal for a cell that exists and a value its column can hold?"""
    rows = ds.df.agg(F.count("*").alias("n"))
    castable = F.lit(False)
    for f in ds.fields:
        fits = cast_value(F.col("proposed_value"), f.dataType).isNotNull()
        castable = castable | ((F.col("column_name") == f.name) & fits)
    return (
        (F.col("status") == APPROVED)
        & (F.col("dataset_name") == ds.name)
        & F.col("row_index").isNotNull()
        & (F.col("row_index") >= 0)
        & F.col("column_name").isin(*ds.columns)
        & castable
        & (F.col("row_index") < rows.scalar())
    )


def _applicable(proposals: DataFrame, ds: Dataset) -> DataFrame:
    return proposals.filter(_fits(ds))


def _order(winner: str) -> Column:
    """Proposals are written most confident first, in the order they were made; the last stays."""
    if winner == LOWEST:
        return F.struct(-F.col("confidence"), F.col("seq"), F.col("id"))
    if winner == HIGHEST:
        return F.struct(F.col("confidence"), -F.col("seq"), F.col("id"))
    raise ValueError(f"winner must be {LOWEST!r} or {HIGHEST!r}")


def cell_winners(proposals: DataFrame, ds: Dataset, winner: str = LOWEST) -> DataFrame:
    """``(row_index, column_name, proposed_value)``: the proposal each cell ends up with.

    Dealt by row, as they are also gathered and joined by row: one shuffle serves all three.
    """
    return (
        _applicable(proposals, ds)
        .select("row_index", "column_name", "proposed_value", "confidence", "seq", "id")
        .repartition("row_index")
        .groupBy("row_index", "column_name")
        .agg(F.max_by("proposed_value", _order(winner)).alias("proposed_value"))
    )


def apply_proposals(ds: Dataset, proposals: DataFrame, winner: str = LOWEST) -> DataFrame:
    """The dataset with its approved changes; rows without one pass through.

    Rows and changes are dealt by ranges of rows in one shuffle and meet there in their order, so that writing
    the rows in order moves none of them again.
    """
    change = F.struct("column_name", "proposed_value", _order(winner).alias("rank")).alias("_change")
    changes = _applicable(proposals, ds).select("row_index", change)
    rows = ds.df.select("row_index", F.struct(*[quoted(f.name) for f in ds.fields]).alias("_row"))
    dealt = rows.unionByName(changes, allowMissingColumns=True).repartitionByRange("row_index")
    named = _names(ds)
    of_row = Window.partitionBy("row_index")

    def winning(column: str) -> Column:
        rank = F.when(F.col("_change.column_name") == column, F.col("_change.rank"))
        return F.max_by(F.col("_change.proposed_value"), rank).over(of_row)

    met = dealt.select("row_index", "_row", *[winning(c).alias(new) for c, new in named.items()])
    kept = met.filter(F.col("_row").isNotNull()).select("row_index", "_row.*", *named.values())
    return kept.select("row_index", *_changed(ds, named))


def write_cells(ds: Dataset, winners: DataFrame) -> DataFrame:
    """The dataset, or some of its rows, with the cells that :func:`cell_winners` names.

    Changes meet the data in one join on ``row_index``, at most one row per data row. Spark
    broadcasts the changes where they turn out small. A row's cells are picked by column, in the order by
    row that the winners and the join have anyway.
    """
    named = _names(ds)
    # a cell has one winner at most
    picked = [F.max(F.when(F.col("column_name") == c, F.col("proposed_value"))).alias(new) for c, new in named.items()]
    changes = winners.groupBy("row_index").agg(*picked)

    return ds.df.join(changes, "row_index", "left").select("row_index", *_changed(ds, named))


def _names(ds: Dataset) -> dict[str, str]:
    """By column, the column with what it is changed to."""
    return {f.name: f"_changed_{k}" for k, f in enumerate(ds.fields)}


def _changed(ds: Dataset, named: dict[str, str]) -> list[Column]:
    def cell(f: T.StructField) -> Column:
        proposed = cast_value(F.col(named[f.name]), f.dataType)
        kept = ds.text(f.name) if isinstance(f.dataType, DATE_TYPES) else F.col(f.name)
        return F.coalesce(proposed, kept).alias(f.name)

    return [cell(f) for f in ds.fields]


def applied_ids(proposals: DataFrame, datasets: dict[str, Dataset]) -> DataFrame:
    ids = [_applicable(proposals, ds).select("id") for ds in datasets.values()]
    out = ids[0]
    for more in ids[1:]:
        out = out.unionByName(more)
    return out


def with_applied(proposals: DataFrame, datasets: dict[str, Dataset]) -> DataFrame:
    """Proposals with ``APPLIED_BY_ID``, 0 for one without an id. Those a review has dealt by id are not moved again."""
    fits = reduce(add, [F.coalesce(_fits(ds), F.lit(False)).cast("int") for ds in datasets.values()])
    found = F.sum("_fits").over(Window.partitionBy("id"))
    counted = proposals.withColumn("_fits", fits).withColumn(APPLIED_BY_ID, found)
    return counted.withColumn(APPLIED_BY_ID, F.when(F.col("id").isNotNull(), F.col(APPLIED_BY_ID)).otherwise(0))


def audit_manifest(proposals: DataFrame, datasets: dict[str, Dataset]) -> DataFrame:
    """One row per proposal of any status; ``applied`` says whether its cell was written. One whose id several
    applicable proposals have is listed once for each of them. ``proposals`` may come from :func:`with_applied`."""
    counted = proposals if APPLIED_BY_ID in proposals.columns else with_applied(proposals, datasets)
    times = F.array_repeat(F.col(APPLIED_BY_ID) > 0, F.greatest(F.col(APPLIED_BY_ID), F.lit(1)).cast("int"))
    return counted.select(*MANIFEST_COLUMNS[:-1], F.explode(times).alias("applied")).select(*MANIFEST_COLUMNS)
