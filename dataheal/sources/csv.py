"""Headered CSV in: typed by the values found, or as plain strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset, quoted
from dataheal.functions.text import PLAIN_NUMBER
from dataheal.session import write_once
from dataheal.sources import quoted as quoted_cells
from dataheal.sources.positions import with_file_positions

POSITION = "__position"
WHOLE_NUMBER = r"^[+-]?\d+$"
BOOLEAN = ("True", "False", "TRUE", "FALSE", "true", "false")


def _read(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All columns as strings, by Spark's reader: line by line, or a whole file in one task."""
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )


def _positioned(spark: SparkSession, path: str, multiline: bool | None) -> DataFrame:
    """``row_index`` and the cells as text; a data column of that name becomes ``row_index_1``.

    ``multiline`` None looks whether any quoted cell holds a line break. Files without one are read line by
    line, the others by records that are put together across splits; both stay split.
    """
    if multiline is None and quoted_cells.holds_breaks(spark, path):
        names = quoted_cells.header(spark, path)
        written = write_once(quoted_cells.parsed(quoted_cells.records(spark, path), [f"c{i}" for i in range(len(names))]))
        placed = quoted_cells.positioned(written, POSITION).toDF(POSITION, *names)
    else:
        names = (texts := _read(spark, path, bool(multiline))).columns
        placed = with_file_positions(texts, POSITION)
    return placed.select(
        F.col(POSITION).alias("row_index"),
        *[quoted(c).alias("row_index_1" if c.lower() == "row_index" else c) for c in names],
    )


def scan_raw_strings(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Every cell as it stands; only an empty cell or the text ``nan`` is null."""
    positioned = _positioned(spark, path, multiline)
    cells = [F.when(~quoted(c).isin("", "nan"), quoted(c)).alias(c) for c in positioned.columns[1:]]
    return positioned.select("row_index", *cells)


def _without_null_tokens(column: str, cfg: QualityConfig) -> Column:
    return F.when(~quoted(column).isin(*cfg.null_tokens), quoted(column)).alias(column)


def _inferred_kinds(texts: DataFrame) -> dict[str, str]:
    """Type per column from one aggregate over all cells.

    Whole numbers without a gap are ``bigint``; other numbers ``double``; true and false without
    a gap ``boolean``; the rest, and columns with no value that is not a number, stay text.
    """
    tests = {
        "present": lambda c: c.isNotNull(),
        "whole": lambda c: c.rlike(WHOLE_NUMBER) & c.try_cast("bigint").isNotNull(),
        "number": lambda c: c.rlike(PLAIN_NUMBER),
        "truth": lambda c: c.isin(*BOOLEAN),
    }
    counts = texts.agg(
        F.count("*").alias("rows"),
        *[
            F.count_if(test(quoted(c))).alias(f"{kind}{i}")
            for i, c in enumerate(texts.columns)
            for kind, test in tests.items()
        ],
    ).first()
    kinds = {}
    for i, c in enumerate(texts.columns):
        present, whole, number, truth = (counts[f"{kind}{i}"] for kind in tests)
        full = present == counts["rows"]
        if present and whole == present and full:
            kinds[c] = "bigint"
        elif number == present:
            kinds[c] = "double"
        elif truth == present and full:
            kinds[c] = "boolean"
        else:
            kinds[c] = "string"
    return kinds


def scan_csv(spark: SparkSession, path: str, cfg: QualityConfig, multiline: bool | None = None) -> DataFrame:
    """``row_index`` and the typed columns of a CSV file or folder.

    The file is parsed once: its cells are written as text, typed when they are read back.
    """
    positioned = _positioned(spark, path, multiline)
    names = positioned.columns[1:]
    texts = write_once(positioned.select("row_index", *[_without_null_tokens(c, cfg) for c in names]))
    kinds = _inferred_kinds(texts.drop("row_index"))
    return texts.select("row_index", *[quoted(c).try_cast(kinds[c]).alias(c) for c in names])


def csv_dataset(spark: SparkSession, name: str, path: str, cfg: QualityConfig, multiline: bool | None = None) -> Dataset:
    """The file as a dataset: its typed rows are written once, so no later step reads the CSV."""
    return Dataset(name, write_once(scan_csv(spark, path, cfg, multiline)))
