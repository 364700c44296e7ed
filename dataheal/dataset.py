"""A named table of a session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Dataset:
    """``df`` plus the columns that fix its row order; those are not data and never profiled.

    Operators that address single rows need ``row_order == ("row_index",)``.
    """

    name: str
    df: DataFrame
    row_order: tuple[str, ...] = ("row_index",)

    @property
    def fields(self) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if f.name not in self.row_order]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.fields if isinstance(f.dataType, T.NumericType)]

    @property
    def textual(self) -> list[str]:
        """String columns, and dates and timestamps, which count as ISO text."""
        kinds = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
        return [f.name for f in self.fields if isinstance(f.dataType, kinds)]

    def col(self, column: str) -> Column:
        """The column of exactly this name, dots and quotes included."""
        return quoted(column)

    def dtype(self, column: str) -> T.DataType:
        return self.df.schema[column].dataType

    def value(self, column: str) -> Column:
        """The cell, with NaN as null and one spelling of zero."""
        col = quoted(column)
        if isinstance(self.dtype(column), (T.DoubleType, T.FloatType)):
            return F.when(col == 0, F.lit(0.0)).when(~F.isnan(col), col)
        return col

    def text(self, column: str) -> Column:
        return self.value(column).cast("string")

    def clean(self, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        chosen = self.columns if columns is None else columns
        return self.df.select(*[quoted(c) for c in keep], *[self.value(c).alias(c) for c in chosen])
