"""Dense row positions without a single-task window.

``with_file_positions`` numbers rows in file order, ``with_sorted_positions`` in the order of
given columns. Both add per-block offsets to block starts; only one number per shuffle
partition ever reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataheal.dataset import quoted
from dataheal.session import local_frame, materialise

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33
# Names of helper columns, which no data column has.
ID, FILE, BLOCK, START, SIZE, FIRST = (f"__position_{k}" for k in ("id", "file", "block", "start", "size", "first"))


def _starts(counted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(block, sum of the sizes before it), blocks in order."""
    ordered = sorted(counted)
    ends = accumulate(n for _, n in ordered)
    return [(block, end - n) for (block, n), end in zip(ordered, ends)]


def with_sorted_positions(df: DataFrame, order_by: list[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based rank of each row in the total order of ``order_by``, then of the whole row.

    Equal rows are interchangeable. The row breaks ties, so rows that share the leading values
    are dealt to several tasks and their ranks do not depend on where they were read.
    """
    keys = [quoted(c) for c in order_by]
    tie = F.xxhash64(*[quoted(c) for c in df.columns])
    ranged = df.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie).withColumn(ID, F.monotonically_increasing_id())
    # A rerun of the range shuffle could draw other bounds, so the ids are fixed first.
    fixed = materialise(ranged).withColumn(BLOCK, F.shiftright(ID, _PARTITION_BITS).cast("int"))
    counted = [(r[BLOCK], r["n"]) for r in fixed.groupBy(BLOCK).agg(F.count("*").alias("n")).collect()]
    starts = local_frame(df.sparkSession, _starts(counted), f"{BLOCK} int, {START} bigint")
    offset = F.col(ID) - F.shiftleft(F.col(BLOCK).cast("bigint"), _PARTITION_BITS)
    return fixed.join(F.broadcast(starts), BLOCK).withColumn(name, F.col(START) + offset).drop(ID, BLOCK, START)


def sums_before(df: DataFrame, order_by: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before each row in the order of ``order_by``."""
    fixed = materialise(df.repartitionByRange(*order_by).withColumn(ID, F.spark_partition_id()))
    counted = [(r[ID], r["n"]) for r in fixed.groupBy(ID).agg(F.sum(value).alias("n")).collect()]
    starts = local_frame(df.sparkSession, _starts(counted), f"{ID} int, {START} bigint")
    before = Window.partitionBy(ID).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col(START) + F.coalesce(F.sum(value).over(before), F.lit(0))
    return fixed.join(F.broadcast(starts), ID).withColumn(name, total).drop(ID, START)


def with_file_positions(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row of a file scan: files by path, rows as they stand.

    File splits are planned the same way each time, so rows need not be materialised.
    """
    columns = [quoted(c) for c in df.columns]
    tagged = df.select(
        *columns,
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ID),
    )
    blocks = tagged.groupBy(FILE, BLOCK).agg(F.count("*").alias(SIZE), F.min(ID).alias(FIRST))
    starts = sums_before(blocks, [FILE, BLOCK], SIZE, "__position_before").drop(SIZE)
    return tagged.join(starts, [FILE, BLOCK]).select(
        (F.col("__position_before") + F.col(ID) - F.col(FIRST)).alias(name), *columns
    )
