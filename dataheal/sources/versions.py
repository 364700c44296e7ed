"""Datasets kept as a list of Parquet files, of which a review rewrites only those it touches.

A manifest lists, by version, the files of a dataset with the rows each one holds. Applying proposals reads the
``row_index`` column of all files to find those with an approved row, rewrites these, one task a file, and writes
the next version of the list, in which the other files stand as they were. A version counts once its commit
row is written, which is the last thing to happen: a failed rewrite leaves the former version in place, and a
reader never sees half of one. Files of former versions stay until they are removed by hand.

Columns keep their types from file to file, so dates, which applying proposals turns to text, must be text before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.dataset import Dataset
from dataheal.operators.apply import DATE_TYPES, LOWEST, cell_winners, write_cells
from dataheal.session import local_frame, materialise

FILES = "ordinal bigint, file string, first_row bigint, last_row bigint, row_count bigint"
COMMITS = "version bigint, attempt string"


def _listed(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, first_row, last_row, row_count)`` of some files, from their ``row_index`` column alone."""
    rows = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file"), "row_index")
    return rows.groupBy("file").agg(F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"), F.count("*").alias("row_count"))


def _commit(files: DataFrame, manifest: str, version: int) -> None:
    spark, attempt = files.sparkSession, uuid.uuid4().hex
    files.coalesce(1).write.parquet(f"{manifest}/files/attempt={attempt}")
    local_frame(spark, [(version, attempt)], COMMITS).coalesce(1).write.mode("append").parquet(f"{manifest}/commits")


def current_version(spark: SparkSession, manifest: str) -> tuple[int, str]:
    """The latest version and its attempt; of two attempts at one version the same one counts for every reader."""
    best = F.max(F.struct("version", "attempt"))
    row = spark.read.schema(COMMITS).parquet(f"{manifest}/commits").agg(best.alias("best")).first()["best"]
    return row["version"], row["attempt"]


def register_files(spark: SparkSession, folder: str, manifest: str) -> None:
    """Version 1 of a dataset: the Parquet files of a folder, which hold a ``row_index`` column."""
    dated = [f.name for f in spark.read.parquet(folder).schema.fields if isinstance(f.dataType, DATE_TYPES)]
    if dated:
        raise ValueError(f"keep these columns as text, as reviewed dates are: {', '.join(dated)}")
    listed = _listed(spark, [folder])
    _commit(listed.select(F.col("first_row").alias("ordinal"), *listed.columns), manifest, 1)


def files_of(spark: SparkSession, manifest: str) -> DataFrame:
    """The files of the current version."""
    _, attempt = current_version(spark, manifest)
    return spark.read.schema(FILES).parquet(f"{manifest}/files/attempt={attempt}")


def read_version(spark: SparkSession, manifest: str, name: str) -> Dataset:
    """The dataset as it stands."""
    files = [r["file"] for r in files_of(spark, manifest).select("file").collect()]
    return Dataset(name, spark.read.parquet(*files))


def apply_to_files(spark: SparkSession, manifest: str, name: str, proposals: DataFrame, folder: str, winner: str = LOWEST) -> int:
    """Apply the approved proposals for dataset ``name``; returns how many files were rewritten.

    Rewritten files go below ``folder``. Without an approved row that the dataset holds, no version is made.
    """
    version, _ = current_version(spark, manifest)
    before = files_of(spark, manifest)
    whole = read_version(spark, manifest, name)
    winners = materialise(cell_winners(proposals, whole, winner))
    rows = winners.select("row_index").distinct()
    places = whole.df.select(F.col("_metadata.file_path").alias("file"), "row_index")
    touched = [r["file"] for r in places.join(rows, "row_index", "left_semi").select("file").distinct().collect()]
    if not touched:
        return 0
    target = f"{folder.rstrip('/')}/version-{version + 1}-{uuid.uuid4().hex}"
    ordinals = before.select("ordinal", "file")
    parts = spark.read.parquet(*touched)
    home = parts.select("row_index", F.col("_metadata.file_path").alias("file")).join(F.broadcast(ordinals), "file").select("row_index", "ordinal")
    changed = write_cells(Dataset(name, parts), winners).join(home, "row_index")
    changed.repartition("ordinal").sortWithinPartitions("ordinal", "row_index").write.partitionBy("ordinal").parquet(target)
    written = spark.read.parquet(target).select(F.col("_metadata.file_path").alias("file"), F.col("ordinal").cast("bigint").alias("ordinal"), "row_index")
    after = written.groupBy("ordinal", "file").agg(F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"), F.count("*").alias("row_count"))
    kept = before.filter(~F.col("file").isin(*touched)).select("ordinal", "file", "first_row", "last_row", "row_count")
    _commit(kept.unionByName(after), manifest, version + 1)
    return len(touched)
