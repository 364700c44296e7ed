"""Session helpers: a Spark session with the settings the plans assume, and materialisation."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A setting of Spark 4.1 and later: an action's shuffle files are deleted when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders that :func:`write_once` has written in this process.
_WRITTEN: list[str] = []


def build_session(app: str = "dataheal", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``. Without one, a folder in the warehouse: in local
    mode any, on a cluster one that was named, since the default lies on the driver's own disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") and not context.getConf().contains("spark.sql.warehouse.dir"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_dataheal"
        context.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    For values that a second run of the same plan could assign differently, such as
    partition numbers after a sampled range shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _write(df: DataFrame, path: str) -> None:
    """Parquet packed by zstd, which halves hashes and other texts that snappy leaves as they are."""
    df.write.option("compression", "zstd").parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """In a ``with`` block, which must run no frame twice, shuffle files go as each action ends, not when the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def write_once(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there, column by column."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as Parquet in the shared folder for the time of a ``with`` block, which must collect what it reads."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    try:
        _write(df, path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_table(df: DataFrame) -> None:
    """Delete the table that :func:`write_once` returned as ``df``, once nothing reads it any more."""
    folders = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
    for path in [p for p in _WRITTEN if p.rsplit("/", 1)[-1] in folders]:
        _delete(df.sparkSession, path)
        _WRITTEN.remove(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that :func:`write_once` wrote, once nothing reads them any more; returns how many."""
    removed = 0
    while _WRITTEN:
        removed += _delete(spark, _WRITTEN.pop())
    return removed


def local_frame(spark: SparkSession, rows: Iterable, ddl: str) -> DataFrame:
    """A few rows of metadata as a local relation, which plans know the size of.

    Rows are tuples in column order, or ``Row`` or dict by name.
    """
    schema = T.StructType.fromDDL(ddl)

    def named(row) -> dict:
        if isinstance(row, Row):
            row = row.asDict(recursive=True)
        return row if isinstance(row, dict) else dict(zip(schema.names, row))

    table = pa.Table.from_pylist([named(r) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)
