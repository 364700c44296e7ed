"""What several operators share: Arrow batches, word hashes, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dataheal.session import materialise

#: Most bytes of text that one step of a Python operator holds as Python objects.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts, where the session has Spark's default.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"
#: Most rows of a broadcast list of identifiers; longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows in a partition of an intermediate table of slim rows.
SETTLED_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches that hold few texts; a size that the user chose stays.

    An executor holds a batch of each task twice over, in the JVM and in Python, so thousands of long texts take most of its room.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def chunks(batches: Iterable[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``most`` (``CHUNK_BYTES``) bytes of ``text`` each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64)
        part = np.cumsum(size) // (most or CHUNK_BYTES)
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def map_rows(df: DataFrame, schema: str, text: str, make: Callable[[pa.RecordBatch], dict], most: int | None = None) -> DataFrame:
    """``make`` turns a slice of rows into columns by name; rows stay in their partitions."""
    small_batches(df.sparkSession)
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, most):
            made = make(part)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` neighbouring word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : n + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, in as many partitions as its rows ask for: few rows do not go through a shuffle of many tiny files."""
    out = materialise(df)
    return out.coalesce(max(1, -(-out.count() // SETTLED_ROWS)))


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids``: a broadcast if the list is short, else a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def without(df: DataFrame, found: DataFrame, condition: Column) -> DataFrame:
    """The rows of ``df`` that match none of ``found``, which is written already: a broadcast if it is short, else a shuffle."""
    few = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(found) if few else found, condition, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b); component: its smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. A star's rows
    carry one aggregate, so a node with many neighbours is summed before the shuffle and no
    neighbour list is ever built. Each round is cut from its lineage in the shared folder.
    """
    edges = settled(edges.select("a", "b").where("a <> b").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(least, "a")
        moved = near.where("b > a") if large else near
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    while True:
        after = settled(star(star(edges, True), False))
        total = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        same = total(ordered) == total(after)
        edges = after
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
