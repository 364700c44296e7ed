"""Centroid clustering in whole numbers, with a filter in rotated coordinates.

Components become integers, and all that decides is exact: squared distances, sums and floors. What
makes a round cheap is a bound. The vectors' covariance gives a rotation; of every vector the
``LEADING`` rotated coordinates and the norm of the rest are stored beside its integers. Squared
distance of the leading coordinates plus squared difference of the residual norms never exceeds
the true squared distance, so a centroid whose bound lies above a distance already measured is out.
Only the survivors are measured in integers. Bounds are lowered by more than their rounding error, so
they never decide.

Vectors are written once in that form, packed, to the shared folder. A round reads that table in
place and returns, from each task, one sum for each centroid and component; Spark adds them up and the
driver gets ``centroids x (components + 2)`` numbers, whatever the number of vectors. Rounds after one
that moved no centroid would change nothing and are left out.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinite component are
left out; a null id is hashed as an empty one; repeated rows are clustered each, and as first
centroids they are ordered by their integers; a table with fewer vectors than centroids has as many
centroids as vectors; one without vectors gives no rows; other columns are not read. An integer beyond
``LARGEST`` raises an error, as squared distances would no longer fit into 64 bits.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.llm import common
from dataheal.session import write_once

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED, LEADING = 64, 8, 10, 1024, 3, 16
LARGEST = 1 << 27
#: Relative rounding error allowed to a bound: stored coordinates have 24 bits.
SLACK = 2.0**-20
ROTATED = "vec_id long, whole binary, lead binary, rest float"


def finite(embedding: Column, components: int) -> Column:
    """Whether a vector has all its components, none null, NaN or infinite (NaN compares above all numbers)."""
    number = lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(sys.float_info.max), F.lit(False))
    return F.coalesce((F.size(embedding) == components) & F.forall(embedding, number), F.lit(False))


def whole(column: pa.Array, components: int, scale: int) -> np.ndarray:
    """The integers floor(scale * x) of a list column, one row a vector."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, components)
    if len(x) and np.abs(x).max() > LARGEST:
        raise OverflowError(f"a component times {scale} is beyond {LARGEST}: squared distances would not fit into 64 bits")
    return x.astype(np.int64)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


@dataclass
class Rotation:
    """Leading principal axes (a column each) of vectors around their mean."""

    mean: np.ndarray
    axes: np.ndarray

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest, in 32 bits."""
        centred = x - self.mean
        lead = centred @ self.axes
        rest = np.sqrt(np.maximum(0.0, (centred * centred).sum(1) - (lead * lead).sum(1)))
        return lead.astype(np.float32), rest.astype(np.float32)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centres: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centre of every vector (ties: smaller number), its squared distance, and how many distances were measured."""
    centre_lead, centre_rest = (a.astype(np.float64) for a in rotation.split(centres))
    lead, rest = lead.astype(np.float64), rest.astype(np.float64)
    bound = (rest[:, None] - centre_rest) ** 2
    for k in range(lead.shape[1]):
        bound += (lead[:, k, None] - centre_lead[:, k]) ** 2
    norm = lambda a, b: np.sqrt((a * a).sum(1) + b * b)
    slack = SLACK * (norm(lead, rest)[:, None] + norm(centre_lead, centre_rest))
    first = bound.argmin(1)
    bound = np.maximum(0.0, np.sqrt(bound) - slack) ** 2 * (1 - SLACK)
    gap = x - centres[first]
    cluster, best, measured = first.astype(np.int32), (gap * gap).sum(1), len(x)
    for c in range(len(centres)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        gap = x[rows] - centres[c]
        far = (gap * gap).sum(1)
        better = (far < best[rows]) | ((far == best[rows]) & (c < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = c, far[better]
        measured += len(rows)
    return cluster, best, measured


def of_tasks(df: DataFrame, keys: list[str], measure: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple]]) -> dict[tuple, int | float]:
    """``measure`` yields (*keys, sum) once for each task; sums of all tasks by key. Whole numbers come as two halves."""
    schema = T.StructType([T.StructField(k, T.IntegerType()) for k in keys]).add("high", T.LongType()).add("low", T.LongType()).add("real", T.DoubleType())
    arrow = common.to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, *((None, None, s) if isinstance(s, float) else (s >> 32, s & 0xFFFFFFFF, None))) for *key, s in measure(batches)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    total = df.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("real").alias("real"))
    return {tuple(r[k] for k in keys): r["real"] if r["high"] is None else (r["high"] << 32) + r["low"] for r in total.collect()}


def principal(kept: DataFrame, components: int, scale: int, leading: int) -> Rotation | None:
    """The rotation by the covariance of all vectors; None without vectors. Its rounding changes no result."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        total, square = np.zeros(components + 1), np.zeros((components, components))
        for b in batches:
            x = whole(b.column("embedding"), components, scale).astype(np.float64)
            total += np.append(x.sum(0), len(x))
            square += x.T @ x
        if total[-1]:
            yield from ((components, i, float(s)) for i, s in enumerate(total))
            yield from ((i, j, float(square[i, j])) for i in range(components) for j in range(i, components))

    sums = of_tasks(kept.select("embedding"), ["i", "j"], measure)
    if not sums:
        return None
    n = sums[components, components]
    mean = np.array([sums[components, i] for i in range(components)]) / n
    spread = np.array([[sums[min(i, j), max(i, j)] for j in range(components)] for i in range(components)]) / n - np.outer(mean, mean)
    return Rotation(mean, np.linalg.eigh(spread)[1][:, ::-1][:, :leading])


def rotated(kept: DataFrame, rotation: Rotation, components: int, scale: int) -> DataFrame:
    """Every vector's integers, leading coordinates and residual norm, packed."""
    arrow = common.to_arrow_schema(T.StructType.fromDDL(ROTATED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column("embedding"), components, scale)
            lead, rest = rotation.split(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), packed(x.astype(np.int32)), packed(lead), pa.array(rest)], schema=arrow)

    return kept.mapInArrow(run, ROTATED)


def assigned(b: pa.RecordBatch, centres: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers, nearest centre and squared distance of a batch of rotated vectors."""
    x = unpacked(b.column("whole"), np.int32, centres.shape[1]).astype(np.int64)
    lead = unpacked(b.column("lead"), np.float32, rotation.axes.shape[1])
    cluster, best, _ = nearest(x, lead, b.column("rest").to_numpy(), centres, rotation)
    return x, cluster, best


def totals(vectors: DataFrame, centres: np.ndarray, rotation: Rotation) -> dict[tuple, int]:
    """By (centre, place): sums of its vectors' components, then their number and their summed distance."""
    k, d = centres.shape

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        sums, inertia = np.zeros((k, d + 1), np.int64), [0] * k
        for b in batches:
            x, cluster, best = assigned(b, centres, rotation)
            for c in np.unique(cluster).tolist():
                of = cluster == c
                sums[c, :d] += x[of].sum(0)
                sums[c, d] += int(of.sum())
                inertia[c] += (int((best[of] >> 32).sum()) << 32) + int((best[of] & 0xFFFFFFFF).sum())
        for c in np.flatnonzero(sums[:, d]).tolist():
            yield from ((c, i, s) for i, s in enumerate(sums[c].tolist()))
            yield c, d + 1, inertia[c]

    return of_tasks(vectors, ["centre", "place"], measure)


def moved(centres: np.ndarray, sums: dict[tuple, int]) -> np.ndarray:
    """Every centre that has vectors at the floor of their mean."""
    k, d = centres.shape
    return np.array([[sums[c, i] // sums[c, d] if (c, d) in sums else int(centres[c, i]) for i in range(d)] for c in range(k)], np.int64)


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS,
    components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED, leading: int = LEADING,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(finite(F.col("embedding"), components))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rotation = principal(kept, components, scale, leading)
    if rotation is None:
        return spark.createDataFrame([], schema)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    integers = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    first = kept.select(order.alias("o"), integers.alias("x")).orderBy("o", "x").limit(centroids).collect()
    centres = np.array([r["x"] for r in first], np.int64)
    stored = write_once(rotated(kept, rotation, components, scale))
    sums = totals(stored, centres, rotation)
    for _ in range(rounds):
        after = moved(centres, sums)
        if (after == centres).all():
            break
        centres, sums = after, totals(stored, after, rotation)
    k, d = centres.shape
    inertia = [sums.get((c, d + 1), 0) for c in range(k)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    arrow = common.to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, of, best = assigned(b, centres, rotation)
            of_row = of.tolist()
            cols = [b.column("vec_id"), of, best, [inertia[c] for c in of_row], [sum(inertia)] * len(of_row), [names[c] for c in of_row]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return stored.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def sql() -> str:
    measured = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::HUGEINT".format(n=COMPONENTS)
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {COMPONENTS})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM v
          QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) <= {CENTROIDS})""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, vec_id, c, d, x FROM (SELECT v.r, v.vec_id, v.x, c.c, {measured} AS d FROM v CROSS JOIN c{k} c)
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, {COMPONENTS + 1}) t(i) GROUP BY c, i),
          c{k + 1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{k} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM m{k} GROUP BY c) USING (c))""")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN (SELECT c, x FROM c{ROUNDS}) z USING (c)"""
