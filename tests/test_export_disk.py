"""An export moves and keeps no more than it needs; a stream of decisions keeps no state."""

import os

from pyspark.sql import functions as F

from dataheal.dataset import Dataset
from dataheal.operators import apply as applying
from dataheal.operators.proposals import APPROVED, PENDING, PROPOSAL_SCHEMA
from dataheal.plans import pipeline
from dataheal.session import FREE_SHUFFLES, local_frame, remove_table, write_once

ROWS = [(0, "a", 1, "2024-01-02 03:04:05"), (1, None, 2, None), (1, "twin", None, None), (2, "c", 3, None), (None, "n", 4, None)]
MADE = [
    ("1", 0, "s", "x", 0.9, APPROVED), ("2", 0, "s", "y", 0.8, APPROVED), ("2", 0, "s", "y", 0.8, APPROVED), ("3", 0, "n", "7.0", 0.9, APPROVED),
    ("4", 1, "t", "later", 0.5, APPROVED), ("5", 1, "s", "both", 0.5, APPROVED), ("5", 9, "s", "gone", 0.5, APPROVED),
    ("6", 2, "n", "no number", 0.5, APPROVED), ("7", 2, "s", "z", 0.5, PENDING), (None, 2, "n", "8", 0.5, APPROVED),
]


def dataset(spark):
    df = spark.createDataFrame(ROWS, "row_index bigint, s string, n int, t string").withColumn("t", F.col("t").cast("timestamp"))
    return Dataset("d", df)


def proposals(spark):
    named = ("id", "row_index", "column_name", "proposed_value", "confidence", "status")
    return local_frame(spark, [{"dataset_name": "d", "seq": 0, **dict(zip(named, row))} for row in MADE], PROPOSAL_SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_in_order_are_dealt_once(spark):
    ds, made = dataset(spark), proposals(spark)
    in_order = applying.apply_proposals(ds, made).orderBy("row_index")
    assert plan(in_order).count("Exchange rangepartitioning(") == 1 and "Exchange hashpartitioning(" not in plan(in_order)
    got = [tuple(r) for r in in_order.collect()]
    joined = applying.write_cells(ds, applying.cell_winners(made, ds))
    assert in_order.schema == joined.schema
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in joined.collect())))
    assert [r[0] for r in got] == [None, 0, 1, 1, 2] and got[1] == (0, "y", 7, "2024-01-02 03:04:05") and got[4][2] == 8
    highest = {r["row_index"]: r["s"] for r in applying.apply_proposals(ds, made, applying.HIGHEST).collect()}
    assert highest[0] == "x"


def test_manifest_is_worked_out_where_the_review_dealt_it(spark):
    ds, made = dataset(spark), proposals(spark)
    dealt = made.repartition(8, "id")
    manifest = applying.audit_manifest(dealt, {"d": ds})
    assert plan(manifest).count("Exchange hashpartitioning(") <= 1 and "Join" not in plan(manifest)  # dealt above
    done = applying.applied_ids(made, {"d": ds}).withColumn("done", F.lit(True))
    joined = made.join(done, "id", "left").withColumn("applied", F.coalesce("done", F.lit(False))).select(*applying.MANIFEST_COLUMNS)
    listed = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert listed(manifest) == listed(joined) and manifest.count() == len(MADE) + 2


def test_export_keeps_little(spark, tmp_path):
    ds, made = dataset(spark), write_once(proposals(spark))
    assert all(f.endswith(".zstd.parquet") for f in made.inputFiles())
    source, kept = os.path.dirname(made.inputFiles()[0].removeprefix("file:")), []
    folder = os.path.dirname(source)

    def when_kept():
        remove_table(made)
        tables = {f: spark.read.parquet(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("table-")}
        kept.extend(df.filter(F.col("id").isNotNull()).count() for df in tables.values() if applying.APPLIED_BY_ID in df.columns)
        assert spark.conf.get(FREE_SHUFFLES) == "true"

    written = pipeline.export_session(spark, {"d": ds}, made, str(tmp_path), when_kept=when_kept)
    assert kept == [6] and not os.path.exists(source)  # ids of the applicable ones
    assert spark.conf.get(FREE_SHUFFLES, "false") == "false"
    assert spark.read.option("header", True).csv(written["audit_manifest"]).count() == len(MADE) + 2
    assert spark.read.option("header", True).csv(written["d"]).count() == len(ROWS)
