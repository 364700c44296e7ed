"""File-wise application: only touched files are written, versions swap at once, results equal the batch."""

import pytest
from pyspark.sql import functions as F

from dataheal.dataset import Dataset
from dataheal.operators.apply import apply_proposals
from dataheal.operators.proposals import PROPOSAL_SCHEMA
from dataheal.session import local_frame
from dataheal.sources import versions

BASE = dict(session_id="s", proposal_type="data_correction", source_method="m", dataset_name="d", explanation="", confidence=0.5, status="approved", seq=1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def kept(spark, tmp_path):
    df = spark.range(200).selectExpr("id AS row_index", "concat('v', id % 7) AS name", "CAST(id AS double) AS amount")
    df.repartitionByRange(10, "row_index").sortWithinPartitions("row_index").write.parquet(str(tmp_path / "data"))
    versions.register_files(spark, str(tmp_path / "data"), str(tmp_path / "manifest"))
    return str(tmp_path / "manifest"), str(tmp_path / "new"), Dataset("d", spark.read.parquet(str(tmp_path / "data")))


def test_untouched_files_stay(spark, kept):
    manifest, folder, whole = kept
    before = {r["ordinal"]: r["file"] for r in versions.files_of(spark, manifest).collect()}
    assert len(before) == 10
    made = [{**BASE, "id": f"p{i}", "row_index": i, "column_name": c, "proposed_value": v} for i, c, v in (
        (3, "name", "new"), (4, "amount", "7.5"), (4, "name", "also"), (101, "amount", "many"), (150, "name", "x"), (999, "name", "no row"), (20, "nope", "x"))]
    made.append({**BASE, "id": "other", "dataset_name": "e", "row_index": 60, "column_name": "name", "proposed_value": "x"})
    made.append({**BASE, "id": "open", "status": "pending", "row_index": 60, "column_name": "name", "proposed_value": "x"})
    proposals = local_frame(spark, made, PROPOSAL_SCHEMA)
    assert versions.apply_to_files(spark, manifest, "d", proposals, folder) == 2
    after = {r["ordinal"]: r["file"] for r in versions.files_of(spark, manifest).collect()}
    assert after.keys() == before.keys() and sum(after[k] == before[k] for k in before) == 8
    now = versions.read_version(spark, manifest, "d")
    assert now.df.columns == whole.df.columns and now.df.dtypes == whole.df.dtypes
    assert rows(now.df) == rows(apply_proposals(whole, proposals.filter("dataset_name = 'd'")))
    listed = versions.files_of(spark, manifest).orderBy("ordinal").collect()
    assert sum(r["row_count"] for r in listed) == 200
    assert all(a["last_row"] < b["first_row"] for a, b in zip(listed, listed[1:]))
    # a second review works on the first one's result
    again = local_frame(spark, [{**BASE, "id": "q", "row_index": 4, "column_name": "amount", "proposed_value": "8"}], PROPOSAL_SCHEMA)
    assert versions.apply_to_files(spark, manifest, "d", again, folder) == 1
    assert versions.current_version(spark, manifest)[0] == 3
    assert [tuple(r) for r in versions.read_version(spark, manifest, "d").df.filter("row_index = 4").collect()] == [(4, "also", 8.0)]


def test_nothing_approved_makes_no_version(spark, kept):
    manifest, folder, _ = kept
    assert versions.apply_to_files(spark, manifest, "d", local_frame(spark, [], PROPOSAL_SCHEMA), folder) == 0
    assert versions.current_version(spark, manifest)[0] == 1


def test_a_failed_rewrite_leaves_the_version(spark, kept, monkeypatch):
    manifest, folder, whole = kept
    proposals = local_frame(spark, [{**BASE, "id": "p", "row_index": 5, "column_name": "name", "proposed_value": "new"}], PROPOSAL_SCHEMA)

    def fails(*_):
        raise OSError("disk gone")

    monkeypatch.setattr(versions, "_commit", fails)
    with pytest.raises(OSError):
        versions.apply_to_files(spark, manifest, "d", proposals, folder)
    monkeypatch.undo()
    assert versions.current_version(spark, manifest)[0] == 1
    assert rows(versions.read_version(spark, manifest, "d").df) == rows(whole.df)


def test_dates_must_be_text(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("row_index"), F.current_date().alias("day")).write.parquet(str(tmp_path / "data"))
    with pytest.raises(ValueError, match="day"):
        versions.register_files(spark, str(tmp_path / "data"), str(tmp_path / "manifest"))
