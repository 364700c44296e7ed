"""A small session with hand-counted defects, from CSV to export."""

import pytest
from pyspark.sql import functions as F

from dataheal.config import QualityConfig, Rules
from dataheal.dataset import Dataset
from dataheal.operators import apply as applying
from dataheal.operators import context, insights, proposals, review, rules
from dataheal.plans import pipeline
from dataheal.session import local_frame, remove_written, write_once
from dataheal.sources import csv, sinks

CFG = QualityConfig()

POLICIES = """policy_number,customer_id,inception_date,expiry_date,premium,ncd,postcode,product_type,status,created_at
POL-01,C-1,2024-01-15,2025-01-15,625.00,3,SW1A 1AA,Motor,Active,2024-01-15 06:00:00
,C-2,2024-01-15,2025-01-15,580.00,2,EC1A 1BB,Motor,Active,2024-01-15 06:01:00
POL-03,C-3,2024-01-15,2025-01-15,"£1,710",4,w1a 0ax,home, Active,2024-01-15 06:02:00
POL-04,C-4,20/02/2023,2024-02-20,432.44,12,SE1 7PB,Home,Active,2024-01-15 06:03:00
POL-05,C-5,2023-06-28,,23.58,8,EC2R 8AH,Motor,Lapsed,2024-01-15 06:04:00
POL-06,C-6,2023-11-30,2022-11-29,-7.5,,WC2N 5DU,Home,Active,2024-01-15 06:05:00
POL-07,C-7,2022-03-31,2023-03-31,900,,N1 9GU,Travel,Active,2024-01-15 06:06:00
POL-08,C-8,2022-04-30,2023-04-30,800,1,N1 9GU,Travel,Active,2024-01-15 06:07:00
POL-09,C-9,2022-05-31,2023-05-31,700,1,N1 9GU,Travel,Active,2024-01-15 06:08:00
POL-10,C-10,2022-05-31,2023-05-31,700.5,1,N1 9GU,Travel,Active,2024-01-15 06:09:00
POL-11,C-11,2022-05-31,2023-05-31,700.6,1,N1 9GU,Travel,Active,2024-01-15 06:10:00
"""
RISKS = """policy_number,ncd,score
POL-06,5,0.1
POL-06,6,0.2
POL-01,1,0.3
POL-02,1,0.4
POL-03,1,0.5
POL-04,1,0.6
POL-08,1,0.7
"""
CLAIMS = """claim_id,policy_number,claim_amount,claim_type
CL-1,POL-01,100.10,Fire
CL-2,POL-01,£200,Fire
CL-3,POL-04,,Flood
CL-4,POL-99,50,Theft
"""


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("session")
    made = {}
    for name, text in (("policies.csv", POLICIES), ("risks.csv", RISKS), ("claims.csv", CLAIMS)):
        (folder / name).write_text(text)
        made[name] = csv.csv_dataset(spark, name, str(folder / name), CFG)
    return made


@pytest.fixture(scope="module")
def result(session, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "proposals")
    return pipeline.run_pipeline(session, CFG, "s1", {"max_ncd": 9}, path)


def cells(df, *where):
    got = df
    for w in where:
        got = got.filter(w)
    return sorted((r["row_index"], r["column_name"], r["proposed_value"]) for r in got.collect())


def test_types(session):
    assert dict(session["policies.csv"].df.dtypes)["ncd"] == "double"  # whole numbers with gaps
    assert dict(session["risks.csv"].df.dtypes)["ncd"] == "bigint"
    assert dict(session["policies.csv"].df.dtypes)["premium"] == "string"


def test_proposals(result):
    p = result.proposals
    of = lambda method: F.col("source_method") == method
    assert cells(p, of("sequential_id_inference")) == [(1, "policy_number", "POL-02")]
    assert cells(p, of("date_inference")) == [(4, "expiry_date", "2024-06-28")]
    # The first of two source rows with the key wins; POL-07 has no source row.
    assert cells(p, of("cross_dataset_lookup")) == [(5, "ncd", "5")]
    assert cells(p, of("value_cleaning"), "dataset_name = 'policies.csv'") == [(2, "premium", "1710.0")]
    assert cells(p, of("format_correction")) == [
        (2, "postcode", "W1A 0AX"), (2, "product_type", "Home"), (2, "status", "Active"),
    ]
    assert cells(p, of("business_rule")) == [
        (3, "ncd", "9.0"), (4, "premium", "50.0"), (5, "expiry_date", "2023-11-30"),
        (5, "premium", "0.0"), (5, "premium", "50.0"),
    ]
    assert (3, "inception_date", "20-02-23") in cells(p, of("date_format_standardisation"))


def test_every_proposed_cell_exists(result, session):
    rows = {n: d.df.count() for n, d in session.items()}
    for r in result.proposals.collect():
        assert 0 <= r["row_index"] < rows[r["dataset_name"]]
        assert r["column_name"] in session[r["dataset_name"]].columns
        assert r["status"] == "pending" and r["id"]
    ids = [r["id"] for r in result.proposals.select("id").collect()]
    assert len(ids) == len(set(ids))


def test_scores_have_a_floor(result):
    scores = {r["dataset"]: r["score"] for r in result.session.scores.collect()}
    assert scores["policies.csv"] >= 0 and scores["risks.csv"] == 100.0
    assert {r["field"] for r in result.session.critical_fields.collect()} >= {"policy_number", "ncd", "expiry_date"}


def test_nothing_approved_changes_nothing(result, session):
    ds = session["policies.csv"]
    before = ds.df.orderBy("row_index").collect()
    assert applying.apply_proposals(ds, result.proposals).orderBy("row_index").collect() == before


def test_last_write_is_the_least_confident(result, session):
    ds = session["policies.csv"]
    approved = result.proposals.withColumn("status", F.lit("approved"))
    lowest = applying.apply_proposals(ds, approved).filter("row_index = 5").first()
    highest = applying.apply_proposals(ds, approved, applying.HIGHEST).filter("row_index = 5").first()
    assert (lowest["premium"], highest["premium"]) == ("50.0", "0.0")
    assert lowest["ncd"] == 5.0


def test_bad_addresses_are_not_applied(spark, session):
    ds = session["policies.csv"]
    schema = proposals.PROPOSAL_SCHEMA
    base = dict(session_id="s", proposal_type="data_correction", source_method="business_rule",
                dataset_name="policies.csv", proposed_value="1", explanation="", confidence=0.5,
                status="approved", seq=1)
    rows = [
        {**base, "id": "ok", "row_index": 0, "column_name": "ncd"},
        {**base, "id": "no-row", "row_index": None, "column_name": "ncd"},
        {**base, "id": "far", "row_index": 99, "column_name": "ncd"},
        {**base, "id": "no-column", "row_index": 0, "column_name": "nope"},
        {**base, "id": "no-number", "row_index": 0, "column_name": "ncd", "proposed_value": "many"},
        {**base, "id": "pending", "row_index": 1, "column_name": "ncd", "status": "pending"},
    ]
    frame = local_frame(spark, rows, schema)
    assert [r["id"] for r in applying.applied_ids(frame, {"p": ds}).collect()] == ["ok"]
    assert applying.audit_manifest(frame, {"p": ds}).filter("applied").count() == 1
    assert applying.audit_manifest(frame, {"p": ds}).count() == len(rows)


def test_corrections_are_idempotent(result, session):
    ds = session["policies.csv"]
    approved = review.bulk_review_cleaning(result.proposals, "approved", "s1")
    cleaned = Dataset(ds.name, applying.apply_proposals(ds, approved))
    formatting = ("postcode_uppercase", "whitespace_trim", "product_casing", "currency_clean")
    assert rules.find_correction_proposals(cleaned, CFG, only=formatting).count() == 0


def test_review(spark, result):
    some = [r["id"] for r in result.proposals.orderBy("id").limit(2).collect()]
    at = "2024-01-01 0{}:00:00"
    decisions = local_frame(spark, [(some[0], "approved", 1), (some[0], "rejected", 2), (some[1], "rejected", 1),
                                    ("ghost", "approved", 1), (some[1], "perhaps", 0)], "id string, decision string, h int")
    decisions = decisions.select(
        "id", "decision", F.concat(F.lit("2024-01-01 0"), F.col("h").cast("string"), F.lit(":00:00")).cast("timestamp").alias("decided_at")
    )
    after = review.apply_decisions(result.proposals, decisions)
    states = {r["id"]: r["status"] for r in after.collect()}
    assert (states[some[0]], states[some[1]]) == ("approved", "rejected")
    assert sum(s != "pending" for s in states.values()) == 2 and len(states) == result.proposals.count()
    errors = {(r["id"], r["decision"]): r["error"] for r in review.decision_errors(result.proposals, decisions).collect()}
    assert errors == {(some[0], "rejected"): "conflict", ("ghost", "approved"): "not_found", (some[1], "perhaps"): "invalid"}
    # A second review of a decided proposal is a conflict.
    again = review.decision_errors(after, decisions.filter("decision = 'approved'")).collect()
    assert {(r["id"], r["error"]) for r in again} == {(some[0], "conflict"), ("ghost", "not_found")}


def test_context(result, session):
    gap = result.proposals.filter("source_method = 'sequential_id_inference'")
    rows = context.row_context(gap, session["policies.csv"]).orderBy("row_index").collect()
    assert [(r["_position"], r["row_index"]) for r in rows] == [("above", 0), ("target", 1), ("below", 2), ("below", 3)]
    assert rows[0]["total_rows"] == 11 and rows[1]["policy_number"] is None
    fill = result.proposals.filter("proposal_type = 'cross_dataset_fill'")
    rows = context.source_context(fill, session["risks.csv"], "policy_number").orderBy("row_index").collect()
    assert [(r["_position"], r["match_row_index"]) for r in rows] == [("target", 0), ("below", 0), ("below", 0)]


def test_export(spark, result, session, tmp_path):
    with pytest.raises(pipeline.ExportError):
        pipeline.export_session(spark, session, result.proposals, str(tmp_path / "none"))
    approved = review.bulk_review_cleaning(result.proposals, "approved")
    written = pipeline.export_session(spark, session, approved, str(tmp_path / "out"))
    assert set(written) == {"policies.csv", "claims.csv", "audit_manifest"}
    cleaned = spark.read.option("header", True).csv(written["policies.csv"])
    assert [r["customer_id"] for r in cleaned.collect()] == [f"C-{i}" for i in range(1, 12)]
    manifest = spark.read.option("header", True).csv(written["audit_manifest"])
    assert manifest.count() == approved.count()
    assert manifest.filter("applied = 'true'").count() == approved.filter("status = 'approved'").count()


def test_stored_proposals_come_back_by_confidence(spark, result, tmp_path):
    path = str(tmp_path / "p")
    sinks.save_proposals(result.proposals, path)
    sinks.save_proposals(result.proposals.withColumn("session_id", F.lit("other")), path)
    got = [r["confidence"] for r in sinks.get_proposals(spark, path, "s1").collect()]
    assert got == sorted(got, reverse=True) and len(got) == result.proposals.count()


def test_a_repeated_run_replaces_its_proposals(spark, result, tmp_path):
    path, count = str(tmp_path / "p"), result.proposals.count()
    stored = lambda session: sinks.get_proposals(spark, path, session).count()
    for _ in range(2):
        sinks.save_proposals(result.proposals, path, "first", ["s1", "quiet"])
    assert (stored("s1"), stored("quiet"), stored("unknown")) == (count, 0, 0)
    sinks.save_proposals(result.proposals.limit(3), path, "second")
    assert stored("s1") == count + 3
    # an attempt that was never committed does not count
    result.proposals.withColumn("attempt", F.lit("9" * 20)).write.mode("append").partitionBy("session_id", "attempt").parquet(f"{path}/rows")
    assert stored("s1") == count + 3
    # a run that finds nothing any more leaves nothing
    sinks.save_proposals(result.proposals.limit(0), path, "first", ["s1"])
    assert stored("s1") == 3


def test_running_a_session_twice_leaves_counts_alone(spark, session, tmp_path):
    path = str(tmp_path / "p")
    one = {"policies.csv": session["policies.csv"]}
    counts = [pipeline.run_pipeline(one, CFG, "s9", proposals_path=path).proposals.count() for _ in range(2)]
    assert counts[0] == counts[1] == sinks.get_proposals(spark, path, "s9").count() > 0


def test_what_a_run_left_out_is_told(spark, session, monkeypatch):
    def fails(*_args, **_kwargs):
        raise ValueError("no such luck\nand more")

    monkeypatch.setattr(pipeline, "find_interpolation_proposals", fails)
    done = pipeline.run_pipeline({"policies.csv": session["policies.csv"]}, CFG, "s8")
    assert [tuple(r) for r in done.left_out.collect()] == [("inference on 'policies.csv'", "no such luck")]
    assert done.proposals.count() > 0
    missing: list = []
    monkeypatch.setattr(pipeline, "join_reports", fails)
    assert pipeline.build_dashboard(session, CFG, missing).first()["dataset_count"] == 3
    assert missing == [("join discovery", "no such luck")]


def test_written_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr("dataheal.session._WRITTEN", [])
    kept = write_once(spark.range(5))
    assert kept.count() == 5 and remove_written(spark) == 1
    with pytest.raises(Exception):
        kept.count()
    assert remove_written(spark) == 0


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.register_session(spark, path, "s1", [{"dataset_name": "a.csv", "file_path": "/x/a.csv"}], Rules())
    sinks.register_session(spark, path, "s2", [{"dataset_name": "b.csv", "file_path": "/x/b.csv"}])
    rows = sinks.session_files(spark, path, "s1").collect()
    assert [(r["dataset_name"], r["saved_as"]) for r in rows] == [("a.csv", "a.csv")]
    assert '"minimum_premium": 50.0' in rows[0]["analyst_rules_json"]


def test_rules_accept_both_spellings():
    assert Rules().overlaid({"minimum_premium": 70, "max_premium": None, "unknown": 1}) == Rules().overlaid({"min_premium": 70})
    assert Rules().overlaid(None) == Rules()


def test_insights(session):
    claims, policies = session["claims.csv"], session["policies.csv"]
    by_type = {r["claim_type"]: (r["avg_claim_amount"], r["claim_count"]) for r in insights.generate_insight("avg_claim_by_type", claims).collect()}
    assert by_type == {"Fire": (150.05, 2), "Flood": (None, 0), "Theft": (50.0, 1)}
    freq = insights.generate_insight("claim_freq_by_product", policies, claims, "policy_number").collect()
    assert [(r["product_type"], r["claim_count"], r["total_claim_amount"]) for r in freq] == [("Motor", 2, 300.1), ("Home", 0, 0.0)]
    for bad in (("nope", policies), ("avg_claim_by_ncd", policies), ("avg_claim_by_type", policies)):
        with pytest.raises(insights.InsightError):
            insights.generate_insight(*bad)


def test_dashboard(session):
    row = pipeline.build_dashboard(session, CFG).first()
    assert row["dataset_count"] == row["total"] == 3
    opportunities = row["join_opportunities"]
    assert 0 < len(row["critical_alerts"]) <= 5 and opportunities["total"] == len(opportunities["shown"]) == 3
    assert row["critical_alerts"][0]["severity"] == "critical"


def test_a_broken_dataset_is_fatal_for_the_pipeline_only(spark, session):
    broken = Dataset("broken.csv", spark.range(3).select(F.col("id").alias("row_index"), F.raise_error(F.lit("boom")).cast("string").alias("x")))
    with pytest.raises(pipeline.PipelineError):
        pipeline.profile_session({"broken.csv": broken}, CFG)
    kept = pipeline.profile_session({"risks.csv": session["risks.csv"], "broken.csv": broken}, CFG, skip_failed=True)
    assert list(kept.datasets) == ["risks.csv"]


def test_fills_of_many_datasets_read_each_twice(spark, tmp_path):
    """Four datasets, twelve ordered pairs: each is read as a source and as a target, and a hot key fills all its rows."""
    from dataheal.operators import fill

    datasets = {}
    for n in range(4):
        rows = [(i, f"P{i}", f"v{n}" if (i + n) % 3 else None, float(i) if (i + n) % 4 else None) for i in range(300)]
        df = spark.createDataFrame(rows, "row_index bigint, policy_id string, cover string, size double")
        df.write.parquet(str(tmp_path / f"d{n}"))
        datasets[f"d{n}"] = Dataset(f"d{n}", spark.read.parquet(str(tmp_path / f"d{n}")))
    profiles = pipeline.profile_columns_of(datasets, CFG)
    together = fill.find_cross_dataset_fills(datasets, profiles, CFG, "s")
    seen = lambda df: sorted(tuple(r) for r in df.drop("id", "created_at", "reviewed_at", "user_decision").fillna("").collect())
    one_by_one, order = [], [(a, b) for a in datasets for b in datasets if a != b]
    for r in fill.find_fillable_columns(profiles, CFG).collect():
        pair = (r["dataset_a"], r["dataset_b"])
        one_by_one += seen(fill.cross_dataset_fill(datasets[pair[0]], datasets[pair[1]], r["join_key"], [r["column"]], r["confidence"], "s", order.index(pair)))
    assert seen(together) == sorted(one_by_one) and len(one_by_one) > 1000
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 8
