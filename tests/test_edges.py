"""Empty and all-null input, awkward names and types, failures at run time, and hot keys."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.operators import context, fill, insights, profile, rules, score
from dataheal.plans import pipeline
from dataheal.session import write_once
from dataheal.sources import csv
from dataheal.sources.positions import with_sorted_positions

CFG = QualityConfig()


def data(spark, rows, schema, name="d"):
    return Dataset(name, spark.createDataFrame(rows, f"row_index bigint, {schema}"))


# --- empty and all-null input


def test_all_null_number(spark):
    ds = data(spark, [(i, None, float(i)) for i in range(9)], "empty double, full double")
    stats = {r["name"]: r for r in profile.numeric_stats(ds).collect()}
    assert stats["empty"]["median"] is None and stats["full"]["median"] == 4.0
    found = {r["name"]: r for r in profile.profile_columns(ds, CFG).collect()}
    assert found["empty"]["null_count"] == 9 and found["empty"]["outlier_count"] == 0
    assert profile.outlier_rows(ds, "empty").count() == 0
    assert {r["name"]: r["outlier_count"] for r in profile.iqr_outliers(ds).collect()} == {"empty": 0, "full": 0}


def test_empty_table(spark):
    ds = data(spark, [], "premium double, postcode string, inception_date string")
    got = profile.profile_columns(ds, CFG).collect()
    assert [r["row_count"] for r in got] == [0, 0, 0] and [r["unique_count"] for r in got] == [0, 0, 0]
    assert profile.duplicate_rows(ds).first()["duplicate_row_count"] == 0
    assert rules.find_correction_proposals(ds, CFG).count() == 0
    session = pipeline.profile_session({"d": ds}, CFG)
    assert session.scores.count() == 1


def test_blank_csv_column(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,blank\n1,\n2,\n3,\n")
    ds = csv.csv_dataset(spark, "t", str(tmp_path / "t.csv"), CFG)
    got = {r["name"]: r for r in profile.profile_columns(ds, CFG).collect()}
    assert got["blank"]["null_count"] == 3 and got["blank"]["median"] is None
    plan = ds.df.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "csv" not in plan.lower().replace("t.csv", "")


# --- whole columns, not their first values


def test_dates_are_judged_by_all_values(spark):
    rows = [(i, "2024-05-01" if i < 60 else "01/05/2024" if i < 1990 else "soon") for i in range(2_000)]
    got = profile.date_format_scan(data(spark, rows, "claim_date string"), CFG).first()
    assert got["date_formats_detected"] == ["ISO (YYYY-MM-DD)", "Slash (DD/MM/YYYY)"] and got["invalid_date_count"] == 10


def test_every_correction_is_proposed(spark):
    ds = data(spark, [(i, "ab1 2cd", "x") for i in range(1_500)], "postcode string, status string")
    assert rules.find_correction_proposals(ds, CFG, only=("postcode_uppercase",)).count() == 1_500


def test_value_sample_keeps_row_order(spark):
    ds = data(spark, [(i, None if i % 2 else f"v{i}", f"w{i}") for i in range(400)], "a string, b string")
    got = {(r["name"], r["value"]) for r in profile.value_sample(ds, size=3).collect()}
    assert got == {("a", "v0"), ("a", "v2"), ("a", "v4"), ("b", "w0"), ("b", "w1"), ("b", "w2")}


# --- names and types


@pytest.mark.parametrize("name", ["no.", "_id", "row_count", "Annual No.", "n0", "a`b", "value", "name"])
def test_any_column_name(spark, name):
    ds = Dataset("d", spark.createDataFrame([(0, " x ", 1.0), (1, "x", 2.0), (2, None, 9.0)], ["row_index", name, "amount"]))
    found = {r["name"]: r for r in profile.profile_columns(ds, CFG).collect()}
    assert found[name]["null_count"] == 1 and found[name]["unique_count"] == 2
    assert {r["name"]: r["null_count"] for r in profile.null_profile(ds).collect()}[name] == 1
    assert profile.distinct_profile_approx(ds).count() == 2
    assert profile.duplicate_rows(ds).first()["duplicate_row_count"] == 0
    assert rules.find_correction_proposals(ds, CFG, only=("whitespace_trim",)).first()["column_name"] == name


@pytest.mark.parametrize("name", ["no.", "_id", "row_index", "row_count", "_file"])
def test_any_csv_header(spark, tmp_path, name):
    (tmp_path / "t.csv").write_text(f"{name},b\n7,x\n8,y\n")
    got = csv.scan_csv(spark, str(tmp_path / "t.csv"), CFG).orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(0, 7, "x"), (1, 8, "y")]
    assert got[0].__fields__[1] == ("row_index_1" if name == "row_index" else name)
    assert [r["b"] for r in csv.scan_raw_strings(spark, str(tmp_path / "t.csv")).orderBy("row_index").collect()] == ["x", "y"]


def test_join_of_names_that_differ_in_case(spark):
    a = data(spark, [(0, "k", 1)], "policy_number string, NCD int", "a")
    b = data(spark, [(0, "k", 2)], "policy_number string, ncd int", "b")
    got = insights.insight_join(a, b, "policy_number")
    assert got.columns == ["policy_number", "NCD", "ncd_joined"] and tuple(got.first()) == ("k", 1, 2)


def test_large_decimals_and_maps(spark):
    rows = [(i, Decimal("1" + "0" * 29 + str(i % 2)), {"a": 1, "b": i % 2} if i % 3 else None) for i in range(6)]
    ds = data(spark, rows, "amount decimal(38,0), tags map<string,int>")
    assert {r["name"]: r["unique_count"] for r in profile.distinct_profile(Dataset("d", ds.df.drop("tags"))).collect()} == {"amount": 2}
    assert profile.duplicate_rows(ds).first()["duplicate_row_count"] == 2


# --- a session whose generators fail, and datasets ordered by keys


def small_session(spark):
    policies = data(spark, [(i, f"POL-{i:03d}", "ab1 2cd") for i in range(40)], "policy_number string, postcode string", "policies")
    claims = Dataset(
        "claims", spark.createDataFrame([(i, f"POL-{i:03d}", "2024-05-20") for i in range(40)], "claim_key bigint, policy_number string, claim_date string"),
        ("claim_key",))
    return {"policies": policies, "claims": claims}


def test_key_ordered_datasets_get_proposals(spark):
    made = pipeline.run_pipeline(small_session(spark), CFG, "s").proposals
    assert {r["dataset_name"]: r["n"] for r in made.groupBy("dataset_name").agg(F.count("*").alias("n")).collect()} == {"policies": 40, "claims": 40}
    assert sorted(r["row_index"] for r in made.where("dataset_name = 'claims'").collect()) == list(range(40))


def test_a_generator_that_fails_while_running(spark, monkeypatch):
    good = pipeline.find_correction_proposals

    def failing(ds, *args, **kwargs):
        made = good(ds, *args, **kwargs)
        if ds.name != "claims":
            return made
        return made.withColumn("seq", F.when(F.col("row_index") == 7, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("seq")))

    monkeypatch.setattr(pipeline, "find_correction_proposals", failing)
    made = pipeline.run_pipeline(small_session(spark), CFG, "s").proposals
    assert {r["dataset_name"] for r in made.select("dataset_name").distinct().collect()} == {"policies"} and made.count() == 40


# --- hot keys


def test_positions_with_one_hot_value(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(6_000)]
    got = with_sorted_positions(spark.createDataFrame(rows, "k string, v bigint").repartition(7), ["k"])
    assert sorted(r["row_index"] for r in got.collect()) == list(range(6_000))
    pairs = [(r["row_index"], r["k"]) for r in got.collect()]
    assert [k for _, k in sorted(pairs)] == sorted(k for k, _ in rows)


def test_fill_with_one_hot_key(spark):
    target = data(spark, [(i, "hot" if i % 3 == 0 else f"k{i}", None if i % 2 else "own") for i in range(900)], "policy_number string, product string", "t")
    source = data(spark, [(i, "hot" if i < 300 else f"k{i}", f"v{i}") for i in range(900)], "policy_number string, product string", "s")
    got = {r["row_index"]: r["proposed_value"] for r in fill.cross_dataset_fill(target, source, "policy_number", ["product"], 0.9).collect()}
    first = {}
    for r in sorted(source.df.collect()):
        first.setdefault(r["policy_number"], r["product"])
    assert got == {r["row_index"]: first[r["policy_number"]] for r in target.df.collect() if r["product"] is None and r["policy_number"] in first}


def test_quantiles_of_a_hot_value(spark):
    import numpy as np

    values = [5.0 if i % 3 else float(i) ** 2 for i in range(4_000)]
    got = profile.numeric_stats(data(spark, list(enumerate(values)), "v double")).first()
    want = np.quantile(values, [0.25, 0.5, 0.75])
    assert (got["q1"], got["median"], got["q3"]) == pytest.approx(tuple(want))


@pytest.mark.parametrize("n_columns", [5, 50])
def test_profile_reads_the_table_three_times(spark, tmp_path, n_columns):
    kinds = ("CAST(id AS INT)", "CAST(id AS DOUBLE)", "CAST(id AS STRING)", "CAST(DATE '2024-01-01' + CAST(id AS INT) AS STRING)", "CAST(id AS DECIMAL(20,2))")
    names = ("whole", "fraction", "words", "claim_date", "money")
    cols = [f"{kinds[i % 5]} AS {names[i % 5]}_{i}" for i in range(n_columns)]
    spark.range(700).selectExpr("id AS row_index", *cols).write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        reads.add(1)
        return value

    df = spark.read.parquet(str(tmp_path / "t"))
    pipeline.profile_whole(Dataset("d", df.withColumn("words_2", seen("words_2"))), CFG)
    assert 700 < reads.value <= 3 * 700
