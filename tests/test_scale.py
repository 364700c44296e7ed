"""The plans that stand in for single-task shortcuts, against brute force on skewed data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.operators import infer, insights, joins, profile, quantiles, rules
from dataheal.session import local_frame
from dataheal.sources import csv, sinks
from dataheal.sources.positions import with_sorted_positions

CFG = QualityConfig()


def frame(spark, rows, ddl, parts=5):
    return local_frame(spark, rows, ddl).repartition(parts)


@pytest.mark.parametrize("shape", ["normal", "hot", "tail", "constant", "small"])
def test_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(100, 15, 20_000),
        "hot": np.where(np.arange(20_000) % 3 == 0, 42.0, rng.exponential(50, 20_000)),
        "tail": np.append(rng.lognormal(3, 2, 19_999), 1e15),
        "constant": np.full(9_000, 3.5),
        "small": rng.normal(0, 1, 11),
    }[shape]
    df = frame(spark, [(i, float(v)) for i, v in enumerate(values)], "row_index bigint, v double")
    row = profile.numeric_stats(Dataset("d", df)).first()
    expected = np.quantile(values, [0.25, 0.5, 0.75])
    assert [row["q1"], row["median"], row["q3"]] == pytest.approx(list(expected), rel=1e-12)
    q1, q3 = expected[0], expected[2]
    outside = ((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))).sum()
    assert profile.iqr_outliers(Dataset("d", df)).first()["outlier_count"] == outside


def test_wide_cells_of_one_value(spark, monkeypatch):
    """Few cells force many values into the cell that is ranked; the answer must not change."""
    monkeypatch.setattr(quantiles, "CELLS", 2)
    values = [float(x * x % 9973) for x in range(12_000)]
    df = frame(spark, list(enumerate(values)), "row_index bigint, v double")
    row = profile.numeric_stats(Dataset("d", df)).first()
    assert [row["q1"], row["median"], row["q3"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_a_missed_bracket_is_still_exact(spark):
    """Brackets that hold no quantile at all: the ranks fall in the cells around them."""
    values = [float(x * x % 9973) for x in range(8_000)]
    hist = frame(spark, [("v", v, 1) for v in values], "name string, num double, n bigint")
    for lo, hi in ((-9.0, -5.0), (1e6, 2e6), (9_000.0, 9_001.0)):
        wrong = [
            {"name": "v", "non_null": 8_000, "min": 0.0, "max": 9_972.0, "near": [{"lo": lo, "hi": hi}] * 3}
        ]
        row = quantiles.exact_quantiles(hist, quantiles.search_frame(spark, wrong)).first()
        assert [row["q1"], row["median"], row["q3"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_sorted_positions_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [(1 if rnd.random() < 0.4 else rnd.randrange(1000), i) for i in range(5_000)]
    df = with_sorted_positions(frame(spark, rows, "k int, i int", 7), ["k", "i"], "position")
    got = [(r["k"], r["i"]) for r in df.orderBy("position").collect()]
    assert got == sorted(rows)
    assert sorted(r["position"] for r in df.select("position").collect()) == list(range(len(rows)))


def test_csv_positions_across_splits(spark, tmp_path):
    lines = [f"{i},name {i},{'' if i % 7 == 0 else i * 1.5}" for i in range(4_000)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join(["id,name,amount", *lines[:2500]]) + "\n")
    (folder / "b.csv").write_text("\n".join(["id,name,amount", *lines[2500:]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = csv.scan_csv(spark, str(folder), CFG)
        rows = df.orderBy("row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert dict(df.dtypes) == {"row_index": "bigint", "id": "bigint", "name": "string", "amount": "double"}
    assert [r["row_index"] for r in rows] == list(range(4_000))
    assert [r["id"] for r in rows] == list(range(4_000))


def test_csv_round_trip_keeps_blanks_and_nulls(spark, tmp_path):
    rows = [(0, " a", None, 'q"uote'), (1, "b ", 2, "x,y"), (2, "NA-x", None, "line")]
    df = local_frame(spark, rows, "row_index bigint, t string, n int, q string")
    path = sinks.write_cleaned(df, str(tmp_path), "t.csv")
    back = csv.scan_csv(spark, path, CFG).orderBy("row_index").collect()
    assert [(r["t"], r["n"], r["q"]) for r in back] == [(" a", None, 'q"uote'), ("b ", 2.0, "x,y"), ("NA-x", None, "line")]


def test_null_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\nNA,1\nnull,2\nx,\nnan,4\n")
    typed = csv.scan_csv(spark, str(tmp_path / "t.csv"), CFG).orderBy("row_index").collect()
    assert [r["a"] for r in typed] == [None, None, "x", None]
    assert [r["b"] for r in typed] == [1.0, 2.0, None, 4.0]
    raw = csv.scan_raw_strings(spark, str(tmp_path / "t.csv")).orderBy("row_index").collect()
    assert [(r["a"], r["b"]) for r in raw] == [("NA", "1"), ("null", "2"), ("x", None), (None, "4")]


def hot_pair(spark):
    rnd = random.Random(11)
    key = lambda: "K0" if rnd.random() < 0.35 else None if rnd.random() < 0.05 else f"K{rnd.randrange(60)}"
    left = [(i, key(), rnd.choice(["Motor", "Home", None]), rnd.randrange(4)) for i in range(900)]
    right = [(i, key(), round(rnd.uniform(-5, 500), 2) if rnd.random() < 0.9 else None) for i in range(700)]
    a = Dataset("a", frame(spark, left, "row_index bigint, policy_number string, product_type string, ncd int"))
    b = Dataset("b", frame(spark, right, "row_index bigint, policy_number string, claim_amount double"))
    return a, b


def test_joined_insight_equals_the_plain_join(spark):
    a, b = hot_pair(spark)
    pre = insights.generate_insight("claim_freq_by_product", a, b, "policy_number").collect()
    plain = (
        insights.insight_join(a, b, "policy_number").filter("product_type IS NOT NULL").groupBy("product_type")
        .agg(F.count("claim_amount").alias("n"), F.sum(F.col("claim_amount").cast("decimal(28,6)")).alias("s"))
        .collect()
    )
    assert {r["product_type"]: (r["claim_count"], r["total_claim_amount"]) for r in pre} == {
        r["product_type"]: (r["n"], float(r["s"])) for r in plain
    }


def test_key_overlap_adds_up(spark):
    a, b = hot_pair(spark)
    row = joins.join_quality(a, b, "policy_number").first()
    keys = lambda ds: {r[0] for r in ds.df.select("policy_number").collect()} - {None}
    assert row["matched_keys"] == len(keys(a) & keys(b))
    assert row["matched_keys"] + row["unmatched_in_a"] == row["total_keys_a"] == len(keys(a))
    assert row["matched_keys"] + row["unmatched_in_b"] == row["total_keys_b"] == len(keys(b))


def test_duplicates_count_equal_nulls(spark):
    rows = [(i, "x" if i % 3 else None, i % 2) for i in range(300)]
    ds = Dataset("d", frame(spark, rows, "row_index bigint, a string, b int"))
    distinct = len({r[1:] for r in rows})
    assert profile.duplicate_rows(ds).first()["duplicate_row_count"] == 300 - distinct


def test_sequence_needs_single_gaps_in_time_order(spark):
    ids = ["P-001", None, "P-003", None, None, "P-006", None, "P-009", "Q-1", None, "Q-03", "P-010", None, "P-012"]
    rows = [(i, ids[i], f"2024-01-{i + 1:02d} 00:00:00", f"row{i}") for i in range(len(ids))]
    random.Random(1).shuffle(rows)
    ds = Dataset(
        "d", frame(spark, rows, "row_index bigint, policy_number string, created_at string, ref string")
    )
    made = infer.sequential_id_inference(ds, CFG).orderBy("row_index").collect()
    assert [(r["row_index"], r["proposed_value"], r["row_identifier"]) for r in made] == [
        (1, "P-002", "row1"), (12, "P-011", "row12"),
    ]


def test_plans_avoid_single_task_shapes(spark):
    """No cross product, and the top-k windows are cut down before their shuffle."""
    rows = [(i, f"v{i % 9}", float(i)) for i in range(500)]
    ds = Dataset("d", frame(spark, rows, "row_index bigint, status string, amount double"))
    for df in (profile.top_values(ds, CFG), profile.duplicate_rows(ds), joins.uniqueness_ratio(ds)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in profile.top_values(ds, CFG)._jdf.queryExecution().executedPlan().toString()


def test_histograms_are_hashed_not_sorted(spark):
    """No reader of the histogram may sort its cells to count them."""
    ds = Dataset("d", spark.range(50).selectExpr("id AS row_index", "id % 7 AS whole", "id / 3 AS fraction", "concat('t', id % 5) AS text"))
    for frame_ in (profile.distinct_profile(ds), profile.top_values(ds, CFG), profile.numeric_stats(ds), profile.iqr_outliers(ds)):
        assert "SortAggregate" not in frame_._jdf.queryExecution().executedPlan().toString()
