"""Steps whose cost was out of proportion to the table: what they read, merge and write."""

import os

from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.operators import consistency, joins, profile
from dataheal.plans import queries

CFG = QualityConfig()


def plan(df):
    return df._jdf.queryExecution().toString()


def test_profile_merges_the_histogram_once(spark, monkeypatch):
    rows = [(i, f"k{i % 7}", "K1" if i % 7 == 1 and i > 30 else None, float(i), f"2024-01-0{i % 9 + 1}") for i in range(70)]
    ds = Dataset("d", spark.createDataFrame(rows, "row_index bigint, a string, b string, v double, seen_date string"))
    merged, measured = [], []
    once, wide = profile.written, profile.measure_columns
    monkeypatch.setattr(profile, "written", lambda df: (merged.append(1), once(df))[1])
    monkeypatch.setattr(profile, "measure_columns", lambda ds: (measured.append(ds.columns), wide(ds))[1])
    got = {r["name"]: r for r in profile.profile_columns(ds, CFG).collect()}
    assert merged == [1] and measured == [["v"]]
    assert [got[c]["null_count"] for c in ("a", "b", "v", "seen_date")] == [0, 70 - 5, 0, 0]
    assert [got[c]["unique_count"] for c in ("a", "b", "v", "seen_date")] == [7, 1, 70, 9]
    assert [got[c]["ordinal"] for c in ("a", "b", "v", "seen_date")] == [0, 1, 2, 3] and got["v"]["median"] == 34.5
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("table-") and "n" in spark.read.parquet(f"{folder}/{f}").columns]


def test_casing_of_values_without_ascii_letters(spark):
    values = ["Ä", "ä", "2024-01-01", "2024-01-01", "12.5", "K", "k", "K", "ϴ", "θ", "İ", "i̇", "ᾈ", "ᾀ", "漢", "", "-", "a1", "A1", "b2"]
    ds = Dataset("d", spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_index bigint, v string"))
    hist = profile.text_histogram(ds, ["v"])
    folded = [r["f"] for r in ds.df.select(F.lower("v").alias("f")).collect()]
    by_form = {}
    for f, v in zip(folded, values):
        by_form.setdefault(f, []).append(v)
    mixed = sum(len(vs) for vs in by_form.values() if len(set(vs)) > 1)
    assert profile._casing_counts(hist).first().asDict() == {"name": "v", "unique_count": len(set(values)), "non_null": len(values), "mixed": mixed}


def test_distinct_cells_are_merged_once_for_all_kinds(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 4), str(i % 5)) for i in range(40)], "row_index bigint, a int, b double, c string")
    found = joins.uniqueness_ratio(Dataset("d", df))
    assert "Union" not in plan(found)
    assert {r["name"]: r["uniqueness"] for r in found.collect()} == {"a": 3 / 40, "b": 4 / 40, "c": 5 / 40}


def test_duplicate_keys_write_no_number_as_text(spark):
    nan = float("nan")
    rows = [(0, 1, 0.0, "x", None), (1, 1, -0.0, "x", None), (2, 1, None, "x", "y"), (3, 2, nan, None, "x"), (4, 2, None, "x", None), (5, None, 1.0, "x", "x"), (6, 3, 1.0, "x", "x")]
    ds = Dataset("d", spark.createDataFrame(rows, "row_index bigint, k int, v double, a string, b string"))
    found = consistency.duplicate_keys(ds, "k")
    assert "format_string" not in plan(found)
    assert {(r["k"], r["rows"], r["versions"]) for r in found.collect()} == {("1", 3, 2), ("2", 2, 2)}
    assert {(r["v"], r["rows"]) for r in consistency.duplicate_keys(ds, "v").collect()} == {("0.0", 2), ("1.0", 2)}


def test_arriving_files_grow_with_the_decisions():
    assert [queries._arriving_files(n) for n in (0, 5, 6_000_000, 6_000_001, 240_000_000)] == [6, 6, 6, 7, 240]


def test_agreement_moves_each_cell_once_without_its_names(spark, monkeypatch):
    a = Dataset("a", spark.createDataFrame([(i, f"k{i % 5}" if i else None, "x" if i % 2 else None, i % 3, 1.0) for i in range(12)], "row_index bigint, k string, v string, n int, w double"))
    b = Dataset("b", spark.createDataFrame([(i, f"k{i}", "x", "1") for i in range(4)], "row_index bigint, k string, v string, n string"))
    c = Dataset("c", spark.createDataFrame([(i, f"k{i}", 1.0, None) for i in range(9)], "row_index bigint, k string, w double, v string"))
    pairs = spark.createDataFrame([("a", "b", "k"), ("a", "c", "k"), ("b", "c", "k"), ("a", "b", "k")], "dataset_a string, dataset_b string, join_key string")
    sets = {}
    for ds in (a, b, c):
        for r in ds.df.collect():
            for col in set(ds.columns) - {"k"}:
                if r["k"] is not None:
                    sets.setdefault((ds.name, r["k"], col), set()).add(None if r[col] is None else str(r[col]))
    expected = {}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = [(s, sets[y, *rest]) for (name, *rest), s in sets.items() if name == x and (y, *rest) in sets]
        expected[x, y, "k"] = (len(both), sum(len(s & t) / len(s | t) for s, t in both) / len(both))
    for at_once in (30, 2):
        monkeypatch.setattr(consistency, "PAIRS_AT_ONCE", at_once, raising=False)
        found = consistency.exact_agreement({"a": a, "b": b, "c": c}, pairs)
        moved = [line for line in plan(found).split("\n") if "Exchange hashpartitioning(" in line]
        assert moved and not any("column#" in line or "dataset_a#" in line for line in moved)
        rows = found.collect()
        assert len(rows) == 4
        for r in rows:
            cells, agreement = expected[r["dataset_a"], r["dataset_b"], r["join_key"]]
            assert r["cells"] == cells and abs(r["agreement"] - agreement) < 1e-12


def test_estimate_reads_only_cells_of_both_sides_and_moves_small_numbers(spark):
    a = Dataset("a", spark.createDataFrame([(i, f"k{i}", f"v{i % 3}", "s") for i in range(200)], "row_index bigint, k string, v string, only_ac string"))
    b = Dataset("b", spark.createDataFrame([(i, f"k{i}", f"v{i % 2}") for i in range(150)], "row_index bigint, k string, v string"))
    c = Dataset("c", spark.createDataFrame([(i, f"k{i}", "t") for i in range(50)], "row_index bigint, k string, only_ac string"))
    pairs = spark.createDataFrame([("a", "b", "k")], "dataset_a string, dataset_b string, join_key string")
    found = consistency.estimated_agreement({"a": a, "b": b, "c": c}, pairs)
    assert "column, only_ac," not in plan(found) and "column, v," in plan(found)
    assert plan(found).split("== Physical Plan ==")[-1].count("Exchange hashpartitioning(") == 1
    # k0, k1 of each six agree; the rest of a value set of one value never does
    assert abs(found.first()["estimate"] - 1 / 3) < 0.01
    alone = spark.createDataFrame([("b", "c", "k")], "dataset_a string, dataset_b string, join_key string")
    assert consistency.estimated_agreement({"a": a, "b": b, "c": c}, alone).first()["estimate"] is None


def test_first_decisions_are_counted_in_hash_tables(spark):
    from dataheal.operators import review

    times = [None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"]
    rows = [(f"{i}-{j}-{k}-{m}", d, times[t]) for i in range(3) for j in range(3) for k in (0, 1) for m in (0, 1)
            for d, t, there in (("approved", i, k), ("rejected", j, m), ("approved", 2, k)) if there] + [(None, "rejected", times[1])]
    df = spark.createDataFrame(rows, "id string, decision string, decided_at string").withColumn("decided_at", F.col("decided_at").cast("timestamp"))
    first = review._first_decisions(df)
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()
    expected = {}
    for name, d, at in rows:
        key = (at is not None, at or "", d)
        expected[name] = min(expected.get(name, key), key)
    got = {r["id"]: (r["decision"], r["decided_at"] and str(r["decided_at"])) for r in first.collect()}
    assert got == {name: (d, at if dated else None) for name, (dated, at, d) in expected.items()} and len(got) == 28


def test_changes_are_dealt_by_row_once(spark):
    from dataheal.operators import apply as applying
    from dataheal.operators.proposals import APPROVED

    ds = Dataset("d", spark.createDataFrame([(0, "a", 1, 1.5), (1, None, 2, None), (1, "twin", None, 2.5), (2, "c", 3, 3.5), (None, "n", 4, 4.5)], "row_index bigint, s string, n int, w double"))
    made = [("1", 0, "s", "x", 0.9), ("2", 0, "s", "y", 0.8), ("3", 0, "n", "7.0", 0.9), ("4", 1, "w", "9", 0.5), ("5", 1, "s", "both", 0.5), ("6", 2, "n", "no number", 0.5), ("7", 2, "other", "z", 0.5), ("8", 9, "s", "z", 0.5)]
    proposals = spark.createDataFrame([(i, "d", r, c, p, conf, APPROVED, 0) for i, r, c, p, conf in made],
                                      "id string, dataset_name string, row_index bigint, column_name string, proposed_value string, confidence double, status string, seq int")
    winners = applying.cell_winners(proposals, ds)
    changed = applying.write_cells(ds, winners)
    assert plan(winners).split("== Physical Plan ==")[-1].count("Exchange hashpartitioning(") == 1
    physical = plan(changed).split("== Physical Plan ==")[-1]
    assert physical.count("Exchange hashpartitioning(") <= 2 and "ObjectHashAggregate" not in physical
    assert sorted(map(str, (tuple(r) for r in changed.collect()))) == sorted(map(str, [
        (0, "y", 7, 1.5), (1, "both", 2, 9.0), (1, "both", None, 9.0), (2, "c", 3, 3.5), (None, "n", 4, 4.5)]))


def test_an_export_works_its_proposals_out_once(spark, tmp_path):
    from dataheal.operators.proposals import APPROVED, PENDING, PROPOSAL_SCHEMA
    from dataheal.plans import pipeline
    from dataheal.session import local_frame

    worked = spark.sparkContext.accumulator(0)
    rows = [{"id": str(i), "dataset_name": "d", "row_index": i, "column_name": "v", "proposed_value": f"new{i}", "confidence": 0.5, "status": APPROVED if i else PENDING, "seq": 0} for i in range(6)]
    base = local_frame(spark, rows, PROPOSAL_SCHEMA)

    def counted(batches):
        for b in batches:
            worked.add(b.num_rows)
            yield b

    ds = Dataset("d", spark.createDataFrame([(i, f"old{i}") for i in range(6)], "row_index bigint, v string"))
    made = pipeline.export_session(spark, {"d": ds}, base.mapInArrow(counted, base.schema), str(tmp_path))
    assert worked.value == 6
    assert [r["v"] for r in spark.read.option("header", True).csv(made["d"]).collect()] == ["old0", *[f"new{i}" for i in range(1, 6)]]
    assert spark.read.option("header", True).csv(made["audit_manifest"]).where("applied = 'true'").count() == 5
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("table-") and {"applied", "id"} & set(spark.read.parquet(f"{folder}/{f}").columns)]
