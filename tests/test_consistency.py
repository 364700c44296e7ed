"""Keys that contradict themselves, against plain Python, with hot keys, nulls and awkward names."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.operators import consistency

CFG = QualityConfig()


def sets_of(tables: dict[str, tuple], key: str) -> dict:
    """(key, column) to {dataset: values}."""
    out: dict = defaultdict(lambda: defaultdict(list))
    for name, (columns, rows) in tables.items():
        for row in rows:
            cells = dict(zip(columns, row))
            if key in cells and cells[key] is not None:
                for c, v in cells.items():
                    if c != key:
                        out[cells[key], c][name].append(v)
    return out


def made(spark, tables: dict[str, tuple], parts: int = 4) -> dict[str, Dataset]:
    out = {}
    for name, (columns, rows) in tables.items():
        ddl = ", ".join(f"`{c}` string" for c in columns)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_index bigint, {ddl}").repartition(parts)
        out[name] = Dataset(name, df)
    return out


@pytest.fixture(scope="module")
def tables():
    """A third of the rows on one key, nulls in keys and cells, repeated rows, a column name with a dot."""
    r = random.Random(4)
    say = lambda: r.choice(["x", "x", "x", "y", None, ""])
    some = lambda: r.choice(["hot", f"k{r.randrange(40)}", f"k{r.randrange(40)}", None])
    first = [(some(), say(), say(), "only") for _ in range(300)]
    return {
        "first": (("id", "a.b", "kind", "own"), first + first[:5]),
        "second": (("id", "a.b", "kind"), [(some(), say(), say()) for _ in range(300)]),
        "third": (("kind", "id"), [(say(), some()) for _ in range(200)]),
        "keyless": (("kind", "a.b"), [("x", "y")]),
    }


def test_entity_mismatch_against_all_pairs(spark, tables):
    expected = []
    for (key, column), held in sets_of(tables, "id").items():
        if column == "own":
            continue
        if any(x != y for a, b in combinations(held, 2) for x in held[a] for y in held[b]):
            for v in {v for values in held.values() for v in values}:
                owners = [n for n in tables if v in held.get(n, [])]
                expected.append(("id", key, column, v, ",".join(owners), sum(values.count(v) for values in held.values())))
    found = consistency.entity_mismatch(made(spark, tables), "id")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    summary = {r["column"]: (r["keys"], r["values"]) for r in consistency.mismatch_summary(found).collect()}
    for column, got in summary.items():
        mine = [e for e in expected if e[2] == column]
        assert got == (len({e[1] for e in mine}), len(mine))


def test_mismatch_reads_each_dataset_once(spark, tables, tmp_path):
    datasets = {}
    for name, ds in made(spark, tables).items():
        ds.df.write.parquet(str(tmp_path / name))
        datasets[name] = Dataset(name, spark.read.parquet(str(tmp_path / name)))
    found = consistency.entity_mismatch(datasets, "id")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 3 and "SortAggregate" not in plan


def test_nothing_to_compare(spark, tables):
    datasets = made(spark, tables)
    assert consistency.entity_mismatch({"first": datasets["first"], "keyless": datasets["keyless"]}, "id").count() == 0
    assert consistency.entity_mismatch(datasets, "no such key").count() == 0
    empty = {n: Dataset(n, ds.df.limit(0)) for n, ds in datasets.items()}
    assert consistency.entity_mismatch(empty, "id").count() == 0
    assert consistency.ghost_joins({"keyless": datasets["keyless"]}, CFG).count() == 0
    assert consistency.duplicate_keys(empty["first"], "id").count() == 0


def agreement(tables: dict[str, tuple], a: str, b: str, key: str) -> tuple[int, float | None]:
    rates = []
    for held in sets_of(tables, key).values():
        if a in held and b in held:
            x, y = set(held[a]), set(held[b])
            rates.append(len(x & y) / len(x | y))
    return len(rates), sum(rates) / len(rates) if rates else None


def test_ghosts_are_found_and_recounted(spark):
    """Pairs from full agreement to none: every ghost is found, its agreement exact, and no other pair is called one."""
    r = random.Random(9)
    tables = {}
    for n, share in enumerate((1.0, 0.9, 0.62, 0.45, 0.3, 0.0)):
        rows = [(f"P{i}", "same" if r.random() < share else f"v{n}", "text" if r.random() < share else None) for i in range(400)]
        tables[f"t{n}"] = (("policy_id", "cover", "remark"), rows + [("P0", "same", "text")] * 200)
    datasets = made(spark, tables)
    exact = {(a, b): agreement(tables, a, b, "policy_id") for a, b in combinations(tables, 2)}
    pairs = consistency.ghost_joins(datasets, CFG).collect()
    assert len(pairs) == len(exact)
    for p in pairs:
        cells, rate = exact[p["dataset_a"], p["dataset_b"]]
        assert p["join_key"] == "policy_id" and p["match_rate"] == 1.0
        assert p["is_ghost"] == (rate <= 0.5), (p, rate)
        if p["agreement"] is not None:
            assert p["cells"] == cells and p["agreement"] == pytest.approx(rate, abs=1e-4)
    chosen = spark.createDataFrame([(a, b, "policy_id") for a, b in exact], "dataset_a string, dataset_b string, join_key string")
    for e in consistency.estimated_agreement(datasets, chosen).collect():
        assert e["estimate"] == pytest.approx(exact[e["dataset_a"], e["dataset_b"]][1], abs=0.02)


def test_estimate_of_value_sets(spark):
    """Many values a key: equal shares of least hash values estimate the Jaccard similarity of the sets."""
    a = [(f"k{k}", f"v{v}") for k in range(150) for v in range(0, 12)]
    b = [(f"k{k}", f"v{v}") for k in range(150) for v in range(6, 18)]
    datasets = made(spark, {"a": (("key_id", "says"), a), "b": (("key_id", "says"), b)})
    pair = spark.createDataFrame([("a", "b", "key_id")], "dataset_a string, dataset_b string, join_key string")
    assert consistency.estimated_agreement(datasets, pair).first()["estimate"] == pytest.approx(1 / 3, abs=0.06)
    exact = consistency.exact_agreement(datasets, pair).first()
    assert exact["cells"] == 150 and exact["agreement"] == pytest.approx(1 / 3)


def test_duplicate_keys(spark, tables):
    columns, rows = tables["first"]
    by_key = defaultdict(list)
    for row in rows:
        if row[0] is not None:
            by_key[row[0]].append(row)
    expected = sorted(("first", k, len(v), len(set(v))) for k, v in by_key.items() if len(v) > 1)
    assert max(e[2] for e in expected) > len(rows) / 5
    ds = made(spark, tables)["first"]
    assert sorted(map(tuple, consistency.duplicate_keys(ds, "id").collect())) == expected
    pair = consistency.duplicate_keys(ds, ["a.b", "kind"]).collect()
    held = defaultdict(list)
    for row in rows:
        if row[1] is not None and row[2] is not None:
            held[row[1], row[2]].append(row)
    assert sorted(map(tuple, pair)) == sorted(("first", *k, len(v), len(set(v))) for k, v in held.items() if len(v) > 1)


def test_unique_keys_are_not_moved_as_text(spark):
    """The shuffle that every row's key goes through holds numbers only."""
    ds = Dataset("d", spark.range(3000).selectExpr("id AS row_index", "concat('key ', CASE WHEN id % 3 = 0 THEN 0 ELSE id END) AS id", "id % 2 AS v"))
    found = consistency.duplicate_keys(ds, "id")
    assert [tuple(r) for r in found.collect()] == [("d", "key 0", 1000, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    counted = next(line for line in plan.splitlines() if "Aggregate [_hash" in line)
    assert "id#" not in counted
