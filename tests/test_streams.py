"""Streams end with what the batch operators give, whatever the order of arrival and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.operators import review, rules
from dataheal.session import local_frame
from dataheal.streaming import corrections, decisions

CFG = QualityConfig().with_rules({"max_ncd": 9})
ROWS = "row_index bigint, policy_number string, premium string, ncd double, postcode string, product_type string, inception_date string, status string"
SAID = ("row_index", "row_identifier", "column_name", "original_value", "proposed_value", "source_method", "confidence", "explanation", "seq", "id")


def some_rows(n: int) -> list[tuple]:
    r = random.Random(3)
    pick = lambda *values: r.choice(values)
    return [
        (i, f"POL-{i:04d}", pick("100.5", "£1,200", "-3", "20", None, "", "abc"), pick(1.0, 12.0, None), pick("ab1 2cd", "AB1 2CD ", None),
         pick("Motor", "Motor", "motor", " HOME", None), pick("2024-05-01", "01/05/2024", "13/05/2024", None), pick("open", " open", ""))
        for i in range(n)
    ]


def said(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*SAID).collect()), key=repr)


def test_corrections_equal_the_batch_after_restarts(spark, tmp_path):
    rows = some_rows(240)
    whole = Dataset("policies", spark.createDataFrame(rows, ROWS))
    learned = corrections.learn(whole, CFG)
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run() -> None:
        arriving = corrections.row_stream(spark, folder, whole.df.schema, files_per_batch=1)
        found = corrections.corrections(arriving, "policies", CFG, learned, "s1")
        corrections.write_corrections(found, sink, checkpoint).awaitTermination()

    for part in range(3):  # the stream is started again for each
        spark.createDataFrame(rows[part::3], ROWS).repartition(2).write.mode("append").parquet(folder)
        run()
    run()  # nothing new
    assert said(corrections.written_corrections(spark, sink)) == said(rules.find_correction_proposals(whole, CFG, "s1"))


def test_a_failed_batch_is_repeated_and_counts_once(spark, tmp_path):
    rows = some_rows(60)
    whole = Dataset("policies", spark.createDataFrame(rows, ROWS))
    learned = corrections.learn(whole, CFG)
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    whole.df.repartition(1).write.parquet(folder)
    arriving = corrections.row_stream(spark, folder, whole.df.schema)
    found = corrections.corrections(arriving, "policies", CFG, learned, "s1")
    failing = found.withColumn("explanation", F.when(F.col("row_index") > 40, F.raise_error(F.lit("lost"))).otherwise(F.col("explanation")))
    with pytest.raises(Exception):
        corrections.write_corrections(failing, sink, checkpoint).awaitTermination()
    corrections.write_corrections(found, sink, checkpoint).awaitTermination()
    assert said(corrections.written_corrections(spark, sink)) == said(rules.find_correction_proposals(whole, CFG, "s1"))


def test_no_rule_for_the_columns(spark):
    df = spark.createDataFrame([(0, 1.5)], "row_index bigint, amount_of_rain double")
    learned = corrections.learn(Dataset("d", df), CFG)
    assert corrections.corrections(df, "d", CFG, learned) is None


@pytest.fixture(scope="module")
def proposals_and_decisions(spark):
    from dataheal.operators.proposals import PROPOSAL_SCHEMA

    r = random.Random(5)
    base = dict(session_id="s", proposal_type="data_correction", source_method="m", dataset_name="d", proposed_value="1", explanation="", confidence=0.5, seq=1)
    made = [{**base, "id": f"p{i}", "row_index": i, "status": "approved" if i % 11 == 0 else "pending"} for i in range(60)]
    ids = [f"p{i}" for i in range(70)] + ["p1"] * 200 + [None]  # one proposal gets most decisions, some are unknown
    drawn = [(r.choice(ids), r.choice(["approved", "rejected", "maybe", None]), r.randrange(1, 50)) for _ in range(400)]
    drawn += drawn[:40]  # repeated ones
    frame = local_frame(spark, drawn, "id string, decision string, minute int")
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("minute").cast("long") * 60_000_000)
    return local_frame(spark, made, PROPOSAL_SCHEMA), frame.select("id", "decision", at.alias("decided_at"))


@pytest.mark.parametrize("order", ["by time", "latest first", "shuffled"])
def test_first_decision_wins_in_any_order(spark, tmp_path, proposals_and_decisions, order):
    proposals, taken = proposals_and_decisions
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = taken.collect()
    if order == "shuffled":
        random.Random(8).shuffle(rows)
    else:
        rows.sort(key=lambda r: r["decided_at"], reverse=order == "latest first")
    for k in range(4):  # each quarter meets a restarted stream
        spark.createDataFrame(rows[k::4] if order == "shuffled" else rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4], decisions.DECISION_SCHEMA).repartition(2).write.mode("append").parquet(folder)
        arriving = decisions.decision_stream(spark, folder, files_per_batch=1)
        decisions.write_decisions(arriving, sink, checkpoint).awaitTermination()
    got = review.apply_decisions(proposals, decisions.current_decisions(spark, sink))
    expected = review.apply_decisions(proposals, taken.filter("id IS NOT NULL"))
    states = lambda df: sorted(tuple(r) for r in df.select("id", "status", F.coalesce("user_decision", F.lit("")), F.col("reviewed_at").cast("string")).fillna("").collect())
    assert states(got) == states(expected)
    assert sum(s[1] != "pending" for s in states(got)) > 20
