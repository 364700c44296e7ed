"""The first decision of a proposal is found without state that grows with the proposals."""

import os

from dataheal.streaming import decisions


def test_revisions_are_all_that_a_stream_keeps(spark, tmp_path):
    folder, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [
        [("p", "rejected", "2024-01-02 00:00:00"), ("q", "approved", "2024-01-02 00:00:00"), ("r", "maybe", "2024-01-01 00:00:00")],
        [("p", "approved", "2024-01-03 00:00:00"), ("q", "rejected", "2024-01-01 00:00:00"), ("s", "approved", None), (None, "approved", None)],
        [("p", "approved", "2024-01-02 00:00:00"), ("s", "rejected", "2024-01-01 00:00:00"), ("q", "rejected", "2024-01-01 00:00:00")],
    ]
    for rows in batches:
        made = spark.createDataFrame(rows, "id string, decision string, at string")
        made.selectExpr("id", "decision", "CAST(at AS timestamp) AS decided_at").coalesce(1).write.mode("append").parquet(folder)
        decisions.write_decisions(decisions.decision_stream(spark, folder), sink, checkpoint).awaitTermination()
    assert not os.path.exists(f"{checkpoint}/state")
    found = {r["id"]: (r["decision"], r["decided_at"] and str(r["decided_at"])) for r in decisions.current_decisions(spark, sink).collect()}
    assert found == {"p": ("approved", "2024-01-02 00:00:00"), "q": ("rejected", "2024-01-01 00:00:00"), "s": ("approved", None)}
    assert spark.read.parquet(sink).count() == 8  # one of each proposal and batch


def test_first_decisions_are_searched_once(spark):
    from dataheal.operators import review
    from dataheal.operators.proposals import PROPOSAL_SCHEMA
    from dataheal.plans import queries
    from dataheal.session import local_frame

    made = local_frame(spark, [{"id": f"p{i}", "row_index": i, "status": "pending"} for i in (0, 1, 2, 3, -1, None)], PROPOSAL_SCHEMA)
    taken = queries.approved_by_row(made)
    assert sorted((r["id"], r["decision"], r["decided_at"].hour) for r in taken.collect()) == [
        ("p0", "approved", 1), ("p0", "rejected", 2), ("p1", "rejected", 1), ("p2", "maybe", 1), ("p2-unknown", "approved", 1),
        ("p3", "approved", 1), ("p3", "rejected", 2)]
    assert "filter(" not in taken._jdf.queryExecution().executedPlan().toString()  # no array is made and thinned out
    first = decisions.first_decisions(taken)
    once, again = review.apply_decisions(made, first, one_each=True), review.apply_decisions(made, first)
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("HashAggregate(")
    assert count(once) < count(again)
    assert sorted(map(repr, once.select("id", "status", "reviewed_at").collect())) == sorted(map(repr, again.select("id", "status", "reviewed_at").collect()))
