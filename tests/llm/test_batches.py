"""Rows of texts reach Python a few at a time."""

from dataheal.llm import common


def test_texts_come_in_small_batches(spark):
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(3500).coalesce(1).selectExpr("id", "cast(id as string) as text")
    make = lambda part: {"n": [part.num_rows]}
    before = spark.conf.get(key)
    try:
        for held, most in (("10000", common.BATCH_ROWS), ("2000", 2000)):
            spark.conf.set(key, held)
            sizes = [r["n"] for r in common.map_rows(rows, "n long", "text", make).collect()]
            assert sum(sizes) == 3500 and max(sizes) == most
    finally:
        spark.conf.set(key, before)
