"""Review decisions on a stream: the first decision of a proposal wins, whenever it arrives.

Every batch writes a *revision* of each proposal that it decides, the earliest valid decision in that batch. The earliest
of a proposal's revisions is its first decision among all that have arrived, so neither the order of arrival nor a repeated
decision or batch matters in the end. The revisions are all that is kept between batches: no state grows
in memory with the proposals. Reviewing proposals with the current decisions is the batch operator's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dataheal.operators.proposals import APPROVED, REJECTED
from dataheal.operators.review import DECISION_SCHEMA, _first_decisions

REVISION_SCHEMA = f"{DECISION_SCHEMA}, revision bigint"


def decision_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Decisions ``(id, decision, decided_at)`` from Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(DECISION_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def first_decisions(decisions: DataFrame) -> DataFrame:
    """The earliest valid decision of each proposal among those that have arrived; equally early ones by name."""
    valid = decisions.filter(F.col("decision").isin(APPROVED, REJECTED) & F.col("id").isNotNull())
    return _first_decisions(valid).select("id", "decision", "decided_at")


def write_decisions(decisions: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the revisions of each batch to a folder of its own, which a repeated batch replaces."""

    def write(arrived: DataFrame, batch: int) -> None:
        first_decisions(arrived).write.mode("overwrite").parquet(f"{sink}/revision={batch}")

    writer = decisions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_decisions(spark: SparkSession, sink: str) -> DataFrame:
    """``(id, decision, decided_at)``: the earliest revision of each proposal."""
    return first_decisions(spark.read.schema(REVISION_SCHEMA).parquet(sink))
