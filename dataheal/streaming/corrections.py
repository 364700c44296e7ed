"""Correction rules on a stream of rows.

The rules look at one row each, so a stream needs no state: every micro-batch yields the proposals that the
batch operator would make for its rows. What the batch operator learns from the whole table, the column
that names a row and the usual casing of a product column, comes from a dataset profiled before.

Rows carry their own ``row_index``; the position of a row cannot be known while rows still arrive. Sinks
are files with a checkpoint, so a restarted stream neither repeats nor loses a row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dataheal.config import QualityConfig
from dataheal.dataset import Dataset
from dataheal.functions.text import apply_casing, strip
from dataheal.operators.labels import Identifiers, count_identifiers, string_columns
from dataheal.operators.proposals import PROPOSAL_SCHEMA
from dataheal.operators.rules import RULE_NAMES, RULES, Candidate, Rule, majority_casing, proposals_of

CASING = "product_casing"


@dataclass(frozen=True)
class Learned:
    """What the rules know beforehand: identifying columns, and the usual casing by product column."""

    identifiers: Identifiers
    casing: dict[str, str]


def learn(ds: Dataset, cfg: QualityConfig) -> Learned:
    """From a dataset of the same kind as the stream: one count of identifiers, one of each product column."""
    columns = [c for c in ds.columns if c.lower() in cfg.product_columns and c in string_columns(ds)]
    return Learned(count_identifiers(ds, cfg), {c: majority_casing(ds, c).first()["style"] for c in columns})


def _stated(rule: Rule, learned: Learned) -> Rule:
    """The casing rule with the styles that were learned; columns without one are passed over."""
    if rule.name != CASING:
        return rule

    def candidates(ds: Dataset, cfg: QualityConfig) -> list[Candidate]:
        return [
            Candidate(c, ds.col(c), apply_casing(strip(ds.col(c)), F.lit(style)), F.lit(style))
            for c, style in learned.casing.items() if c in ds.columns
        ]

    return replace(rule, candidates=candidates)


def corrections(
    rows: DataFrame, name: str, cfg: QualityConfig, learned: Learned, session_id: str = "session", only: tuple[str, ...] = RULE_NAMES
) -> DataFrame | None:
    """The proposals for each row of a stream (or table) with a ``row_index``; None if no rule fits its columns."""
    ds = Dataset(name, rows)
    rules = [_stated(r, learned) for r in RULES if r.name in only]
    return proposals_of(ds, cfg, rules, learned.identifiers, session_id)


def row_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def write_corrections(proposals: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append proposals to a folder of Parquet files; ``once`` ends when all files that are there have been read."""
    writer = proposals.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def written_corrections(spark: SparkSession, sink: str) -> DataFrame:
    """What the stream has written so far, by its own log: files of failed batches do not count."""
    return spark.read.schema(PROPOSAL_SCHEMA).parquet(sink)
