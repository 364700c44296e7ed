"""Tables a session writes: cleaned data, audit manifest, proposals, session manifest."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.config import Rules
from dataheal.dataset import Dataset
from dataheal.operators.apply import audit_manifest
from dataheal.operators.proposals import PROPOSAL_SCHEMA, no_proposals, session_proposals
from dataheal.session import local_frame

MANIFEST_SCHEMA = (
    "session_id string, dataset_name string, file_path string, saved_as string, analyst_rules_json string"
)


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV that reads back unchanged: blanks around a value are kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def stem(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base[1:] else base


def write_cleaned(cleaned: DataFrame, folder: str, name: str, fmt: str = "csv") -> str:
    """One cleaned dataset under ``folder``, without ``row_index``; returns where.

    Rows keep their order, within a part file and from one part file to the next.
    """
    path = f"{folder.rstrip('/')}/{stem(name)}_cleaned"
    data = cleaned.orderBy("row_index").drop("row_index")
    if fmt == "csv":
        write_csv(data, path)
    else:
        data.write.mode("overwrite").format(fmt).save(path)
    return path


def write_audit_manifest(proposals: DataFrame, datasets: dict[str, Dataset], folder: str) -> str:
    path = f"{folder.rstrip('/')}/audit_manifest"
    write_csv(audit_manifest(proposals, datasets), path)
    return path


# ── the proposal store ─────────────────────────────────────────────────────

#: One row for each finished write: which attempt holds a session's run. Attempts sort by time.
COMMIT_SCHEMA = "session_id string, run string, attempt string"
STORED_SCHEMA = f"{PROPOSAL_SCHEMA}, attempt string"


def save_proposals(proposals: DataFrame, path: str, run: str = "proposals", sessions: list[str] | None = None) -> None:
    """Store proposals as the result of ``run`` of their sessions, in place of what that run stored before.

    Rows go to a folder of their own by session and attempt; a commit row for each session, written last,
    makes them the ones that count. A write that fails leaves the former result as it was, and a
    repeated run changes no count. ``sessions`` are committed even without a proposal, so a run that no
    longer finds any leaves none.
    """
    spark = proposals.sparkSession
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    proposals.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("session_id", "attempt").parquet(f"{path}/rows")
    written = spark.read.schema(STORED_SCHEMA).parquet(f"{path}/rows").filter(F.col("attempt") == attempt)
    found = {r["session_id"] for r in written.select("session_id").distinct().collect()}
    commits = [(s, run, attempt) for s in sorted(found | set(sessions or []))]
    local_frame(spark, commits, COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def committed_attempts(spark: SparkSession, path: str, session_id: str) -> list[str]:
    """The attempts that hold a session's proposals, one for each of its runs."""
    commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits").filter(F.col("session_id") == session_id)
    return [r["attempt"] for r in commits.groupBy("run").agg(F.max("attempt").alias("attempt")).collect()]


def stored_proposals(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """A session's proposals as stored; other sessions' and replaced attempts' folders are not read."""
    kept = F.col("attempt").isin(*committed_attempts(spark, path, session_id))
    rows = spark.read.schema(STORED_SCHEMA).parquet(f"{path}/rows")
    return rows.filter((F.col("session_id") == session_id) & kept).select(*no_proposals(spark).columns)


def get_proposals(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """A session's proposals, most confident first."""
    return session_proposals(stored_proposals(spark, path, session_id), session_id)


def register_session(
    spark: SparkSession, path: str, session_id: str, files: list[dict], rules: Rules | None = None
) -> None:
    """Append ``(session, dataset, file, rules)`` rows to the session manifest.

    ``files`` hold ``dataset_name``, ``file_path`` and optionally ``saved_as``.
    """
    text = rules.to_json() if rules else None
    rows = [
        (session_id, f["dataset_name"], f["file_path"], f.get("saved_as", f["file_path"].rsplit("/", 1)[-1]), text)
        for f in files
    ]
    local_frame(spark, rows, MANIFEST_SCHEMA).write.mode("append").partitionBy("session_id").parquet(path)


def session_files(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    return (
        spark.read.schema(MANIFEST_SCHEMA).parquet(path).filter(F.col("session_id") == session_id)
        .select(*[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")])
    )
