"""Insurance-shaped datasets derived from the clean order tables.

Each column is one SQL expression over ``orders`` or ``lineitem``; defects are planted by
integer arithmetic on the keys, on every row of the table. The expressions are plain enough to
mean the same in Spark and in DuckDB, so the checks derive the same rows on their side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dataheal.dataset import Dataset
from dataheal.sources.positions import with_sorted_positions

_KEY = "lpad(CAST(o_orderkey AS STRING), 9, '0')"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_PRODUCT = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'Motor' WHEN 1 THEN 'Home' WHEN 2 THEN 'Travel' ELSE 'Life' END"
)
_POSTCODE = (
    "concat(substr('ABCDEFGHIJ', CAST(o_custkey % 10 AS INT) + 1, 1), 'X', "
    "CAST(o_custkey % 9 + 1 AS STRING), ' 1AA')"
)

POLICIES = {
    "row_index": "o_orderkey",
    "policy_number": f"CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE concat('POL-', {_KEY}) END",
    "customer_id": "concat('CUST-', lpad(CAST(o_custkey AS STRING), 6, '0'))",
    "inception_date": (
        f"CASE WHEN o_orderkey % 67 = 3 THEN concat(substr({_DAY}, 9, 2), '/', substr({_DAY}, 6, 2), '/', "
        f"substr({_DAY}, 1, 4)) ELSE {_DAY} END"
    ),
    "expiry_date": (
        f"CASE WHEN o_orderkey % 31 = 2 THEN NULL "
        f"WHEN o_orderkey % 53 = 1 THEN CAST(CAST({_DAY} AS DATE) - 30 AS STRING) "
        f"ELSE CAST(CAST({_DAY} AS DATE) + 365 AS STRING) END"
    ),
    "premium": (
        "CASE WHEN o_orderkey % 37 = 4 THEN NULL "
        "WHEN o_orderkey % 41 = 6 THEN concat('£', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ',000') "
        "WHEN o_orderkey % 43 = 7 THEN '-25.5' WHEN o_orderkey % 47 = 8 THEN '20.5' "
        "ELSE CAST(o_totalprice AS STRING) END"
    ),
    "ncd": "CASE WHEN o_orderkey % 37 = 9 THEN NULL ELSE CAST(o_orderkey % 16 AS INT) END",
    "postcode": f"CASE WHEN o_orderkey % 23 = 10 THEN lower({_POSTCODE}) ELSE {_POSTCODE} END",
    "product_type": (
        f"CASE WHEN o_orderkey % 59 = 11 THEN NULL WHEN o_orderkey % 29 = 12 THEN lower({_PRODUCT}) "
        f"WHEN o_orderkey % 101 = 13 THEN concat({_PRODUCT}, ' ') ELSE {_PRODUCT} END"
    ),
    "status": "CASE WHEN o_orderkey % 89 = 14 THEN concat(' ', o_orderstatus) ELSE o_orderstatus END",
    "created_at": "TIMESTAMP '2024-01-01 00:00:00' + o_orderkey * INTERVAL '1' SECOND",
}

# Every third quote names a policy that does not exist.
QUOTES = {
    "row_index": "o_orderkey",
    "quote_id": f"concat('QUO-', {_KEY})",
    "policy_number": (
        f"CASE WHEN o_orderkey % 3 = 0 THEN concat('NEW-', {_KEY}) ELSE concat('POL-', {_KEY}) END"
    ),
    "ncd": "CAST(o_orderkey % 9 AS INT)",
    "product_type": _PRODUCT,
    "quoted_premium": "o_totalprice + 100",
}

CLAIM_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
CLAIMS = {
    **{c: c for c in CLAIM_ORDER},
    "policy_number": "concat('POL-', lpad(CAST(l_orderkey AS STRING), 9, '0'))",
    "claim_date": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "claim_amount": "CASE WHEN l_partkey % 61 = 5 THEN NULL ELSE l_extendedprice END",
    "claim_type": (
        "CASE l_returnflag WHEN 'A' THEN 'Accident' WHEN 'N' THEN 'Flood' ELSE 'Theft' END"
    ),
    "status": "l_linestatus",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(df: DataFrame, view: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in view.items()])


def policies_of(orders: DataFrame) -> DataFrame:
    """The policies of a table or stream of orders."""
    return _derive(orders, POLICIES)


def policies(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset("policies", policies_of(table(spark, sf_dir, "orders")))


def quotes(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset("quotes", _derive(table(spark, sf_dir, "orders"), QUOTES))


def claims(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset("claims", _derive(table(spark, sf_dir, "lineitem"), CLAIMS), CLAIM_ORDER)


def positioned_claims(spark: SparkSession, sf_dir: str) -> Dataset:
    """Claims addressed by ``row_index``, the rank of the row in key order."""
    ranked = with_sorted_positions(claims(spark, sf_dir).df, list(CLAIM_ORDER))
    return Dataset("claims", ranked.drop(*CLAIM_ORDER))


def policies_dup(spark: SparkSession, sf_dir: str) -> Dataset:
    """Policies with every fiftieth row entered twice."""
    entered = policies(spark, sf_dir).df.selectExpr(
        "*", "explode(CASE WHEN row_index % 50 = 7 THEN array(1, 2) ELSE array(1) END) AS entry"
    )
    return Dataset("policies_dup", entered, ("row_index", "entry"))


def generic(spark: SparkSession, sf_dir: str, name: str, key: str) -> Dataset:
    """A table as it is, its rows in the order of ``key``."""
    df = table(spark, sf_dir, name).selectExpr(f"{key} AS row_index", "*")
    return Dataset(name, df)


def session(spark: SparkSession, sf_dir: str) -> dict[str, Dataset]:
    return {d.name: d for d in (policies(spark, sf_dir), quotes(spark, sf_dir), claims(spark, sf_dir))}
