"""Driver tables and the ``dirty_sales`` fixture derived from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# One portable query (runs unchanged in Spark SQL and DuckDB) that turns
# lineitem x orders x part into an all-string sales table with known faults.
DIRTY_SALES_SQL = """
WITH b AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, p.p_name, p.p_type,
         (l.l_orderkey * 31 + l.l_partkey * 17 + l.l_linenumber * 7) AS h,
         CAST(l.l_quantity AS INT) AS q,
         CAST(p.p_retailprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS d
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey)
SELECT
  'TXN' || lpad(CAST(l_orderkey * 8 + l_linenumber AS STRING), 9, '0') AS transaction_id,
  'CUST' || lpad(CAST(o_custkey AS STRING), 6, '0') AS customer_id,
  CASE WHEN h % 19 = 0 THEN 'UNKNOWN' ELSE p_name END AS item,
  CASE WHEN h % 19 = 1 THEN ' n/a ' WHEN h % 11 = 0 THEN lower(p_type)
       WHEN h % 11 = 1 THEN '  ' || p_type || ' '
       WHEN h % 29 = 0 THEN substr(p_type, 1, length(p_type) - 1) ELSE p_type END AS category,
  CASE WHEN h % 13 = 0 THEN 'ERROR' WHEN h % 41 = 0 THEN '-' || CAST(q AS STRING)
       WHEN h % 43 = 0 THEN '0' ELSE CAST(q AS STRING) END AS quantity,
  CASE WHEN h % 17 = 0 THEN NULL WHEN h % 5 = 0 THEN '$' || CAST(price AS STRING)
       WHEN h % 251 = 0 THEN CAST(CAST(price * 50 AS DECIMAL(12,2)) AS STRING)
       ELSE CAST(price AS STRING) END AS price_per_unit,
  CASE WHEN h % 31 = 0 THEN 'N/A' WHEN h % 7 = 0 THEN CAST(CAST(q * price + 10 AS DECIMAL(12,2)) AS STRING)
       ELSE CAST(CAST(q * price AS DECIMAL(12,2)) AS STRING) END AS total_spent,
  CASE WHEN h % 6 = 0 THEN 'True' WHEN h % 6 = 1 THEN 'FALSE' WHEN h % 6 = 2 THEN 'yes'
       WHEN h % 6 = 3 THEN '0' WHEN h % 6 = 4 THEN NULL ELSE 'false' END AS discount_applied,
  CASE WHEN h % 37 = 0 THEN 'not available' WHEN h % 53 = 0 THEN '2099-01-01'
       WHEN h % 9 = 0 THEN substr(d, 9, 2) || '-' || substr(d, 6, 2) || '-' || substr(d, 1, 4) ELSE d END AS transaction_date,
  CASE WHEN h % 47 = 0 THEN 'DW' WHEN h % 47 = 1 THEN 'Digital' WHEN h % 47 = 2 THEN 'Csh'
       WHEN h % 3 = 0 THEN 'Digital Wallet' WHEN h % 3 = 1 THEN 'Cash' ELSE 'Credit Card' END AS payment_method,
  CASE WHEN h % 59 = 0 THEN 9 ELSE CAST(h % 5 AS INT) + 1 END AS customer_rating
FROM b
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver tables as temp views (lazy: nothing is read yet)."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def dirty_sales_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty all-string sales table as a lazy join plan over three tables."""
    register_tables(spark, sf_dir, ("lineitem", "orders", "part"))
    return spark.sql(DIRTY_SALES_SQL)


_WRITTEN: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """``build()`` written once per session and input folder to the shared folder, then
    read back as parquet: a lineage cut, so every later job starts from a plain scan."""
    from kpiforge.session import scratch_path, write_table

    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, name)
        write_table(build(), path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty sales table, stored once - the way a cleaning job meets its input."""
    return stored(spark, sf_dir, "dirty_sales", lambda: dirty_sales_plan(spark, sf_dir))
