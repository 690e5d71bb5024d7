"""Shared input stages for the registered queries (Spark side and SQL side).

``raw``    : dirty_sales as generated (all text + an int rating)
``nulled`` : no-data words -> NULL in every text column
``typed``  : nulled, then numbers parsed (quantity plain, price with currency
             marks, total plain), discount flag as boolean, date parsed with the
             voted format first (no year-range check, so future dates stay visible)
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions import scalars as S
from kpiforge.operators import repair as R
from kpiforge.sources.tables import dirty_sales, stored
from kpiforge.suite import sqlparts as Q

AS_OF = dt.date(2025, 1, 1)
# The voted format on dirty_sales (checked by the date_format_vote query).
DATE_WINNER_PY = "%Y-%m-%d"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_sales(spark, sf_dir)


def nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.null_sentinels(raw(spark, sf_dir))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed stage, stored once per session (every query over it starts from a scan)."""
    return stored(spark, sf_dir, "dirty_sales_typed", lambda: _typed_plan(spark, sf_dir))


def _typed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nulled(spark, sf_dir)
    best = R.best_date_format(df, "transaction_date")
    return df.select(
        "transaction_id", "customer_id", "item", "category",
        S.num_parse("quantity").alias("quantity"),
        S.num_currency("price_per_unit").alias("price_per_unit"),
        S.num_parse("total_spent").alias("total_spent"),
        S.bool_word("discount_applied").alias("discount_applied"),
        S.parse_date_formats("transaction_date", S.ordered_formats(best)).alias("transaction_date"),
        "payment_method", "customer_rating")


# ------------------------------------------------------------------ SQL side
def sql_raw() -> str:
    return Q.dirty_sales_cte()


def sql_nulled() -> str:
    return sql_raw() + ", nl AS (" + Q.sentinel_select() + ")"


def _ordered_py_formats():
    from kpiforge import constants as K
    fm = [py for py, _ in K.DATE_FORMATS]
    fm.remove(DATE_WINNER_PY)
    return [DATE_WINNER_PY] + fm


def sql_typed() -> str:
    return sql_nulled() + (
        ", ty AS (SELECT transaction_id, customer_id, item, category, "
        f"{Q.num_parse('quantity')} AS quantity, "
        f"{Q.num_currency('price_per_unit')} AS price_per_unit, "
        f"{Q.num_parse('total_spent')} AS total_spent, "
        f"{Q.bool_word('discount_applied')} AS discount_applied, "
        f"{Q.date_any('transaction_date', _ordered_py_formats())} AS transaction_date, "
        "payment_method, customer_rating FROM nl)")
