"""Problem detection. Each detector returns rows of the long ``problems`` table:

``(category, column_name, issue, count, pct, severity)``

Counts come from single aggregates (``count_if`` per column), order statistics
from the distributed exact quantiles.
"""

from __future__ import annotations

import datetime as _dt
from typing import Dict, List, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions import scalars as S
from kpiforge.functions.stats import exact_quantiles
from kpiforge.operators.profile import value_counts

PROBLEM_SCHEMA = ("category string, column_name string, issue string, count bigint, pct double, "
                  "severity string")


def _pct2(n: str, d: str) -> Column:
    return F.expr(f"CAST((CAST({n} AS BIGINT) * 20000 + CAST({d} AS BIGINT)) div (CAST({d} AS BIGINT) * 2) "
                  f"AS DOUBLE) / 100")


def _long(row_df: DataFrame, items: List[tuple]) -> DataFrame:
    """items: (category, column, issue, count_col, severity Column or str)."""
    structs = []
    for cat, c, issue, cnt, sev in items:
        structs.append(F.struct(F.lit(cat).alias("category"), F.lit(c).alias("column_name"),
                                F.lit(issue).alias("issue"), F.col(cnt).cast("bigint").alias("count"),
                                _pct2(cnt, "__n").alias("pct"),
                                (sev if isinstance(sev, Column) else F.lit(sev)).alias("severity")))
    if not structs:
        return row_df.sparkSession.createDataFrame([], PROBLEM_SCHEMA)
    return row_df.select(F.inline(F.array(*structs))).where(F.col("count") > 0)


def severity(pct: Column) -> Column:
    return (F.when(pct > 50, "CRITICAL").when(pct > 20, "HIGH").when(pct > 5, "MEDIUM").otherwise("LOW"))


def det_missing(df: DataFrame, smap: Optional[Dict[str, dict]] = None) -> DataFrame:
    """NULLs plus no-data words per column; severity by share; Discount/Category nullable."""
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(df.columns):
        miss = F.col(c).isNull()
        if types[c] == "string":
            miss = miss | S.is_null_word(c)
        aggs.append(F.count_if(miss).alias(f"m{i}"))
    row = df.agg(*aggs)
    items = []
    for i, c in enumerate(df.columns):
        sem = (smap or {}).get(c, {}).get("semantic_type", "Unknown")
        nullable = "nullable" if sem in ("Discount", "Category") else "required"
        items.append(("missing_values", c, nullable, f"m{i}", severity(_pct2(f"m{i}", "__n"))))
    return _long(row, items)


def det_dup_rows(df: DataFrame) -> DataFrame:
    """Rows that belong to a duplicated group (every member counts)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__g"))
    row = g.agg(F.sum("__g").alias("__n"), F.coalesce(F.sum(F.when(F.col("__g") > 1, F.col("__g"))),
                                                       F.lit(0)).alias("d"))
    return _long(row, [("duplicates", "*", "exact_duplicates", "d", "HIGH")])


def _by_column(counts: DataFrame, category: str, issues: Dict[str, tuple]) -> DataFrame:
    """``counts``: a row per column_name with ``__n`` and the columns of ``issues`` -> problem rows."""
    structs = [F.struct(F.lit(category).alias("category"), F.col("column_name"), F.lit(issue).alias("issue"),
                        F.col(c).cast("bigint").alias("count"), _pct2(c, "__n").alias("pct"), F.lit(level).alias("severity"))
               for c, (issue, level) in issues.items()]
    return counts.select(F.inline(F.array(*structs))).where(F.col("count") > 0)


def det_dup_ids(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first per id value (NULL counts as one value)."""
    if not id_cols:
        return df.sparkSession.createDataFrame([], PROBLEM_SCHEMA)
    counts = value_counts(df, id_cols).groupBy("column_name").agg(F.sum("n").alias("__n"), (F.sum("n") - F.count(F.lit(1))).alias("extra"))
    return _by_column(counts, "duplicates", {"extra": ("duplicate_ids", "MEDIUM")})


def det_invalid(df: DataFrame, negative_cols: Sequence[str] = (), zero_cols: Sequence[str] = (),
                date_cols: Sequence[str] = (), as_of: Optional[_dt.date] = None) -> DataFrame:
    """Negative quantity/price/total, zero quantity, dates after ``as_of``."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    items = []
    for i, c in enumerate(negative_cols):
        aggs.append(F.count_if(F.col(c).cast("double") < 0).alias(f"neg{i}"))
        items.append(("invalid_values", c, "negative_values", f"neg{i}", "HIGH"))
    for i, c in enumerate(date_cols):
        aggs.append(F.count_if(F.col(c).cast("date") > F.lit(as_of)).alias(f"fut{i}"))
        items.append(("invalid_values", c, "future_dates", f"fut{i}", "MEDIUM"))
    for i, c in enumerate(zero_cols):
        aggs.append(F.count_if(F.col(c).cast("double") == 0).alias(f"zero{i}"))
        items.append(("invalid_values", c, "zero_quantity", f"zero{i}", "MEDIUM"))
    return _long(df.agg(*aggs), items)


def det_inconsistent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Case/space variants (distinct raw minus distinct lower+trim) and padded values."""
    if not cols:
        return df.sparkSession.createDataFrame([], PROBLEM_SCHEMA)
    text = F.col("s")
    keys = value_counts(df, cols).groupBy("column_name", F.lower(S.strip_ws(text)).alias("key")).agg(
        F.sum("n").alias("n"), F.count("s").alias("spellings"), F.sum(F.when(text.rlike(r"^\s+|\s+$"), F.col("n")).otherwise(0)).alias("padded"))
    counts = keys.groupBy("column_name").agg(F.sum("n").alias("__n"), (F.sum("spellings") - F.count("key")).alias("variants"),
                                             F.sum("padded").alias("padded"))
    return _by_column(counts, "inconsistencies", {"variants": ("case_inconsistency", "LOW"), "padded": ("whitespace", "LOW")})


def det_formula(df: DataFrame, cols: Sequence[str], tol: float = K.FORMULA_TOL_DETECT) -> DataFrame:
    """Rows where |q*p - d - t| > tol."""
    q, p, t = [F.col(c).cast("double") for c in cols[:3]]
    expected = q * p
    if len(cols) > 3:
        expected = expected - F.coalesce(F.col(cols[3]).cast("double"), F.lit(0.0))
    row = df.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.abs(expected - t) > tol).alias("v"))
    return _long(row, [("business_violations", cols[2], "formula", "v", "HIGH")])


# ----------------------------------------------------------------- outliers
def outlier_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """det_outlier_iqr + det_outlier_z per column:

    (column_name, n, q1, q3, lower, upper, iqr_count, z_count). Columns with
    fewer than 10 values, zero spread or zero IQR are left out.
    """
    spark = df.sparkSession
    vals = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    q = exact_quantiles(vals, cols, [0.25, 0.75])
    mom = vals.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mu{i}"), F.stddev_pop(c).alias(f"sd{i}"))]).first()
    keep, bounds = [], {}
    for i, c in enumerate(cols):
        n, sd = mom[f"n{i}"], mom[f"sd{i}"]
        q1, q3 = q[c]
        if n < 10 or not sd or q3 - q1 == 0:
            continue
        iqr = q3 - q1
        bounds[c] = (q1, q3, q1 - K.IQR_FACTOR * iqr, q3 + K.IQR_FACTOR * iqr, mom[f"mu{i}"], sd, n)
        keep.append(c)
    if not keep:
        return spark.createDataFrame([], "column_name string, n bigint, q1 double, q3 double, lower double, "
                                         "upper double, iqr_count bigint, z_count bigint")
    aggs = []
    for i, c in enumerate(keep):
        q1, q3, lo, hi, mu, sd, n = bounds[c]
        x = F.col(c)
        aggs.append(F.count_if((x < lo) | (x > hi)).alias(f"i{i}"))
        aggs.append(F.count_if(F.abs((x - F.lit(mu)) / F.lit(sd)) > K.Z_CUT).alias(f"z{i}"))
    row = vals.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(bounds[c][6]).cast("bigint").alias("n"),
        F.lit(bounds[c][0]).alias("q1"), F.lit(bounds[c][1]).alias("q3"),
        F.lit(bounds[c][2]).alias("lower"), F.lit(bounds[c][3]).alias("upper"),
        F.col(f"i{i}").cast("bigint").alias("iqr_count"), F.col(f"z{i}").cast("bigint").alias("z_count"))
        for i, c in enumerate(keep)])))


def problems_union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def issue_totals(problems: DataFrame) -> DataFrame:
    """Sum of counts per category."""
    return problems.groupBy("category").agg(F.sum("count").cast("bigint").alias("total"),
                                            F.count(F.lit(1)).alias("issues"))
