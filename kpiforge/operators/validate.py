"""Validation of a cleaned table and the run report.

Every check is a ``count_if`` inside one aggregate; the score is arithmetic on
that one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Dict, List, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge import constants as K


def _null_cells(df: DataFrame) -> Column:
    return sum(F.count_if(F.col(c).isNull()) for c in df.columns)


def completeness_pct(df: DataFrame) -> DataFrame:
    n = len(df.columns)
    return df.agg(((1 - _null_cells(df) / (F.count(F.lit(1)) * n)) * 100).alias("completeness"))


def val_completeness(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Before / after completeness %, improvement and IMPROVED / UNCHANGED.

    Both sides are one-row aggregates, combined with a one-row broadcast join.
    """
    a = completeness_pct(original).withColumnRenamed("completeness", "o").withColumn("__j", F.lit(1))
    b = completeness_pct(cleaned).withColumnRenamed("completeness", "c").withColumn("__j", F.lit(1))
    j = a.join(F.broadcast(b), "__j")
    return j.select(F.round("o", 2).alias("original"), F.round("c", 2).alias("cleaned"),
                    F.round(F.col("c") - F.col("o"), 2).alias("improvement"),
                    F.when(F.col("c") > F.col("o"), "IMPROVED").otherwise("UNCHANGED").alias("status"))


@dataclass
class Rule:
    column: str
    check: str            # not_null | gt0 | ge0 | range_0_5
    predicate: Column     # TRUE when the value passes


def schema_rules(df: DataFrame, smap: Dict[str, dict]) -> List[Rule]:
    """Rules from semantic types: price/quantity > 0, total >= 0, rating in 0..5,
    non-null unless Discount."""
    rules: List[Rule] = []
    for c, info in smap.items():
        if c not in df.columns:
            continue
        sem = info.get("semantic_type", "")
        x = F.col(c).cast("double") if info.get("expected_dtype") in ("float", "integer") else F.col(c)
        if sem != "Discount":
            rules.append(Rule(c, "not_null", F.col(c).isNotNull()))
        if sem in ("Price", "Quantity"):
            rules.append(Rule(c, "gt0", x.isNull() | (x > 0)))
        if sem == "TotalAmount":
            rules.append(Rule(c, "ge0", x.isNull() | (x >= 0)))
        if "rating" in c.lower() or "score" in c.lower():
            xv = F.col(c).cast("double")
            rules.append(Rule(c, "range_0_5", xv.isNull() | xv.between(0, 5)))
    return rules


def val_schema(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(column_name, check, failures) for every rule, from one scan."""
    row = df.agg(*[F.count_if(~r.predicate).alias(f"r{i}") for i, r in enumerate(rules)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(r.column).alias("column_name"), F.lit(r.check).alias("check"),
                                                  F.col(f"r{i}").cast("bigint").alias("failures"))
                                         for i, r in enumerate(rules)])))


def all_failing_values(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(column_name, check, value, n): every distinct failing value of every rule, from one scan."""
    if not rules:
        return df.sparkSession.createDataFrame([], "column_name string, check string, value string, n bigint")
    cells = F.array(*[F.struct(F.lit(r.column).alias("column_name"), F.lit(r.check).alias("check"), F.col(r.column).cast("string").alias("value"),
                               (~r.predicate).alias("failed")) for r in rules])
    failed = df.select(F.inline(F.filter(cells, lambda x: x["failed"])))
    return failed.groupBy("column_name", "check", "value").agg(F.count(F.lit(1)).alias("n"))


def failing_values(df: DataFrame, rule: Rule) -> DataFrame:
    """(value, n): every distinct failing value and how often it fails."""
    return df.where(~rule.predicate).groupBy(F.col(rule.column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def val_basic(df: DataFrame, smap: Dict[str, dict]) -> DataFrame:
    """Nulls left (except Discount) and negatives left (quantity/price/total)."""
    rules = []
    for c, info in smap.items():
        if c not in df.columns:
            continue
        sem = info.get("semantic_type", "")
        if sem != "Discount":
            rules.append(Rule(c, "nulls_remain", F.col(c).isNotNull()))
        if sem in ("Quantity", "Price", "TotalAmount"):
            rules.append(Rule(c, "negative_values", ~(F.col(c).cast("double") < 0) | F.col(c).isNull()))
    out = val_schema(df, rules)
    return out.where(F.col("failures") > 0)


def formula_mismatch(q: Column, p: Column, t: Column, d: Optional[Column] = None) -> Column:
    """TRUE when total is not close to round(q*p - d, 2) (atol 0.02, rtol 1e-5); NULLs as 0."""
    q, p, t = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in (q, p, t)]
    disc = F.coalesce(d.cast("double"), F.lit(0.0)) if d is not None else F.lit(0.0)
    expected = F.round(q * p - disc, 2)
    return F.abs(t - expected) > (F.lit(K.FORMULA_TOL_VALIDATE) + F.lit(1e-5) * F.abs(expected))


def val_formula(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    d = F.col(cols[3]) if len(cols) > 3 else None
    m = formula_mismatch(F.col(cols[0]), F.col(cols[1]), F.col(cols[2]), d)
    row = df.agg(F.count_if(m).cast("bigint").alias("mismatches"))
    return row.select("mismatches", F.when(F.col("mismatches") > 0, "VIOLATIONS_FOUND").otherwise("PASS")
                      .alias("status"))


def val_accuracy(df: DataFrame, qty: str, price: str, total: str, discount: Optional[str] = None) -> DataFrame:
    """Share of rows whose total is within 0.01 (+1e-5 relative) of q*p (- discount when given)."""
    q, p, t = [F.col(c).cast("double") for c in (qty, price, total)]
    expected = q * p
    if discount is not None:
        expected = expected - F.coalesce(F.col(discount).cast("double"), F.lit(0.0))
    ok = F.abs(t - expected) <= (F.lit(K.FORMULA_TOL_ACCURACY) + F.lit(1e-5) * F.abs(expected))
    return df.agg(F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("double")), 3).alias("accuracy"))


def quality_score(completeness_after: Column, integrity_pass: Column, rules_pass: Column) -> Column:
    """0.4 x completeness + 0.3 x (1 | 0.7) + 0.3 x (1 | 0.6), rounded to 3."""
    return F.round(completeness_after / 100 * 0.4 + F.when(integrity_pass, 1.0).otherwise(0.7) * 0.3
                   + F.when(rules_pass, 1.0).otherwise(0.6) * 0.3, 3)


def score_label(score: Column) -> Column:
    return (F.when(score >= 0.9, "EXCELLENT").when(score >= 0.8, "GOOD").when(score >= 0.7, "ACCEPTABLE")
            .otherwise("NEEDS REVIEW"))
