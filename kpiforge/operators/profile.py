"""Profiling: table basics, per-column profile, logical types, distributions.

Design: one wide ``agg`` over every column feeds all per-column metrics (null,
no-data words, numeric/date/boolean parse rates, distinct counts, moments), then
a tiny one-row result is reshaped to one row per column with ``inline``.
Exact order statistics come from :mod:`kpiforge.functions.stats`.
"""

from __future__ import annotations

import math
from typing import Dict, List, Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions import scalars as S
from kpiforge.functions.stats import exact_quantiles, to_long

SAMPLES = 5
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric_dtype(t: str) -> bool:
    return t in NUMERIC_TYPES or t.startswith("decimal")


def is_date_dtype(t: str) -> bool:
    return t in ("date", "timestamp", "timestamp_ntz")


def _clean_value(df: DataFrame, c: str) -> Column:
    """Value with no-data words removed (text columns only)."""
    t = dict(df.dtypes)[c]
    if t == "string":
        return S.null_sentinel(c)
    return F.col(c)


def long_values(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """Unpivot to ``(column_name, dtype, s)`` with the value as text.

    Processing one value column (instead of N typed columns) keeps the generated
    code a constant size however wide the table is.
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                               F.col(c).cast("string").alias("s")) for c in cols])
    return df.select(F.inline(parts))


def value_counts(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """(column_name, dtype, s, n): every distinct value of every column with its number of rows,
    NULL included. Combined before the shuffle, so a frequent value is one row per task."""
    return long_values(df, cols).groupBy("column_name", "dtype", "s").agg(F.count(F.lit(1)).alias("n"))


def _typed_parts(values: DataFrame) -> DataFrame:
    """Per distinct value: clean text (no-data words removed), number, date.

    Split into two projections so each costly sub-expression is computed once
    (the optimizer keeps non-cheap expressions from being inlined twice).
    """
    dtype = F.col("dtype")
    s = F.col("s")
    is_text = dtype == "string"
    sent = is_text & S.is_null_word(s)
    step1 = values.select("column_name", "dtype", "n", s.alias("raw"), sent.alias("sent"),
                          F.when(sent, F.lit(None)).otherwise(s).alias("v"))
    v = F.col("v")
    step2 = step1.select("*", S.strip_ws(v).alias("t"))
    is_num = dtype.isin(*NUMERIC_TYPES) | dtype.startswith("decimal")
    is_date = dtype.isin("date", "timestamp", "timestamp_ntz")
    num = F.when(is_num, F.col("raw").try_cast("double")).when(is_text, S.num_parse(F.col("t")))
    dat = F.when(is_date, F.col("raw").try_cast("timestamp").cast("date")).when(
        is_text, S.parse_date_formats(F.col("t"), [sp for _, sp in K.DATE_FORMATS], stripped=True))
    return step2.select("column_name", "dtype", "n", "raw", "v", num.alias("num"), dat.alias("dat"), "sent")


def wide_profile(df: DataFrame, cols: Optional[Sequence[str]] = None, samples: bool = False) -> DataFrame:
    """One row per column: counts and parse rates, every distinct value parsed once.

    Columns: column_name, dtype, n_rows, null_count, sentinel_count, n_clean,
    num_count, whole_count, date_count, non_bool_count, distinct_nonnull,
    num_min, num_max, num_mean; with ``samples`` also the five smallest distinct
    values (text order). The value counts are shuffled once; what follows is one
    partially aggregated row per (task, column).
    """
    counts = value_counts(df, cols)
    t = _typed_parts(counts)
    n, num = F.col("n"), F.col("num")

    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    g = t.groupBy("column_name", "dtype").agg(
        F.sum("n").alias("n_rows"),
        rows(F.col("raw").isNull()).alias("null_count"),
        rows(F.col("sent")).alias("sentinel_count"),
        rows(F.col("v").isNotNull()).alias("n_clean"),
        rows(num.isNotNull()).alias("num_count"),
        rows(num == F.floor(num)).alias("whole_count"),
        rows(F.col("dat").isNotNull()).alias("date_count"),
        rows(F.col("v").isNotNull() & ~F.lower(F.col("v")).isin(list(K.BOOL_WORDS))).alias("non_bool_count"),
        F.count("raw").alias("distinct_nonnull"),
        F.min(num).alias("num_min"), F.max(num).alias("num_max"),
        (F.sum(num * n) / rows(num.isNotNull())).alias("num_mean"))
    if not samples:
        return g
    # the row limit of the window is applied in every task before its shuffle
    smallest = Window.partitionBy("column_name").orderBy("s")
    few = counts.where("s is not null").withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= SAMPLES)
    lists = few.groupBy(F.col("column_name").alias("c")).agg(F.array_sort(F.collect_list("s")).alias("samples"))
    return g.join(lists, F.col("column_name") == F.col("c"), "left").drop("c")


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> Dict[str, tuple]:
    """{column: (rows, distinct non-null values)} from the value counts (no parsing)."""
    r = value_counts(df, cols).groupBy("column_name").agg(F.sum("n").alias("n"), F.count("s").alias("d")).collect()
    return {x["column_name"]: (x["n"], x["d"]) for x in r}


def logical_type_expr() -> Column:
    """Logical type ladder over a wide-profile row."""
    n_clean = F.col("n_clean")
    uniq = F.col("distinct_nonnull")
    ratio = uniq / F.col("n_rows")
    return (F.when(n_clean == 0, "empty")
            .when(F.col("num_count") / n_clean > 0.9,
                  F.when(F.col("whole_count") == F.col("num_count"), "integer").otherwise("float"))
            .when(F.col("date_count") / n_clean > 0.7, "datetime")
            .when(F.col("non_bool_count") == 0, "boolean")
            .when((ratio < 0.05) | (uniq <= 20), "categorical")
            .when(ratio > 0.95, "identifier")
            .otherwise("text"))


def column_types(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """type_detect: (column_name, logical_type)."""
    return wide_profile(df, cols).select("column_name", logical_type_expr().alias("logical_type"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct full rows with their multiplicity ``__g`` (map-side combined)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__g"))


def basic_stats(df: DataFrame) -> DataFrame:
    """prof_basic: rows, columns, rows in duplicated groups (every member counts)."""
    g = F.col("__g")
    return distinct_rows(df).agg(
        F.coalesce(F.sum(g), F.lit(0)).cast("bigint").alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.coalesce(F.sum(F.when(g > 1, g)), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum(g - 1), F.lit(0)).cast("bigint").alias("extra_duplicate_rows"))


def column_profile(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """prof_columns: dtype, logical type, nulls, distinct (NULL counted as a value), five smallest values."""
    wp = wide_profile(df, cols, samples=True)
    return wp.select(
        "column_name", "dtype", logical_type_expr().alias("logical_type"),
        F.col("null_count"),
        F.round(F.col("null_count") * 100.0 / F.col("n_rows"), 2).alias("null_pct"),
        (F.col("distinct_nonnull") + F.when(F.col("null_count") > 0, 1).otherwise(0)).alias("unique_count"),
        F.round((F.col("distinct_nonnull") + F.when(F.col("null_count") > 0, 1).otherwise(0)) * 100.0
                / F.col("n_rows"), 2).alias("unique_pct"),
        F.array_join(F.coalesce("samples", F.array()), " | ").alias("samples"),
    )


def numeric_columns(df: DataFrame) -> List[str]:
    return [r["column_name"] for r in column_types(df).collect()
            if r["logical_type"] in ("integer", "float")]


def numeric_profile(df: DataFrame, cols: Optional[Sequence[str]] = None,
                    approx: bool = False) -> DataFrame:
    """prof_numeric: min, max, mean, exact median, sample std of parsed numbers."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, min double, max double, mean double, "
                                         "median double, std double")
    parsed = df.select(*[S.num_parse(_clean_value(df, c)).alias(c) if dict(df.dtypes)[c] == "string"
                         else F.col(c).cast("double").alias(c) for c in cols])
    med = exact_quantiles(parsed, cols, [0.5])
    med_df = spark.createDataFrame([(c, float(med[c][0])) for c in cols], "column_name string, median double")
    wp = to_long(parsed, cols).groupBy(F.col("k").alias("column_name")).agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return med_df.join(wp, "column_name", "left").select(
        "column_name", "min", "max", "mean", F.nanvl("median", F.lit(None).cast("double")).alias("median"), "std")


def distribution_profile(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """prof_distribution: population skewness, excess kurtosis, linear q25/q50/q75."""
    types = dict(df.dtypes)
    cols = list(cols or df.columns)
    spark = df.sparkSession
    parsed = df.select(*[(S.num_parse(c) if types[c] == "string" else F.col(c).cast("double")).alias(c)
                         for c in cols])
    q = exact_quantiles(parsed, cols, [0.25, 0.5, 0.75])
    cols = [c for c in cols if not math.isnan(q[c][0])]
    if not cols:
        return spark.createDataFrame([], "column_name string, skewness double, kurtosis double, "
                                         "q25 double, q50 double, q75 double")
    qdf = spark.createDataFrame([(c, *map(float, q[c])) for c in cols],
                                "column_name string, q25 double, q50 double, q75 double")
    mom = to_long(parsed, cols).groupBy(F.col("k").alias("column_name")).agg(
        F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"))
    return mom.join(qdf, "column_name")


def quality_metrics(df: DataFrame) -> DataFrame:
    """prof_quality: completeness %, total nulls, duplicate rows and %.

    Everything comes from the distinct-row table: a group's nulls count ``__g`` times.
    """
    ncols = len(df.columns)
    g = F.col("__g")
    row_nulls = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns)
    a = distinct_rows(df).agg(F.sum(g).alias("n"), F.sum(row_nulls * g).alias("nulls"),
                              F.coalesce(F.sum(F.when(g > 1, g)), F.lit(0)).alias("dups"))
    return a.select(
        F.round((1 - F.col("nulls") / (F.col("n") * ncols)) * 100, 2).alias("completeness"),
        F.col("nulls").cast("bigint").alias("total_nulls"),
        F.col("dups").cast("bigint").alias("duplicate_rows"),
        F.round(F.col("dups") * 100.0 / F.col("n"), 2).alias("duplicate_pct"))


def light_profile(df: DataFrame) -> DataFrame:
    """prof_light: dtype, distinct (NULL excluded), missing, min/max/mean of numeric columns, five
    smallest values of text columns."""
    wp = wide_profile(df, samples=True)
    types = dict(df.dtypes)
    numeric = [c for c in df.columns if is_numeric_dtype(types[c])]
    return wp.select(
        "column_name", "dtype",
        F.col("distinct_nonnull").alias("unique"),
        F.col("null_count").alias("missing"),
        F.when(F.col("column_name").isin(numeric), F.col("num_min")).alias("min"),
        F.when(F.col("column_name").isin(numeric), F.col("num_max")).alias("max"),
        F.when(F.col("column_name").isin(numeric), F.col("num_mean")).alias("mean"),
        F.when(F.col("dtype") == "string", F.array_join(F.coalesce("samples", F.array()), " | ")).alias("samples"))


DATE_NAME_WORDS = ("date", "time", "day", "month", "year", "period", "created", "updated")


def dashboard_profile(df: DataFrame) -> DataFrame:
    """prof_dashboard: labels for the final table.

    datetime when the name has a date word and >80 % of values parse as dates;
    text columns whose values are >80 % numeric become int64/float64; mean of
    numeric-looking columns rounded to 4 places.
    """
    wp = wide_profile(df)
    nonnull = F.col("n_rows") - F.col("null_count")
    date_named = F.lit(False)
    for w in DATE_NAME_WORDS:
        date_named = date_named | F.lower(F.col("column_name")).contains(w)
    num_rate = F.col("num_count") / nonnull
    label = (F.when(date_named & (F.col("date_count") / nonnull > 0.8), "datetime")
             .when(F.col("dtype") != "string", F.col("dtype"))
             .when(num_rate > 0.8, F.when(F.col("whole_count") == F.col("num_count"), "int64").otherwise("float64"))
             .otherwise("string"))
    return wp.select(
        "column_name", label.alias("label"),
        F.col("distinct_nonnull").alias("unique"), F.col("null_count").alias("missing"),
        F.when(num_rate > 0.8, F.round(F.col("num_mean"), 4)).alias("mean"))


def clean_gate(df: DataFrame) -> DataFrame:
    """Is it clean enough? nulls + null words <= 1 % of cells, extra duplicate rows <= 0.5 %."""
    ncols = len(df.columns)
    g = F.col("__g")
    row_bad = sum(F.when(F.col(c).isNull() | F.lower(S.strip_ws(S.as_text(c))).isin(list(K.GATE_NULL_WORDS)), 1)
                  .otherwise(0) for c in df.columns)
    a = distinct_rows(df).agg(F.sum(g).alias("n"), F.sum(row_bad * g).alias("null_cells"),
                              F.sum(g - 1).alias("dup_rows"))
    null_pct = F.round(F.col("null_cells") * 100.0 / (F.col("n") * ncols), 4)
    dup_pct = F.round(F.col("dup_rows") * 100.0 / F.col("n"), 4)
    return a.select(F.col("null_cells").cast("bigint").alias("null_cells"), null_pct.alias("null_pct"),
                    F.col("dup_rows").cast("bigint").alias("dup_rows"), dup_pct.alias("dup_pct"),
                    ((null_pct <= K.GATE_NULL_PCT) & (dup_pct <= K.GATE_DUP_PCT)).alias("is_clean"))


def null_gate(df: DataFrame) -> DataFrame:
    """Total nulls in the table -> warning / success."""
    tot = df.agg(sum(F.count_if(F.col(c).isNull()) for c in df.columns).cast("bigint").alias("total_nulls"))
    return tot.select("total_nulls", F.when(F.col("total_nulls") > 0, "warning").otherwise("success").alias("status"))


# --- fixed values: the five date formats and the boolean words of the second probe
PROBE_DATE_FORMATS = (("%Y-%m-%d", "yyyy-M-d"), ("%d-%m-%Y", "d-M-yyyy"), ("%d/%m/%Y", "d/M/yyyy"),
                      ("%Y/%m/%d", "yyyy/M/d"), ("%d %b %Y", "d MMM yyyy"))


def type_probe(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """Second type probe on text: currency/comma/space stripped > 85 % numeric ->
    integer/float; one of five date formats > 80 % -> datetime; boolean words ->
    boolean; else categorical (empty when no value). Every distinct value is probed once."""
    s, n = F.col("s"), F.col("n")
    num = S.num_parse(F.regexp_replace(s, r"[₹$£€,\s]", ""))
    values = value_counts(df, cols).where("s is not null")
    parsed = values.select("column_name", "n", num.alias("num"), (~F.lower(s).isin(list(K.BOOL_WORDS))).alias("odd"),
                           *[S.parse_date_formats(s, [sp]).isNotNull().alias(f"d{j}") for j, (_, sp) in enumerate(PROBE_DATE_FORMATS)])

    def share(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)) / F.sum("n")

    kind = (F.when(share(F.col("num").isNotNull()) > 0.85, F.when(share(F.col("num") != F.floor("num")) == 0, "integer").otherwise("float"))
            .when(F.greatest(*[share(F.col(f"d{j}")) for j in range(len(PROBE_DATE_FORMATS))]) > 0.8, "datetime")
            .when(share(F.col("odd")) == 0, "boolean").otherwise("categorical"))
    found = parsed.groupBy("column_name").agg(kind.alias("kind"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols or df.columns], "c string")  # also columns without values
    return names.join(found, F.col("c") == F.col("column_name"), "left").select(
        F.col("c").alias("column_name"), F.coalesce("kind", F.lit("empty")).alias("probe_type"))


TYPE_CONVERT_NUMBER = r"^[\$€£\s]*[\d,]+(\.\d+)?\s*$"
TYPE_CONVERT_DATE = r"(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{4}-\d{2}-\d{2})"
TYPE_CONVERT_DATE_WORDS = ("date", "time", "day", "year", "month")
TYPE_CONVERT_NONE_WORDS = ("None", "none", "null", "NULL", "NONE")


def type_convert(df: DataFrame) -> DataFrame:
    """convert_smart_types: per text column pick number / ISO date / day-first date
    by success rates (> 70 %) from one aggregate, then one ``select`` of casts.
    Text columns left as text get no-data words and NULL as ''."""
    text = [c for c, t in df.dtypes if t == "string"]
    aggs = []
    for i, c in enumerate(text):
        s = F.col(c)
        num = S.num_parse(F.regexp_replace(s, r"[^\d.\-]", ""))
        iso = F.to_date(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
        norm = F.regexp_replace(s, r"[/.]", "-")
        mixed = S.parse_date_formats(norm, ["d-M-yyyy", "yyyy-M-d", "d-M-yy"])
        aggs += [F.count(s).alias(f"nn{i}"), F.count_if(F.lower(s).isin("none", "null", "nan", "")).alias(f"none{i}"),
                 F.count_if(s.rlike(TYPE_CONVERT_NUMBER)).alias(f"pat{i}"), F.count(num).alias(f"num{i}"),
                 F.count_if(s.rlike(TYPE_CONVERT_DATE)).alias(f"dpat{i}"), F.count(iso).alias(f"iso{i}"),
                 F.count(mixed).alias(f"mix{i}")]
    r = df.agg(*aggs).first() if text else None
    new = {}
    for i, c in enumerate(text):
        nn = r[f"nn{i}"]
        s = F.col(c)
        if nn == 0 or r[f"none{i}"] > nn * 0.7:
            continue
        if r[f"pat{i}"] / nn > 0.7 and r[f"num{i}"] / nn > 0.7:
            new[c] = S.num_parse(F.regexp_replace(s, r"[^\d.\-]", ""))
            continue
        if any(w in c.lower() for w in TYPE_CONVERT_DATE_WORDS) or r[f"dpat{i}"] / nn > 0.5:
            if r[f"iso{i}"] / nn > 0.7:
                new[c] = F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))
                continue
            if r[f"mix{i}"] / nn > 0.7:
                new[c] = F.to_timestamp(S.parse_date_formats(F.regexp_replace(s, r"[/.]", "-"),
                                                             ["d-M-yyyy", "yyyy-M-d", "d-M-yy"]))
                continue
        new[c] = F.when(s.isNull() | s.isin(*TYPE_CONVERT_NONE_WORDS), F.lit("")).otherwise(s)
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
