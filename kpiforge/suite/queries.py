"""Registered queries: one per operator, each paired with an oracle SQL string.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator through this
library on the driver tables (or ``dirty_sales`` derived from them).
``ORACLE[name]`` is an independent SQL formulation for DuckDB over the same
tables. Column names match between both sides.
"""

from __future__ import annotations

from typing import Callable, Dict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions import scalars as S
from kpiforge.operators import measures as M
from kpiforge.operators import profile as P
from kpiforge.operators import repair as R
from kpiforge.plans import cleaning as CL
from kpiforge.sources.tables import table
from kpiforge.suite import sqlparts as Q
from kpiforge.suite import stages as ST

QUERIES: Dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: Dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def pct2(n: str, d: str) -> Column:
    """round(100*n/d, 2) half-up with integer arithmetic (exact in every engine)."""
    return F.expr(f"CAST((CAST({n} AS BIGINT) * 20000 + CAST({d} AS BIGINT)) div (CAST({d} AS BIGINT) * 2) AS DOUBLE) / 100")


def sql_pct2(n: str, d: str) -> str:
    return f"(((CAST({n} AS BIGINT) * 20000 + CAST({d} AS BIGINT)) // (CAST({d} AS BIGINT) * 2)) / 100.0)"


DS = Q.DS_COLS
TEXT = Q.DS_TEXT_COLS
NUMERIC_TYPED = ["quantity", "price_per_unit", "total_spent", "customer_rating"]


# =========================================================== flagship
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dirty_sales -> no-data words -> currency parse -> recalculated total ->
    keep-first per transaction id -> revenue by category."""
    df = ST.nulled(spark, sf_dir)
    df = df.select("transaction_id", "category",
                   S.num_parse("quantity").alias("quantity"),
                   S.num_currency("price_per_unit").alias("price_per_unit"),
                   S.num_parse("total_spent").alias("total_spent"))
    df = R.recalc_total(df, "quantity", "price_per_unit", "total_spent")
    df = R.dedup_key(df, "transaction_id")
    g = M.chart_group(df, "category", "total_spent", "sum")
    return g.select("category", F.round("value", 2).alias("revenue"))


_FLAG_SQL = Q.dirty_sales_cte() + f""",
nl AS ({Q.sentinel_select()}),
p AS (SELECT transaction_id, category, {Q.num_parse('quantity')} AS quantity,
             {Q.num_currency('price_per_unit')} AS price_per_unit, {Q.num_parse('total_spent')} AS total_spent FROM nl),
r AS (SELECT transaction_id, category, quantity, price_per_unit,
             greatest(round(coalesce(quantity, 0) * coalesce(price_per_unit, 0), 2), 0.0) AS total_spent FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY category NULLS FIRST,
             quantity NULLS FIRST, price_per_unit NULLS FIRST, total_spent NULLS FIRST) AS rn
      FROM r WHERE transaction_id IS NOT NULL AND trim(transaction_id) <> '' AND lower(transaction_id) <> 'nan'),
d AS (SELECT transaction_id, category, quantity, price_per_unit, total_spent FROM k WHERE rn = 1
      UNION ALL SELECT * FROM r WHERE transaction_id IS NULL OR trim(transaction_id) = '' OR lower(transaction_id) = 'nan')
SELECT category, round(coalesce(sum(total_spent), 0.0), 2) AS revenue FROM d GROUP BY category
"""
register("flagship", _FLAG_SQL)(flagship)


# =========================================================== sources (parquet)
@register("src_parquet", "SELECT l_returnflag, l_linestatus, count(*) AS n, "
          "round(sum(l_quantity), 2) AS qty FROM lineitem "
          "GROUP BY l_returnflag, l_linestatus")
def q_src_parquet(spark, sf_dir):
    """Parquet read of the whole table with pruned columns."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_returnflag", "l_linestatus")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")))


# =========================================================== no-data words
@register("null_sentinels", ST.sql_nulled() + " SELECT * FROM nl")
def q_null_sentinels(spark, sf_dir):
    return ST.nulled(spark, sf_dir)


def _sentinel_count_sql():
    parts = [f"sum(CASE WHEN {Q.is_null_word(c)} THEN 1 ELSE 0 END)" for c in TEXT]
    return ST.sql_raw() + f" SELECT CAST({' + '.join(parts)} AS BIGINT) AS cells_converted FROM ds"


@register("null_sentinel_count", _sentinel_count_sql())
def q_null_sentinel_count(spark, sf_dir):
    return R.count_sentinels(ST.raw(spark, sf_dir))


@register("fill_constant", ST.sql_nulled() + " SELECT " + ", ".join(
    [f"coalesce({c}, 'Unknown') AS {c}" for c in TEXT] + ["customer_rating"]) + " FROM nl")
def q_fill_constant(spark, sf_dir):
    return R.fill_constant(ST.nulled(spark, sf_dir), "Unknown")


# =========================================================== scalar parses
@register("num_parse", ST.sql_raw() + f" SELECT DISTINCT quantity AS raw_value, {Q.num_parse('quantity')} AS parsed FROM ds")
def q_num_parse(spark, sf_dir):
    return ST.raw(spark, sf_dir).select(F.col("quantity").alias("raw_value"),
                                        S.num_parse("quantity").alias("parsed")).distinct()


@register("num_currency", ST.sql_raw() + f" SELECT DISTINCT price_per_unit AS raw_value, "
          f"{Q.num_currency('price_per_unit')} AS parsed FROM ds")
def q_num_currency(spark, sf_dir):
    return ST.raw(spark, sf_dir).select(F.col("price_per_unit").alias("raw_value"),
                                        S.num_currency("price_per_unit").alias("parsed")).distinct()


@register("num_locale", ST.sql_raw() + f" SELECT DISTINCT total_spent AS raw_value, "
          f"{Q.num_locale('total_spent')} AS parsed FROM ds")
def q_num_locale(spark, sf_dir):
    return ST.raw(spark, sf_dir).select(F.col("total_spent").alias("raw_value"),
                                        S.num_locale("total_spent").alias("parsed")).distinct()


@register("bool_normalise", ST.sql_raw() + " SELECT transaction_id, "
          f"coalesce({Q.bool_word('discount_applied')}, false) AS discount_applied FROM ds")
def q_bool_normalise(spark, sf_dir):
    df = R.bool_normalise(ST.raw(spark, sf_dir))
    return df.select("transaction_id", "discount_applied")


@register("key_slug", "SELECT DISTINCT p_type, regexp_replace(lower(p_type), '\\s+', '_', 'g') AS p_type_key FROM part")
def q_key_slug(spark, sf_dir):
    return M.key_slugs(table(spark, sf_dir, "part").select("p_type"), ["p_type"]).distinct()


@register("cast_string", ST.sql_raw() + f" SELECT DISTINCT {Q.strip('category')} AS category FROM ds")
def q_cast_string(spark, sf_dir):
    return R.cast_string(ST.raw(spark, sf_dir).select("category"), ["category"]).distinct()


# =========================================================== profile
def _prof_sql_one(c: str, dtype: str, src: str) -> str:
    is_text = dtype == "string"
    v = Q.null_sentinel(c) if is_text else c
    num = Q.num_parse(v) if is_text else f"CAST({c} AS DOUBLE)"
    dat = Q.date_any(v) if is_text else "CAST(NULL AS DATE)"
    return (f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, count(*) AS n_rows, count_if({c} IS NULL) AS null_count, "
            f"count(v) AS n_clean, count(num) AS num_count, count_if(num = floor(num)) AS whole_count, "
            f"count(dat) AS date_count, count_if(v IS NOT NULL AND lower(CAST(v AS VARCHAR)) NOT IN "
            f"({', '.join(Q.q(w) for w in K.BOOL_WORDS)})) AS non_bool_count, count(DISTINCT {c}) AS distinct_nonnull, "
            f"min(num) AS num_min, max(num) AS num_max, avg(num) AS num_mean, stddev_samp(num) AS num_std "
            f"FROM (SELECT {c}, {v} AS v, {num} AS num, {dat} AS dat FROM {src})")


def _samples_sql(c: str, src: str) -> str:
    """The five smallest distinct values, joined."""
    return (f"(SELECT coalesce(string_agg(v, ' | ' ORDER BY v), '') FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {src} "
            f"WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5))")


def _wide_sql(src: str, cols_types) -> str:
    return " UNION ALL ".join(_prof_sql_one(c, t, src) for c, t in cols_types)


_LADDER = ("CASE WHEN n_clean = 0 THEN 'empty' "
           "WHEN num_count / n_clean > 0.9 THEN CASE WHEN whole_count = num_count THEN 'integer' ELSE 'float' END "
           "WHEN date_count / n_clean > 0.7 THEN 'datetime' "
           "WHEN non_bool_count = 0 THEN 'boolean' "
           "WHEN distinct_nonnull / n_rows < 0.05 OR distinct_nonnull <= 20 THEN 'categorical' "
           "WHEN distinct_nonnull / n_rows > 0.95 THEN 'identifier' ELSE 'text' END")

RAW_TYPES = [(c, "string") for c in TEXT] + [("customer_rating", "int")]


@register("prof_columns", ST.sql_raw() + f", w AS ({_wide_sql('ds', RAW_TYPES)}) SELECT column_name, dtype, "
          f"{_LADDER} AS logical_type, null_count, {sql_pct2('null_count', 'n_rows')} AS null_pct, "
          "distinct_nonnull + CASE WHEN null_count > 0 THEN 1 ELSE 0 END AS unique_count, "
          f"{sql_pct2('distinct_nonnull + CASE WHEN null_count > 0 THEN 1 ELSE 0 END', 'n_rows')} AS unique_pct, CASE column_name "
          + " ".join(f"WHEN '{c}' THEN {_samples_sql(c, 'ds')}" for c, _ in RAW_TYPES) + " END AS samples FROM w")
def q_prof_columns(spark, sf_dir):
    wp = P.wide_profile(ST.raw(spark, sf_dir), samples=True)
    uniq = "(distinct_nonnull + CASE WHEN null_count > 0 THEN 1 ELSE 0 END)"
    return wp.select("column_name", "dtype", P.logical_type_expr().alias("logical_type"), "null_count",
                     pct2("null_count", "n_rows").alias("null_pct"),
                     F.expr(uniq).alias("unique_count"), pct2(uniq, "n_rows").alias("unique_pct"),
                     F.array_join(F.coalesce("samples", F.array()), " | ").alias("samples"))


@register("type_detect", ST.sql_raw() + f", w AS ({_wide_sql('ds', RAW_TYPES)}) SELECT column_name, "
          f"{_LADDER} AS logical_type FROM w")
def q_type_detect(spark, sf_dir):
    return P.column_types(ST.raw(spark, sf_dir))


@register("prof_basic", ST.sql_raw() + ", g AS (SELECT count(*) AS g FROM ds GROUP BY ALL_COLS) "
          "SELECT CAST(sum(g) AS BIGINT) AS total_rows, CAST(11 AS BIGINT) AS total_columns, "
          "CAST(coalesce(sum(CASE WHEN g > 1 THEN g END), 0) AS BIGINT) AS duplicate_rows, "
          "CAST(sum(g - 1) AS BIGINT) AS extra_duplicate_rows FROM g".replace("ALL_COLS", ", ".join(DS)))
def q_prof_basic(spark, sf_dir):
    return P.basic_stats(ST.raw(spark, sf_dir))


def _prof_quality_sql():
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in DS)
    return (ST.sql_nulled() + f", g AS (SELECT count(*) AS g, {nulls} AS rn FROM nl GROUP BY {', '.join(DS)}) "
            "SELECT round((1 - sum(rn * g) / (sum(g) * 11)) * 100, 2) AS completeness, "
            "CAST(sum(rn * g) AS BIGINT) AS total_nulls, "
            "CAST(coalesce(sum(CASE WHEN g > 1 THEN g END), 0) AS BIGINT) AS duplicate_rows, "
            "round(coalesce(sum(CASE WHEN g > 1 THEN g END), 0) * 100.0 / sum(g), 2) AS duplicate_pct FROM g")


@register("prof_quality", _prof_quality_sql())
def q_prof_quality(spark, sf_dir):
    return P.quality_metrics(ST.nulled(spark, sf_dir))


def _clean_gate_sql():
    words = "(" + ", ".join(Q.q(w) for w in K.GATE_NULL_WORDS) + ")"
    bad = " + ".join(f"CASE WHEN {c} IS NULL OR lower({Q.strip(f'CAST({c} AS VARCHAR)')}) IN {words} THEN 1 ELSE 0 END"
                     for c in DS)
    return (ST.sql_raw() + f", g AS (SELECT count(*) AS g, {bad} AS rb FROM ds GROUP BY {', '.join(DS)}), "
            "a AS (SELECT sum(g) AS n, sum(rb * g) AS null_cells, sum(g - 1) AS dup_rows FROM g) "
            "SELECT CAST(null_cells AS BIGINT) AS null_cells, round(null_cells * 100.0 / (n * 11), 4) AS null_pct, "
            "CAST(dup_rows AS BIGINT) AS dup_rows, round(dup_rows * 100.0 / n, 4) AS dup_pct, "
            f"(round(null_cells * 100.0 / (n * 11), 4) <= {K.GATE_NULL_PCT} AND round(dup_rows * 100.0 / n, 4) <= "
            f"{K.GATE_DUP_PCT}) AS is_clean FROM a")


@register("clean_gate", _clean_gate_sql())
def q_clean_gate(spark, sf_dir):
    return P.clean_gate(ST.raw(spark, sf_dir))


@register("null_gate", ST.sql_nulled() + " SELECT CAST(" + " + ".join(f"count_if({c} IS NULL)" for c in DS) +
          " AS BIGINT) AS total_nulls, CASE WHEN " + " + ".join(f"count_if({c} IS NULL)" for c in DS) +
          " > 0 THEN 'warning' ELSE 'success' END AS status FROM nl")
def q_null_gate(spark, sf_dir):
    return P.null_gate(ST.nulled(spark, sf_dir))


def _numeric_profile_sql():
    parts = []
    for c in NUMERIC_TYPED:
        parts.append(f"SELECT '{c}' AS column_name, min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, "
                     f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
                     f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std FROM ty")
    return ST.sql_typed() + " " + " UNION ALL ".join(parts)


@register("prof_numeric", _numeric_profile_sql())
def q_prof_numeric(spark, sf_dir):
    out = P.numeric_profile(ST.typed(spark, sf_dir), NUMERIC_TYPED)
    return out.select("column_name", "min", "max", F.round("mean", 6).alias("mean"), "median",
                      F.round("std", 6).alias("std"))


def _distribution_sql():
    parts = []
    for c in NUMERIC_TYPED:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis, "
            f"q25, q50, q75 FROM (SELECT avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4, "
            f"any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75 FROM "
            f"(SELECT {x} AS x, avg({x}) OVER () AS mu, quantile_cont({x}, 0.25) OVER () AS q25, "
            f"quantile_cont({x}, 0.5) OVER () AS q50, quantile_cont({x}, 0.75) OVER () AS q75 FROM ty) WHERE x IS NOT NULL)")
    return ST.sql_typed() + " " + " UNION ALL ".join(parts)


@register("prof_distribution", _distribution_sql())
def q_prof_distribution(spark, sf_dir):
    out = P.distribution_profile(ST.typed(spark, sf_dir), NUMERIC_TYPED)
    return out.select("column_name", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"),
                      "q25", "q50", "q75")


# =========================================================== repairs
def _typed_order_sql(cols):
    return ", ".join(f"{c} NULLS FIRST" for c in cols)


TYPED_COLS = ["transaction_id", "customer_id", "item", "category", "quantity", "price_per_unit", "total_spent",
              "discount_applied", "transaction_date", "payment_method", "customer_rating"]


def _dedup_sql(src: str, cols) -> str:
    others = [c for c in cols if c != "transaction_id"]
    has = "transaction_id IS NOT NULL AND trim(transaction_id) <> '' AND lower(transaction_id) <> 'nan'"
    return (f"SELECT {', '.join(cols)} FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY "
            f"{_typed_order_sql(others)}) AS rn FROM {src} WHERE {has}) WHERE rn = 1 "
            f"UNION ALL SELECT {', '.join(cols)} FROM {src} WHERE NOT ({has}) OR transaction_id IS NULL")


@register("dedup_key", ST.sql_typed() + " " + _dedup_sql("ty", TYPED_COLS))
def q_dedup_key(spark, sf_dir):
    return R.dedup_key(ST.typed(spark, sf_dir), "transaction_id")


@register("recalc_total", ST.sql_typed() + " SELECT transaction_id, quantity, price_per_unit, "
          "greatest(round(coalesce(quantity, 0) * coalesce(price_per_unit, 0), 2), 0.0) AS total_spent FROM ty")
def q_recalc_total(spark, sf_dir):
    df = ST.typed(spark, sf_dir).select("transaction_id", "quantity", "price_per_unit", "total_spent")
    return R.recalc_total(df, "quantity", "price_per_unit", "total_spent")


# =========================================================== measures / charts
@register("chart_group", ST.sql_typed() + " SELECT payment_method, round(coalesce(sum(total_spent), 0.0), 2) AS value "
          "FROM ty GROUP BY payment_method")
def q_chart_group(spark, sf_dir):
    g = M.chart_group(ST.typed(spark, sf_dir), "payment_method", "total_spent", "sum")
    return g.select("payment_method", F.round("value", 2).alias("value"))


# =========================================================== semantic typing & relationships
from kpiforge.operators import detect as D  # noqa: E402
from kpiforge.operators import semantic as SEM  # noqa: E402


@register("sem_pattern")
def q_sem_pattern(spark, sf_dir):
    return SEM.semantic_types(ST.raw(spark, sf_dir))


def _proto_spark(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    pe = emb.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = pe.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    protos = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s")) \
        .select("label", F.transform("s", lambda e: e["m"]).alias("embedding"))
    vecs = emb.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return SEM.nearest_prototype(vecs, "embedding", protos)


@register("sem_prototype", """
WITH pe AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings),
m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM pe GROUP BY label, pos),
p AS (SELECT CAST(label AS VARCHAR) AS label, list(m ORDER BY pos) AS v FROM m GROUP BY label),
s AS (SELECT e.vec_id, p.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), p.v) AS cos
      FROM embeddings e, p),
b AS (SELECT vec_id, arg_max(label, cos) AS best, max(cos) AS cos FROM s GROUP BY vec_id)
SELECT vec_id, CASE WHEN cos > 0.5 THEN best ELSE 'Unknown' END AS nearest, round(cos, 6) AS similarity FROM b
""")
def q_sem_prototype(spark, sf_dir):
    out = _proto_spark(spark, sf_dir)
    return out.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


def _mult_cols():
    return ["quantity", "price_per_unit", "total_spent"]


@register("rel_multiply", ST.sql_typed() + """ SELECT 'multiplication' AS kind,
 'total_spent = quantity x price_per_unit' AS formula, ['quantity', 'price_per_unit', 'total_spent'] AS columns,
 round(CASE WHEN avg(total_spent) <> 0 THEN greatest(0.0, least(1.0, 1 - avg(abs(quantity * price_per_unit - total_spent)) / avg(total_spent))) ELSE 0.0 END, 6) AS confidence,
 round(avg(abs(quantity * price_per_unit - total_spent)), 6) AS mean_error,
 round(max(abs(quantity * price_per_unit - total_spent)), 6) AS max_error,
 CAST(count_if(abs(quantity * price_per_unit - total_spent) > 0.01) AS BIGINT) AS mismatches FROM ty""")
def q_rel_multiply(spark, sf_dir):
    ty = ST.typed(spark, sf_dir)
    smap = SEM.semantic_map(ST.raw(spark, sf_dir))
    cols = SEM.multiplication_columns(ty, smap)
    out = SEM.multiplication_check(ty, cols)
    return out.select("kind", "formula", "columns", F.round("confidence", 6).alias("confidence"),
                      F.round("mean_error", 6).alias("mean_error"), F.round("max_error", 6).alias("max_error"),
                      "mismatches")


def _corr_sql():
    cols = NUMERIC_TYPED
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM ty")
    return (ST.sql_typed() + ", c AS (" + " UNION ALL ".join(parts) + ") SELECT col1, col2, round(r, 6) AS correlation "
            "FROM c WHERE abs(r) > 0.7")


@register("rel_correlation", _corr_sql())
def q_rel_correlation(spark, sf_dir):
    out = SEM.correlations(ST.typed(spark, sf_dir), NUMERIC_TYPED)
    return out.select("col1", "col2", F.round("correlation", 6).alias("correlation"))


# =========================================================== detection
def _sql_long(items, src_agg: str) -> str:
    """items: (category, column, issue, count_expr, severity_sql) -> long rows with count > 0."""
    sel = " UNION ALL ".join(
        f"SELECT '{cat}' AS category, '{c}' AS column_name, '{iss}' AS issue, CAST({cnt} AS BIGINT) AS count, "
        f"{sql_pct2(cnt, 'n')} AS pct, {sev} AS severity FROM a"
        for cat, c, iss, cnt, sev in items)
    return f", a AS ({src_agg}) SELECT * FROM ({sel}) WHERE count > 0"


def _sev_sql(cnt: str) -> str:
    p = sql_pct2(cnt, "n")
    return f"CASE WHEN {p} > 50 THEN 'CRITICAL' WHEN {p} > 20 THEN 'HIGH' WHEN {p} > 5 THEN 'MEDIUM' ELSE 'LOW' END"


NULLABLE_RAW = {"category", "discount_applied"}


def _det_missing_sql():
    aggs = ["count(*) AS n"] + [
        f"count_if({c} IS NULL OR {Q.is_null_word(c)}) AS m_{c}" if c in TEXT else f"count_if({c} IS NULL) AS m_{c}"
        for c in DS]
    items = [("missing_values", c, "nullable" if c in NULLABLE_RAW else "required", f"m_{c}", _sev_sql(f"m_{c}"))
             for c in DS]
    return ST.sql_raw() + _sql_long(items, "SELECT " + ", ".join(aggs) + " FROM ds")


@register("det_missing", _det_missing_sql())
def q_det_missing(spark, sf_dir):
    raw_df = ST.raw(spark, sf_dir)
    return D.det_missing(raw_df, SEM.semantic_map(raw_df))


@register("det_dup_rows", ST.sql_raw() + ", g AS (SELECT count(*) AS g FROM ds GROUP BY " + ", ".join(DS) + ")" +
          _sql_long([("duplicates", "*", "exact_duplicates", "d", "'HIGH'")],
                    "SELECT sum(g) AS n, coalesce(sum(CASE WHEN g > 1 THEN g END), 0) AS d FROM g"))
def q_det_dup_rows(spark, sf_dir):
    return D.det_dup_rows(ST.raw(spark, sf_dir))


ID_COLS = ["transaction_id", "customer_id", "customer_rating"]


@register("det_dup_ids", ST.sql_raw() + _sql_long(
    [("duplicates", c, "duplicate_ids", f"d_{c}", "'MEDIUM'") for c in ID_COLS],
    "SELECT count(*) AS n, " + ", ".join(
        f"count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS d_{c}" for c in ID_COLS)
    + " FROM ds"))
def q_det_dup_ids(spark, sf_dir):
    raw_df = ST.raw(spark, sf_dir)
    smap = SEM.semantic_map(raw_df)
    ids = [c for c, v in smap.items() if v["semantic_type"] in K.ID_SEMANTIC_TYPES]
    return D.det_dup_ids(raw_df, ids)


NEG_COLS = ["quantity", "price_per_unit", "total_spent"]


def _det_invalid_sql():
    aggs = ["count(*) AS n"] + [f"count_if({c} < 0) AS neg_{c}" for c in NEG_COLS] + \
        [f"count_if(transaction_date > DATE '{ST.AS_OF.isoformat()}') AS fut", "count_if(quantity = 0) AS zero"]
    items = [("invalid_values", c, "negative_values", f"neg_{c}", "'HIGH'") for c in NEG_COLS] + \
        [("invalid_values", "transaction_date", "future_dates", "fut", "'MEDIUM'"),
         ("invalid_values", "quantity", "zero_quantity", "zero", "'MEDIUM'")]
    return ST.sql_typed() + _sql_long(items, "SELECT " + ", ".join(aggs) + " FROM ty")


@register("det_invalid", _det_invalid_sql())
def q_det_invalid(spark, sf_dir):
    return D.det_invalid(ST.typed(spark, sf_dir), NEG_COLS, ["quantity"], ["transaction_date"], ST.AS_OF)


CAT_TEXT = ["transaction_id", "customer_id", "item", "category", "payment_method"]


def _det_incons_sql():
    aggs = ["count(*) AS n"]
    items = []
    for c in CAT_TEXT:
        aggs.append(f"count(DISTINCT {c}) - count(DISTINCT lower({Q.strip(c)})) AS v_{c}")
        aggs.append(f"count_if(regexp_matches({c}, '^\\s+|\\s+$')) AS w_{c}")
        items.append(("inconsistencies", c, "case_inconsistency", f"v_{c}", "'LOW'"))
        items.append(("inconsistencies", c, "whitespace", f"w_{c}", "'LOW'"))
    return ST.sql_nulled() + _sql_long(items, "SELECT " + ", ".join(aggs) + " FROM nl")


@register("det_inconsistent", _det_incons_sql())
def q_det_inconsistent(spark, sf_dir):
    return D.det_inconsistent(ST.nulled(spark, sf_dir), CAT_TEXT)


@register("det_formula", ST.sql_typed() + _sql_long(
    [("business_violations", "total_spent", "formula", "v", "'HIGH'")],
    "SELECT count(*) AS n, count_if(abs(quantity * price_per_unit - total_spent) > 0.01) AS v FROM ty"))
def q_det_formula(spark, sf_dir):
    return D.det_formula(ST.typed(spark, sf_dir), ["quantity", "price_per_unit", "total_spent"])


def _outlier_sql():
    parts = []
    for c in NUMERIC_TYPED:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, n, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
 (SELECT CAST(count_if({x} < s.q1 - 1.5 * (s.q3 - s.q1) OR {x} > s.q3 + 1.5 * (s.q3 - s.q1)) AS BIGINT) FROM ty) AS iqr_count,
 (SELECT CAST(count_if(abs(({x} - s.mu) / s.sd) > 3) AS BIGINT) FROM ty) AS z_count, sd
 FROM (SELECT count({x}) AS n, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3,
       avg({x}) AS mu, stddev_pop({x}) AS sd FROM ty) s""")
    return (ST.sql_typed() + ", o AS (" + " UNION ALL ".join(parts) + ") SELECT column_name, n, q1, q3, lower, upper, "
            "iqr_count, z_count FROM o WHERE n >= 10 AND sd > 0 AND q3 - q1 <> 0")


@register("det_outlier_iqr", _outlier_sql())
def q_det_outlier_iqr(spark, sf_dir):
    return D.outlier_counts(ST.typed(spark, sf_dir), NUMERIC_TYPED)


def _issue_totals_sql():
    # the union of the detector oracles above, grouped by category
    names = ("det_missing", "det_dup_rows", "det_dup_ids", "det_invalid", "det_inconsistent", "det_formula")
    u = " UNION ALL ".join(f"SELECT * FROM ({ORACLE[n]})" for n in names)
    return (f"SELECT category, CAST(sum(count) AS BIGINT) AS total, count(*) AS issues FROM ({u}) "
            "GROUP BY category")


@register("issue_totals", _issue_totals_sql())
def q_issue_totals(spark, sf_dir):
    raw_df, ty, nl = ST.raw(spark, sf_dir), ST.typed(spark, sf_dir), ST.nulled(spark, sf_dir)
    smap = SEM.semantic_map(raw_df)
    parts = [D.det_missing(raw_df, smap), D.det_dup_rows(raw_df),
             D.det_dup_ids(raw_df, ["transaction_id", "customer_id", "customer_rating"]),
             D.det_invalid(ty, NEG_COLS, ["quantity"], ["transaction_date"], ST.AS_OF),
             D.det_inconsistent(nl, CAT_TEXT), D.det_formula(ty, ["quantity", "price_per_unit", "total_spent"])]
    return D.issue_totals(D.problems_union(parts))


# =========================================================== KPIs, measures, charts (driver tables)
LI_KPIS = [M.Kpi("Total Quantity", "l_quantity", "sum", "number"),
           M.Kpi("Avg Price", "l_extendedprice", "mean", "currency"),
           M.Kpi("Orders", "l_orderkey", "nunique", "number"),
           M.Kpi("Max Discount", "l_discount", "max", "percentage"),
           M.Kpi("Min Tax", "l_tax", "min", "percentage"),
           M.Kpi("Rows", "index", "count", "number"),
           M.Kpi("Discount per Tax", "l_discount", "ratio", "number", ["l_discount", "l_tax"]),
           M.Kpi("Unknown agg", "l_quantity", "median", "number"),
           M.Kpi("Missing column", "no_such_column", "sum", "number")]


def _kpi_sql(src: str, where: str = "") -> str:
    vals = [("Total Quantity", "coalesce(sum(l_quantity), 0)", "number"),
            ("Avg Price", "coalesce(avg(l_extendedprice), 0)", "currency"),
            ("Orders", "CAST(count(DISTINCT l_orderkey) AS DOUBLE)", "number"),
            ("Max Discount", "coalesce(max(l_discount), 0)", "percentage"),
            ("Min Tax", "coalesce(min(l_tax), 0)", "percentage"),
            ("Rows", "CAST(count(*) AS DOUBLE)", "number"),
            ("Discount per Tax", "CASE WHEN sum(l_tax) <> 0 THEN sum(l_discount) / sum(l_tax) ELSE 0 END", "number"),
            ("Unknown agg", "coalesce(sum(l_quantity), 0)", "number")]
    parts = [f"SELECT {i} AS position, '{lab}' AS label, round(CAST({e} AS DOUBLE), 4) AS value, '{fmt}' AS fmt "
             f"FROM {src} {where}" for i, (lab, e, fmt) in enumerate(vals)]
    return " UNION ALL ".join(parts)


def _round_value(df, digits=4):
    return df.select(*[F.round("value", digits).alias("value") if c == "value" else F.col(c) for c in df.columns])


@register("kpi_eval", _kpi_sql("lineitem"))
def q_kpi_eval(spark, sf_dir):
    return _round_value(M.kpi_eval(table(spark, sf_dir, "lineitem"), LI_KPIS))


FILTERS = {"L_RETURNFLAG": ["R", "A"], "l_linestatus": ["F"], "l_shipmode": [], "no_such": ["x"]}


@register("kpi_filtered", _kpi_sql("lineitem", "WHERE CAST(l_returnflag AS VARCHAR) IN ('R', 'A') "
                                               "AND CAST(l_linestatus AS VARCHAR) IN ('F')"))
def q_kpi_filtered(spark, sf_dir):
    return _round_value(M.kpi_filtered(table(spark, sf_dir, "lineitem"), FILTERS, LI_KPIS))


@register("filter_in", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem "
          "WHERE l_returnflag IN ('R', 'A') AND l_linestatus IN ('F')")
def q_filter_in(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return M.filter_in(li, FILTERS).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@register("kpi_default", "SELECT 0 AS position, 'L Orderkey' AS label, round(CAST(sum(l_orderkey) AS DOUBLE), 4) AS value, "
          "'number' AS fmt FROM lineitem UNION ALL SELECT 1, 'L Partkey', round(CAST(sum(l_partkey) AS DOUBLE), 4), "
          "'number' FROM lineitem UNION ALL SELECT 2, 'L Suppkey', round(CAST(sum(l_suppkey) AS DOUBLE), 4), 'number' "
          "FROM lineitem UNION ALL SELECT 3, 'L Linenumber', round(CAST(sum(l_linenumber) AS DOUBLE), 4), 'number' FROM lineitem")
def q_kpi_default(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return _round_value(M.kpi_eval(li, M.default_kpis(li, max_kpis=4)))


@register("slicer_values", "SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders "
          "UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def q_slicer_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return M.slicer_values(o, M.default_slicers(o, max_slicers=3))


def _measure_pack_sql():
    tot = Q.num_parse("regexp_replace(total_spent, '[₹$£€,]', '', 'g')")
    tot_sum = f"CAST(sum(CAST({tot} AS DECIMAL(38,6))) AS DOUBLE)"
    qty_sum = "CAST(sum(CAST(" + Q.num_parse("regexp_replace(quantity, '[₹$£€,]', '', 'g')") + " AS DECIMAL(38,6))) AS DOUBLE)"
    qty = Q.num_parse("regexp_replace(quantity, '[₹$£€,]', '', 'g')")
    pri = Q.num_parse("regexp_replace(price_per_unit, '[₹$£€,]', '', 'g')")
    rows = [("Total_Revenue", tot_sum), ("Avg_Order_Value", f"round(avg({tot}), 2)"),
            ("Total_Units_Sold", qty_sum), ("Avg_Units_Per_Order", f"round(avg({qty}), 2)"),
            ("Avg_Selling_Price", f"round(avg({pri}), 2)"),
            ("Unique_Customers", "CAST(count(DISTINCT customer_id) AS DOUBLE)"),
            ("Revenue_Per_Customer", f"round(sum({tot}) / count(DISTINCT customer_id), 2)"),
            ("Avg_Review_Score", "round(avg(CAST(customer_rating AS DOUBLE)), 2)"),
            ("Discount_Rate_%", f"round(avg(CASE WHEN {Q.bool_word('discount_applied')} THEN 1.0 ELSE 0.0 END) * 100, 2)")]
    return ST.sql_raw() + " " + " UNION ALL ".join(
        f"SELECT '{n}' AS name, round(CAST({e} AS DOUBLE), 2) AS value FROM ds" for n, e in rows)


@register("measure_pack", _measure_pack_sql())
def q_measure_pack(spark, sf_dir):
    out = M.measure_pack(ST.raw(spark, sf_dir))
    return out.select("name", F.round("value", 2).alias("value"))


def _li_fin(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    # money rounded through DECIMAL so every engine rounds the same value half-up
    def r2(x):
        return F.round(x.cast("decimal(38,10)"), 2).cast("double")
    return li.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus",
                     r2(rev).alias("total_revenue"),
                     r2(rev - F.col("l_extendedprice") * F.col("l_tax")).alias("profit"),
                     r2(F.col("l_extendedprice") * F.col("l_tax")).alias("cost"),
                     (F.col("l_discount") > 0.05).alias("discount_applied"))


def _r2sql(e):
    return f"CAST(round(CAST({e} AS DECIMAL(38,10)), 2) AS DOUBLE)"


LI_FIN_SQL = ("WITH lf AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, l_linestatus, "
              f"{_r2sql('l_extendedprice * (1 - l_discount)')} AS total_revenue, "
              f"{_r2sql('l_extendedprice * (1 - l_discount) - l_extendedprice * l_tax')} AS profit, "
              f"{_r2sql('l_extendedprice * l_tax')} AS cost, l_discount > 0.05 AS discount_applied FROM lineitem)")

MEASURES = {
    "measure_sum": (M.Measure("Total_Revenue", "sum", ["total_revenue"]),
                    "round(CAST(sum(CAST(total_revenue AS DECIMAL(38,6))) AS DOUBLE), 2)"),
    "measure_mean": (M.Measure("Avg_Order_Value", "mean", ["total_revenue"]), "round(avg(total_revenue), 2)"),
    "measure_nunique": (M.Measure("Unique_Customers", "nunique", ["l_orderkey"]),
                        "CAST(count(DISTINCT l_orderkey) AS DOUBLE)"),
    "measure_profit_margin": (M.Measure("Profit_Margin_%", "profit_margin", ["profit", "total_revenue"]),
                              "CASE WHEN sum(total_revenue) <> 0 THEN round(sum(profit) / sum(total_revenue) * 100, 2) ELSE 0 END"),
    "measure_ratio": (M.Measure("Cost_to_Revenue", "ratio", ["cost", "total_revenue"]),
                      "CASE WHEN sum(total_revenue) <> 0 THEN round(sum(cost) / sum(total_revenue), 4) ELSE 0 END"),
    "measure_rev_per_customer": (M.Measure("Revenue_Per_Customer", "rev_per_cust", ["total_revenue", "l_orderkey"]),
                                 "round(sum(total_revenue) / count(DISTINCT l_orderkey), 2)"),
    "measure_discount_rate": (M.Measure("Discount_Rate_%", "discount_rate", ["discount_applied"]),
                              "round(avg(CASE WHEN discount_applied THEN 1.0 ELSE 0.0 END) * 100, 2)"),
}


def _measure_query(m):
    def run(spark, sf_dir):
        out = M.evaluate_measures(_li_fin(spark, sf_dir), [m])
        return out.select("name", F.round("value", 2).alias("value"))
    return run


for _name, (_m, _sql) in MEASURES.items():
    register(_name, LI_FIN_SQL + f" SELECT '{_m.name}' AS name, round(CAST({_sql} AS DOUBLE), 2) AS value FROM lf")(
        _measure_query(_m))


@register("attach_scalars", LI_FIN_SQL + " SELECT l_orderkey, l_partkey, total_revenue, "
          "round(CAST(sum(CAST(total_revenue AS DECIMAL(38,6))) OVER () AS DOUBLE), 2) AS revenue_all FROM lf")
def q_attach_scalars(spark, sf_dir):
    lf = _li_fin(spark, sf_dir).select("l_orderkey", "l_partkey", "total_revenue")
    out = M.attach_measures(lf, [M.Measure("revenue_all", "sum", ["total_revenue"])])
    return out.withColumn("revenue_all", F.round("revenue_all", 2))


@register("chart_pie_axes", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY o_orderpriority")
def q_chart_pie_axes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = M.chart_pie(o, "o_totalprice", "o_orderpriority", "sum")   # numeric x, text y -> swapped
    return g.select("o_orderpriority", F.round("value", 2).alias("value"))


@register("chart_share", "SELECT event_type, round(sum(value), 4) AS value, round(sum(value) / sum(sum(value)) OVER (), 6) "
          "AS share FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def q_chart_share(spark, sf_dir):
    out = M.chart_share(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", F.round("value", 4).alias("value"), F.round("share", 6).alias("share"))


@register("chart_time", "SELECT date_trunc('month', ts) AS period, round(coalesce(sum(value), 0), 4) AS value FROM events "
          "WHERE ts IS NOT NULL GROUP BY 1")
def q_chart_time(spark, sf_dir):
    out = M.chart_time(table(spark, sf_dir, "events"), "ts", "value", "sum")
    return out.select("period", F.round("value", 4).alias("value"))


@register("chart_hist", """WITH mm AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS bin FROM events, mm WHERE value IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 10), 6) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS bin_end,
       count(*) AS n FROM b, mm GROUP BY bin, lo, hi""")
def q_chart_hist(spark, sf_dir):
    out = M.chart_hist(table(spark, sf_dir, "events"), "value", 10)
    return out.select("bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "n")


@register("chart_scatter", "SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, "
          "round(corr(l_quantity, l_extendedprice) OVER (), 6) AS r FROM lineitem")
def q_chart_scatter(spark, sf_dir):
    out = M.chart_scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("x", "y", F.round("r", 6).alias("r"))


@register("chart_group_mean", "SELECT o_orderstatus, round(coalesce(avg(o_totalprice), 0), 4) AS value FROM orders "
          "GROUP BY o_orderstatus")
def q_chart_group_mean(spark, sf_dir):
    g = M.chart_group(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "mean")
    return g.select("o_orderstatus", F.round("value", 4).alias("value"))


@register("pivot_filter", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS value FROM lineitem "
          "GROUP BY l_returnflag, l_linestatus")
def q_pivot_filter(spark, sf_dir):
    out = M.pivot_filter(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "sum", page="l_linestatus")
    return out.select("l_returnflag", "l_linestatus", F.round("value", 2).alias("value"))


@register("top_sellers", "SELECT l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem "
          "GROUP BY l_partkey ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_partkey LIMIT 10")
def q_top_sellers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn(
        "revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = M.top_sellers(li, "l_partkey", "revenue", 10)
    return out.select("l_partkey", F.round("total", 2).alias("total"))


@register("result_head", "SELECT o_orderkey, o_custkey, o_orderstatus, count(*) OVER () AS total_rows FROM orders "
          "ORDER BY o_orderkey LIMIT 5")
def q_result_head(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return M.result_head(o, ["o_orderkey"], 5)


@register("limit_pairs", "SELECT l_quantity, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, "
          "l_suppkey, l_quantity, l_extendedprice LIMIT 100")
def q_limit_pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return M.limit_pairs(li, "l_quantity", "l_extendedprice",
                         ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], 100)


def _kpi_format_sql():
    v = "(value + 0.0)"   # -0.0 + 0.0 = 0.0: no negative zero in the display
    cur = (f"CASE WHEN abs({v}) >= 1e6 THEN '$' || format('{{:,.1f}}', {v} / 1e6) || 'M' "
           f"WHEN abs({v}) >= 1e3 THEN '$' || format('{{:,.1f}}', {v} / 1e3) || 'K' "
           f"ELSE '$' || format('{{:,.2f}}', {v}) END")
    disp = (f"CASE WHEN fmt = 'currency' THEN {cur} WHEN fmt = 'percentage' THEN format('{{:,.1f}}', {v}) || '%' "
            f"ELSE format('{{:,.0f}}', {v}) END")
    body = _kpi_sql("lineitem").replace("round(CAST(", "(CAST(").replace("AS DOUBLE), 4) AS value", "AS DOUBLE)) AS value")
    return f"SELECT label, {disp} AS display FROM ({body})"


@register("kpi_format", _kpi_format_sql())
def q_kpi_format(spark, sf_dir):
    k = M.kpi_eval(table(spark, sf_dir, "lineitem"), LI_KPIS)
    return k.select("label", M.kpi_format(F.col("value"), F.col("fmt")).alias("display"))


@register("project_keep", ST.sql_raw() + " SELECT transaction_id, category, total_spent FROM ds")
def q_project_keep(spark, sf_dir):
    return M.project_keep(ST.raw(spark, sf_dir), ["transaction_id", "category", "total_spent"])


@register("filter_not_null", ST.sql_nulled() + " SELECT category, total_spent FROM nl WHERE category IS NOT NULL "
          "AND total_spent IS NOT NULL")
def q_filter_not_null(spark, sf_dir):
    return M.filter_not_null(ST.nulled(spark, sf_dir).select("category", "total_spent"), ["category", "total_spent"])


@register("union_parts", ST.sql_nulled() + " SELECT item, count(*) AS n FROM (SELECT * FROM nl WHERE item IS NOT NULL "
          "UNION ALL SELECT * FROM nl WHERE item IS NULL) GROUP BY item")
def q_union_parts(spark, sf_dir):
    u = R.union_parts(ST.nulled(spark, sf_dir), "item")
    return u.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@register("mode_value", ST.sql_nulled() + " " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS mode_value, count(*) AS mode_count FROM nl WHERE {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ["item", "category", "payment_method", "customer_id"]))
def q_mode_value(spark, sf_dir):
    from kpiforge.functions.stats import modes_frame
    return modes_frame(ST.nulled(spark, sf_dir), ["item", "category", "payment_method", "customer_id"])


# =========================================================== dates and casts
def _vote_sql():
    parts = []
    for i, (py, sp) in enumerate(K.DATE_FORMATS):
        parts.append(f"SELECT {i} AS format_order, '{py}' AS format, '{sp}' AS spark_format, "
                     f"count(try_strptime({Q.strip('transaction_date')}, '{py}')) AS parsed FROM nl")
    return ST.sql_nulled() + " " + " UNION ALL ".join(parts)


@register("date_format_vote", _vote_sql())
def q_date_format_vote(spark, sf_dir):
    return R.date_format_vote(ST.nulled(spark, sf_dir), "transaction_date")


@register("date_parse", ST.sql_typed() + f" SELECT transaction_id, CASE WHEN year(transaction_date) BETWEEN 1990 AND "
          f"{ST.AS_OF.year + 1} THEN transaction_date END AS transaction_date FROM ty")
def q_date_parse(spark, sf_dir):
    df = R.date_parse(ST.nulled(spark, sf_dir), "transaction_date", ST.AS_OF)
    return df.select("transaction_id", "transaction_date")


@register("date_epoch", "SELECT event_id, CAST(ts AS DATE) AS d_seconds, CAST(ts AS DATE) AS d_millis FROM events")
def q_date_epoch(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("d_seconds"),
                                               (F.unix_timestamp("ts") * 1000).alias("d_millis"))
    assert R.looks_like_epoch(ev, "d_seconds") and R.looks_like_epoch(ev, "d_millis")
    return R.date_epoch(R.date_epoch(ev, "d_seconds", ST.AS_OF), "d_millis", ST.AS_OF)


@register("fix_future", ST.sql_typed() + f" SELECT transaction_id, CASE WHEN transaction_date > DATE '{ST.AS_OF}' "
          f"THEN DATE '{ST.AS_OF}' ELSE transaction_date END AS transaction_date FROM ty")
def q_fix_future(spark, sf_dir):
    return R.fix_future(ST.typed(spark, sf_dir).select("transaction_id", "transaction_date"), "transaction_date", ST.AS_OF)


@register("date_parts", ST.sql_typed() + " SELECT transaction_id, transaction_date, year(transaction_date) AS transaction_date_Year, "
          "month(transaction_date) AS transaction_date_Month, quarter(transaction_date) AS transaction_date_Quarter FROM ty")
def q_date_parts(spark, sf_dir):
    return M.date_parts(ST.typed(spark, sf_dir).select("transaction_id", "transaction_date"), ["transaction_date"])


@register("derive_month_name", "SELECT DISTINCT o_orderdate, monthname(o_orderdate) AS month_name FROM orders")
def q_derive_month_name(spark, sf_dir):
    return M.month_name(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate").distinct()


@register("cast_integer", ST.sql_nulled() + f", p AS (SELECT transaction_id, {Q.num_locale('quantity')} AS quantity FROM nl) "
          "SELECT transaction_id, CAST(trunc(coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM p))) AS BIGINT) "
          "AS quantity FROM p")
def q_cast_integer(spark, sf_dir):
    return R.cast_integer(ST.nulled(spark, sf_dir).select("transaction_id", "quantity"), ["quantity"])


@register("cast_float", ST.sql_nulled() + f" SELECT transaction_id, round({Q.num_locale('price_per_unit')}, 2) AS price_per_unit FROM nl")
def q_cast_float(spark, sf_dir):
    return R.cast_float(ST.nulled(spark, sf_dir).select("transaction_id", "price_per_unit"), ["price_per_unit"])


@register("map_values", """WITH memory AS (SELECT n.n_name AS from_value, r.r_name AS to_value FROM nation n JOIN region r
 ON n.n_regionkey = r.r_regionkey), c AS (SELECT c.c_custkey, n.n_name AS place FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT c_custkey, coalesce(m.to_value, c.place) AS place FROM c LEFT JOIN memory m ON c.place = m.from_value""")
def q_map_values(spark, sf_dir):
    nation, region, cust = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    memory = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("from_value"), F.col("r_name").alias("to_value"))
    c = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("place"))
    return R.map_values(c, "place", memory)


# =========================================================== sources, sinks, catalog
from kpiforge.operators import select as SEL  # noqa: E402
from kpiforge.operators import sqlbatch as SB  # noqa: E402
from kpiforge.session import scratch_path, write_table  # noqa: E402
from kpiforge.sources import files as FS  # noqa: E402


@register("src_csv", ST.sql_raw() + " SELECT * FROM ds")
def q_src_csv(spark, sf_dir):
    """dirty_sales written to CSV in the shared folder, read back typed."""
    path = FS.write_csv(ST.raw(spark, sf_dir), scratch_path(spark, "src_csv"))
    return FS.read_csv_typed(spark, path)


@register("src_csv_string", ST.sql_raw() + " SELECT " + ", ".join(TEXT) +
          ", CAST(customer_rating AS VARCHAR) AS customer_rating FROM ds")
def q_src_csv_string(spark, sf_dir):
    path = FS.write_csv(ST.raw(spark, sf_dir), scratch_path(spark, "src_csv_string"))
    return FS.read_csv_strings(spark, path)


@register("src_csv_encoding")
def q_src_csv_encoding(spark, sf_dir):
    """documents written as ISO-8859-1 CSV; the UTF-8 probe finds bad bytes and re-reads as Latin-1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = scratch_path(spark, "src_csv_latin1")
    docs.write.mode("overwrite").options(**FS.CSV_EXACT).option("encoding", "ISO-8859-1").csv(path)
    return FS.read_csv_any_encoding(spark, path)


@register("src_json")
def q_src_json(spark, sf_dir):
    path = scratch_path(spark, "src_json")
    table(spark, sf_dir, "orders").write.mode("overwrite").json(path)
    return FS.read_json(spark, path)


@register("cat_tables")
def q_cat_tables(spark, sf_dir):
    from kpiforge.sources.tables import register_tables
    register_tables(spark, sf_dir)
    return FS.list_tables(spark)


@register("cat_describe")
def q_cat_describe(spark, sf_dir):
    names = ("orders", "lineitem", "customer")
    return FS.describe_tables(spark, {n: table(spark, sf_dir, n) for n in names})


@register("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, "
          "count(*) OVER () AS n_rows, 6 AS n_columns FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview(spark, sf_dir):
    return FS.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], 10)


MESSY = {"transaction_id": " Transaction ID ", "price_per_unit": "Price Per Unit ($)", "total_spent": "Total-Spent",
         "category": "__Category__"}


@register("norm_names", ST.sql_raw() + " SELECT transaction_id, price_per_unit, total_spent, category FROM ds")
def q_norm_names(spark, sf_dir):
    df = ST.raw(spark, sf_dir).select(*[F.col(k).alias(v) for k, v in MESSY.items()])
    return FS.normalise_names(df)


@register("sink_csv")
def q_sink_csv(spark, sf_dir):
    df = R.dedup_key(ST.typed(spark, sf_dir), "transaction_id")
    path = FS.write_csv(df, scratch_path(spark, "sink_csv"))
    return FS.read_csv_strings(spark, path)


@register("sink_report")
def q_sink_report(spark, sf_dir):
    raw_df = ST.raw(spark, sf_dir)
    parts = {"profile": P.column_profile(raw_df), "semantic": SEM.semantic_types(raw_df),
             "problems": D.det_missing(raw_df)}
    paths = FS.write_report(spark, parts, scratch_path(spark, "report"))
    return spark.read.json(paths["profile"])


@register("sink_bundle")
def q_sink_bundle(spark, sf_dir):
    raw_df = ST.raw(spark, sf_dir)
    parts = {"raw copy": raw_df, "cleaned copy": R.dedup_key(ST.typed(spark, sf_dir), "transaction_id"),
             "revenue by category": M.chart_group(ST.typed(spark, sf_dir), "category", "total_spent")}
    paths = FS.write_bundle(parts, scratch_path(spark, "bundle"))
    return spark.read.parquet(paths["revenue by category"])


# =========================================================== SQL batch and declarative plans
BATCH = [
    {"question": "Best sellers by revenue",
     "sql": "SELECT l_partkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem "
            "GROUP BY l_partkey ORDER BY revenue DESC LIMIT 5"},
    {"question": "Orders per status", "sql": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"},
    {"question": "Broken query", "sql": "SELECT no_such_column FROM orders"},
]


@register("sql_batch")
def q_sql_batch(spark, sf_dir):
    from kpiforge.sources.tables import register_tables
    register_tables(spark, sf_dir, ("lineitem", "orders"))
    return SB.sql_batch(spark, BATCH)


PLAN = SB.AnalysisPlan(type_updates={"quantity": "double", "total_spent": "double"},
                       derivations={"order_month": "month(to_date(transaction_date))",
                                    "big_order": "CAST(quantity AS DOUBLE) >= 25"},
                       chart_x="big_order", chart_y="total_spent", chart_agg="count")


@register("plan_apply", ST.sql_nulled() + " SELECT TRY_CAST(quantity AS DOUBLE) >= 25 AS big_order, "
          "CAST(count(TRY_CAST(total_spent AS DOUBLE)) AS DOUBLE) AS value FROM nl GROUP BY 1")
def q_plan_apply(spark, sf_dir):
    return SB.plan_apply(ST.nulled(spark, sf_dir), PLAN)


# =========================================================== feature selection (lineitem-derived table)
def _fs_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r2 = lambda x: F.round(x.cast("decimal(38,10)"), 2).cast("double")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                     r2(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_revenue"))


FS_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "total_revenue"]
FS_SQL = ("WITH ft AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
          f"{_r2sql('l_extendedprice * (1 - l_discount)')} AS total_revenue FROM lineitem)")


def _fs_variance_sql():
    parts = [f"SELECT '{c}' AS column_name, CASE WHEN max({c}) - min({c}) > 0 THEN var_samp({c}) / pow(max({c}) - min({c}), 2) "
             f"ELSE var_samp({c}) END AS v FROM ft" for c in FS_NUM]
    return FS_SQL + ", s AS (" + " UNION ALL ".join(parts) + ") SELECT column_name, CASE WHEN v < 0.01 THEN 0.0 " \
        "ELSE round(v / (SELECT CASE WHEN max(v) > 0 THEN max(v) ELSE 1 END FROM s), 3) END AS variance_score FROM s"


@register("fs_variance", _fs_variance_sql())
def q_fs_variance(spark, sf_dir):
    return SEL.variance_scores(_fs_table(spark, sf_dir), FS_NUM)


@register("fs_pearson", FS_SQL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(abs(corr({c}, total_revenue)), 6) AS pearson FROM ft" for c in FS_NUM[:-1]))
def q_fs_pearson(spark, sf_dir):
    out = SEL.pearson_scores(_fs_table(spark, sf_dir), FS_NUM, "total_revenue")
    return out.select("column_name", F.round("pearson", 6).alias("pearson"))


def _fs_mi_sql():
    qs = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in FS_NUM)
    binx = {c: (f"CASE WHEN {c} <= q_{c}[1] THEN '0' WHEN {c} <= q_{c}[2] THEN '1' WHEN {c} <= q_{c}[3] THEN '2' ELSE '3' END")
            for c in FS_NUM}
    ybin = binx["total_revenue"].replace("'", "")
    parts = [f"SELECT '{c}' AS column_name, {binx[c]} AS bx, {ybin} AS yb FROM ft, q" for c in FS_NUM[:-1]]
    parts += [f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), '__missing__') AS bx, {ybin} AS yb FROM ft, q"
              for c in ("l_returnflag", "l_linestatus")]
    return (FS_SQL + f", q AS (SELECT {qs} FROM ft), l AS (" + " UNION ALL ".join(parts) + "), "
            "j AS (SELECT column_name, bx, yb, count(*) AS nxy FROM l GROUP BY ALL), "
            "nx AS (SELECT column_name, bx, sum(nxy) AS nx FROM j GROUP BY ALL), "
            "ny AS (SELECT column_name, yb, sum(nxy) AS ny FROM j GROUP BY ALL), "
            "n AS (SELECT column_name, sum(nxy) AS n FROM j GROUP BY ALL), "
            "mi AS (SELECT j.column_name, greatest(sum(nxy / n * ln(nxy * n / (nx * ny))), 0) AS mi FROM j "
            "JOIN nx USING (column_name, bx) JOIN ny USING (column_name, yb) JOIN n USING (column_name) GROUP BY j.column_name), "
            "f AS (SELECT *, CASE WHEN column_name IN ('l_returnflag', 'l_linestatus') THEN 'categorical' ELSE 'numeric' END "
            "AS family FROM mi) SELECT column_name, family, round(mi, 6) AS mi, round(CASE WHEN max(mi) OVER (PARTITION BY family) > 0 "
            "THEN least(1.0, mi / max(mi) OVER (PARTITION BY family)) ELSE 0 END, 6) AS mi_score FROM f")


@register("fs_mutual_info", _fs_mi_sql())
def q_fs_mutual_info(spark, sf_dir):
    out = SEL.mutual_info(_fs_table(spark, sf_dir), FS_NUM + ["l_returnflag", "l_linestatus"], "total_revenue",
                          FS_NUM)
    return out.select("column_name", "family", F.round("mi", 6).alias("mi"), F.round("mi_score", 6).alias("mi_score"))


@register("fs_collinear")
def q_fs_collinear(spark, sf_dir):
    return SEL.collinear_columns(_fs_table(spark, sf_dir), FS_NUM)


@register("fs_forest")
def q_fs_forest(spark, sf_dir):
    return SEL.forest_importance(_fs_table(spark, sf_dir), FS_NUM + ["l_returnflag", "l_linestatus"],
                                 "total_revenue", FS_NUM)


@register("fs_select")
def q_fs_select(spark, sf_dir):
    return SEL.select_columns(_fs_table(spark, sf_dir), requirements="revenue by return flag", use_forest=True)


def _fs_select_sql():
    """The ranked rules over measured scores, forest off; name scores are those of quantity and discount (volume, 0.9),
    price and tax (money, 1.0), the flag (status, 0.8) and the two-valued status (0.75)."""
    named = {"l_quantity": (0.9, "Volume Metric"), "l_extendedprice": (1.0, "Financial KPI"), "l_discount": (0.9, "Volume Metric"),
             "l_tax": (1.0, "Numeric Measure"), "total_revenue": (1.0, "Financial KPI"), "l_returnflag": (0.8, "Status / Segment Flag"),
             "l_linestatus": (0.75, "Status / Segment Flag")}
    cols = [*FS_NUM, "l_returnflag", "l_linestatus"]
    w_var = K.FUSE_WEIGHTS["variance"] + K.FUSE_WEIGHTS["forest"] * 0.4
    w_uni = K.FUSE_WEIGHTS["univariate"] + K.FUSE_WEIGHTS["forest"] * 0.6
    facts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {named[c][0]} AS dom, '{named[c][1]}' AS label, '{'categorical' if c.endswith(('flag', 'status')) else ''}' AS kind, "
        f"count(DISTINCT {c}) AS u, round(count_if({c} IS NULL) * 100.0 / count(*), 2) AS null_pct, "
        + ("bool_and(" + f"{c} = floor({c}))" if c in FS_NUM else "NULL::BOOLEAN") + " AS whole, "
        + (f"abs(corr({c}, total_revenue))" if c in FS_NUM[:-1] else "0.0") + " AS pr FROM ft" for c in cols)
    return (FS_SQL + f""", fa AS ({facts}), mi AS (SELECT column_name, family, mi FROM ({_fs_mi_raw_sql()})),
        vs AS (SELECT * FROM ({_fs_variance_sql()})), dr AS (SELECT * FROM ({_collinear_sql()})),
        ra AS (SELECT column_name, family, mi + CASE WHEN family = 'numeric' THEN coalesce(pr, 0) ELSE 0 END AS raw FROM mi JOIN fa USING (column_name)),
        un AS (SELECT column_name, round(CASE WHEN max(raw) OVER (PARTITION BY family) > 0 THEN least(1.0, raw / max(raw) OVER (PARTITION BY family)) ELSE 0 END, 3) AS uni
               FROM ra UNION ALL SELECT 'total_revenue', 1.0),
        fu AS (SELECT fa.*, dr.dropped_column IS NOT NULL AS red, dom * {K.FUSE_WEIGHTS['domain']} + coalesce(variance_score, 0.5) * {w_var} + coalesce(uni, 0) * {w_uni} AS f
               FROM fa LEFT JOIN vs USING (column_name) LEFT JOIN un USING (column_name) LEFT JOIN dr ON dr.dropped_column = fa.column_name),
        sc AS (SELECT *, CASE WHEN column_name = 'total_revenue' THEN 1.0 WHEN u = 1 THEN 0.0 WHEN null_pct > 70 THEN 0.05 WHEN red THEN 0.2
                 WHEN dom >= 0.85 THEN greatest(f, 0.5) ELSE f END AS score FROM fu)
        SELECT column_name, CASE WHEN kind <> '' THEN kind WHEN whole THEN 'integer' ELSE 'float' END AS data_type, u AS unique_count, null_pct,
          round(round(score, 9), 2) AS relevance_score, CASE WHEN column_name = 'total_revenue' THEN 'Force-Included' WHEN u = 1 THEN 'Constant'
            WHEN null_pct > 70 THEN 'Mostly Null' WHEN red THEN 'Redundant (Collinear)' ELSE label END AS role, round(score, 9) >= 0.5 AS relevant FROM sc""")


def _fs_mi_raw_sql():
    """fs_mutual_info before rounding."""
    return _fs_mi_sql().replace("round(mi, 6) AS mi", "mi")


def q_fs_select_rules(spark, sf_dir):
    """fs_select with the forest off: every score has SQL."""
    return SEL.select_columns(_fs_table(spark, sf_dir), requirements="revenue, by return flag.", use_forest=False)


def _fs_fuse_sql():
    # expected name scores: quantity/discount read as volume words (0.9), price/tax as money words (1.0)
    dom = {"l_quantity": 0.9, "l_extendedprice": 1.0, "l_discount": 0.9, "l_tax": 1.0}
    w_var = K.FUSE_WEIGHTS["variance"] + K.FUSE_WEIGHTS["forest"] * 0.4
    w_uni = K.FUSE_WEIGHTS["univariate"] + K.FUSE_WEIGHTS["forest"] * 0.6
    var_sql = _fs_variance_sql()[len(FS_SQL):]
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {dom[c]} AS dom, abs(corr({c}, total_revenue)) AS pr "
                               f"FROM ft" for c in FS_NUM[:-1])
    return (FS_SQL + f", vs AS (SELECT * FROM (WITH {var_sql.lstrip(', ')})), p AS ({parts}) "
            f"SELECT p.column_name, round(dom * {K.FUSE_WEIGHTS['domain']} + coalesce(vs.variance_score, 0.5) * {w_var} "
            f"+ coalesce(pr, 0) * {w_uni}, 4) AS fused FROM p LEFT JOIN vs USING (column_name)")


@register("fs_fuse", _fs_fuse_sql())
def q_fs_fuse(spark, sf_dir):
    """Fused score per numeric column from the variance and univariate scores (no forest)."""
    t = _fs_table(spark, sf_dir)
    var = {r[0]: r[1] for r in SEL.variance_scores(t, FS_NUM).collect()}
    pear = {r[0]: r[1] for r in SEL.pearson_scores(t, FS_NUM, "total_revenue").collect()}
    rows = [(c, round(SEL.fuse(SEL.domain_score(c, "float", 100), var.get(c, 0.5), pear.get(c, 0.0), 0.0, False), 4))
            for c in FS_NUM[:-1]]
    return spark.createDataFrame(rows, "column_name string, fused double")


# =========================================================== type probes
def _probe_sql():
    parts = []
    for c in DS:
        s = f"CAST({c} AS VARCHAR)"
        num = Q.num_parse(f"regexp_replace({s}, '[₹$£€,\\s]', '', 'g')")
        dates = " OR ".join(f"count(try_strptime({Q.strip(s)}, '{py}')) / count({c}) > 0.8" for py, _ in P.PROBE_DATE_FORMATS)
        parts.append(f"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'empty' "
                     f"WHEN count({num}) / count({c}) > 0.85 THEN CASE WHEN count_if({num} <> floor({num})) = 0 "
                     f"THEN 'integer' ELSE 'float' END WHEN {dates} THEN 'datetime' "
                     f"WHEN count_if({c} IS NOT NULL AND lower({s}) NOT IN ({', '.join(Q.q(w) for w in K.BOOL_WORDS)})) = 0 "
                     f"THEN 'boolean' ELSE 'categorical' END AS probe_type FROM nl")
    return ST.sql_nulled() + " " + " UNION ALL ".join(parts)


@register("type_probe", _probe_sql())
def q_type_probe(spark, sf_dir):
    return P.type_probe(ST.nulled(spark, sf_dir))


@register("type_convert", ST.sql_raw() + " SELECT "
          f"{Q.num_parse(chr(114) + 'egexp_replace(quantity, ' + chr(39) + '[^0-9.-]' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS quantity, "
          f"{Q.num_parse('regexp_replace(price_per_unit, ' + chr(39) + '[^0-9.-]' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS price_per_unit, "
          f"{Q.num_parse('regexp_replace(total_spent, ' + chr(39) + '[^0-9.-]' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS total_spent, "
          "try_strptime(transaction_date, '%Y-%m-%d') AS transaction_date, "
          + ", ".join(f"CASE WHEN {c} IS NULL OR {c} IN ('None','none','null','NULL','NONE') THEN '' ELSE {c} END AS {c}"
                      for c in ["transaction_id", "customer_id", "item", "category", "discount_applied", "payment_method"])
          + ", customer_rating FROM ds")
def q_type_convert(spark, sf_dir):
    return P.type_convert(ST.raw(spark, sf_dir))


def _light_sql():
    cols = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False),
            ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False), ("o_orderpriority", "string", False)]
    parts = []
    for c, t, num in cols:
        mm = (f"min(CAST({c} AS DOUBLE)), max(CAST({c} AS DOUBLE)), avg(CAST({c} AS DOUBLE))" if num
              else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
        few = _samples_sql(c, "orders") if t == "string" else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(DISTINCT {c}) AS unique, "
                     f"count_if({c} IS NULL) AS missing, {mm}, {few} FROM orders")
    return ("WITH p(column_name, dtype, \"unique\", missing, mn, mx, av, samples) AS (" + " UNION ALL ".join(parts) + ") "
            "SELECT column_name, dtype, \"unique\", missing, round(mn, 4) AS min, round(mx, 4) AS max, "
            "round(av, 4) AS mean, samples FROM p")


@register("prof_light", _light_sql())
def q_prof_light(spark, sf_dir):
    out = P.light_profile(table(spark, sf_dir, "orders"))
    return out.select("column_name", "dtype", "unique", "missing", F.round("min", 4).alias("min"),
                      F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"), "samples")


_DASH_LABEL = ("CASE WHEN (lower(column_name) LIKE '%date%' OR lower(column_name) LIKE '%time%' OR lower(column_name) LIKE '%day%' "
               "OR lower(column_name) LIKE '%month%' OR lower(column_name) LIKE '%year%' OR lower(column_name) LIKE '%period%' "
               "OR lower(column_name) LIKE '%created%' OR lower(column_name) LIKE '%updated%') "
               "AND date_count / (n_rows - null_count) > 0.8 THEN 'datetime' WHEN dtype <> 'string' THEN dtype "
               "WHEN num_count / (n_rows - null_count) > 0.8 THEN CASE WHEN whole_count = num_count THEN 'int64' ELSE 'float64' END "
               "ELSE 'string' END")


@register("prof_dashboard", ST.sql_raw() + f", w AS ({_wide_sql('ds', RAW_TYPES)}) SELECT column_name, {_DASH_LABEL} AS label, "
          "distinct_nonnull AS unique, null_count AS missing, CASE WHEN num_count / (n_rows - null_count) > 0.8 "
          "THEN round(num_mean, 4) END AS mean FROM w")
def q_prof_dashboard(spark, sf_dir):
    return P.dashboard_profile(ST.raw(spark, sf_dir))


# =========================================================== repairs (SQL-checked)
def _med(c, src="ty"):
    return f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {src})"


@register("impute_median", ST.sql_typed() + f" SELECT transaction_id, coalesce(quantity, {_med('quantity')}) AS quantity, "
          f"coalesce(price_per_unit, {_med('price_per_unit')}) AS price_per_unit FROM ty")
def q_impute_median(spark, sf_dir):
    df = ST.typed(spark, sf_dir).select("transaction_id", "quantity", "price_per_unit")
    return R.impute_median(df, ["quantity", "price_per_unit"])


def _mode(c, src="nl"):
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("impute_mode", ST.sql_nulled() + f" SELECT transaction_id, coalesce(item, {_mode('item')}) AS item, "
          f"coalesce(category, {_mode('category')}) AS category FROM nl")
def q_impute_mode(spark, sf_dir):
    return R.impute_mode(ST.nulled(spark, sf_dir).select("transaction_id", "item", "category"), ["item", "category"])


@register("impute_business", ST.sql_typed() + " SELECT transaction_id, coalesce(discount_applied, false) AS discount_applied FROM ty")
def q_impute_business(spark, sf_dir):
    return R.impute_business(ST.typed(spark, sf_dir).select("transaction_id", "discount_applied"), ["discount_applied"])


@register("impute_identifier", ST.sql_nulled() + " SELECT coalesce(item, 'unknown') AS item, count(*) AS n FROM nl GROUP BY 1")
def q_impute_identifier(spark, sf_dir):
    out = R.impute_identifier(ST.nulled(spark, sf_dir).select("item"), ["item"])
    return out.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


SEM_TYPED = {"transaction_id": "TransactionID", "customer_id": "CustomerID", "item": "ProductName", "category": "Category",
             "quantity": "Quantity", "price_per_unit": "Price", "total_spent": "Unknown", "discount_applied": "Discount",
             "transaction_date": "Unknown", "payment_method": "PaymentMethod", "customer_rating": "CustomerID"}


def _strategy_sql():
    """The ladder over facts measured in SQL: missing share, filled context columns, correlated columns."""
    facts = []
    for c in TYPED_COLS:
        is_num = c in NUMERIC_TYPED
        filled = {x: f"(count({x}) * 1.0 / count(*) > 0.8)::INTEGER" for x in TYPED_COLS}
        context = " + ".join(filled[x] for x in ("category", "price_per_unit")) if SEM_TYPED[c] == "ProductName" else "0"
        near = " + ".join(f"(coalesce(abs(corr({c}, {x})), 0) > 0.7)::INTEGER * {filled[x]}" for x in NUMERIC_TYPED if x != c) if is_num else "0"
        ratio = f"count(DISTINCT {c}) * 1.0 / count(*)" if c in TEXT and c not in ("quantity", "price_per_unit", "total_spent",
                                                                                  "discount_applied", "transaction_date") else "0.0"
        facts.append(f"SELECT '{c}' AS column_name, '{SEM_TYPED[c]}' AS sem, {'true' if is_num else 'false'} AS num, "
                     f"{'true' if CL.is_identity(c, SEM_TYPED[c]) else 'false'} AS ident, count_if({c} IS NULL) * 100.0 / count(*) AS pct, "
                     f"count({c}) AS available, {context} AS context, {near} AS near, {ratio} AS ratio FROM ty")
    return ST.sql_typed() + ", fa AS (" + " UNION ALL ".join(facts) + """)
        SELECT column_name, CASE WHEN pct = 0 THEN 'none' WHEN pct > 80 THEN 'skip' WHEN ident THEN 'skip_identity'
          WHEN column_name = 'total_spent' OR sem = 'TotalAmount' THEN 'calculate'
          WHEN pct < 5 AND num THEN 'median'
          WHEN pct >= 5 AND sem IN ('ProductID', 'ProductName', 'CustomerID') AND context >= 2 AND available >= 50 AND pct <= 40 THEN 'random_forest'
          WHEN pct >= 5 AND num AND near >= 2 AND available >= 50 AND pct <= 40 THEN 'knn'
          WHEN num THEN 'median_fallback' WHEN sem = 'Discount' THEN 'business_false' WHEN ratio > 0.5 THEN 'identifier_unknown'
          WHEN pct < 5 THEN 'mode' ELSE 'mode_fallback' END AS strategy FROM fa"""


@register("impute_select", _strategy_sql())
def q_impute_select(spark, sf_dir):
    ty = ST.typed(spark, sf_dir)
    smap = SEM.semantic_map(ST.raw(spark, sf_dir))
    rel = SEM.multiplication_columns(ty, smap)
    facts = CL.column_facts(ty, smap, rel[2] if rel else None)
    return spark.createDataFrame([(c, CL.select_strategy(f).name) for c, f in facts.items()], "column_name string, strategy string")


@register("fix_negative", ST.sql_typed() + " SELECT transaction_id, abs(quantity) AS quantity, "
          "CASE WHEN price_per_unit < 0 THEN (SELECT quantile_cont(price_per_unit, 0.5) FROM ty WHERE price_per_unit >= 0) "
          "ELSE price_per_unit END AS price_per_unit, CASE WHEN total_spent < 0 THEN (SELECT quantile_cont(total_spent, 0.5) "
          "FROM ty WHERE total_spent >= 0) ELSE total_spent END AS total_spent FROM ty")
def q_fix_negative(spark, sf_dir):
    df = ST.typed(spark, sf_dir).select("transaction_id", "quantity", "price_per_unit", "total_spent")
    return R.fix_negative(df, ["quantity"], ["price_per_unit", "total_spent"])


@register("fix_zero_qty", ST.sql_typed() + " SELECT transaction_id, CASE WHEN quantity = 0 THEN 1.0 ELSE quantity END AS quantity FROM ty")
def q_fix_zero_qty(spark, sf_dir):
    return R.fix_zero_qty(ST.typed(spark, sf_dir).select("transaction_id", "quantity"), ["quantity"])


@register("clip_nonneg", ST.sql_typed() + " SELECT transaction_id, " + ", ".join(
    f"CASE WHEN {c} < 0 THEN 0.0 ELSE {c} END AS {c}" for c in NEG_COLS) + " FROM ty")
def q_clip_nonneg(spark, sf_dir):
    return R.clip_nonneg(ST.typed(spark, sf_dir).select("transaction_id", *NEG_COLS), NEG_COLS)


@register("clamp_rating", ST.sql_raw() + " SELECT transaction_id, CASE WHEN customer_rating > 5 THEN "
          "(SELECT quantile_cont(CAST(customer_rating AS DOUBLE), 0.5) FROM ds WHERE customer_rating <= 5) "
          "ELSE CAST(customer_rating AS DOUBLE) END AS customer_rating FROM ds")
def q_clamp_rating(spark, sf_dir):
    return R.clamp_rating(ST.raw(spark, sf_dir).select("transaction_id", "customer_rating"))


def _cap_sql():
    c = "price_per_unit"
    q = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ty)"
    lo = "greatest(q1 - 1.5 * (q3 - q1), 0.0)"
    hi = "q3 + 1.5 * (q3 - q1)"
    return (ST.sql_typed() + f" SELECT transaction_id, CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} "
            f"ELSE {c} END AS {c} FROM ty, {q} b")


@register("cap_outliers", _cap_sql())
def q_cap_outliers(spark, sf_dir):
    df = ST.typed(spark, sf_dir).select("transaction_id", "price_per_unit")
    return R.cap_outliers(df, R.iqr_bounds(df, ["price_per_unit"]))


@register("recalc_profit", LI_FIN_SQL + " SELECT l_orderkey, l_partkey, round(coalesce(total_revenue, 0) - "
          "coalesce(l_quantity, 1) * coalesce(cost, 0), 2) AS profit FROM lf")
def q_recalc_profit(spark, sf_dir):
    df = _li_fin(spark, sf_dir).select("l_orderkey", "l_partkey", "total_revenue", "cost", "l_quantity", "profit")
    out = R.recalc_profit(df, "total_revenue", "cost", "l_quantity", "profit")
    return out.select("l_orderkey", "l_partkey", "profit")


@register("dedup_rows", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def q_dedup_rows(spark, sf_dir):
    return R.dedup_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@register("canon_case", ST.sql_nulled() + """, c AS (SELECT category, count(*) AS n FROM nl WHERE category IS NOT NULL GROUP BY category),
k AS (SELECT category, n, lower(""" + Q.strip("category") + """) AS key FROM c),
b AS (SELECT key, arg_min(category, (-n, category)) AS best FROM k GROUP BY key),
m AS (SELECT k.category AS from_value, b.best AS to_value FROM k JOIN b USING (key))
SELECT coalesce(m.to_value, nl.category) AS category, count(*) AS n FROM nl LEFT JOIN m ON nl.category = m.from_value GROUP BY 1""")
def q_canon_case(spark, sf_dir):
    out = R.canon_case(ST.nulled(spark, sf_dir).select("category"), ["category"])
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("trim_text", ST.sql_nulled() + f" SELECT {Q.strip('category')} AS category, count(*) AS n FROM nl GROUP BY 1")
def q_trim_text(spark, sf_dir):
    out = R.trim_text(ST.nulled(spark, sf_dir).select("category"), ["category"])
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _det_view(name: str, issue_filter: str):
    base_q, base_sql = QUERIES[name], ORACLE[name]

    def run(spark, sf_dir):
        return base_q(spark, sf_dir).where(F.col("issue").isin(*issue_filter.split(",")))
    cond = " OR ".join(f"issue = '{i}'" for i in issue_filter.split(","))
    return run, f"SELECT * FROM ({base_sql}) WHERE {cond}"


for _new, (_base, _issues) in {"det_negative": ("det_invalid", "negative_values"),
                               "det_zero_qty": ("det_invalid", "zero_quantity"),
                               "det_future": ("det_invalid", "future_dates"),
                               "det_case_variants": ("det_inconsistent", "case_inconsistency"),
                               "det_whitespace": ("det_inconsistent", "whitespace")}.items():
    _fn, _sql = _det_view(_base, _issues)
    register(_new, _sql)(_fn)


@register("det_outlier_z", "SELECT column_name, z_count FROM (" + ORACLE["det_outlier_iqr"] + ")")
def q_det_outlier_z(spark, sf_dir):
    return D.outlier_counts(ST.typed(spark, sf_dir), NUMERIC_TYPED).select("column_name", "z_count")


# =========================================================== validation (SQL-checked, on the typed stage)
from kpiforge.operators import validate as V  # noqa: E402

SCHEMA_RULES_SQL = [("transaction_id", "not_null"), ("customer_id", "not_null"), ("item", "not_null"),
                    ("category", "not_null"), ("quantity", "not_null"), ("quantity", "gt0"),
                    ("price_per_unit", "not_null"), ("price_per_unit", "gt0"), ("total_spent", "not_null"),
                    ("transaction_date", "not_null"), ("payment_method", "not_null"),
                    ("customer_rating", "not_null"), ("customer_rating", "range_0_5")]


def _rule_sql(c, check):
    x = f"CAST({c} AS DOUBLE)"
    return {"not_null": f"{c} IS NULL", "gt0": f"{x} <= 0", "ge0": f"{x} < 0",
            "range_0_5": f"NOT ({x} BETWEEN 0 AND 5)"}[check]


def _schema_sql(only_failing=False):
    parts = [f"SELECT '{c}' AS column_name, '{k}' AS check, CAST(count_if({_rule_sql(c, k)}) AS BIGINT) AS failures FROM ty"
             for c, k in SCHEMA_RULES_SQL]
    return ST.sql_typed() + " SELECT * FROM (" + " UNION ALL ".join(parts) + ")"


def _typed_rules(spark, sf_dir):
    ty = ST.typed(spark, sf_dir)
    smap = SEM.semantic_map(ST.raw(spark, sf_dir))
    return ty, smap, V.schema_rules(ty, smap)


@register("val_schema", _schema_sql())
def q_val_schema(spark, sf_dir):
    ty, _, rules = _typed_rules(spark, sf_dir)
    return V.val_schema(ty, rules)


@register("val_schema_values", ST.sql_typed() + " SELECT column_name, \"check\", value, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS \"check\", CAST({c} AS VARCHAR) AS value FROM ty WHERE {_rule_sql(c, k)}" for c, k in SCHEMA_RULES_SQL)
    + ") GROUP BY ALL")
def q_val_schema_values(spark, sf_dir):
    """Every distinct failing value of every rule."""
    ty, _, rules = _typed_rules(spark, sf_dir)
    return V.all_failing_values(ty, rules)


@register("val_basic", ST.sql_typed() + " SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, 'nulls_remain' AS check, CAST(count_if({c} IS NULL) AS BIGINT) AS failures FROM ty"
     for c in TYPED_COLS if c != "discount_applied"] +
    [f"SELECT '{c}' AS column_name, 'negative_values' AS check, CAST(count_if({c} < 0) AS BIGINT) AS failures FROM ty"
     for c in ("quantity", "price_per_unit")]) + ") WHERE failures > 0")
def q_val_basic(spark, sf_dir):
    ty, smap, _ = _typed_rules(spark, sf_dir)
    return V.val_basic(ty, smap)


_VF = ("abs(coalesce(total_spent, 0) - round(coalesce(quantity, 0) * coalesce(price_per_unit, 0), 2)) > "
       "0.02 + 1e-5 * abs(round(coalesce(quantity, 0) * coalesce(price_per_unit, 0), 2))")


@register("val_formula", ST.sql_typed() + f" SELECT CAST(count_if({_VF}) AS BIGINT) AS mismatches, "
          f"CASE WHEN count_if({_VF}) > 0 THEN 'VIOLATIONS_FOUND' ELSE 'PASS' END AS status FROM ty")
def q_val_formula(spark, sf_dir):
    return V.val_formula(ST.typed(spark, sf_dir), ["quantity", "price_per_unit", "total_spent"])


@register("val_accuracy", ST.sql_typed() + " SELECT round(avg(CASE WHEN abs(total_spent - quantity * price_per_unit) <= "
          "0.01 + 1e-5 * abs(quantity * price_per_unit) THEN 1.0 ELSE 0.0 END), 3) AS accuracy FROM ty")
def q_val_accuracy(spark, sf_dir):
    return V.val_accuracy(ST.typed(spark, sf_dir), "quantity", "price_per_unit", "total_spent")


def _compl_sql(src):
    return f"(1 - (" + " + ".join(f"count_if({c} IS NULL)" for c in DS) + f") / (count(*) * {len(DS)})) * 100"


@register("val_completeness", ST.sql_nulled() + ", fl AS (SELECT " + ", ".join(
    [f"coalesce({c}, 'Unknown') AS {c}" for c in TEXT] + ["customer_rating"]) + " FROM nl), "
    f"a AS (SELECT {_compl_sql('nl')} AS o FROM nl), b AS (SELECT {_compl_sql('fl')} AS c FROM fl) "
    "SELECT round(o, 2) AS original, round(c, 2) AS cleaned, round(c - o, 2) AS improvement, "
    "CASE WHEN c > o THEN 'IMPROVED' ELSE 'UNCHANGED' END AS status FROM a, b")
def q_val_completeness(spark, sf_dir):
    nl = ST.nulled(spark, sf_dir)
    return V.val_completeness(nl, R.fill_constant(nl, "Unknown"))


def _score_sql():
    schema_fail = "(SELECT sum(failures) FROM (" + " UNION ALL ".join(
        f"SELECT count_if({_rule_sql(c, k)}) AS failures FROM ty" for c, k in SCHEMA_RULES_SQL) + "))"
    comp = "(1 - (" + " + ".join(f"count_if({c} IS NULL)" for c in TYPED_COLS) + f") / (count(*) * {len(TYPED_COLS)})) * 100"
    score = (f"round(({comp}) / 100 * 0.4 + CASE WHEN {schema_fail} = 0 THEN 1.0 ELSE 0.7 END * 0.3 + "
             f"CASE WHEN count_if({_VF}) = 0 THEN 1.0 ELSE 0.6 END * 0.3, 3)")
    return (ST.sql_typed() + f", s AS (SELECT {score} AS quality_score FROM ty) SELECT quality_score, CASE WHEN quality_score >= 0.9 "
            "THEN 'EXCELLENT' WHEN quality_score >= 0.8 THEN 'GOOD' WHEN quality_score >= 0.7 THEN 'ACCEPTABLE' "
            "ELSE 'NEEDS REVIEW' END AS assessment FROM s")


@register("val_score", _score_sql())
def q_val_score(spark, sf_dir):
    ty, smap, rules = _typed_rules(spark, sf_dir)
    integrity = V.val_schema(ty, rules).agg(F.sum("failures").alias("f")).first()["f"] == 0
    formula_ok = V.val_formula(ty, ["quantity", "price_per_unit", "total_spent"]).first()["status"] == "PASS"
    comp = V.completeness_pct(ty)
    s = V.quality_score(F.col("completeness"), F.lit(integrity), F.lit(formula_ok))
    return comp.select(s.alias("quality_score")).select("quality_score",
                                                         V.score_label(F.col("quality_score")).alias("assessment"))


# =========================================================== end-to-end cleaning (rows-only checks)
@register("clean_table")
def q_clean_table(spark, sf_dir):
    out, _ = CL.fit_and_clean(ST.raw(spark, sf_dir), ST.AS_OF)
    return out


def _clean_rules_sql():
    """The whole order without models and fuzzy groups, step by step."""
    spelled = ["customer_id", "item", "category", "payment_method"]
    med = lambda c, src, cond="true": f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {src} WHERE {cond})"
    mode = lambda c: f"(SELECT {c} FROM ty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    as_of = f"DATE '{ST.AS_OF.isoformat()}'"
    base = "trim(regexp_replace(regexp_replace(lower(trim(orig)), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"
    values = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS orig, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY {c}" for c in spelled)
    spell = lambda c: f"coalesce((SELECT to_value FROM sp WHERE sp.column_name = '{c}' AND sp.from_value = tr.{c}), tr.{c}) AS {c}"
    cap = lambda c, lo: f"""CASE WHEN {c} < b_{c}.lo THEN b_{c}.lo WHEN {c} > b_{c}.hi THEN b_{c}.hi ELSE CAST({c} AS DOUBLE) END AS {c}"""
    bound = lambda c, lo: (f"b_{c} AS (SELECT {lo.format(x='q1 - 1.5 * (q3 - q1)')} AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT "  # noqa: E731
                           f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM rt))")
    others = [c for c in TYPED_COLS if c != "transaction_id"]
    return ST.sql_typed() + f""",
    im AS (SELECT transaction_id, customer_id, coalesce(item, {mode('item')}) AS item, coalesce(category, {mode('category')}) AS category,
             coalesce(quantity, {med('quantity', 'ty')}) AS quantity, coalesce(price_per_unit, {med('price_per_unit', 'ty')}) AS price_per_unit,
             total_spent, coalesce(discount_applied, false) AS discount_applied, coalesce(transaction_date, {mode('transaction_date')}) AS transaction_date,
             payment_method, customer_rating FROM ty),
    iv AS (SELECT * REPLACE (CASE WHEN quantity = 0 THEN 1.0 ELSE abs(quantity) END AS quantity,
             CASE WHEN price_per_unit < 0 THEN {med('price_per_unit', 'im', 'price_per_unit >= 0')} ELSE price_per_unit END AS price_per_unit,
             CASE WHEN total_spent < 0 THEN {med('total_spent', 'im', 'total_spent >= 0')} ELSE total_spent END AS total_spent,
             CASE WHEN transaction_date > {as_of} THEN {as_of} ELSE transaction_date END AS transaction_date) FROM im),
    dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {_typed_order_sql(others)}) AS rn FROM iv) WHERE rn = 1),
    tr AS (SELECT * REPLACE ({', '.join(f"{Q.strip(c)} AS {c}" for c in spelled)}) FROM dd),
    v0 AS ({values}),
    ca AS (SELECT column_name, orig, n, first_value(orig) OVER (PARTITION BY column_name, lower({Q.strip('orig')}) ORDER BY n DESC, orig) AS cased FROM v0),
    v1 AS (SELECT column_name, cased AS orig, sum(n) AS n, any_value({base.replace('orig', 'cased')}) AS base FROM ca GROUP BY column_name, cased),
    ba AS (SELECT column_name, base, sum(n) AS bn, first(orig ORDER BY n DESC, orig) AS canon,
             array_to_string(list_transform(string_split(base, ' '), lambda w: w[1]), '') AS initials FROM v1 GROUP BY column_name, base),
    ab AS (SELECT s.column_name, s.base, d.canon, row_number() OVER (PARTITION BY s.column_name, s.base ORDER BY d.bn DESC, d.base) AS r
           FROM ba s JOIN ba d ON s.column_name = d.column_name AND s.base <> d.base
            AND ((length(s.base) <= 4 AND s.base = d.initials) OR starts_with(d.base, s.base || ' '))),
    sp AS (SELECT ca.column_name, ca.orig AS from_value, coalesce(ab.canon, ca.cased) AS to_value FROM ca
           JOIN v1 ON ca.column_name = v1.column_name AND ca.cased = v1.orig LEFT JOIN ab ON v1.column_name = ab.column_name AND v1.base = ab.base AND ab.r = 1),
    sd AS (SELECT * REPLACE ({', '.join(spell(c) for c in spelled)}) FROM tr),
    rt AS (SELECT * REPLACE (CASE WHEN customer_rating > 5 THEN {med('customer_rating', 'sd', 'customer_rating <= 5')}
             ELSE CAST(customer_rating AS DOUBLE) END AS customer_rating) FROM sd),
    {bound('quantity', 'greatest({x}, 0.0)')}, {bound('price_per_unit', 'greatest({x}, 0.0)')}, {bound('customer_rating', '{x}')},
    cp AS (SELECT rt.* REPLACE ({cap('quantity', 0)}, {cap('price_per_unit', 0)}, {cap('customer_rating', None)})
           FROM rt, b_quantity, b_price_per_unit, b_customer_rating)
    SELECT transaction_id, customer_id, item, category, CAST(trunc(quantity) AS BIGINT) AS quantity, round(price_per_unit, 2) AS price_per_unit,
      round(greatest(round(coalesce(quantity, 0) * coalesce(price_per_unit, 0), 2), 0.0), 2) AS total_spent, discount_applied,
      CASE WHEN year(transaction_date) BETWEEN 1990 AND {ST.AS_OF.year + 1} THEN transaction_date END AS transaction_date, payment_method, customer_rating
    FROM cp"""


@register("clean_table_rules", _clean_rules_sql())
def q_clean_table_rules(spark, sf_dir):
    """clean_table without models and fuzzy groups: every step has SQL."""
    out, _ = CL.fit_and_clean(ST.raw(spark, sf_dir), ST.AS_OF, use_fuzzy=False, models=False)
    return out


_FITTED: dict = {}


def _fitted(spark, sf_dir, **how):
    """(cleaned table, plan), fitted and stored once per session, folder and way."""
    import os
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), tuple(sorted(how.items())))
    if key not in _FITTED:
        out, plan = CL.fit_and_clean(ST.raw(spark, sf_dir), ST.AS_OF, **how)
        path = scratch_path(spark, "cleaned")
        write_table(out, path)
        _FITTED[key] = (path, out.schema, plan)
    path, schema, plan = _FITTED[key]
    return spark.read.schema(schema).parquet(path), plan


_REPORT_SQL = ST.sql_typed() + """, m AS (SELECT count(*) AS n, count(DISTINCT transaction_id) AS ids, """ + " + ".join(
    f"count_if({c} IS NULL)" for c in ("item", "category", "quantity", "price_per_unit", "discount_applied", "transaction_date")) + """ AS filled FROM ty),
    d AS (SELECT count(*) AS n FROM (""" + " UNION ALL ".join(
    f"SELECT 1 FROM ds HAVING count_if({c} IS NULL OR {Q.is_null_word(c)}) > 0" if c in TEXT else f"SELECT 1 FROM ds HAVING count_if({c} IS NULL) > 0" for c in DS) + """)),
    i AS (SELECT (count(*) > count(DISTINCT transaction_id))::INTEGER AS dup FROM ds)
    SELECT 'rows_before' AS metric, n::DOUBLE AS value FROM m UNION ALL SELECT 'rows_after', ids FROM m UNION ALL SELECT 'rows_removed', n - ids FROM m
    UNION ALL SELECT 'problems', d.n + i.dup FROM d, i UNION ALL SELECT 'cells_filled', filled FROM m"""


@register("report_summary", _REPORT_SQL)
def q_report_summary(spark, sf_dir):
    """Rows before and after, columns with missing or duplicate values, cells filled; from the fitted plan and one count."""
    raw_df = ST.raw(spark, sf_dir)
    out, plan = _fitted(spark, sf_dir, use_fuzzy=False, models=False)
    problems = D.det_missing(raw_df, plan.semantics).unionByName(D.det_dup_ids(raw_df, [plan.key_col]))
    n_after = out.count()
    rows = [("rows_before", float(plan.rows_in)), ("rows_after", float(n_after)), ("rows_removed", float(plan.rows_in - n_after)),
            ("problems", float(problems.count())), ("cells_filled", float(sum(plan.nulls[c] for c in plan.fills)))]
    return spark.createDataFrame(rows, "metric string, value double")


@register("run_log")
def q_run_log(spark, sf_dir):
    """Every step of the plan with status and confidence, and row counts gathered by ``observe`` while
    the cleaned table is written once more."""
    from pyspark.sql import Observation
    out, plan = _fitted(spark, sf_dir)
    obs = Observation("clean_run")
    observed = out.observe(obs, F.count(F.lit(1)).alias("rows_written"),
                           F.count_if(F.col("total_spent") == 0).alias("zero_totals"))
    observed.write.mode("overwrite").parquet(scratch_path(spark, "clean_run"))
    extra = spark.createDataFrame([("run", k, "observed", str(v), "done", 1.0) for k, v in sorted(obs.get.items())],
                                  "step string, column_name string, method string, value string, status string, confidence double")
    return CL.plan_table(spark, plan).unionByName(extra)


# =========================================================== model-backed operators (rows-only checks)
from kpiforge.operators import canon as CN  # noqa: E402
from kpiforge.operators import ml as ML  # noqa: E402


@register("det_outlier_iforest")
def q_det_outlier_iforest(spark, sf_dir):
    return ML.iforest_outliers(ST.typed(spark, sf_dir), NUMERIC_TYPED)


@register("det_outlier_consensus")
def q_det_outlier_consensus(spark, sf_dir):
    ty = ST.typed(spark, sf_dir)
    return ML.outlier_consensus(D.outlier_counts(ty, NUMERIC_TYPED), ML.iforest_outliers(ty, NUMERIC_TYPED))


@register("impute_forest")
def q_impute_forest(spark, sf_dir):
    """Context columns are chosen by the target's type."""
    smap = SEM.semantic_map(ST.raw(spark, sf_dir))
    return ML.impute_forest(ST.typed(spark, sf_dir), "item", semantic_type=smap["item"]["semantic_type"])


@register("impute_knn")
def q_impute_knn(spark, sf_dir):
    """Neighbours by all other numeric columns, which may be missing as well."""
    ty = ST.typed(spark, sf_dir)
    return ML.impute_knn(ty, "quantity", [c for c in NUMERIC_TYPED if c != "quantity"], k=5)


def _pick_sql():
    """Categorical by type (names and values of the two columns), or under 20 % distinct values."""
    rates = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS d, count(*) AS n FROM nl" for c in TEXT)
    return ST.sql_nulled() + (f" SELECT column_name FROM ({rates}) WHERE column_name IN ('category', 'payment_method') "
                              f"OR d < {K.AUTO_CATEGORICAL_RATIO} * n")


@register("canon_pick", _pick_sql())
def q_canon_pick(spark, sf_dir):
    nl = ST.nulled(spark, sf_dir)
    cols = CN.canon_pick(nl, SEM.semantic_map(ST.raw(spark, sf_dir)))
    return spark.createDataFrame([(c,) for c in cols], "column_name string")


SPELLED = ["category", "item", "payment_method"]


def _abbreviation_ctes():
    """(column_name, from_value, to_value): short initials or leading words -> commonest longer spelling."""
    base = "trim(regexp_replace(regexp_replace(lower(trim(orig)), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"
    values = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS orig, count(*) AS n FROM nl WHERE {c} IS NOT NULL GROUP BY {c}" for c in SPELLED)
    return ST.sql_nulled() + f""", v AS (SELECT column_name, orig, n, {base} AS base FROM ({values})),
        b AS (SELECT column_name, base, sum(n) AS bn, first(orig ORDER BY n DESC, orig) AS canon,
                     array_to_string(list_transform(string_split(base, ' '), lambda w: w[1]), '') AS initials FROM v GROUP BY column_name, base),
        j AS (SELECT s.column_name, s.base AS short, d.canon, row_number() OVER (PARTITION BY s.column_name, s.base ORDER BY d.bn DESC, d.base) AS r
              FROM b s JOIN b d ON s.column_name = d.column_name AND s.base <> d.base
               AND ((length(s.base) <= 4 AND s.base = d.initials) OR starts_with(d.base, s.base || ' '))),
        am AS (SELECT v.column_name, v.orig AS from_value, j.canon AS to_value FROM v JOIN j ON v.column_name = j.column_name
               AND v.base = j.short AND j.r = 1 WHERE v.orig <> j.canon)"""


@register("canon_initials", _abbreviation_ctes() + " SELECT * FROM am")
def q_canon_initials(spark, sf_dir):
    return CN.abbreviation_mappings(CN.value_tables(ST.nulled(spark, sf_dir), SPELLED))


@register("canon_prefix", _abbreviation_ctes() + """ SELECT v.column_name, coalesce(am.to_value, v.orig) AS spelling, sum(v.n)::BIGINT AS n
    FROM v LEFT JOIN am ON v.column_name = am.column_name AND v.orig = am.from_value GROUP BY ALL""")
def q_canon_prefix(spark, sf_dir):
    """The mapping applied to the rows of every column."""
    out = CN.canon_abbreviations(ST.nulled(spark, sf_dir).select(*SPELLED), SPELLED)
    long = out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("spelling")) for c in SPELLED])))
    return long.where("spelling is not null").groupBy("column_name", "spelling").agg(F.count(F.lit(1)).alias("n"))


@register("fuzzy_pairs")
def q_fuzzy_pairs(spark, sf_dir):
    nl = R.trim_text(ST.nulled(spark, sf_dir), SPELLED)
    return CN.fuzzy_pairs(nl, SPELLED).select("column_name", "a", "b", "overlap", F.round("similarity", 4).alias("similarity"))


@register("canon_fuzzy")
def q_canon_fuzzy(spark, sf_dir):
    nl = R.trim_text(ST.nulled(spark, sf_dir), SPELLED)
    return CN.fuzzy_mapping(nl, SPELLED)


# =========================================================== streaming by-product (rows-only)
@register("stream_clean")
def q_stream_clean(spark, sf_dir):
    """Fit the whole plan on the table, then clean the same rows arriving as a parquet stream."""
    from kpiforge.streaming.apply import clean_stream, parquet_stream
    raw_df = ST.raw(spark, sf_dir)
    _, plan = _fitted(spark, sf_dir)
    src, out_path, ckpt = (scratch_path(spark, f"stream_{x}") for x in ("src", "out", "ckpt"))
    raw_df.write.mode("overwrite").parquet(src)
    clean_stream(parquet_stream(spark, raw_df.schema, src), plan, out_path, ckpt).awaitTermination()
    return spark.read.parquet(out_path).drop("batch")


# =========================================================== late additions with oracle SQL
@register("date_sanity", ST.sql_typed() + f" SELECT transaction_id, CASE WHEN year(transaction_date) BETWEEN 1990 AND "
          f"{ST.AS_OF.year + 1} THEN transaction_date END AS transaction_date FROM ty")
def q_date_sanity(spark, sf_dir):
    ty = ST.typed(spark, sf_dir).select("transaction_id", "transaction_date")
    return ty.select("transaction_id", S.date_in_range(F.col("transaction_date"), ST.AS_OF.year).alias("transaction_date"))


def _collinear_sql():
    pairs = [(a, b) for i, a in enumerate(FS_NUM) for b in FS_NUM[i + 1:]]
    body = " UNION ALL ".join(f"SELECT '{b}' AS dropped_column, abs(corr({a}, {b})) AS r FROM ft" for a, b in pairs)
    # a later column is dropped when any earlier column is collinear with it
    return FS_SQL + f" SELECT DISTINCT dropped_column FROM ({body}) WHERE r >= {K.SELECT_COLLINEAR}"


ORACLE["fs_collinear"] = _collinear_sql()

ORACLE["cat_describe"] = (
    "SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
    "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
    "ELSE lower(data_type) END AS data_type FROM information_schema.columns "
    "WHERE table_name IN ('orders', 'lineitem', 'customer')")

register("fs_select_rules", _fs_select_sql())(q_fs_select_rules)


_SLUG = "regexp_replace(lower({c}), '\\s+', '_', 'g') AS {c}_key"


@register("derive_features", ST.sql_typed() + " SELECT transaction_id, item, category, transaction_date, year(transaction_date) AS transaction_date_Year, "
          "month(transaction_date) AS transaction_date_Month, quarter(transaction_date) AS transaction_date_Quarter, "
          + _SLUG.format(c="item") + ", " + _SLUG.format(c="category") + " FROM ty")
def q_derive_features(spark, sf_dir):
    """What a requirement asks for: date parts and category keys, no place keys."""
    ty = ST.typed(spark, sf_dir).select("transaction_id", "item", "category", "transaction_date")
    return M.derive_features(ty, "monthly revenue by product")


@register("impute_identifiers", ST.sql_nulled() + ", w AS (SELECT " + ", ".join(
    f"CASE WHEN customer_rating > 1 THEN {c} END AS {c}" for c in TEXT) + " FROM nl) SELECT " + ", ".join(
    f"coalesce({c}, 'unknown') AS {c}" if c in ("transaction_id", "customer_id") else
    f"coalesce({c}, CASE WHEN (SELECT count(DISTINCT {c}) > 0.5 * count(*) FROM w) THEN 'unknown' END) AS {c}" for c in TEXT) + " FROM w")
def q_impute_identifiers(spark, sf_dir):
    """Columns chosen by rule: identifier types, contact names, mostly distinct; others keep their gaps."""
    gaps = ST.nulled(spark, sf_dir).select(*[F.when(F.col("customer_rating") > 1, F.col(c)).alias(c) for c in TEXT])
    return R.impute_identifier(gaps, None, SEM.semantic_map(ST.raw(spark, sf_dir)))
