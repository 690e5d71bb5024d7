"""Repairs: no-data words, casts, invalid values, duplicates, case, formulas, caps.

All repairs are ``DataFrame -> DataFrame`` column rewrites that fold into one
projection. Where a repair needs a fitted value (a median, a mode, a mapping)
the value is computed by a distributed aggregate first and then applied as a
literal or a broadcast join of a size-checked mapping.
"""

from __future__ import annotations

import datetime as _dt
from typing import Dict, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions import scalars as S
from kpiforge.functions.stats import exact_quantiles, medians, modes



def string_columns(df: DataFrame) -> list:
    return [c for c, t in df.dtypes if t == "string"]


def replace_columns(df: DataFrame, new: Dict[str, Column]) -> DataFrame:
    """Single projection that rewrites some columns in place (keeps order)."""
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- no-data words
def null_sentinels(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    cols = list(cols or string_columns(df))
    return replace_columns(df, {c: S.null_sentinel(c) for c in cols})


def count_sentinels(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    cols = list(cols or string_columns(df))
    return df.agg(sum(F.count_if(S.is_null_word(c)) for c in cols).cast("bigint").alias("cells_converted"))


def fill_constant(df: DataFrame, value: str = "Unknown", cols: Optional[Sequence[str]] = None) -> DataFrame:
    cols = list(cols or string_columns(df))
    return df.fillna(value, subset=cols)


# ---------------------------------------------------------------- casts
def cast_string(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim text; NULL stays NULL (no 'nan' text)."""
    return replace_columns(df, {c: S.strip_ws(S.as_text(c)) for c in cols})


def cast_float(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: F.round(S.num_locale(c), 2) for c in cols})


def cast_integer(df: DataFrame, cols: Sequence[str], fills: Optional[Dict[str, float]] = None) -> DataFrame:
    """Locale-clean numbers; NULL -> median (1 when no value); truncate to integer."""
    parsed = replace_columns(df, {c: S.num_locale(c) for c in cols})
    if fills is None:
        med = medians(parsed, cols)
        fills = {c: (1.0 if med[c] != med[c] else med[c]) for c in cols}
    return replace_columns(parsed, {c: F.coalesce(F.col(c), F.lit(float(fills[c]))).cast("long") for c in cols})


def is_identity_name(name: str) -> bool:
    n = name.lower().replace(" ", "_")
    return any(w in n for w in K.NEVER_COERCE_KEYWORDS)


# ---------------------------------------------------------------- dates
def date_format_vote(df: DataFrame, c: str) -> DataFrame:
    """Parse count per candidate format; the best (first on ties) has rank 1. Every distinct text is tried once."""
    texts = df.groupBy(S.strip_ws(S.as_text(c)).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    row = texts.agg(*[F.coalesce(F.sum(F.when(S.parse_date_formats("t", [sp], stripped=True).isNotNull(), F.col("n"))), F.lit(0)).alias(f"f{i}")
                      for i, (_, sp) in enumerate(K.DATE_FORMATS)])
    long = row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("format_order"), F.lit(py).alias("format"), F.lit(sp).alias("spark_format"),
                 F.col(f"f{i}").alias("parsed")) for i, (py, sp) in enumerate(K.DATE_FORMATS)])))
    return long


def best_date_format(df: DataFrame, c: str) -> Optional[str]:
    rows = date_format_vote(df, c).collect()
    best = None
    for r in sorted(rows, key=lambda r: r["format_order"]):
        if r["parsed"] > 0 and (best is None or r["parsed"] > best["parsed"]):
            best = r
    return best["spark_format"] if best else None


def date_parse(df: DataFrame, c: str, as_of: _dt.date, best: Optional[str] = None) -> DataFrame:
    """Winner format first, then the others per row; years outside 1990..as_of+1 -> NULL."""
    best = best if best is not None else best_date_format(df, c)
    d = S.parse_date_formats(c, S.ordered_formats(best))
    return replace_columns(df, {c: S.date_in_range(d, as_of.year)})


def looks_like_epoch(df: DataFrame, c: str) -> bool:
    """>80 % of non-null values numeric and >80 % of those in 1e9..2e10 (s) or 1e12..2e13 (ms)."""
    x = S.num_parse(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
    r = df.agg(F.count(c).alias("nn"), F.count(x).alias("num"),
               F.count_if(x.between(1e9, 2e10) | x.between(1e12, 2e13)).alias("inrange")).first()
    return r["nn"] > 0 and r["num"] / r["nn"] > 0.8 and r["num"] > 0 and r["inrange"] / r["num"] > 0.8


def date_epoch(df: DataFrame, c: str, as_of: _dt.date) -> DataFrame:
    x = S.num_parse(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
    return replace_columns(df, {c: S.epoch_to_date(x, as_of.year)})


def fix_future(df: DataFrame, c: str, as_of: _dt.date) -> DataFrame:
    """Dates after the as-of day become the as-of day (kept as DATE)."""
    d = F.col(c).cast("date")
    return replace_columns(df, {c: F.when(d > F.lit(as_of), F.lit(as_of)).otherwise(d)})


# ---------------------------------------------------------------- booleans
def bool_normalise(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """Boolean-named text columns: if >50 % of rows map to a boolean word, map; else keep."""
    if cols is None:
        cols = [c for c in string_columns(df) if S.name_has_any(c, K.BOOL_NAME_KEYWORDS)]
    cols = list(cols)
    if not cols:
        return df
    r = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(S.bool_word(c)).alias(c) for c in cols]).first()
    chosen = [c for c in cols if r[c] > r["__n"] * 0.5]
    return replace_columns(df, {c: F.coalesce(S.bool_word(c), F.lit(False)) for c in chosen})


# ---------------------------------------------------------------- invalid values
def fix_negative(df: DataFrame, qty_cols: Sequence[str] = (), money_cols: Sequence[str] = ()) -> DataFrame:
    """Quantity -> abs; money -> median of the non-negative values."""
    new = {c: F.abs(F.col(c)) for c in qty_cols}
    if money_cols:
        nonneg = df.select(*[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in money_cols])
        med = medians(nonneg, money_cols)
        for c in money_cols:
            new[c] = F.when(F.col(c) < 0, F.lit(med[c])).otherwise(F.col(c))
    return replace_columns(df, new)


def fix_zero_qty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: F.when(F.col(c) == 0, F.lit(1).cast(dict(df.dtypes)[c])).otherwise(F.col(c))
                                for c in cols})


def clip_nonneg(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: F.when(F.col(c) < 0, F.lit(0).cast(dict(df.dtypes)[c])).otherwise(F.col(c))
                                for c in cols})


def clamp_rating(df: DataFrame, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """Rating-like columns: values above 5 -> median of the values <= 5."""
    if cols is None:
        cols = [c for c in df.columns if S.name_has_any(c, K.RATING_NAME_KEYWORDS)]
    cols = list(cols)
    if not cols:
        return df
    num = {c: (S.num_parse(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")) for c in cols}
    valid = df.select(*[F.when(num[c] <= 5, num[c]).alias(c) for c in cols])
    med = medians(valid, cols)
    return replace_columns(df, {c: F.when(num[c] > 5, F.lit(med[c])).otherwise(num[c]) for c in cols})


# ---------------------------------------------------------------- duplicates
def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_key(df: DataFrame, key: str, order_by: Optional[Sequence[str]] = None, copies: bool = True) -> DataFrame:
    """Keep the first row per non-empty key; rows with an empty key are all kept, or with
    ``copies=False`` once each.

    "First" is the smallest row by ``order_by`` (default: all columns, NULLs
    first). One aggregate over one scan: a row without a key is its own group, counted, and comes
    back as often. ``min(struct)`` combines on the map side, so a key holding a third of all rows
    is reduced before the shuffle instead of landing whole in one task (a ``row_number`` window
    would).
    """
    others = [c for c in df.columns if c != key]
    order = list(order_by or others)
    rest = [c for c in others if c not in order]
    has_key = F.coalesce(F.col(key).isNotNull() & (S.strip_ws(S.as_text(key)) != "") & (F.lower(S.as_text(key)) != "nan"), F.lit(False))
    row = F.struct(*[F.col(c) for c in [*order, *rest, key]])
    own = F.when(~has_key, row)
    firsts = df.groupBy(F.when(has_key, F.col(key)).alias("__key"), own.alias("__own")).agg(
        F.min(F.when(has_key, row)).alias("__first"), F.count(F.lit(1)).alias("__n"))
    firsts = firsts.select(F.coalesce("__first", "__own").alias("__r"), F.col("__own").isNotNull().alias("__single"), "__n")
    if copies:
        times = F.when(F.col("__single"), F.col("__n")).otherwise(1)
        firsts = firsts.select("__r", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return firsts.select(*[F.col("__r")[c].alias(c) for c in df.columns])


def union_parts(df: DataFrame, key: str) -> DataFrame:
    """Row concat of the keyed and the key-less parts of one table."""
    has_key = F.col(key).isNotNull()
    return df.where(has_key).unionByName(df.where(~has_key))


# ---------------------------------------------------------------- text
def trim_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: S.strip_ws(F.col(c)) for c in cols})


def _join_mapping(df: DataFrame, c: str, mapping: DataFrame, from_col: str, to_col: str) -> DataFrame:
    """Left-join a (from, to) mapping on column ``c``. The join is adaptive: a mapping that turns out
    small in bytes is broadcast, else skewed values are split."""
    m = mapping.select(F.col(from_col).alias("__from"), F.col(to_col).alias("__to"))
    j = df.join(m, F.col(c) == F.col("__from"), "left")
    return j.select(*[F.coalesce(F.col("__to"), F.col(c)).alias(c) if x == c else F.col(x)
                      for x in df.columns])


def canon_case_mapping(df: DataFrame, c: str) -> DataFrame:
    """(from, to): every spelling -> the commonest spelling of its lower+trim key (ties: smallest)."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.withColumn("__k", F.lower(S.strip_ws(F.col(c))))
    best = keyed.groupBy("__k").agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col(c).alias("v"))).alias("b"))
    return keyed.join(best, "__k").select(F.col(c).alias("from_value"), F.col("b.v").alias("to_value"))


def canon_case(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = _join_mapping(df, c, canon_case_mapping(df, c), "from_value", "to_value")
    return df


def map_values(df: DataFrame, c: str, mapping: DataFrame, from_col: str = "from_value",
               to_col: str = "to_value") -> DataFrame:
    """Apply a (from, to) value memory to one column in one pass (no chaining)."""
    return _join_mapping(df, c, mapping, from_col, to_col)


# ---------------------------------------------------------------- formulas
def recalc_total(df: DataFrame, qty: str, price: str, total: str, discount: Optional[str] = None) -> DataFrame:
    """total = round(q*p - d, 2) floored at 0, for every row; NULL inputs count as 0."""
    q = F.coalesce(F.col(qty).cast("double"), F.lit(0.0))
    p = F.coalesce(F.col(price).cast("double"), F.lit(0.0))
    t = q * p
    if discount is not None and dict(df.dtypes)[discount] != "boolean":
        t = t - F.coalesce(F.col(discount).cast("double"), F.lit(0.0))
    return replace_columns(df, {total: F.greatest(F.round(t, 2), F.lit(0.0))})


def recalc_profit(df: DataFrame, total_price: str, cost: str, qty: str, profit: str) -> DataFrame:
    tp = F.coalesce(F.col(total_price).cast("double"), F.lit(0.0))
    co = F.coalesce(F.col(cost).cast("double"), F.lit(0.0))
    q = F.coalesce(F.col(qty).cast("double"), F.lit(1.0))
    return replace_columns(df, {profit: F.round(tp - q * co, 2)})


# ---------------------------------------------------------------- outliers
MONEY_NAME_WORDS = ("price", "cost", "amount", "total", "quantity", "qty")


def iqr_bounds(df: DataFrame, cols: Sequence[str]) -> Dict[str, tuple]:
    q = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = q[c]
        iqr = q3 - q1
        out[c] = (q1 - K.IQR_FACTOR * iqr, q3 + K.IQR_FACTOR * iqr)
    return out


def cap_outliers(df: DataFrame, bounds: Dict[str, tuple]) -> DataFrame:
    """Clip to IQR bounds; the lower bound is at least 0 for money/quantity names."""
    new = {}
    for c, (lo, hi) in bounds.items():
        if S.name_has_any(c, MONEY_NAME_WORDS):
            lo = max(lo, 0.0)
        x = F.col(c).cast("double")
        new[c] = F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)
    return replace_columns(df, new)


# ---------------------------------------------------------------- imputation
def impute_median(df: DataFrame, cols: Sequence[str], fills: Optional[Dict[str, float]] = None) -> DataFrame:
    """NULL -> exact median of the column (0 when the column has no value)."""
    if fills is None:
        med = medians(df, cols)
        fills = {c: (0.0 if med[c] != med[c] else med[c]) for c in cols}
    return replace_columns(df, {c: F.coalesce(F.col(c), F.lit(fills[c]).cast(dict(df.dtypes)[c])) for c in cols})


def impute_mode(df: DataFrame, cols: Sequence[str], fills: Optional[Dict[str, str]] = None) -> DataFrame:
    """NULL -> most frequent value that is not a no-data word (ties: smallest)."""
    if fills is None:
        clean = df.select(*[S.null_sentinel(c).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c)
                            for c in cols])
        fills = modes(clean, cols)
    new = {}
    for c in cols:
        if fills.get(c) is not None:
            new[c] = F.coalesce(F.col(c), F.lit(fills[c]).cast(dict(df.dtypes)[c]))
    return replace_columns(df, new)


def impute_constant(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    return replace_columns(df, {c: F.coalesce(F.col(c), F.lit(value).cast(dict(df.dtypes)[c])) for c in cols})


def impute_business(df: DataFrame, discount_cols: Sequence[str]) -> DataFrame:
    """Discount flags: NULL -> false."""
    return impute_constant(df, discount_cols, False)


CONTACT_NAME_WORDS = ("email", "mail", "name", "address", "url", "phone", "mobile")


def identifier_columns(df: DataFrame, smap: Dict[str, dict]) -> List[str]:
    """Text columns that a commonest value would corrupt: over half distinct, an identifier type or a contact name."""
    from kpiforge.operators.profile import distinct_counts

    text = string_columns(df)
    found = distinct_counts(df, text) if text else {}
    return [c for c in text if found[c][1] > 0.5 * found[c][0] or smap.get(c, {}).get("semantic_type") in K.ID_SEMANTIC_TYPES
            or any(w in c.lower() for w in CONTACT_NAME_WORDS)]


def impute_identifier(df: DataFrame, cols: Optional[Sequence[str]] = None, smap: Optional[Dict[str, dict]] = None) -> DataFrame:
    """Identifier / contact columns: NULL -> 'unknown'; without given columns they are chosen."""
    return impute_constant(df, identifier_columns(df, smap or {}) if cols is None else cols, "unknown")
