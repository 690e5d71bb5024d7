"""Small DuckDB SQL snippets used by the oracle queries.

These mirror the *meaning* of the Spark expressions in standard SQL so the
oracle is an independent formulation, not a call into this library.
"""

from __future__ import annotations

from kpiforge import constants as K
from kpiforge.sources.tables import DIRTY_SALES_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def null_words(words=K.STRING_NULL_WORDS) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def is_null_word(e: str) -> str:
    return f"coalesce(lower({strip(e)}) IN {null_words()}, false)"


def null_sentinel(e: str) -> str:
    return f"CASE WHEN lower({strip(e)}) IN {null_words()} THEN NULL ELSE {e} END"


def num_parse(e: str) -> str:
    return (f"CASE WHEN regexp_matches(CAST({e} AS VARCHAR), {q(K.NUMBER_REGEX)}) "
            f"THEN TRY_CAST({strip(f'CAST({e} AS VARCHAR)')} AS DOUBLE) END")


def thousands(e: str) -> str:
    # no look-around in this engine: apply a capture-group rewrite three times
    for _ in range(3):
        e = f"regexp_replace({e}, '(\\d),(\\d{{3}})', '\\1\\2', 'g')"
    return e


def num_currency(e: str) -> str:
    s = f"regexp_replace(CAST({e} AS VARCHAR), '[{K.CURRENCY_PROBE_CHARS}]', '', 'g')"
    s = f"regexp_replace({s}, '(?i)\\bRs\\.?\\b', '', 'g')"
    s = f"regexp_replace({s}, '(?i)\\bINR\\b', '', 'g')"
    s = thousands(s)
    s = f"regexp_replace({s}, '%$', '')"
    return num_parse(strip(s))


def num_locale(e: str) -> str:
    s = strip(f"CAST({e} AS VARCHAR)")
    s = strip(f"regexp_replace({s}, '[{K.CURRENCY_LOCALE_CHARS}]', '', 'g')")
    s = (f"CASE WHEN regexp_matches({s}, '^\\d{{1,3}}(\\.\\d{{3}})+(,\\d+)?$') "
         f"THEN replace(replace({s}, '.', ''), ',', '.') ELSE {s} END")
    s = thousands(s)
    s = f"nullif(regexp_extract({s}, '^(-?[\\d.]+)', 1), '')"
    return num_parse(s)


def bool_word(e: str) -> str:
    s = f"lower({strip(f'CAST({e} AS VARCHAR)')})"
    return (f"CASE WHEN {s} IN ('true','1','yes','t','y') THEN true "
            f"WHEN {s} IN ('false','0','no','f','n') THEN false END")


def date_any(e: str, formats=None) -> str:
    fmts = formats or [py for py, _ in K.DATE_FORMATS]
    s = strip(f"CAST({e} AS VARCHAR)")
    return "coalesce(" + ", ".join(f"CAST(try_strptime({s}, {q(f)}) AS DATE)" for f in fmts) + ")"


def dirty_sales_cte() -> str:
    return "WITH ds AS (" + DIRTY_SALES_SQL.strip() + ")"


DS_COLS = ["transaction_id", "customer_id", "item", "category", "quantity", "price_per_unit",
           "total_spent", "discount_applied", "transaction_date", "payment_method", "customer_rating"]
DS_TEXT_COLS = DS_COLS[:-1]


def sentinel_select(cols=DS_COLS, text_cols=DS_TEXT_COLS, src: str = "ds") -> str:
    parts = [f"{null_sentinel(c)} AS {c}" if c in text_cols else c for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}"
