"""Row-wise building blocks as native Column expressions (no Python UDFs).

Every function here returns a ``Column`` so it stays inside whole-stage codegen
and composes into one ``select``.
"""

from __future__ import annotations

from typing import Iterable, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiforge import constants as K

ColLike = Union[str, Column]


def col_(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# whitespace characters stripped from both ends (tab, newline, vertical tab, form feed, CR, space, NBSP)
WHITESPACE = " \t\n\x0b\f\r\xa0"


def strip_ws(c: ColLike) -> Column:
    """Strip leading/trailing whitespace of any kind (not only spaces); native ``btrim``."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def as_text(c: ColLike) -> Column:
    return col_(c).cast("string")


def is_null_word(c: ColLike, words: Iterable[str] = K.STRING_NULL_WORDS) -> Column:
    """True when the trimmed, lower-cased text is a no-data word."""
    return F.lower(strip_ws(as_text(c))).isin(list(words))


def null_sentinel(c: ColLike) -> Column:
    """No-data words become NULL; other values unchanged."""
    return F.when(is_null_word(c), F.lit(None)).otherwise(col_(c))


def is_number_text(c: ColLike) -> Column:
    return as_text(c).rlike(K.NUMBER_REGEX)


def num_parse(c: ColLike) -> Column:
    """Lenient number parse: anything that is not a plain number -> NULL.

    ``try_cast`` alone accepts suffixes such as ``1f``; the regex guard keeps only
    plain decimal / scientific notation.
    """
    t = as_text(c)
    return F.when(t.rlike(K.NUMBER_REGEX), strip_ws(t).try_cast("double"))


def remove_thousands_commas(c: Column) -> Column:
    # a comma between a digit and three more digits is a thousands separator
    return F.regexp_replace(c, r"(\d),(?=\d{3})", "$1")


def num_currency(c: ColLike) -> Column:
    """Strip currency marks, Rs/INR, thousands commas and a trailing % then parse.

    Plain numbers take the short path (one regex test) instead of the rewrite chain.
    """
    t = as_text(c)
    # the rewrite chain can only help a value with a digit and a currency/percent/comma mark
    marked = t.rlike("[0-9]") & t.rlike("[" + K.CURRENCY_PROBE_CHARS + ",%]|(?i)rs|(?i)inr")
    return (F.when(t.rlike(K.NUMBER_REGEX), strip_ws(t).try_cast("double"))
            .when(marked, _num_currency_chain(t)))


def _num_currency_chain(c: ColLike) -> Column:
    s = as_text(c)
    s = F.regexp_replace(s, "[" + K.CURRENCY_PROBE_CHARS + "]", "")
    s = F.regexp_replace(s, r"(?i)\bRs\.?\b", "")
    s = F.regexp_replace(s, r"(?i)\bINR\b", "")
    s = remove_thousands_commas(s)
    s = F.regexp_replace(s, r"%$", "")
    return num_parse(strip_ws(s))


def num_locale_text(c: ColLike) -> Column:
    """Locale clean-up to a numeric-looking prefix (text)."""
    s = strip_ws(as_text(c))
    s = strip_ws(F.regexp_replace(s, "[" + K.CURRENCY_LOCALE_CHARS + "]", ""))
    euro = s.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    s = F.when(euro, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(s)
    s = remove_thousands_commas(s)
    return F.regexp_extract(s, r"^(-?[\d.]+)", 1)


def num_locale(c: ColLike) -> Column:
    """European ``1.299,99`` -> 1299.99, thousands, trailing units (``5 units``)."""
    return num_parse(num_locale_text(c))


def bool_word(c: ColLike) -> Column:
    """Boolean words -> true/false; anything else -> NULL."""
    s = F.lower(strip_ws(as_text(c)))
    return (F.when(s.isin(list(K.BOOL_TRUE_WORDS)), F.lit(True))
            .when(s.isin(list(K.BOOL_FALSE_WORDS)), F.lit(False)))


def format_shape(spark_format: str) -> str:
    """Cheap regex a value must match before a format is tried.

    Derived from the pattern letters (d/M -> 1-2 digits, yyyy -> 4, yy -> 2,
    MMM/MMMM -> letters), so a failed parse (costly in the JVM) is attempted only
    for values of the right shape.
    """
    import re as _re

    out = ""
    for tok in _re.findall(r"y+|M+|d+|[^yMd]", spark_format):
        if tok in ("d", "M"):
            out += r"\d{1,2}"
        elif tok == "yyyy":
            out += r"\d{4}"
        elif tok == "yy":
            out += r"\d{2}"
        elif tok == "MMM":
            out += "[A-Za-z]{3}"
        elif tok == "MMMM":
            out += "[A-Za-z]+"
        else:
            out += _re.escape(tok)
    return "^" + out + "$"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` refers to it; the code made
    for the projection around it stays small enough for the JVM to compile."""
    return F.transform(F.array(value), use).getItem(0)


def _iso_date(t: Column, spark_format: str) -> Column:
    """The date of a text that has the shape of ``spark_format``. All-numeric formats are put in the order
    year-month-day and cast, which costs no exception where the day or month does not exist."""
    import re as _re

    parts = _re.findall(r"y+|M+|d+", spark_format)
    if not all(p in ("d", "M", "yy", "yyyy") for p in parts):
        return F.to_date(F.try_to_timestamp(t, F.lit(spark_format)))
    order = {p[0]: i + 1 for i, p in enumerate(parts)}
    century = "20" if "yy" in parts else ""
    iso = F.regexp_replace(t, r"^(\d+)\D(\d+)\D(\d+)$", f"{century}${order['y']}-${order['M']}-${order['d']}")
    return iso.try_cast("date")


def parse_date_formats(c: ColLike, spark_formats: Iterable[str], stripped: bool = False) -> Column:
    """First format that parses wins (per row); result is a DATE.

    Pass an already-stripped column (``stripped=True``) produced by an earlier
    projection to keep the generated code small.
    """
    fmts = list(spark_formats)

    def parsed(t: Column) -> Column:
        found = F.coalesce(*[F.when(t.rlike(format_shape(f)), _iso_date(t, f)) for f in fmts])
        # one cheap test first: three parts split by - / or space, the last of 1-4 digits
        return F.when(t.rlike(DATE_LIKE), found)

    return bound(col_(c) if stripped else strip_ws(as_text(c)), parsed)


# every supported format has three parts separated by '-', '/' or ' ' and ends in a day or a year
DATE_LIKE = r"^[0-9A-Za-z]{1,9}[-/ ][0-9A-Za-z]{1,9}[-/ ][0-9]{1,4}\z"


def ordered_formats(best: str | None) -> list:
    """Winner first, then the remaining formats in the fixed order."""
    fmts = [sp for _, sp in K.DATE_FORMATS]
    if best in fmts:
        fmts.remove(best)
        fmts.insert(0, best)
    return fmts


def date_in_range(d: Column, as_of_year: int) -> Column:
    """Years outside 1990..as_of+1 -> NULL."""
    return F.when(F.year(d).between(K.MIN_DATE_YEAR, as_of_year + 1), d)


def epoch_to_date(x: ColLike, as_of_year: int) -> Column:
    """Epoch seconds (milliseconds above 1e12) -> DATE, years 1990..as_of+2."""
    v = col_(x).cast("double")
    secs = F.when(v > F.lit(1e12), v / 1000.0).otherwise(v)
    d = F.to_date(F.timestamp_seconds(secs))
    return F.when(F.year(d).between(K.MIN_DATE_YEAR, as_of_year + 2), d)


def key_slug(c: ColLike) -> Column:
    """lower-case, whitespace runs -> '_' (join-key form of a label)."""
    return F.regexp_replace(F.lower(as_text(c)), r"\s+", "_")


def name_has_any(name: str, words: Iterable[str]) -> bool:
    n = name.lower()
    return any(w in n for w in words)


def compact_name(name: str) -> str:
    """Lower-case name without spaces and underscores (for keyword tests)."""
    return name.lower().strip().replace(" ", "").replace("_", "")
