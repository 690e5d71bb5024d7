"""Row-wise expressions on hand-made values."""
import datetime as dt

from pyspark.sql import functions as F

from kpiforge.functions import scalars as S


def _one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o")).collect()]


def test_null_words(spark):
    out = _one(spark, S.null_sentinel, [" UNKNOWN ", "error", "N/A", "tea", None, "#N/A", "not available", "-"])
    assert out == [None, None, None, "tea", None, None, None, None]


def test_num_parse_rejects_suffixes(spark):
    assert _one(spark, S.num_parse, ["12", " 3.5 ", "1e3", "1f", "abc", "-4", ".5", None]) == \
        [12.0, 3.5, 1000.0, None, None, -4.0, 0.5, None]


def test_num_currency(spark):
    out = _one(spark, S.num_currency, ["$1,234.50", "€12", "12%", "Rs.500", "INR 700", "1,234,567", "x"])
    assert out == [1234.5, 12.0, 12.0, 500.0, 700.0, 1234567.0, None]


def test_num_locale(spark):
    out = _one(spark, S.num_locale, ["1.299,99", "5 units", "€ 41.0 USD", "1,299", "-7", "abc"])
    assert out == [1299.99, 5.0, 41.0, 1299.0, -7.0, None]


def test_bool_word(spark):
    assert _one(spark, S.bool_word, ["Yes", "0", " TRUE ", "maybe", None]) == [True, False, True, None, None]


def test_date_formats_first_wins(spark):
    fm = S.ordered_formats("yyyy-M-d")
    out = _one(spark, lambda c: S.parse_date_formats(c, fm), ["2020-01-05", "05-03-1995", "3/4/2001", "junk"])
    assert out == [dt.date(2020, 1, 5), dt.date(1995, 3, 5), dt.date(2001, 4, 3), None]


def test_date_range_and_epoch(spark):
    out = _one(spark, lambda c: S.date_in_range(c, 2025), [dt.date(1980, 1, 1), dt.date(2000, 1, 1), dt.date(2099, 1, 1)],
               "date")
    assert out == [None, dt.date(2000, 1, 1), None]
    ep = _one(spark, lambda c: S.epoch_to_date(c, 2025), [1_600_000_000.0, 1_600_000_000_000.0, 5.0], "double")
    assert ep == [dt.date(2020, 9, 13), dt.date(2020, 9, 13), None]


def test_key_slug(spark):
    assert _one(spark, S.key_slug, ["New  York City", "A\tB"]) == ["new_york_city", "a_b"]


def test_dates_of_impossible_days_and_trailing_breaks(spark):
    formats = ["yyyy-M-d", "d-M-yyyy", "M/d/yyyy", "d-M-yy", "d MMM yyyy"]
    values = ["31-02-2020", "2020-2-29", "2021-02-29", "12/31/1999", "31/12/1999", "5-6-24", "1 Jan 2020", "31 Feb 2020", "2020-1-1\n", "0-1-2020", None]
    got = _one(spark, lambda c: S.parse_date_formats(c, formats, stripped=True), values)
    assert got == [None, dt.date(2020, 2, 29), None, dt.date(1999, 12, 31), None, dt.date(2024, 6, 5), dt.date(2020, 1, 1), None, None, None, None]
