"""Repairs: invariants, skew, partitioning."""
from pyspark.sql import functions as F

from kpiforge.operators import repair as R


def test_dedup_key_keeps_first_and_null_keys(spark):
    rows = [("k1", 3), ("k1", 1), ("k2", 5), (None, 1), (None, 1), ("", 9)]
    df = spark.createDataFrame(rows, "id string, v int")
    key = lambda t: (str(t[0]), t[1])
    out = sorted(((r.id, r.v) for r in R.dedup_key(df, "id").collect()), key=key)
    assert out == sorted([("", 9), ("k1", 1), ("k2", 5), (None, 1), (None, 1)], key=key)


def test_dedup_key_hot_key_and_repartition_invariant(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, v int")
    a = {(r.id, r.v) for r in R.dedup_key(df, "id").collect()}
    b = {(r.id, r.v) for r in R.dedup_key(df.repartition(13), "id").collect()}
    assert a == b
    assert ("hot", 0) in a and len(a) == 6001


def test_canon_case_commonest_spelling(spark):
    df = spark.createDataFrame([("Cash",), ("cash",), ("Cash",), (" CASH ",), (None,)], "p string")
    out = [r.p for r in R.canon_case(df, ["p"]).collect()]
    assert sorted(x for x in out if x) == ["Cash"] * 4 and None in out


def test_recalc_total_floor_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 3.5, 0.0), (None, 4.0, 1.0), (1.0, 2.0, 5.0)], "q double, p double, t double")
    out = [r.t for r in R.recalc_total(df, "q", "p", "t").collect()]
    assert out == [7.0, 0.0, 2.0]


def test_fix_negative_and_zero(spark):
    df = spark.createDataFrame([(-3.0, -1.0), (0.0, 4.0), (2.0, 6.0)], "q double, p double")
    out = R.fix_zero_qty(R.fix_negative(df, ["q"], ["p"]), ["q"]).collect()
    assert [(r.q, r.p) for r in out] == [(3.0, 5.0), (1.0, 4.0), (2.0, 6.0)]


def test_clean_plan_idempotent_null_free(spark):
    from kpiforge.plans import cleaning as CL
    import datetime as dt
    rows = [(f"T{i % 40}", "Cash" if i % 3 else "csh", str(i % 7 + 1) if i % 11 else "ERROR",
             f"{10 + i % 5}.00", None, "2020-01-0" + str(i % 9 + 1), 3) for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_id string, payment_method string, quantity string, "
                                     "unit_price string, total_spent string, order_date string, customer_rating int")
    out, plan = CL.fit_and_clean(df, dt.date(2025, 1, 1))
    assert out.count() == 40
    assert out.where(F.col("quantity").isNull() | F.col("total_spent").isNull()).count() == 0
    again = CL.apply_plan(df, plan)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in out.collect()}


def test_identifier_columns(spark):
    df = spark.createDataFrame([(f"u{i}", "a", f"m{i % 3}", None if i % 2 else "x", f"c{i % 2}") for i in range(40)],
                               "code string, kind string, contact_email string, note string, client string")
    assert R.identifier_columns(df, {"client": {"semantic_type": "CustomerID"}}) == ["code", "contact_email", "client"]
    assert R.impute_identifier(df, ["note"]).where("note = 'unknown'").count() == 20


def test_derive_features(spark):
    from kpiforge.operators import measures as M
    df = spark.createDataFrame([("3/2/2021", "New  Item", "Big City", "z")] * 3 + [("x", None, None, None)],
                               "created string, item string, city string, other string")
    out = M.derive_features(df, "Monthly sales, by product!").where("item IS NOT NULL").first().asDict()
    assert (out["created_Year"], out["created_Month"], out["created_Quarter"], out["item_key"]) == (2021, 2, 1, "new_item") and "city_key" not in out
    assert M.derive_features(df, "by region").columns == [*df.columns, "city_key"] and M.derive_features(df, "").columns == df.columns
    assert M.requirement_flags("margin per client")["profitability_analysis"] and not M.requirement_flags("timely")["time_grouping"]
