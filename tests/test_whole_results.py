"""Nothing is lost: dates with one digit, misfits late in a CSV, whole SQL results, names, models with few columns."""
import datetime
import json

import pytest
from pyspark.sql import functions as F

from kpiforge.functions import scalars as S
from kpiforge.operators import forest, ml, select, sqlbatch, validate
from kpiforge.sources import files


def test_one_digit_days(spark):
    df = spark.createDataFrame([("2020-1-5",), ("2020/3/7",), ("2020-12-31",)], "d string")
    got = [r[0] for r in df.select(S.parse_date_formats("d", S.ordered_formats(None))).collect()]
    assert got[0] == datetime.date(2020, 1, 5) and got[1] == datetime.date(2020, 3, 7) and got[2] == datetime.date(2020, 12, 31)


def test_sql_batch_keeps_order_and_rows(spark):
    spark.range(1, 101).withColumnRenamed("id", "rev").repartition(4).createOrReplaceTempView("revs")
    out = sqlbatch.sql_batch(spark, [{"question": "a", "sql": "SELECT rev FROM revs ORDER BY rev DESC LIMIT 8"},
                                     {"question": "b", "sql": "SELECT rev FROM revs"}, {"question": "c", "sql": "SELECT nope FROM revs"}])
    rows = out.collect()
    first = sorted((r for r in rows if r.position == 0), key=lambda r: r.row_order)
    assert [json.loads(r.row)["rev"] for r in first] == list(range(100, 92, -1))
    assert sum(r.position == 1 for r in rows) == 100
    assert [r.row for r in rows if r.position == 2] == [None] and [r for r in rows if r.error][0].position == 2


def test_names_one_underscore_per_symbol_and_no_collision(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Unit  Price ($/kg)", "a", "a_1", "A"])
    assert files.normalise_names(df).columns == ["unit__price____kg", "a", "a_1", "a_2"]


def test_csv_types_fit_all_rows(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("v,n\n" + "".join(f"{i},{i}\n" for i in range(12_000)) + "late text,7\n")
    df = files.read_csv_typed(spark, path)
    assert dict(df.dtypes) == {"v": "string", "n": "int"} and df.where("v = 'late text'").count() == 1


def test_every_row_trains_the_forest(spark):
    """Labels of one row each, among many rows, all have their votes, with the share of all rows in the leaf."""
    n, rare = 120_000, 40
    label = F.when(F.col("id") < rare, F.concat(F.lit("rare"), F.col("id"))).otherwise(F.lit("usual"))
    df = spark.range(0, n, 1, 8).select(label.alias("t"), (F.col("id") % 7).alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    model = forest.fit_forest(df, "t", ["a", "b"], trees=3, depth=1)
    leaves = spark.read.parquet(model.leaves).collect()
    for tree, ((i, cut),) in enumerate(model.tests):
        step = (7, 11)[i]
        for leaf in (0, 1):
            ids = [x for x in range(n) if int(x % step > cut) == leaf]
            want = {f"rare{x}": 1 / len(ids) for x in ids if x < rare}
            got = {r["label"]: r["share"] for r in leaves if (r["tree"], r["leaf"]) == (tree, leaf) and r["label"] != "usual"}
            assert got == pytest.approx(want)


@pytest.mark.parametrize("context", [[], ["a"]])
def test_forest_with_few_columns_takes_the_mode(spark, context):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), (None, "q")], "t string, a string")
    assert [r.t for r in ml.impute_forest(df, "t", context).collect()] == ["x"] * 3


def test_knn_with_one_feature(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(10)] + [(4.0, None)], "f double, t double")
    assert ml.impute_knn(df, "t", ["f"], k=1).where("f = 4.0").select(F.min("t"), F.max("t")).first()[:] == (4.0, 4.0)


def test_isolation_sample_reaches_the_end(spark, monkeypatch):
    seen = []
    steps = ml.isolation_steps
    monkeypatch.setattr(ml, "isolation_steps", lambda sample, *a: (seen.append(sample), steps(sample, *a))[1])
    ml.iforest_scores(spark.range(0, 200_000, 1, 16).select(F.col("id").alias("x")), "x", trees=10)
    assert len(seen[0]) == 2560 and seen[0].max() > 190_000 and seen[0].min() < 10_000


def test_keys_before_exclusion(spark):
    df = spark.createDataFrame([(i, f"t{i}", i * 2.0, float(i)) for i in range(60)], "phone_no long, session_token string, revenue double, qty double")
    got = {r.column_name: r.role for r in select.select_columns(df, use_forest=False).collect()}
    assert got["phone_no"] == "Primary / Foreign Key" and got["session_token"] == "Force-Excluded"


def test_all_failing_values(spark):
    df = spark.range(200).select((F.col("id") - 100).alias("q"))
    rule = validate.Rule("q", "ge0", F.col("q") >= 0)
    assert validate.failing_values(df, rule).count() == 100
