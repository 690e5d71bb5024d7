"""Work is dealt to many tasks however few files, row groups or bytes the input has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge import session
from kpiforge.operators import canon, forest, knn, select
from kpiforge.sources import tables


def test_stored_table_has_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "FILE_ROWS", 100)
    df = tables.stored(spark, str(tmp_path), "spread", lambda: spark.range(0, 1000, 1, 1).withColumn("t", F.col("id").cast("string")))
    files = [r[0] for r in df.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).select("n").collect()]
    assert len(files) == 10 and max(files) == 100
    assert sorted(r["id"] for r in df.collect()) == list(range(1000))


def test_cut_table_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", None, float("nan")), (2, None, True, None), (2, None, True, None)], "`an id` int, t string, b boolean, x double")
    out = session.cut_table(df)
    assert out.schema == df.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert session.cut_table(df.limit(0)).count() == 0 and session.cut_table(df.withColumn("v", F.lit(None))).count() == 3


def test_regression_forest_is_grown_by_many_tasks(spark, monkeypatch):
    from pyspark.ml import Pipeline
    seen = []
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, data, params=None: seen.append(data.rdd.getNumPartitions()) or fit(self, data, params))
    monkeypatch.setattr(select, "FOREST_TASK_ROWS", 100, raising=False)
    df = spark.range(0, 400, 1, 1).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                                          (F.col("id") % 7 * 10).cast("double").alias("total"))
    got = {r["column_name"]: r["forest"] for r in select.forest_importance(df, ["a", "b", "total"], "total", ["a", "b", "total"]).collect()}
    assert seen == [4]
    assert got["a"] == 1.0 and got["b"] < 0.2
    assert select.forest_importance(df.limit(49), ["a", "b", "total"], "total", ["a", "b", "total"]).count() == 0


def test_forest_votes_once_a_cell(spark):
    """Fills equal those of all the trees asked row by row, and cells are fewer than contexts."""
    rng = np.random.default_rng(5)
    rows = [(None if i % 4 == 0 else f"item{int(p) // 20}", f"c{int(p) % 3}", float(p)) for i, p in enumerate(rng.integers(0, 100, 800) + rng.random(800))]
    df = spark.createDataFrame(rows, "item string, category string, price double")
    model = forest.fit_forest(df, "item", ["category", "price"], trees=12, depth=5)
    asked = model.with_units(df.where("item is null").distinct())
    cells = asked.select(F.array(*model.cell()).alias("cell"), model.leaf_ids().alias("leaves"), "category", "price").collect()
    by_cell = {}
    for r in cells:
        by_cell.setdefault(tuple(r["cell"]), set()).add(tuple(r["leaves"]))
    assert all(len(v) == 1 for v in by_cell.values()) and len(by_cell) < len(cells)
    votes = {}
    for r in spark.read.parquet(model.leaves).collect():
        votes.setdefault((r["tree"], r["leaf"]), []).append((r["label"], r["share"]))
    want = {}
    for r in cells:
        total = {}
        for tree, leaf in enumerate(r["leaves"]):
            for label, share in votes.get((tree, leaf), []):
                total[label] = total.get(label, 0.0) + share
        want[r["category"], r["price"]] = min((-round(n, 9), label) for label, n in total.items())[1] if total else model.mode
    got = forest.apply_forest(df, model).collect()
    known = {(r[1], r[2]): r[0] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        key = (r["category"], r["price"])
        assert r["item"] == (want[key] if known[key] is None else known[key])


def test_fuzzy_pairs_read_the_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    df = spark.createDataFrame([("digital wallet",), ("digital walet",), ("cash",), ("cash",)], "v string").select(F.udf(seen, "string")("v").alias("v"))
    got = canon.fuzzy_pairs(df, ["v"]).select("a", "b").collect()
    assert [tuple(r) for r in got] == [("digital walet", "digital wallet")]
    assert read.value == 4


@pytest.mark.parametrize("n,k", [(3, 5), (5, 5), (300, 5), (300, 1)])
def test_nearest_is_the_sorted_head(n, k):
    rng = np.random.default_rng(n)
    y, x = np.round(rng.normal(size=(40, 2)), 1), np.round(rng.normal(size=(n, 2)), 1)
    x[0] = np.nan
    full = np.sqrt(((y[:, None, :] - x[None]) ** 2).sum(axis=2))
    at, col = knn._nearest(knn._distances(y, x), k)
    keep = np.argsort(full, axis=1, kind="stable")[:, :k]
    assert (at == np.repeat(np.arange(40), keep.shape[1])).all() and (col == keep.ravel()).all()
