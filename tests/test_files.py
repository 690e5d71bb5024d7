"""Round trips of the file sources and sinks, whole contents compared."""
from kpiforge.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latin1_file_is_read_again(spark, tmp_path):
    path = str(tmp_path / "latin1.csv")
    with open(path, "wb") as f:
        f.write("name,n\ncafé,1\n\"a,b\",2\nplain,\n".encode("latin-1"))
    assert rows(files.read_csv_any_encoding(spark, path)) == sorted([("café", "1"), ("a,b", "2"), ("plain", None)], key=repr)


def test_utf8_file_stays_utf8(spark, tmp_path):
    path = str(tmp_path / "utf8.csv")
    with open(path, "wb") as f:
        f.write("name\ncafé\n日本\n".encode())
    assert rows(files.read_csv_any_encoding(spark, path)) == sorted([("café",), ("日本",)], key=repr)


def test_sinks_keep_every_row(spark, tmp_path):
    one = spark.createDataFrame([(i, f"v {i}, \"q\"") for i in range(200)], "id long, s string").repartition(4)
    two = spark.createDataFrame([(1, None), (2, 2.5)], "id long, x double")
    csv = files.write_csv(one, str(tmp_path / "csv"))
    assert rows(files.read_csv_strings(spark, csv)) == sorted([(str(a), b) for a, b in rows(one)], key=repr)
    report = files.write_report(spark, {"one": one, "two": two}, str(tmp_path / "report"))
    assert rows(files.read_json(spark, report["one"]).select("id", "s")) == rows(one)
    assert rows(files.read_json(spark, report["two"]).select("id", "x")) == rows(two)
    bundle = files.write_bundle({"raw data": one, "two": two}, str(tmp_path / "bundle"))
    assert rows(files.read_parquet(spark, bundle["raw data"])) == rows(one)
    assert rows(files.read_parquet(spark, bundle["two"])) == rows(two)


def test_list_tables(spark):
    spark.range(3).createOrReplaceTempView("a_view_of_this_test")
    got = {r.table_name: r.is_temporary for r in files.list_tables(spark).collect()}
    assert got["a_view_of_this_test"] is True
    spark.catalog.dropTempView("a_view_of_this_test")


def test_csv_of_whole_lines_is_shared_by_tasks(spark, tmp_path):
    """Typed and text reads split a file whose lines are records; a file with line breaks in cells is read whole, equally."""
    table = [(i, f"v{i}, \"q\" ", "1e3" if i % 2 else "0x1p3", "2020-01-05", 7 if i % 3 else None) for i in range(3000)]
    df = spark.createDataFrame(table, "id int, s string, x string, d string, n int").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_csv_typed(spark, files.write_csv(df, str(tmp_path / "lines")))
        assert got.rdd.getNumPartitions() > 3
        assert dict(got.dtypes) == {"id": "int", "s": "string", "x": "double", "d": "string", "n": "int"}
        assert got.agg({"x": "sum"}).first()[0] == 1500 * 1000.0 + 1500 * 8.0
        assert rows(got.drop("x")) == rows(df.drop("x"))
        broken = df.limit(50).selectExpr("id", "concat(s, '\\n', s) as s", "'\\r' as r")
        assert rows(files.read_csv_typed(spark, files.write_csv(broken, str(tmp_path / "breaks")))) == rows(broken)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_double_text_holds_what_the_cast_takes(spark):
    texts = ["1", " 1.5 ", "+.5", "5.", ".", "1e5", "1E-5f", "2d", "NaN", "-Infinity", "iNF", "nan ", "0x1.8p3", "0x1p-2d", "1e", "abc", "2020-01-05",
             "", " ", "1,5", "--1", "\t7\n", "1 2", "infinit", "NaNd", "0x1", "+inf", "１"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "try_cast(t as double) is not null as ok")
    from pyspark.sql import functions as F
    assert df.where(F.col("ok") & ~F.col("t").rlike(files.DOUBLE_TEXT)).collect() == []


def test_whole_text_holds_what_the_casts_take(spark):
    texts = ["1", " 12 ", "+5", "-7\n", "1.5", "1.", ".5", ".", "1e3", "abc", "2020-01-05", "", "\x00" + "3\x7f", "\t4\x1f", "99999999999", "1 2", "--1", "\x855",
             "\u00a06", "1-", "7d", "９"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "try_cast(t as int) is not null or try_cast(t as bigint) is not null as ok")
    from pyspark.sql import functions as F
    assert df.where(F.col("ok") & ~F.col("t").rlike(files.WHOLE_TEXT)).collect() == []
