"""File sources and sinks, catalog listing, previews, column-name clean-up."""

from __future__ import annotations

import os
import re
from typing import Dict, List, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# CSV options that keep text exactly as written (no trimming, only empty = NULL)
CSV_EXACT = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
             "multiLine": "true", "escape": '"'}


#: Records per written CSV file: a file whose cells hold line breaks is read by one task.
CSV_FILE_ROWS = 500_000

# all texts that a cast to double takes (leading and trailing control characters and blanks, sign, digits with point and
# exponent, a type letter, hexadecimal, the words); any other text would only raise and catch an exception per cell
DOUBLE_TEXT = (r"^[\x00-\x20]*[+-]?(?:(?i:nan|inf|infinity)|(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|"
               r"0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*[pP][+-]?[0-9]+)[fFdD]?)[\x00-\x20]*\z")

# a superset of the texts that a cast to int or bigint takes
WHOLE_TEXT = r"^[^0-9A-Za-z.]*[0-9]+[^0-9A-Za-z]*\z"


def _csv_options(spark: SparkSession, path: str) -> Dict[str, str]:
    """Options of an exact read. Where every line of the files is a whole record - its quotes are even, no carriage return,
    no blank line - lines are read apart, so that many tasks share a file; else one task reads a whole file."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    odd = spark.read.option("lineSep", "\n").text(path).where((quotes % 2 != 0) | line.contains("\r") | (F.trim(line) == ""))
    if odd.limit(1).count() > 0:
        return CSV_EXACT
    return {**CSV_EXACT, "multiLine": "false", "lineSep": "\n"}


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV read: a column gets the narrowest type that fits all its cells (one pass
    over the whole file), so no cell is lost; then the file is read with that schema."""
    options = _csv_options(spark, path)
    schema = _infer_types(spark.read.options(**options).csv(path))           # all string
    return spark.read.options(**options).option("mode", "PERMISSIVE").schema(schema).csv(path)


def _infer_types(raw: DataFrame):
    """Schema from counts of the cells that can be cast, over all records."""
    casts = []
    for c in raw.columns:
        x = F.col(c)
        casts.append(F.struct(
            F.count(x).alias("nn"),
            F.count(F.when(x.rlike(WHOLE_TEXT), x.try_cast("int"))).alias("i"),
            F.count(F.when(x.rlike(WHOLE_TEXT), x.try_cast("bigint"))).alias("l"),
            F.count(F.when(x.rlike(DOUBLE_TEXT), x.try_cast("double"))).alias("d")).alias(c))
    r = raw.agg(*casts).first()
    from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                                   StructType)
    fields = []
    for c in raw.columns:
        s = r[c]
        if s["nn"] == 0:
            t = StringType()
        elif s["i"] == s["nn"]:
            t = IntegerType()
        elif s["l"] == s["nn"]:
            t = LongType()
        elif s["d"] == s["nn"]:
            t = DoubleType()
        else:
            t = StringType()
        fields.append(StructField(c, t, True))
    return StructType(fields)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; only empty cells are NULL."""
    df = spark.read.options(**_csv_options(spark, path)).option("inferSchema", "false").csv(path)
    return df.select(*[F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c)).alias(c) for c in df.columns])


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Read as UTF-8; when undecodable bytes show up (U+FFFD), read again as
    ISO-8859-1. An empty table is an error."""
    df = read_csv_strings(spark, path)
    probe = df.where(F.concat_ws("", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns]).contains("�"))
    if probe.limit(1).count() > 0:
        df = spark.read.options(**CSV_EXACT).option("encoding", "ISO-8859-1").csv(path)
        df = df.select(*[F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c)).alias(c) for c in df.columns])
    if df.limit(1).count() == 0:
        raise ValueError(f"empty table: {path}")
    return df


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.option("multiLine", str(multi_line).lower()).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, user: str, password: str,
              driver: str = "com.mysql.cj.jdbc.Driver", partition_column: Optional[str] = None,
              lower: Optional[int] = None, upper: Optional[int] = None, partitions: int = 8) -> DataFrame:
    """Read a database table; with ``partition_column`` the read is split into parallel ranges."""
    r = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
         .option("user", user).option("password", password).option("driver", driver))
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", partitions))
    return r.load()


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_EXACT).option("maxRecordsPerFile", CSV_FILE_ROWS).csv(path)
    return path


def write_report(spark: SparkSession, parts: Dict[str, DataFrame], root: str) -> Dict[str, str]:
    """Each report table as JSON lines under ``root/<name>``."""
    out = {}
    for name, df in parts.items():
        p = os.path.join(root, name)
        df.write.mode("overwrite").json(p)
        out[name] = p
    return out


def write_bundle(parts: Dict[str, DataFrame], root: str, fmt: str = "parquet") -> Dict[str, str]:
    """One folder per table (raw copy, cleaned copy, insights, one per question)."""
    out = {}
    for name, df in parts.items():
        p = os.path.join(root, re.sub(r"[^A-Za-z0-9_]+", "_", name))
        df.write.mode("overwrite").format(fmt).save(p)
        out[name] = p
    return out


# ----------------------------------------------------------------- catalog
def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.isTemporary, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, is_temporary boolean, table_type string")


def describe_tables(spark: SparkSession, tables: Dict[str, DataFrame]) -> DataFrame:
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by an explicit order, with the table's row and column counts."""
    total = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns))) \
        .withColumn("__j", F.lit(1))
    head = df.orderBy(*order_by).limit(n).withColumn("__j", F.lit(1))
    return head.join(F.broadcast(total), "__j").drop("__j")


def clean_name(name: str) -> str:
    n = name.strip().lower()
    n = re.sub(r"[^0-9a-z]", "_", n)
    return n.strip("_")


def normalise_names(df: DataFrame) -> DataFrame:
    """trim, lower, every other symbol -> '_', strip '_'; on collision the
    smallest free number is added."""
    taken: set = set()
    names: List[str] = []
    for c in df.columns:
        n = clean_name(c) or "column"
        base, i = n, 0
        while n in taken:
            i += 1
            n = f"{base}_{i}"
        taken.add(n)
        names.append(n)
    return df.toDF(*names)
