"""Small helpers the operators share: reading tables, stored stages, text clean-up."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Word characters of the contracts: everything but blank and the ASCII controls 9-13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known and the package importable in Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_or_empty(docs: DataFrame, col: str = "text") -> Column:
    return F.coalesce(docs[col].cast("string"), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lineage cut whose files
    every executor can read, so a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name_or_path: str) -> str:
    """A path is taken as it is; a bare file name is looked up among the public tokenizers."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
