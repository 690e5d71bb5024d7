"""Session and shared-folder helpers.

On a cluster the shared scratch location comes from ``spark.checkpoint.dir``
(set by whoever runs the cluster). We only pick a folder ourselves when the
setting is missing, which is the case for local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "kpiforge") -> SparkSession:
    """Session with the settings this library relies on.

    AQE stays on so partition counts and skewed joins are re-planned at run time;
    the session time zone is pinned so timestamps compare across engines.
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Unset: local runs and tests only.
    local = tempfile.mkdtemp(prefix="kpiforge-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Reliable checkpoint (written to the shared folder); survives executor loss.

    The plan is persisted first: an eager checkpoint runs one job to count and a
    second to write the files, and without the cache the second job would
    recompute the whole plan.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


#: Rows of a written file at most. A parquet file of one row group is read by one task, however large it is, so a
#: table that few tasks have written would be read by few.
FILE_ROWS = 100_000


def write_table(df: DataFrame, path: str) -> None:
    """``df`` as parquet files of at most ``FILE_ROWS`` rows, which any number of tasks can share."""
    df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def cut_table(df: DataFrame, name: str = "stage") -> DataFrame:
    """A lineage cut for a wide table that many jobs read: parquet in the shared folder, so that every
    job reads its own columns only."""
    if any(t == "void" for _, t in df.dtypes):  # not storable
        return cut_lineage(df, name)
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kpiforge`` importable in Python workers (pandas UDF / mapInPandas).

    The package is zipped once per application and added with ``addPyFile``, so
    Spark distributes it to every executor (the zip is built on the driver and
    served by Spark itself; executors never read a driver-local path).
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, zpath = tempfile.mkstemp(prefix="kpiforge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
