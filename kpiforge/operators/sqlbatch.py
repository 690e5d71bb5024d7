"""SQL batch over temp views and declarative analysis plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Dict, Optional, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.operators import measures as M
from kpiforge.session import scratch_path


def sql_batch(spark: SparkSession, items: Sequence[Dict[str, str]]) -> DataFrame:
    """Run each ``{question, sql}`` on its own: (position, question, error, row_order, row).

    Every result is written once to the shared folder and returned whole, a row as JSON;
    ``row_order`` ascends in the order the query gave. A query that Spark rejects, or that
    fails while it runs, yields one ``error`` row instead of failing the batch."""
    parts = []
    for pos, it in enumerate(items):
        q, sql = it.get("question", ""), it.get("sql", "")
        head = [F.lit(pos).alias("position"), F.lit(q).alias("question")]
        try:
            df = spark.sql(sql)
            path = scratch_path(spark, "sql-batch")
            row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
            df.select(F.monotonically_increasing_id().alias("row_order"), row.alias("row")).write.parquet(path)
            parts.append(spark.read.parquet(path).select(*head, F.lit(None).cast("string").alias("error"), "row_order", "row"))
        except PySparkException as e:
            text = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
            parts.append(spark.range(1).select(*head, F.lit(text).alias("error"), F.lit(None).cast("long").alias("row_order"),
                                               F.lit(None).cast("string").alias("row")))
    if not parts:
        return spark.createDataFrame([], "position int, question string, error string, row_order bigint, row string")
    return reduce(DataFrame.unionByName, parts)


@dataclass
class AnalysisPlan:
    """Declarative plan: type updates, derived columns (SQL expressions), one chart."""
    type_updates: Dict[str, str] = field(default_factory=dict)
    derivations: Dict[str, str] = field(default_factory=dict)
    chart_x: Optional[str] = None
    chart_y: Optional[str] = None
    chart_agg: str = "sum"


def plan_apply(df: DataFrame, plan: AnalysisPlan) -> DataFrame:
    """Apply type updates (``try_cast``) and derivations, then the chart aggregate."""
    out = df.select(*[F.col(c).try_cast(plan.type_updates[c]).alias(c) if c in plan.type_updates else F.col(c)
                      for c in df.columns])
    if plan.derivations:
        out = out.select("*", *[F.expr(e).alias(n) for n, e in plan.derivations.items()])
    if plan.chart_x:
        return M.chart_group(out, plan.chart_x, plan.chart_y, plan.chart_agg)
    return out
