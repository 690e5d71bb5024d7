"""Model-backed operators: isolation-forest outliers, forest imputation, KNN imputation.

* Isolation forest on one column: the trees are grown on the driver from a
  bounded sample (trees x 256 values, the algorithm's own sub-sample size). In
  one dimension the average path length is a step function of x, so the whole
  forest becomes (break points, score) arrays. Every row is scored JVM-side by
  ``Bucketizer`` (binary search) + ``element_at`` - no Python on the rows.
* Forest imputation is in :mod:`kpiforge.operators.forest`, KNN imputation 
  :mod:`kpiforge.operators.knn`.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import List, Optional, Sequence, Tuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions.stats import exact_quantiles, modes
from kpiforge.operators.forest import impute_forest  # noqa: F401
from kpiforge.operators.knn import impute_knn  # noqa: F401

# ----------------------------------------------------------------- isolation forest


def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(values: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: List[Tuple[float, float, float]],
          lo: float, hi: float) -> None:
    """Append (interval_lo, interval_hi, path_length) leaves of one 1-D isolation tree."""
    n = len(values)
    if depth >= limit or n <= 1 or values.min() == values.max():
        out.append((lo, hi, depth + _c(n)))
        return
    split = rng.uniform(values.min(), values.max())
    left, right = values[values < split], values[values >= split]
    _grow(left, rng, depth + 1, limit, out, lo, split)
    _grow(right, rng, depth + 1, limit, out, split, hi)


def isolation_steps(sample: np.ndarray, trees: int = 100, sub: int = 256, seed: int = 42) -> Tuple[List[float], List[float]]:
    """Forest -> (breaks, score per interval). Interval i is [breaks[i-1], breaks[i])."""
    rng = np.random.default_rng(seed)
    psi = min(sub, len(sample))
    limit = int(math.ceil(math.log2(max(psi, 2))))
    leaves_per_tree = []
    for _ in range(trees):
        s = rng.choice(sample, size=psi, replace=False) if len(sample) > psi else sample
        leaves: List[Tuple[float, float, float]] = []
        _grow(np.asarray(s, dtype=float), rng, 0, limit, leaves, -math.inf, math.inf)
        leaves_per_tree.append(sorted(leaves))
    breaks = sorted({b for leaves in leaves_per_tree for lo, hi, _ in leaves for b in (lo, hi) if math.isfinite(b)})
    # evaluate each tree on every interval (a representative point per interval)
    edges = [-math.inf] + breaks + [math.inf]
    reps = []
    for a, b in zip(edges[:-1], edges[1:]):
        if math.isinf(a) and math.isinf(b):
            reps.append(0.0)
        elif math.isinf(a):
            reps.append(b - 1.0)
        elif math.isinf(b):
            reps.append(a + 1.0)
        else:
            reps.append((a + b) / 2.0)
    reps_arr = np.asarray(reps)
    total = np.zeros(len(reps))
    for leaves in leaves_per_tree:
        los = np.asarray([lo for lo, _, _ in leaves])
        vals = np.asarray([v for _, _, v in leaves])
        idx = np.searchsorted(los, reps_arr, side="right") - 1
        total += vals[np.clip(idx, 0, len(vals) - 1)]
    mean_path = total / len(leaves_per_tree)
    scores = (2.0 ** (-mean_path / _c(psi))).tolist()
    return breaks, scores


def iforest_scores(df: DataFrame, c: str, trees: int = 100, sub: int = 256, seed: int = 42) -> DataFrame:
    """Adds ``iforest_score`` for column ``c`` (NULL where the value is NULL)."""
    from pyspark.ml.feature import Bucketizer

    x = df.select(F.col(c).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    n = x.count()
    want = trees * sub
    frac = min(1.0, 1.5 * want / max(n, 1))
    # the `want` rows with the smallest random numbers: every part of the table can be drawn
    drawn = x.sample(False, min(1.0, 2 * frac), seed).withColumn("__r", F.rand(seed)).orderBy("__r").limit(want)
    sample = np.asarray([r[0] for r in drawn.select("__x").collect()], dtype=float)
    if len(sample) == 0:
        return df.withColumn("iforest_score", F.lit(None).cast("double"))
    breaks, scores = isolation_steps(sample, trees, sub, seed)
    splits = [-math.inf] + breaks + [math.inf]
    tmp = df.withColumn("__x", F.col(c).cast("double"))
    b = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep").transform(tmp)
    score_arr = F.array(*[F.lit(float(s)) for s in scores])
    return b.withColumn("iforest_score", F.when(F.col("__x").isNotNull(),
                                                 F.element_at(score_arr, F.col("__b").cast("int") + 1))) \
        .drop("__x", "__b")


def iforest_outliers(df: DataFrame, cols: Sequence[str], contamination: float = K.OUTLIER_CONTAMINATION
      ) -> DataFrame:
    """det_outlier_iforest: (column_name, n, threshold, ml_count): rows whose score is at or
    above the (1 - contamination) quantile of the scores."""
    spark = df.sparkSession
    rows = []
    for c in cols:
        scored = iforest_scores(df.select(c), c).select("iforest_score").where(F.col("iforest_score").isNotNull())
        q = exact_quantiles(scored, ["iforest_score"], [1 - contamination])["iforest_score"][0]
        r = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("iforest_score") > q).alias("k")).first()
        rows.append((c, int(r["n"]), float(q), int(r["k"])))
    return spark.createDataFrame(rows, "column_name string, n bigint, threshold double, ml_count bigint")


def outlier_consensus(iqr_z: DataFrame, ml: DataFrame) -> DataFrame:
    """det_outlier_consensus: max of the three counts, its share of values, IQR bounds."""
    j = iqr_z.join(ml.select("column_name", "ml_count"), "column_name", "left")
    cons = F.greatest("iqr_count", "z_count", F.coalesce("ml_count", F.lit(0)))
    return j.select("column_name", "iqr_count", "z_count", F.coalesce("ml_count", F.lit(0)).alias("ml_count"),
                    cons.alias("consensus_count"), F.round(cons * 100.0 / F.col("n"), 2).alias("pct"),
                    "lower", "upper").where(F.col("consensus_count") > 0)
