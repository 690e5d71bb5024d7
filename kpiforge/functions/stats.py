"""Distributed exact order statistics (quantiles, medians, modes).

Spark's ``percentile`` keeps every distinct value of a group in one buffer, and
for a table-wide median that group is the whole column in one task. Here the wanted
ranks are found by radix selection instead, with built-in functions only:

1. one aggregate counts the rows per coarse bin (steps of the logarithm's size), with
   the smallest and largest value of each bin;
2. the bins that hold a wanted rank are known from the counts. A bin with a single value
   gives the answer; the others become segments;
3. the rows inside the segments are counted again in ``SPLIT`` finer bins, and so on. A
   round narrows a segment by that factor, so a handful of rounds reaches single values.

Nothing is sorted or shuffled but partial counts: a round's result has at most
``SPLIT`` rows a segment. Results are exact and equal to linear interpolation (numpy /
Spark ``percentile`` semantics). ``approx=True`` swaps in ``percentile_approx``.
"""

from __future__ import annotations

import math
from typing import Dict, List, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the first round per unit of the natural logarithm (at most 45,000 over all doubles), and
#: of a segment in the later rounds.
COARSE, SPLIT = 32, 2048
#: Columns of a block of correlations.
BLOCK = 128


def to_long(df: DataFrame, cols: Sequence[str], value_type: str = "double") -> DataFrame:
    """Unpivot ``cols`` to ``(k, x)``; NULL and NaN values are dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast(value_type).alias("x"))
                      for c in cols])
    out = df.select(F.inline(pairs))
    cond = F.col("x").isNotNull()
    if value_type == "double":
        cond = cond & ~F.isnan("x")
    return out.where(cond)


def _first_bins(long: DataFrame):
    x = F.col("x")
    key = F.floor(F.signum(x) * F.log1p(F.abs(x)) * COARSE)  # rises with x
    return long.groupBy("k", key.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()


def _split_segments(df: DataFrame, segments: Dict[str, list]):
    """Counts of the segments' rows in finer bins; ``segments``: column -> [(lo, hi), ...]."""
    rows = [(c, i, lo, hi) for c, found in segments.items() for i, (lo, hi) in enumerate(found)]
    # as many rows as wanted ranks at most
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "c string, seg int, lo double, hi double"))
    x = F.col("x")
    inside = to_long(df, list(segments)).join(table, (F.col("k") == F.col("c")) & (x >= F.col("lo")) & (x <= F.col("hi")))
    key = F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * SPLIT)
    return inside.groupBy("k", "seg", key.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()


def _locate(bins: list, base: int, ranks: set, found: dict) -> List[tuple]:
    """Ranks inside single-valued bins go to ``found``; the rest come back as (lo, hi, base, ranks)."""
    rest = []
    for r in sorted(bins, key=lambda r: r["lo"]):
        mine = {k for k in ranks if base <= k < base + r["n"]}
        if mine and r["lo"] == r["hi"]:
            found.update(dict.fromkeys(mine, r["lo"]))
        elif mine:
            rest.append((r["lo"], r["hi"], base, mine))
        base += r["n"]
    return rest


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    approx: bool = False, accuracy: int = 100000) -> Dict[str, List[float]]:
    """``{column: [q(p) for p in probs]}``; columns without values map to NaNs."""
    cols = list(cols)
    probs = [float(p) for p in probs]
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c)
                       for c in cols]).first()
        return {c: [float(v) if v is not None else math.nan for v in (row[c] or [None] * len(probs))]
                for c in cols}
    bins: Dict[str, list] = {c: [] for c in cols}
    for r in _first_bins(to_long(df, cols)):
        bins[r["k"]].append(r)
    total = {c: sum(r["n"] for r in bins[c]) for c in cols}
    at = {c: [p * (total[c] - 1) for p in probs] for c in cols}
    found: Dict[str, dict] = {c: {} for c in cols}
    open_ = {}
    for c in cols:
        ranks = {f(x) for x in at[c] for f in (math.floor, math.ceil)} if total[c] else set()
        open_[c] = _locate(bins[c], 0, ranks, found[c])
    while open_ := {c: v for c, v in open_.items() if v}:
        parts: Dict[tuple, list] = {}
        for r in _split_segments(df, {c: [(lo, hi) for lo, hi, _, _ in v] for c, v in open_.items()}):
            parts.setdefault((r["k"], r["seg"]), []).append(r)
        open_ = {c: [x for i, (_, _, base, ranks) in enumerate(v) for x in _locate(parts[c, i], base, ranks, found[c])]
                 for c, v in open_.items()}

    def value(c, x):
        lo, hi = found[c][math.floor(x)], found[c][math.ceil(x)]
        return lo + (hi - lo) * (x - math.floor(x)) if hi != lo else lo

    return {c: [value(c, x) for x in at[c]] if total[c] else [math.nan] * len(probs) for c in cols}


def medians(df: DataFrame, cols: Sequence[str], approx: bool = False) -> Dict[str, float]:
    q = exact_quantiles(df, cols, [0.5], approx=approx)
    return {c: v[0] for c, v in q.items()}


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col1, col2, n, correlation) of every pair of columns, earlier column first; rows that lack
    either value are left out of the pair; no correlation without spread.

    Every task adds up the products of its rows, all columns at once (values around the columns'
    means, presence masks for missing ones), and hands its sums on in blocks of ``BLOCK`` x
    ``BLOCK`` columns; a block's sums of all tasks are added where the block is dealt to."""
    import numpy as np
    import pyarrow as pa

    cols = list(cols)
    k = len(cols)
    means = {r["k"]: r["m"] for r in to_long(df, cols).groupBy("k").agg(F.avg("x").alias("m")).collect()}
    middle = np.array([means.get(c) or 0.0 for c in cols])
    starts = list(range(0, k, BLOCK))

    def sums(batches):
        parts = np.zeros((4, k, k))  # rows with both; sum of a, of a * a where b is there; sum of a * b
        for batch in batches:
            flat = batch.column(0).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, k) - middle
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            mask = there.astype(float)
            parts += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        rows = [(a, b, parts[:, a:a + BLOCK, b:b + BLOCK].tobytes(), parts[:, b:b + BLOCK, a:a + BLOCK].tobytes())
                for i, a in enumerate(starts) for b in starts[i:]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["a", "b", "ab", "ba"])

    def added(batches):
        total: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                na, nb = min(BLOCK, k - r["a"]), min(BLOCK, k - r["b"])
                ab = np.frombuffer(r["ab"]).reshape(4, na, nb)
                ba = np.frombuffer(r["ba"]).reshape(4, nb, na).transpose(0, 2, 1)
                both = np.concatenate([ab, ba[1:3]])
                total[r["a"], r["b"]] = total.get((r["a"], r["b"]), 0) + both
        for (a, b), (n, sa, qa, sab, sb, qb) in total.items():
            with np.errstate(all="ignore"):
                va, vb, c = qa - sa * sa / n, qb - sb * sb / n, sab - sa * sb / n
                r = c / np.sqrt(va * vb)
                r[(va <= 1e-14 * qa) | (vb <= 1e-14 * qb)] = np.nan
            i, j = np.nonzero(np.arange(a, a + r.shape[0])[:, None] < np.arange(b, b + r.shape[1])[None, :])
            value = r[i, j]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cols[x] for x in (a + i).tolist()], pa.string()), pa.array([cols[x] for x in (b + j).tolist()], pa.string()),
                 pa.array(n[i, j].astype(np.int64)), pa.array(np.clip(value, -1, 1), mask=~np.isfinite(value))], names=["col1", "col2", "n", "correlation"])

    one = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    parts = one.mapInArrow(sums, "a long, b long, ab binary, ba binary")
    blocks = len(starts) * (len(starts) + 1) // 2
    return parts.repartition(min(blocks, 256), "a", "b").mapInArrow(added, "col1 string, col2 string, n long, correlation double")


def modes_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column; ties -> smallest.

    Numeric ties break on numeric order, text on string order. Fully
    distributed: a value-count shuffle, then ``min`` over a struct (partial
    aggregation applies, no group is ever collected).
    """
    types = dict(df.dtypes)
    parts = []
    for c in cols:
        numeric = types[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or \
            types[c].startswith("decimal")
        parts.append(F.struct(
            F.lit(c).alias("k"),
            (F.col(c).cast("double") if numeric else F.lit(None).cast("double")).alias("xn"),
            F.col(c).cast("string").alias("xs")))
    long = df.select(F.inline(F.array(*parts))).where(F.col("xs").isNotNull())
    counts = long.groupBy("k", "xn", "xs").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("k").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), "xn", "xs")).alias("b"))
    return best.select(F.col("k").alias("column_name"), F.col("b.xs").alias("mode_value"),
                       (-F.col("b.neg_n")).alias("mode_count"))


def modes(df: DataFrame, cols: Sequence[str]) -> Dict[str, str]:
    if not cols:
        return {}
    return {r["column_name"]: r["mode_value"] for r in modes_frame(df, cols).collect()}
