"""End-to-end cleaning as a fitted, repeatable plan.

``fit_and_clean`` walks the fixed order

    no-data words -> parse -> impute -> invalid values -> duplicates ->
    spellings (case, fuzzy groups, abbreviations) -> rating -> caps -> formulas -> types

Every fitted value (medians, modes, models, mappings, bounds) is computed by a
distributed job on the stage it applies to and kept in a :class:`CleaningPlan`; models and
mappings are stored tables. ``apply_plan`` applies the same plan to new data:
row-wise expressions and joins with the stored tables, plus the key de-duplication.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from typing import Dict, List, Optional, Tuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions import scalars as S
from kpiforge.functions.stats import medians, modes, pair_correlations
from kpiforge.operators import canon as C
from kpiforge.operators import repair as R
from kpiforge.operators import semantic as SEM
from kpiforge.operators.detect import outlier_counts
from kpiforge.operators.forest import ForestModel, apply_forest, context_columns, fit_forest
from kpiforge.operators.knn import impute_knn
from kpiforge.operators.profile import distinct_counts, is_numeric_dtype
from kpiforge.session import cut_lineage, cut_table, scratch_path, write_table


@dataclass
class CleaningPlan:
    as_of: _dt.date
    semantics: Dict[str, dict] = field(default_factory=dict)                     # the input's semantic map
    numeric_cols: List[str] = field(default_factory=list)
    bool_cols: List[str] = field(default_factory=list)
    date_formats: Dict[str, Optional[str]] = field(default_factory=dict)        # date column -> voted format
    epoch_cols: List[str] = field(default_factory=list)
    key_col: Optional[str] = None
    qty: Optional[str] = None
    price: Optional[str] = None
    total: Optional[str] = None
    discount: Optional[str] = None
    profit: Optional[Tuple[str, str, str, str]] = None                          # total price, cost, quantity, profit
    strategies: Dict[str, "Strategy"] = field(default_factory=dict)
    nulls: Dict[str, int] = field(default_factory=dict)                         # missing cells before imputation
    fills: Dict[str, object] = field(default_factory=dict)
    forests: Dict[str, ForestModel] = field(default_factory=dict)
    knn: Dict[str, Tuple[List[str], str]] = field(default_factory=dict)         # column -> (features, stored donors)
    qty_cols: List[str] = field(default_factory=list)
    neg_medians: Dict[str, float] = field(default_factory=dict)
    case_cols: List[str] = field(default_factory=list)
    spelling_path: Optional[str] = None                                         # stored (column, from, to, step)
    spelling_counts: Dict[Tuple[str, str], int] = field(default_factory=dict)   # (column, step) -> spellings mapped
    rating_medians: Dict[str, float] = field(default_factory=dict)
    cap_bounds: Dict[str, Tuple[float, float]] = field(default_factory=dict)
    money_cols: List[str] = field(default_factory=list)
    rows_in: int = 0

    @property
    def date_cols(self) -> List[str]:
        return [*self.date_formats, *self.epoch_cols]


@dataclass(frozen=True)
class Strategy:
    name: str
    confidence: float
    reason: str


@dataclass(frozen=True)
class ColumnFacts:
    """What the choice of an imputation depends on."""
    null_pct: float
    available: int
    numeric: bool = False
    semantic_type: str = "Unknown"
    formula_output: bool = False
    identity: bool = False
    flag: bool = False
    distinct_ratio: float = 0.0
    context: Tuple[str, ...] = ()
    correlated: Tuple[str, ...] = ()


# --- fixed values: name words of columns that are never imputed --------------
IDENTITY_WORDS = ("id", "phone", "mobile", "email", "mail", "name", "address", "url", "uuid", "guid")
FOREST_TYPES = ("ProductID", "ProductName", "CustomerID")


def is_identity(name: str, semantic_type: str) -> bool:
    return semantic_type in K.ID_SEMANTIC_TYPES or any(w in name.lower().replace(" ", "_") for w in IDENTITY_WORDS)


def select_strategy(f: ColumnFacts, models: bool = True) -> Strategy:
    """impute_select: the first rung that holds."""
    enough = models and f.available >= K.ML_MIN_TRAINING_SAMPLES and f.null_pct <= K.ML_MAX_MISSING_PERCENT
    few = f.null_pct < K.SIMPLE_METHOD_THRESHOLD
    simple = "few missing" if few else "no model applies"
    rungs = (
        (f.null_pct == 0, "none", 1.0, "no missing values"),
        (f.null_pct > K.MAX_NULL_PERCENT, "skip", 0.2, "too sparse"),
        (f.identity, "skip_identity", 0.9, "identity or contact column"),
        (f.formula_output or f.semantic_type == "TotalAmount", "calculate", 1.0, "recomputed from its formula"),
        (few and f.numeric, "median", 0.75, simple),
        (not few and f.semantic_type in FOREST_TYPES and len(f.context) >= K.ML_MIN_CONTEXT_FEATURES and enough,
         "random_forest", 0.88, "context " + ", ".join(f.context)),
        (not few and f.numeric and len(f.correlated) >= K.ML_MIN_CONTEXT_FEATURES and enough, "knn", 0.85, "correlated " + ", ".join(f.correlated)),
        (f.numeric, "median_fallback", 0.60, simple),
        (f.semantic_type == "Discount" or f.flag, "business_false", 0.85, "an unknown flag counts as no"),
        (f.distinct_ratio > 0.5, "identifier_unknown", 0.5, "mostly distinct values"),
        (few, "mode", 0.70, simple),
        (True, "mode_fallback", 0.55, simple),
    )
    return next(Strategy(name, confidence, why) for holds, name, confidence, why in rungs if holds)


def column_facts(df: DataFrame, smap: Dict[str, dict], total: Optional[str]) -> Dict[str, ColumnFacts]:
    """The facts of every column, from one value count, one scan of nulls and one of correlations."""
    types = dict(df.dtypes)
    numeric = [c for c in df.columns if is_numeric_dtype(types[c])]
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in df.columns]).first()
    n = counts["__n"]
    filled = {c: counts[c] / max(n, 1) for c in df.columns}
    gaps = [c for c in df.columns if counts[c] < n]
    text_gaps = [c for c in gaps if types[c] == "string"]
    distinct = distinct_counts(df, text_gaps) if text_gaps else {}
    near: Dict[str, list] = {c: [] for c in numeric}
    if any(c in numeric for c in gaps) and len(numeric) > 1:
        for r in pair_correlations(df, numeric).where(F.abs("correlation") > K.CORRELATION_KEEP).collect():
            near[r["col1"]].append(r["col2"])
            near[r["col2"]].append(r["col1"])
    out = {}
    for c in df.columns:
        sem = smap.get(c, {}).get("semantic_type", "Unknown")
        out[c] = ColumnFacts(
            null_pct=(n - counts[c]) * 100.0 / n if n else 0.0, available=counts[c], numeric=c in numeric, semantic_type=sem,
            formula_output=c == total, identity=is_identity(c, sem), flag=types[c] == "boolean",
            distinct_ratio=distinct[c][1] / max(n, 1) if c in distinct else 0.0, context=tuple(context_columns(df.columns, c, sem, filled)),
            correlated=tuple(x for x in near.get(c, ()) if filled[x] > K.CONTEXT_FILLED_MIN))
    return out


def fit_and_clean(df: DataFrame, as_of: _dt.date, use_fuzzy: bool = True, models: bool = True) -> Tuple[DataFrame, CleaningPlan]:
    plan = CleaningPlan(as_of=as_of)
    facts = SEM.value_facts(df, _parse_facts(df))
    smap = plan.semantics = SEM.semantic_map(df, facts)
    _fit_parse(df, facts, smap, plan)
    s2 = cut_table(_parse(df, plan), "parsed")  # every fitted statistic below reads this parsed table, not the source
    sem = {c: smap[c]["semantic_type"] for c in df.columns}
    rel = SEM.multiplication_columns(s2, smap)
    if rel:
        plan.qty, plan.price, plan.total, plan.discount = (*rel, None)[:4]
    plan.key_col = next((c for c in df.columns if sem[c] == "TransactionID"), None)
    _fit_imputation(s2, smap, plan, models)
    s3 = _impute(s2, plan)
    _fit_invalid(s3, sem, plan)
    s5 = cut_table(_dedup(_repair_values(s3, plan), plan), "kept")
    _fit_spellings(s5, smap, plan, use_fuzzy)
    s7 = _spell(s5, plan)
    _fit_ratings_and_caps(s7, plan)
    return _finish(s7, plan), plan


def apply_plan(df: DataFrame, plan: CleaningPlan, dedup: bool = True) -> DataFrame:
    """Re-apply a fitted plan to new data of the same shape (no re-fitting)."""
    out = _repair_values(_impute(_parse(df, plan), plan), plan)
    if dedup:
        out = _dedup(out, plan)
    return _finish(_spell(out, plan), plan)


# ----------------------------------------------------------------- parsing
def _probed(df: DataFrame) -> Tuple[List[str], List[str]]:
    """(text columns that may be numbers or flags, columns that may be dates or epochs); identity columns stay text."""
    types = dict(df.dtypes)
    probe_cols = [c for c in df.columns if types[c] == "string" and not R.is_identity_name(c)]
    named = SEM.date_named(df)
    dated = [c for c in df.columns if not R.is_identity_name(c) and (types[c] == "string" or is_numeric_dtype(types[c]))
             and (any(w in c.lower() for w in ("date", "time")) or c in named)]
    return probe_cols, dated


def _parse_facts(df: DataFrame) -> Dict[str, Column]:
    """Aggregates over the value counts of the columns: values filled, and those that are numbers, flags, epochs or dates
    in every format, with no-data words taken for missing."""
    probe_cols, dated = _probed(df)
    s, value, text = F.col("s"), F.col("filled"), F.col("dtype") == "string"
    probed, may_date = (F.col("column_name").isin(cols or ["__none__"]) & value for cols in (probe_cols, dated))
    x = F.when(may_date, F.when(text, S.num_parse(s)).otherwise(s.try_cast("double")))
    facts = {"filled": value, "num": F.when(probed, S.num_currency(s)).isNotNull(), "flag": F.when(probed, S.bool_word(s)).isNotNull(),
             "dx": x.isNotNull(), "epoch": x.between(1e9, 2e10) | x.between(1e12, 2e13)}
    facts.update({f"format_{k}": F.when(may_date & text, S.parse_date_formats(S.strip_ws(s), [sp], stripped=True)).isNotNull()
                  for k, (_, sp) in enumerate(K.DATE_FORMATS)})
    return {name: SEM.weighted(cond) for name, cond in facts.items()}


def _fit_parse(df: DataFrame, facts: Dict[str, Row], smap: Dict[str, dict], plan: CleaningPlan) -> None:
    """Which text columns are numbers, flags, dates (and in which format) or epochs."""
    types = dict(df.dtypes)
    probe_cols, dated = _probed(df)
    plan.rows_in = facts[df.columns[0]]["n"]
    for c in dated:
        if not any(w in c.lower() for w in ("date", "time")) and smap[c]["expected_dtype"] != "datetime":
            continue
        r = facts[c]
        if r["dx"] > 0.8 * max(r["filled"], 1) and r["epoch"] > 0.8 * r["dx"]:
            plan.epoch_cols.append(c)
        elif types[c] == "string" and r["dx"] <= 0.6 * r["filled"]:
            votes = [r[f"format_{k}"] for k in range(len(K.DATE_FORMATS))]
            # most parsed wins, the first format on ties
            plan.date_formats[c] = K.DATE_FORMATS[votes.index(max(votes))][1] if max(votes) else None
    for c in probe_cols:
        if c in plan.date_cols:
            continue
        r = facts[c]
        if S.name_has_any(c, K.BOOL_NAME_KEYWORDS) and r["flag"] > r["n"] * 0.5:
            plan.bool_cols.append(c)
        elif smap[c]["expected_dtype"] in ("integer", "float") or (r["filled"] and r["num"] / r["filled"] > 0.6):
            plan.numeric_cols.append(c)


def _parse(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """No-data words to NULL, then numbers, flags (another word counts as no) and dates."""
    types = dict(df.dtypes)
    out = R.null_sentinels(df, [c for c in df.columns if types[c] == "string"])
    new = {c: S.num_currency(c) for c in plan.numeric_cols}
    new.update({c: F.when(F.col(c).isNotNull(), F.coalesce(S.bool_word(c), F.lit(False))) for c in plan.bool_cols})
    new.update({c: S.parse_date_formats(c, S.ordered_formats(f)) for c, f in plan.date_formats.items()})
    new.update({c: S.epoch_to_date(S.num_parse(c) if types[c] == "string" else F.col(c).cast("double"), plan.as_of.year) for c in plan.epoch_cols})
    return R.replace_columns(out, new)


# ----------------------------------------------------------------- missing values
def _fit_imputation(df: DataFrame, smap: Dict[str, dict], plan: CleaningPlan, models: bool) -> None:
    facts = column_facts(df, smap, plan.total)
    plan.strategies = {c: select_strategy(f, models) for c, f in facts.items()}
    plan.nulls = {c: plan.rows_in - f.available for c, f in facts.items()}
    by: Dict[str, list] = {}
    for c, s in plan.strategies.items():
        by.setdefault(s.name.removesuffix("_fallback"), []).append(c)
    med = medians(df, by["median"]) if "median" in by else {}
    plan.fills.update({c: 0.0 if v != v else v for c, v in med.items()})
    mod = modes(df, by["mode"]) if "mode" in by else {}
    plan.fills.update({c: mod[c] for c in by.get("mode", ()) if mod.get(c) is not None})
    plan.fills.update({c: False for c in by.get("business_false", ())})
    plan.fills.update({c: "unknown" for c in by.get("identifier_unknown", ())})
    for c in by.get("random_forest", ()):
        plan.forests[c] = fit_forest(df, c, facts[c].context)
    for c in by.get("knn", ()):
        path = scratch_path(df.sparkSession, f"donors-{S.compact_name(c)}")
        write_table(df.where(F.col(c).isNotNull()).select(c, *facts[c].correlated), path)
        plan.knn[c] = (list(facts[c].correlated), path)


def _impute(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Models first: they read the columns as they came, not filled ones."""
    out = df
    for c, model in plan.forests.items():
        out = apply_forest(out, model)
    for c, (features, path) in plan.knn.items():
        out = impute_knn(out, c, features, donors=df.sparkSession.read.parquet(path))
    types = dict(df.dtypes)
    return R.replace_columns(out, {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in plan.fills.items()})


# ----------------------------------------------------------------- invalid values, duplicates
def _fit_invalid(df: DataFrame, sem: Dict[str, str], plan: CleaningPlan) -> None:
    types = dict(df.dtypes)
    numeric = [c for c in df.columns if is_numeric_dtype(types[c]) and not R.is_identity_name(c)]
    plan.qty_cols = [c for c in numeric if sem[c] == "Quantity" or c == plan.qty]
    plan.money_cols = [c for c in numeric if c not in plan.qty_cols and (sem[c] in ("Price", "TotalAmount") or c in (plan.price, plan.total)
                                                                          or S.name_has_any(c, R.MONEY_NAME_WORDS))]
    if plan.money_cols:
        m = medians(df.select(*[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in plan.money_cols]), plan.money_cols)
        plan.neg_medians = {c: v for c, v in m.items() if v == v}
    names = {S.compact_name(c): c for c in df.columns}
    parts = (names.get("totalprice"), names.get("cost"), names.get("quantity") or names.get("qty"), names.get("profit"))
    plan.profit = parts if None not in parts else None


def _repair_values(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    new = {}
    for c in plan.qty_cols:
        new[c] = F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.abs(F.col(c)))
    for c, m in plan.neg_medians.items():
        new[c] = F.when(F.col(c) < 0, F.lit(m)).otherwise(F.col(c))
    for c in plan.date_cols:
        new[c] = F.when(F.col(c) > F.lit(plan.as_of), F.lit(plan.as_of)).otherwise(F.col(c))
    return R.replace_columns(df, new)


def _dedup(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Exact copies go; of the rows with one transaction id the first stays (one pass)."""
    return R.dedup_key(df, plan.key_col, copies=False) if plan.key_col else R.dedup_rows(df)


# ----------------------------------------------------------------- spellings
def _fit_spellings(df: DataFrame, smap: Dict[str, dict], plan: CleaningPlan, use_fuzzy: bool) -> None:
    """One stored mapping for all columns: case and blanks, then fuzzy groups, then abbreviations.

    Only the table of distinct spellings moves; each step maps what the one before has left."""
    # identifiers look alike without being misspelt
    plan.case_cols = [c for c in C.canon_pick(df, smap) if c != plan.key_col and not is_identity(c, smap[c]["semantic_type"])]
    if not plan.case_cols:
        return
    spark = df.sparkSession
    vt = cut_lineage(C.value_tables(R.trim_text(df, plan.case_cols), plan.case_cols))
    all_ = vt.select("column_name", F.col("orig").alias("from_value"), F.col("orig").alias("to_value"), F.lit("").alias("step"))
    for step in ("case", "fuzzy", "abbreviation"):
        if step == "fuzzy" and not use_fuzzy:
            continue
        mapping = {"case": C.case_mapping_vt, "fuzzy": C.fuzzy_mapping_vt, "abbreviation": C.abbreviation_mappings}[step](vt)
        mapping = cut_lineage(mapping.select("column_name", F.col("from_value").alias("to_value"), F.col("to_value").alias("next")))
        all_ = cut_lineage(all_.join(mapping, ["column_name", "to_value"], "left").select(
            "column_name", "from_value", F.coalesce("next", "to_value").alias("to_value"),
            F.when(F.col("next").isNotNull(), F.lit(step)).otherwise(F.col("step")).alias("step")))
        vt = C.remap_values(vt, mapping.select("column_name", F.col("to_value").alias("from_value"), F.col("next").alias("to_value")))
    plan.spelling_path = scratch_path(spark, "spellings")
    all_.where(F.col("from_value") != F.col("to_value")).write.parquet(plan.spelling_path)
    stored = spark.read.parquet(plan.spelling_path)
    plan.spelling_counts = {(r["column_name"], r["step"]): r["count"] for r in stored.groupBy("column_name", "step").count().collect()}


def _spell(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    out = R.trim_text(df, plan.case_cols)
    for c in dict.fromkeys(c for c, _ in plan.spelling_counts):
        m = df.sparkSession.read.schema("column_name string, from_value string, to_value string, step string").parquet(plan.spelling_path)
        out = R.map_values(out, c, m.where(F.col("column_name") == c))
    return out


# ----------------------------------------------------------------- ratings, caps, formulas, types
def _fit_ratings_and_caps(df: DataFrame, plan: CleaningPlan) -> None:
    types = dict(df.dtypes)
    numeric = [c for c in df.columns if is_numeric_dtype(types[c]) and not R.is_identity_name(c)]
    rating = [c for c in numeric if S.name_has_any(c, K.RATING_NAME_KEYWORDS)]
    if rating:
        m = medians(df.select(*[F.when(F.col(c) <= 5, F.col(c).cast("double")).alias(c) for c in rating]), rating)
        plan.rating_medians = {c: v for c, v in m.items() if v == v}
    computed = {plan.total, plan.profit[3] if plan.profit else None}
    inputs = [c for c in numeric if c not in computed]
    if inputs:
        clamped = _clamp_ratings(df, plan)
        found = {r["column_name"]: r for r in outlier_counts(clamped, inputs).collect()}
        plan.cap_bounds = {c: (max(r["lower"], 0.0) if c in plan.money_cols + plan.qty_cols else r["lower"], r["upper"])
                           for c, r in found.items() if r["iqr_count"] > 0}


def _clamp_ratings(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    return R.replace_columns(df, {c: F.when(F.col(c) > 5, F.lit(v)).otherwise(F.col(c).cast("double")) for c, v in plan.rating_medians.items()})


def _finish(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    out = R.cap_outliers(_clamp_ratings(df, plan), plan.cap_bounds)
    if plan.total:
        out = R.recalc_total(out, plan.qty, plan.price, plan.total, plan.discount)
    if plan.profit:
        out = R.recalc_profit(out, *plan.profit)
    new = {c: F.col(c).cast("long") if c in plan.qty_cols else F.round(F.col(c), 2) for c in plan.numeric_cols}
    new.update({c: S.date_in_range(F.col(c), plan.as_of.year) for c in plan.date_cols})
    return R.replace_columns(out, new)


def plan_table(spark, plan: CleaningPlan) -> DataFrame:
    """The fitted plan as rows: (step, column_name, method, value, status, confidence)."""
    rows = []
    for c, s in plan.strategies.items():
        value = {**{k: str(v) for k, v in plan.fills.items()}}.get(c, s.reason)
        rows.append(("impute", c, s.name, value, "skipped" if s.name.startswith("skip") or s.name == "none" else "done", s.confidence))
    for c in plan.qty_cols:
        rows.append(("invalid", c, "absolute_value", "0 becomes 1", "done", 0.75))
    for c, m in plan.neg_medians.items():
        rows.append(("invalid", c, "negative_to_median", str(m), "done", 0.75))
    for c, f in plan.date_formats.items():
        rows.append(("dates", c, "voted_format", str(f), "done" if f else "skipped", 0.6))
    rows += [("dates", c, "epoch", "seconds or milliseconds", "done", 0.6) for c in plan.epoch_cols]
    rows += [("flags", c, "boolean_words", "", "done", 0.85) for c in plan.bool_cols]
    for (c, step), n in sorted(plan.spelling_counts.items()):
        rows.append((step, c, "canonical_spelling", str(n), "done", 0.8))
    for c, v in plan.rating_medians.items():
        rows.append(("rating", c, "above_5_to_median", str(v), "done", 0.8))
    for c, (lo, hi) in plan.cap_bounds.items():
        rows.append(("cap", c, "iqr_clip", f"{lo}..{hi}", "done", 0.8))
    if plan.total:
        rows.append(("formula", plan.total, "recalculated", f"{plan.qty} x {plan.price}", "done", 1.0))
    return spark.createDataFrame(rows, "step string, column_name string, method string, value string, status string, confidence double")
