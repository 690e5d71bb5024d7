"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Four rule scores per text: symbol share, exclamation share, share of words in repeated
3-word windows, share of repeated lines. A strictness level ``t`` scales all four limits
together (``LIMITS[rule] * t``), so every level is one candidate cut-off vector and a
stricter level rejects a superset of a laxer one.

For each stratum and level, labelled clean texts give ``n`` trials and ``k`` false
rejections. The level is certified when the exact binomial tail P(Bin(n, alpha) <= k) is at
most ``delta / tests`` (Bonferroni over strata x levels); with probability 1 - delta no
certified level rejects more than ``alpha`` of the clean texts of its stratum. Among the
certified levels of a stratum the one with the best balance (junk caught minus
``clean_cost`` times clean rejected) is chosen, the laxest at ties. A stratum without a
certified level rejects nothing beyond the base rule.

Edge cases: null text counts as no words (base rule fails); a null stratum is the stratum
``""``; repeated rows are scored each on their own; an empty or unlabelled table certifies
nothing; a null label is no label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import WORD_PATTERN, stored, text_or_empty

#: Limits of the four rules at strictness 1.0.
LIMITS = {"symbol_share": 0.10, "exclaim_share": 0.10, "repeat_share": 0.40, "dup_line_share": 0.60}
#: Candidate strictness levels, fixed before any label is seen.
LEVELS = (1.6, 1.3, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3)
ALPHA, DELTA, CLEAN_COST = 0.05, 0.05, 10.0
_P = "__qr_"


def add_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the counts of the contract under ``__qr_`` names (one pass, no shuffle).

    A window is compared by the XXH64 of its three words within one text. Texts without a
    repeated window stop after one hash-set pass; the others sort (window, position).
    """
    c = lambda n: F.col(_P + n)
    text = text_or_empty(docs, text_col)
    out = docs.withColumn(_P + "t", text)
    out = out.withColumn(_P + "w", F.regexp_extract_all(c("t"), F.lit(WORD_PATTERN), F.lit(0)))
    out = out.withColumn(_P + "n_words", F.size(c("w")).cast("long"))
    hashes = F.transform(F.sequence(F.lit(0), F.size(c("w")) - 3),
                         lambda i: F.xxhash64(c("w")[i], c("w")[i + 1], c("w")[i + 2]))
    out = out.withColumn(_P + "h", F.when(c("n_words") >= 3, hashes)
                         .otherwise(F.array().cast("array<bigint>")))
    ranked = F.array_sort(F.transform(c("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(_P + "s", F.when(F.size(F.array_distinct(c("h"))) < F.size(c("h")), ranked))
    twice = F.filter(c("s"), lambda x, i: ((i > 0) & (F.get(c("s"), i - 1)["h"] == x["h"]))
                     | ((i < F.size(c("s")) - 1) & (F.get(c("s"), i + 1)["h"] == x["h"])))
    covered = F.size(F.array_distinct(F.flatten(
        F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    out = out.withColumn(_P + "n_repeat_words",
                         F.when(c("s").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    out = out.withColumn(_P + "word_chars", F.length(F.array_join(c("w"), "")).cast("long"))
    out = out.withColumn(_P + "n_symbols", F.regexp_count(c("t"), F.lit(r"[#*$%&|<>]")).cast("long"))
    out = out.withColumn(_P + "n_exclaim",
                         (F.length(c("t")) - F.length(F.replace(c("t"), F.lit("!"), F.lit("")))).cast("long"))
    out = out.withColumn(_P + "l", F.filter(F.split(c("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn(_P + "n_lines", F.size(c("l")).cast("long"))
    out = out.withColumn(_P + "n_dup_lines",
                         (F.size(c("l")) - F.size(F.array_distinct(c("l")))).cast("long"))
    return out.drop(*[_P + n for n in ("t", "w", "h", "s", "l")])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaim", "n_lines")


def base_failed() -> Column:
    n, r = F.col(_P + "n_words"), F.col(_P + "n_repeat_words")
    return (n < 50) | (F.lit(100) * r > F.lit(50) * n)


def strictness_hit() -> Column:
    """The smallest strictness ratio at which the text is rejected is 1 / this value:
    the largest rule score relative to its limit (0 for a text without words)."""
    c = lambda n: F.col(_P + n)
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return F.greatest(share("n_symbols", "word_chars") / LIMITS["symbol_share"],
                      share("n_exclaim", "word_chars") / LIMITS["exclaim_share"],
                      share("n_repeat_words", "n_words") / LIMITS["repeat_share"],
                      share("n_dup_lines", "n_lines") / LIMITS["dup_line_share"])


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), exact, by the recurrence of the log terms.

    Only needed while k < n * alpha; above that the tail is over 0.4 and never certifies,
    so 1.0 is returned without summing."""
    step = F.log(F.lit(alpha / (1 - alpha)))
    start = F.struct((n * F.log(F.lit(1.0 - alpha))).alias("term"),
                     (n * F.log(F.lit(1.0 - alpha))).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + step
        hi, lo = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (hi + F.log1p(F.exp(lo - hi))).alias("total"))

    summed = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k))
                         .otherwise(F.array().cast("array<bigint>")), start, add,
                         lambda acc: F.exp(acc["total"]))
    return F.when(k < n * alpha, summed).otherwise(F.lit(1.0))


def certify(scored: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
            clean_cost: float = CLEAN_COST, levels=LEVELS) -> DataFrame:
    """``scored(stratum, hit, clean)`` -> one row per stratum: stratum, level, cutoff.

    ``hit`` is ``strictness_hit()``; a text is rejected at level t when hit > t. Only
    aggregates of strata x levels rows leave the tasks."""
    bins = scored.groupBy("stratum").agg(
        F.count(F.when(F.col("clean"), 1)).alias("n"),
        *[F.count(F.when(F.col("clean") & (F.col("hit") > t), 1)).alias(f"k{i}") for i, t in enumerate(levels)],
        *[F.count(F.when(~F.col("clean") & (F.col("hit") > t), 1)).alias(f"j{i}") for i, t in enumerate(levels)])
    rows = bins.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(t).cast("double").alias("level"), F.col(f"k{i}").alias("k"), F.col(f"j{i}").alias("junk"))
        for i, t in enumerate(levels)])).alias("x")).select("stratum", "n", "x.*")
    tests = rows.agg(F.count("*").alias("tests"))
    judged = rows.join(F.broadcast(tests), F.lit(True))  # one row
    judged = judged.where(binomial_tail(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("tests"))
    judged = judged.withColumn("gain", F.col("junk") - F.lit(clean_cost) * F.col("k"))
    return judged.groupBy("stratum").agg(
        F.max(F.struct("gain", "level", "n", "k")).alias("best")).select("stratum", F.col("best.level").alias("cutoff"))


def score_documents(docs: DataFrame, stratum_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``docs`` plus the counts, ``__qr_base_failed``, ``__qr_hit`` and ``__qr_stratum``."""
    out = add_counts(docs, text_col)
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    return out.withColumns({_P + "base_failed": base_failed(), _P + "hit": strictness_hit(), _P + "stratum": stratum})


def thresholds(scored: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Cut-offs per stratum from the labelled rows of ``scored`` (columns only, no text).
    Labels with several rows for one doc_id count as clean if any row says so. The result is
    stored, so Spark knows its size when it plans the join that applies it."""
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.max("quality") == 1).alias("clean"))
    held = scored.where(~F.col(_P + "base_failed")).select(
        "doc_id", F.col(_P + "stratum").alias("stratum"), F.col(_P + "hit").alias("hit"))
    return stored(certify(held.join(lab, "doc_id").select("stratum", "hit", "clean"), **options), "quality-cutoffs")


def verdicts(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``scored`` plus ``__qr_kept``. The cut-off table has one row per stratum."""
    cut = cutoffs.select(F.col("stratum").alias(_P + "stratum"), F.col("cutoff").alias(_P + "cutoff"))
    rejected = F.col(_P + "hit") > F.coalesce(F.col(_P + "cutoff"), F.lit(float("inf")))
    return scored.join(cut, _P + "stratum", "left").withColumn(
        _P + "kept", ~F.col(_P + "base_failed") & ~rejected)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``op8``: counts, base verdict and final verdict per document."""
    light = docs.select("doc_id", "lang", "text")
    cols = ["doc_id"] + [_P + n for n in (*COUNTS, "base_failed", "hit", "stratum")]
    scored = stored(score_documents(light).select(*cols), "quality-scores")
    return verdicts(scored, thresholds(scored, labels)).select(
        "doc_id", *[F.col(_P + n).alias(n) for n in
                    ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.col(_P + "hit").alias("strictness_hit"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline form: the rows of ``docs`` that are kept, with the columns of ``docs``.
    Texts and scores are stored once; the cut-offs come from the score columns alone."""
    scored = stored(score_documents(docs), "quality-docs")
    return verdicts(scored, thresholds(scored, labels)).where(F.col(_P + "kept")).select(*docs.columns)
