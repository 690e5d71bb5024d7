"""Toxicity scores on text restored by a noisy-channel decoder.

1. Character language model: trigram counts over every text of the table (at most 64^3
   numbers, summed by Spark).
2. Restoration: a token that mixes letters with look-alike signs, stretches a letter, or is
   spelled with gaps becomes a lattice of what each sign may stand for; Viterbi decoding
   under the language model picks the likeliest letters. Single letters with white space
   between them are one such token, each gap nothing or a word break. Other tokens stay.
3. Evidence: words and word beginnings (4 to 8 letters) of the restored text, every word of it. Their counts in
   toxic and clean training texts give a weight, the lower confidence bound of the log odds.
4. A logistic regression on a text's strongest weights gives the score. For the training
   texts the weights leave the text itself out, so rare words don't look better than they are.

Training uses labelled rows outside the held-out remainder only, at most ``FIT_LIMIT`` of
each label, chosen by a hash of the id; the label counts of all of them set the prior. Label,
language, source and id are no inputs of a score.

Edge cases: null text counts as empty and is scored like one; null doc_ids are scored, and
never train; several labels of one id count as toxic if any is; without two labels to learn
from every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import stored

FIT_LIMIT, CUTOFF, SUPPORT, Z = 20_000, 0.3, 3, 1.0
CLASSES, MEMO_LIMIT, FLUSH = 64, 300_000, 300_000
PREFIXES = range(4, 9)
#: The letters a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
GAPS = ".-_*~'/\\"
ENDS = ".,;:!?\"'()[]{}<>|*#%&~^=-_/\\"
SUSPECT = re.compile(r"[0-9@$!|+€]|([^\W\d_])\1\1|[^\W\d_][.\-_*~'/\\][^\W\d_]")
#: Three or more single signs with any white space between them.
SPACED = re.compile(r"(?<![^\s\"'(\[{])(?:[^\W_]|[@$])(?:\s+(?:[^\W_]|[@$!€])){2,}(?=[.,;:!?\"')\]}]*(?:\s|\Z))")
#: What parts words: in a restored token any sign, in a raw one those that stand for no letter.
INNER, APART = re.compile(r"[\W\d_]+"), re.compile(r"[^\w@$!|+€]+|_+")
#: Log probabilities of a word break in a spaced run: rare, as likely as none, frequent. How
#: often words are spelled out in a row isn't known, so the words of all three readings count.
BREAKS = (-2.0, -0.3, 1.7)


def class_table() -> np.ndarray:
    """Class of the code points below 0x250: 0 no letter, 1-26 a-z, others 27-63."""
    t = np.zeros(0x250, dtype=np.int64)
    for cp in range(0x250):
        ch = chr(cp).lower()
        if ch.isalpha():
            t[cp] = ord(ch[0]) - 96 if "a" <= ch[0] <= "z" else 27 + ord(ch[0]) % 37
    return t


TABLE = class_table()


def classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where(cp < 0x250, TABLE[np.minimum(cp, 0x24F)], 27 + cp % 37)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts over all texts, as a CLASSES^3 array; partial sums per task, then per trigram."""

    def work(batches):
        total = np.zeros(CLASSES ** 3, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                c = classes(" " + " ".join(t for t in batch.column(0).slice(lo, 256).to_pylist() if t) + " ")
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(work, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES ** 3, dtype=np.int64)
    for r in rows.toLocalIterator():  # at most 64^3 rows
        out[r["g"]] = r["n"]
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by the bigram and unigram shares."""
    c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    uni = (c.sum((0, 1)) + 1) / (c.sum() + CLASSES)
    two = c.sum(0)
    bi = (two + 5 * uni) / (two.sum(1, keepdims=True) + 5)
    tri = (c + 5 * bi[None]) / (c.sum(2, keepdims=True) + 5)
    return np.log(tri).astype(np.float32)


def lattice(token: str, word_break: float = BREAKS[0]) -> list[list[tuple[str, float]]]:
    """Per observed sign what it may stand for, with the channel's log probability."""
    out, i = [], 0
    while i < len(token):
        ch = token[i]
        run = 1
        while token[i + run:i + run + 1] == ch:
            run += 1
        if ch.isalpha() or ch in LOOKALIKES:
            letters = [(ch, 0.0)] if ch.isalpha() else [(x, -0.7) for x in LOOKALIKES[ch]]
            if run >= 3 or (run == 2 and not ch.isalpha()):
                out.append([(x, p - 0.3) for x, p in letters] + [(x + x, 2 * p - 0.6) for x, p in letters])
            else:
                out += [letters] * run
        elif ch == " ":  # between the letters of a spaced run
            out.append([("", -0.3), (" ", word_break)])
        elif ch in GAPS:
            out.append([("", -0.3), (" ", -2.0)])
        else:
            out.append([(" ", 0.0)])
        i += run
    return out


def decode(token: str, model: np.ndarray, word_break: float = BREAKS[0]) -> str:
    """The likeliest letters of a lower-case token of any length: Viterbi over the last two classes."""
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict] = []  # per step: state -> (state before, letters); linear in the length
    cls: dict[str, int] = {}
    for options in [*lattice(token, word_break), [(" ", 0.0)]]:
        nxt: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple] = {}
        for before, score in best.items():
            for letters, p in options:
                (x, y), s = before, score + p
                for ch in letters:
                    k = cls.get(ch)
                    if k is None:
                        k = cls[ch] = int(classes(ch)[0])
                    s += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in nxt or s > nxt[x, y]:
                    nxt[x, y], came[x, y] = s, (before, letters)
        best = nxt
        back.append(came)
    at, out = max(best, key=best.get), []
    for came in reversed(back):
        at, letters = came[at]
        out.append(letters)
    return "".join(reversed(out)).strip()


def restored(token: str, model: np.ndarray, word_break: float = BREAKS[0]) -> str:
    """Word of a lower-case token: ends trimmed, obfuscation undone."""
    core = token.strip(ENDS)
    trimmed = core.rstrip("@$+")
    if not trimmed or len(core) - len(trimmed) < 3:
        trimmed = core
    if (" " in trimmed or SUSPECT.search(trimmed)) and any(ch.isalpha() for ch in trimmed):
        return decode(trimmed, model, word_break)
    return trimmed


def evidence(word: str) -> list[str]:
    return [word + "$", *["^" + word[:k] for k in PREFIXES if k <= len(word)]] if len(word) > 2 else []


def token_words(token: str, model: np.ndarray) -> list[str]:
    """Distinct words of a token after restoration: the whole, what blanks and other signs
    part in it, and the parts of the token as it was written, each restored."""
    whole = restored(token, model)
    if whole.isalpha() and whole == token:
        return [whole]
    found = [w for b in BREAKS for w in restored(token, model, b).split()] if " " in token else whole.split()
    found += [w for part in found if not part.isalpha() for w in INNER.split(part)]
    parts = [p for p in APART.split(token) if len(p) > 2]
    if parts != [token]:
        found += [w for p in parts for w in restored(p, model).split()]
    return list(dict.fromkeys(w for w in found if w))


def token_evidence(token: str, model: np.ndarray) -> list[list[str]]:
    """Evidence of every word of a token."""
    return [e for w in token_words(token, model) if (e := evidence(w))]


def document_tokens(text: str) -> set[str]:
    """Tokens between white space, and spaced runs with one blank for each gap."""
    low = text.lower()
    found = set(low.split())
    for m in SPACED.finditer(low):
        found.add(" ".join(m.group().split()))
    return found


def _feature_counts(rows: DataFrame, model, wanted) -> DataFrame:
    """``rows(text, toxic)`` -> (f, n): texts with the feature; of ``wanted`` only, if given."""

    def work(batches):
        lm, keep = model.value, wanted.value if wanted is not None else None
        counts: dict[str, int] = {}
        memo: dict[str, list[str]] = {}

        def rows_out():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["f", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen: set[str] = set()
                for tok in document_tokens(text):
                    fs = memo.get(tok)
                    if fs is None:
                        fs = [f for e in token_evidence(tok, lm) for f in e if keep is None or f in keep]
                        if len(memo) > MEMO_LIMIT:
                            memo.clear()
                        memo[tok] = fs
                    seen.update(fs)
                for f in seen:
                    counts[f] = counts.get(f, 0) + 1
                if len(counts) > FLUSH:
                    yield rows_out()
        yield rows_out()

    return rows.select("text").mapInArrow(work, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def lower_log_odds(n1, n0, total1: int, total0: int):
    """Lower confidence bound of the smoothed log odds ratio of a feature."""
    raw = np.log((n1 + 0.5) / (total1 + 1)) - np.log((n0 + 0.5) / (total0 + 1))
    return raw - Z * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


def summary(weights: list[float]) -> list[float]:
    """Inputs of the regression: the three strongest words and the sum of ten."""
    top = sorted(weights, reverse=True)[:10] + [0.0] * 3
    return [top[0], top[1], top[2], math.log1p(sum(top))]


def _summaries(texts, lm, table: dict, column: int) -> list[list[float]]:
    memo: dict[str, list[float]] = {}  # per token its words' weights
    out = []
    for text in texts:
        got = []
        for tok in document_tokens(text):
            ws = memo.get(tok)
            if ws is None:
                ws = [max([table[f][column] for f in e if f in table], default=0.0) for e in token_evidence(tok, lm)]
                ws = [w for w in ws if w > 0]
                if len(memo) > MEMO_LIMIT:
                    memo.clear()
                memo[tok] = ws
            got += ws
        out.append(summary(got))
    return out


def held_out_remainder(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class ToxicityModel:
    """Fitted model: broadcast language model and weight table, four coefficients."""

    def __init__(self, lm, table, coefficients, intercept, share):
        self.lm, self.table = lm, table
        self.coefficients, self.intercept, self.share = coefficients, intercept, share

    def score(self, text: Column) -> Column:
        if self.table is None:
            return F.lit(float(self.share))
        lm, table, coef, b = self.lm, self.table, np.array(self.coefficients), self.intercept

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            x = np.array(_summaries(texts, lm.value, table.value, 0)).reshape(-1, 4)
            return pd.Series(1 / (1 + np.exp(-np.clip(x @ coef + b, -30, 30))))

        return run.asNondeterministic()(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_LIMIT) -> ToxicityModel:
    """Language model from all of ``docs``, weights from labelled training rows."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    lab = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
           .where(~held_out_remainder(F.col("doc_id"))).select(F.col("doc_id").alias("__tx_id"), "toxic"))
    sizes = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return ToxicityModel(None, None, None, None, share)
    lm = sc.broadcast(log_model(trigram_counts(docs)))
    chosen = None
    for y in (0, 1):  # at most `limit` ids of each label: a proven bound for the broadcast
        some = lab.where(F.col("toxic") == y).orderBy(F.xxhash64("__tx_id"), "__tx_id").limit(limit)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = stored(docs.select(F.col("doc_id").alias("__tx_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                  .join(F.broadcast(chosen), "__tx_id").select("text", "toxic"), "toxic-train")
    used = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = used.get(1, 0), used.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(None, None, None, None, share)
    toxic = _feature_counts(rows.where("toxic = 1"), lm, None).where(F.col("n") >= SUPPORT)
    toxic = {r["f"]: r["n"] for r in toxic.toLocalIterator()}  # bounded by `limit` texts
    wanted = sc.broadcast(frozenset(toxic))
    clean = {r["f"]: r["n"] for r in _feature_counts(rows.where("toxic = 0"), lm, wanted).toLocalIterator()}
    wanted.unpersist()
    table = {}
    if toxic:
        names = list(toxic)
        a = np.array([toxic[f] for f in names], dtype=float)
        b = np.array([clean.get(f, 0) for f in names], dtype=float)
        full = lower_log_odds(a, b, n1, n0)
        own1 = np.where(a - 1 >= SUPPORT, lower_log_odds(a - 1, b, n1 - 1, n0), 0.0)
        own0 = lower_log_odds(a, np.maximum(b - 1, 0), n1, max(n0 - 1, 1))
        table = {f: (max(x, 0.0), max(y, 0.0), max(z, 0.0)) for f, x, y, z in zip(names, full.tolist(), own1.tolist(), own0.tolist())
                 if max(x, y, z) > 0}
    shared = sc.broadcast(table)

    def work(batches):
        for batch in batches:
            texts, ys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            xs = [None] * len(texts)
            for y, column in ((1, 1), (0, 2)):
                at = [i for i, v in enumerate(ys) if v == y]
                for i, x in zip(at, _summaries([texts[i] for i in at], lm.value, shared.value, column)):
                    xs[i] = x
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.float64())], names=["x", "y"])

    weight = F.when(F.col("y") == 1, sizes[1] / n1).otherwise(sizes[0] / n0)
    points = stored(rows.select("text", "toxic").mapInArrow(work, "x array<double>, y double"), "toxic-points")
    points = points.select(array_to_vector("x").alias("features"), F.col("y").alias("label"), weight.alias("weight"))
    got = LogisticRegression(maxIter=40, regParam=1e-3, weightCol="weight").fit(points)
    return ToxicityModel(lm, shared, got.coefficients.toArray().tolist(), float(got.intercept), share)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``op4``: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    return docs.select("doc_id", held_out_remainder(F.col("doc_id")).alias("held_out"),
                       model.score(F.col("text")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline form: the rows of ``docs`` scored below the cut-off, with its columns."""
    model = fit(docs, labels)
    return docs.withColumn("__tx_score", model.score(F.col("text"))).where(
        F.col("__tx_score") < CUTOFF).select(*docs.columns)
