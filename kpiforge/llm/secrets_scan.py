"""Secret scan: fixed patterns plus password guess cost on credential-context values.

Base kinds (``assign``, ``access``, ``hex``) are leftmost non-overlapping matches of their
pattern; too short ones are dropped. The kind ``guess`` adds values that stand in a wider
credential context (``pwd``, ``passphrase``, ``auth`` ..., quoted values of any characters)
and whose guess cost is high, in all and per character (sentences and addresses
are left alone): dynamic programming finds the cheapest segmentation of the
value into dictionary words, dates, repeats, keyboard walks and brute-force characters. Cost
is the log10 of the guesses, summed, plus a little per segment. Base spans are never removed;
a guess span never overlaps one.

The dictionary is the lower-case words of a public tokenizer vocabulary in its order (an
installed file, about 25,000 words): rank stands for guesses.

Edge cases: null text counts as empty (no spans); repeated rows and null doc_ids are scanned
each; texts of any length are scanned whole, values of any length are segmented in time linear
in their length.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import tokenizer_file

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # = runs of [0-9a-f]+ of 32 or more
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\x20-]?key|credentials?|auth(?:orization)?)["']?\x20*"""
    r"""(?:[:=]|\x20is\x20)\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))""", re.I | re.A)
HINTS = ("pass", "secret", "token", "api", "pwd", "credential", "auth")
KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10, MIN_PER_CHAR, SEGMENT_COST, MAX_WORD = 10.0, 0.7, 0.3, 24
ADDRESS = re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.|[\w.+-]+@[\w-]+\.)", re.I | re.A)
#: The rows of a US keyboard.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157$@!", "aeoistsai")
DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)?\d\d)|(?:19|20)\d\d")
_WORDS: dict = {}


def _adjacent() -> set[tuple[str, str]]:
    at = {k: (r, c) for r, row in enumerate(KEYBOARD) for c, k in enumerate(row)}
    return {(a, b) for a, (r, c) in at.items() for b, (s, d) in at.items()
            if a != b and abs(r - s) <= 1 and abs(c - d) <= 1}


ADJACENT = _adjacent()


def dictionary(path: str) -> dict[str, float]:
    """word -> log10 of its rank, from the vocabulary's whole lower-case words."""
    if path not in _WORDS:
        import json

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        words = sorted((i, w[1:]) for w, i in vocab.items() if re.fullmatch(r"Ġ[a-z]{3,}", w))
        _WORDS[path] = {w: math.log10(rank) for rank, (_, w) in enumerate(words, 2)}
    return _WORDS[path]


def guess_cost(value: str, words: dict[str, float]) -> tuple[float, list[str]]:
    """Cheapest segmentation: (log10 guesses, segment kinds in order)."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    edges: dict[int, list[tuple[int, float, str]]] = {}

    def edge(a, b, cost, kind):
        edges.setdefault(b, []).append((a, cost, kind))

    for a in range(n):
        for b in range(a + 3, min(n, a + MAX_WORD) + 1):
            rank = words.get(low[a:b])
            bent = rank is None
            rank = words.get(plain[a:b]) if bent else rank
            if rank is not None:
                upper = sum(ch.isupper() for ch in value[a:b])
                edge(a, b, rank + (0.3 if upper in (1, b - a) else 0.3 * min(upper, b - a - upper)) * (upper > 0)
                     + 0.6 * bent, "word")
        m = DATE.match(value, a)
        if m:
            edge(a, m.end(), math.log10(120) if m.end() - a == 4 else math.log10(365 * 120), "date")
    for a, b, unit in [(m.start(), m.end(), len(m.group(1))) for m in re.finditer(r"(.{1,8}?)\1{2,}", value, re.S)]:
        edge(a, b, unit + math.log10((b - a) / unit), "repeat")
    a = 0
    while a < n - 1:
        b = a + 1
        while b < n and (low[b - 1], low[b]) in ADJACENT:
            b += 1
        if b - a >= 4:
            turns = sum(ord(low[i + 1]) - ord(low[i]) != ord(low[i]) - ord(low[i - 1]) for i in range(a + 1, b - 1))
            edge(a, b, math.log10(47) + math.log10(b - a) + 0.4 * min(turns, 6), "walk")
        a = max(b - 1, a + 1)
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    for b in range(1, n + 1):
        cost, _, kind = best[b - 1]
        top = (cost + 1.0 + (SEGMENT_COST if kind != "brute" else 0.0), b - 1, "brute")
        for a, c, kind in edges.get(b, ()):
            if best[a][0] + c + SEGMENT_COST < top[0]:
                top = (best[a][0] + c + SEGMENT_COST, a, kind)
        best.append(top)
    kinds, at = [], n
    while at:
        if not (kinds and kinds[-1] == "brute" == best[at][2]):
            kinds.append(best[at][2])
        at = best[at][1]
    return best[n][0], kinds[::-1]


def hard_to_guess(value: str, words: dict[str, float], min_log10: float) -> bool:
    """The cheapest way to guess it costs enough, in all and per character. Addresses and sentences
    (three or more parts of letters alone, in any language) are none."""
    parts = [p for p in re.split(r"[\s_.,;:!?-]+", value) if p]
    if ADDRESS.match(value) or (len(parts) > 2 and all(map(str.isalpha, parts))):
        return False
    cost = guess_cost(value, words)[0]
    return cost >= min_log10 and cost >= MIN_PER_CHAR * len(value)


def find_spans(text: str, words: dict[str, float], min_log10: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    spans = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if hinted:
        base = sorted((a, b) for _, a, b in spans)
        for m in CONTEXT.finditer(text):
            a, b = m.span(m.lastindex)
            if not any(x < b and a < y for x, y in base) and hard_to_guess(text[a:b], words, min_log10):
                spans.append(("guess", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def span_column(text: Column, vocabulary: str = "byte_bpe_50k.json", min_log10: float = MIN_LOG10) -> Column:
    """array<struct<kind,start,end>> of a text column."""
    path = tokenizer_file(vocabulary)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        words = dictionary(path)
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, words, min_log10)]
                          for t in texts])

    return run.asNondeterministic()(F.coalesce(text, F.lit("")))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_documents(docs: DataFrame, min_log10: float = MIN_LOG10) -> DataFrame:
    """The rows of ``op2``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess."""
    out = docs.select("doc_id", span_column(F.col("text"), min_log10=min_log10).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("s", lambda x: x["kind"] != "guess")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                      count("hex").alias("n_hex"), F.sha2(span_string(base), 256).alias("base_sha256"),
                      span_string(F.col("s")).alias("spans"), count("guess").alias("n_guess"))


def redact_text(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str = "byte_bpe_50k.json",
           min_log10: float = MIN_LOG10) -> DataFrame:
    """Pipeline form: every row stays; secrets in ``text`` become ``mark`` and ``n_chars``
    follows. A null text stays null, a text without secrets stays as it is."""
    path = tokenizer_file(vocabulary)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        words = dictionary(path)
        return pd.Series([None if t is None else redact_text(t, find_spans(t, words, min_log10), mark) for t in texts])

    out = docs.withColumn("__se_text", run.asNondeterministic()(F.col("text")))
    changed = F.col("__se_text") != F.col("text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("__se_text").cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__se_text")).select(*docs.columns)


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    """Digest of a span list as the query gives it (for tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
