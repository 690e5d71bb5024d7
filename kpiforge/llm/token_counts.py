"""Token counts from pre-token frequencies.

1. Every batch of documents becomes its distinct pre-tokens (one row each) and a sparse
   documents x pre-tokens count matrix (one row per batch). A pre-token that is frequent in
   the corpus is one row per batch, so no key is hot.
2. The distinct pre-tokens of the whole corpus are encoded once each; only the number of
   pieces is kept, no ids.
3. The numbers are joined to the batches' pre-tokens by equality, gathered per batch (a batch
   is bounded by its text size) and multiplied with the count matrix: sums per document.

The pre-tokens are those of the byte-level pattern; added special strings inside a text are
one token each, as the library's default has it.

Edge cases: null text counts as empty (0 tokens); null or repeated doc_ids are separate
rows; an empty table gives no rows; texts of any length stay whole (one text is one batch
at most).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import stored, tokenizer_file
from kpiforge.llm.packing import load_tokenizer

LIMIT, BATCH_CHARS = 1024, 10_000_000
#: White space as Unicode has it (the pattern's \s); Python's own \s also holds 1C-1F.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the byte-level split pattern.
PRETOKEN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
            rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
MATRIX = "batch long, doc_ids array<long>, n_bytes array<long>, matrix binary, place long, word string"
#: A unit's place: its batch and, in the lower bits, its number in the batch. A batch is the
#: task's number and, in its lower bits, the number in the task.
PLACE_BITS, BATCH_BITS, ROWS_PER_TASK = 28, 15, 60_000


def pretoken_splitter(specials: list[str]):
    """Function text -> list of pre-tokens; special strings are pre-tokens of their own."""
    import regex

    pattern = regex.compile(PRETOKEN)
    if not specials:
        return pattern.findall
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return pattern.findall(text)
        parts = special.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else pattern.findall(part))]

    return split


def count_matrix(texts: list[str], split) -> tuple[list[str], bytes]:
    """Distinct units of the texts and their packed counts per text.

    ``split`` gives a text's units. It is called once per distinct blank-delimited part: a
    single blank between two non-blank characters is a boundary of every splitter here."""
    units: dict[str, int] = {}
    flat: list[int] = []  # unit numbers of all known parts, one after the other
    lengths: list[int] = []

    def add(part: str) -> int:
        found = split(part)
        flat.extend([units.setdefault(u, len(units)) for u in found])
        lengths.append(len(found))
        return len(lengths) - 1

    class Parts(dict):
        def __missing__(self, p):  # a part after a blank; -1 if that blank is no boundary
            n = self[p] = -1 if not p or p[0].isspace() or p[-1].isspace() else add(" " + p)
            return n

    parts, heads, wholes, which = Parts(), {}, {}, []
    for text in texts:
        cut = text.split(" ")
        head = cut[0]
        at = np.fromiter(map(parts.__getitem__, cut), dtype=np.int64, count=len(cut)) if len(cut) > 1 else np.zeros(1, np.int64)
        if len(cut) > 1 and (at[1:].min() < 0 or head[-1:].isspace()):
            if text not in wholes:
                wholes[text] = add(text)
            at = np.array([wholes[text]])
        else:
            if head not in heads:
                heads[head] = add(head)
            at[0] = heads[head]
        which.append(at)
    lengths = np.array(lengths, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.array(flat, dtype=np.int64)
    indptr, cols, counts = [0], [], []
    for w in which:
        n = lengths[w]
        at = np.repeat(starts[w] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        u, c = np.unique(flat[at], return_counts=True)
        cols.append(np.diff(u, prepend=0).astype("<u4"))
        counts.append(c.astype("<u4"))
        indptr.append(indptr[-1] + len(u))
    planes = [np.concatenate(x).view(np.uint8).reshape(-1, 4).T.tobytes() if x else b"" for x in (cols, counts)]
    blob = np.array(indptr, "<u8").tobytes() + b"".join(planes)  # high bytes together: mostly zeros
    return list(units), zlib.compress(blob, 1)


def matrix_product(blob: bytes, n_docs: int, values: np.ndarray) -> np.ndarray:
    """Per text the sum of count * values[unit] (values: one or several columns)."""
    raw = zlib.decompress(blob)
    indptr = np.frombuffer(raw, "<u8", n_docs + 1).astype(np.int64)
    nnz = int(indptr[-1])
    planes = np.frombuffer(raw, np.uint8, 8 * nnz, 8 * (n_docs + 1)).reshape(2, 4, nnz)
    step, count = (np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes)
    run = np.cumsum(step)
    base = np.concatenate([[0], run])[indptr[:-1]]  # columns are stored as steps within a text
    cols = run - np.repeat(base, np.diff(indptr))
    if len(values) <= (cols.max() if nnz else -1):  # units without a value count 0
        values = np.concatenate([values, np.zeros((int(cols.max()) + 1 - len(values),) + values.shape[1:], np.int64)])
    products = values[cols] * (count if values.ndim == 1 else count[:, None])
    sums = np.zeros((n_docs,) + values.shape[1:], dtype=np.int64)
    np.add.at(sums, np.repeat(np.arange(n_docs), np.diff(indptr)), products)
    return sums


def batch_units(docs: DataFrame, make_split, name: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Step 1, stored: rows with a matrix (``word`` null) and rows with a unit."""

    def work(batches):
        from pyspark import TaskContext

        split, number = make_split(), TaskContext.get().partitionId() << BATCH_BITS
        schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
                            ("matrix", pa.binary()), ("place", pa.int64()), ("word", pa.string())])

        def rows(ids, texts):
            units, blob = count_matrix(texts, split)
            n = len(units)
            if n >> PLACE_BITS or (number & ((1 << BATCH_BITS) - 1)) == (1 << BATCH_BITS) - 1:
                raise ValueError("more units or batches than a place can number")
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t.encode()) for t in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary()),
                pa.array([None], pa.int64()), pa.array([None], pa.string())], schema=schema)
            for lo in range(0, n, 50_000):
                m = min(n - lo, 50_000)
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64())),
                    pa.nulls(m, pa.binary()), pa.array((number << PLACE_BITS) + np.arange(lo, lo + m, dtype=np.int64)),
                    pa.array(units[lo:lo + m], pa.string())], schema=schema)

        for batch in batches:
            ids, texts, size, lo = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= batch_chars or i == len(texts) - 1:
                    yield from rows(ids[lo:i + 1], texts[lo:i + 1])
                    number, size, lo = number + 1, 0, i + 1

    light = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return stored(light.mapInArrow(work, MATRIX), name)


def sum_per_document(units: DataFrame, evaluate, names: list[str]) -> DataFrame:
    """Steps 2 and 3 -> doc_id, n_bytes, *names (sums over the units of a text).

    ``evaluate`` takes (word, first), one row per distinct unit, and adds the columns of
    ``names`` (0 to 2^35 - 1). The units are shuffled once: the distinct ones and the join
    read the same exchange (``first`` is carried along, so both need the same columns)."""
    places = units.where("word is not null and place is not null").select("word", "place")
    parts = max(1, math.ceil(places.count() / ROWS_PER_TASK))
    dealt = places.repartition(parts, "word")
    values = evaluate(dealt.groupBy("word").agg(F.min("place").alias("first")))
    values = values.select(F.col("word").alias("unit"), "first", *names)
    # coalesce: else a null test on one side only would make the two exchanges differ
    number = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    found = (dealt.join(values, (F.col("word") == F.col("unit")) & (F.col("place") >= F.col("first")))
             .groupBy(F.coalesce(F.shiftright("place", PLACE_BITS), F.lit(-1)).alias("batch"))
             .agg(*[F.collect_list(F.when(F.col(n) > 0, F.shiftleft(number, 35).bitwiseOR(F.col(n)))).alias(n) for n in names]))
    held = units.where("word is null").select("batch", "doc_ids", "n_bytes", "matrix").join(found, "batch", "left")

    def work(batches):
        low = (1 << 35) - 1
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n_bytes = batch.column("doc_ids")[r].values, batch.column("n_bytes")[r].values
                got = [np.zeros(0, np.int64) if (v := batch.column(n)[r].values) is None else v.to_numpy() for n in names]
                table = np.zeros((1 + max([int((g >> 35).max()) for g in got if len(g)], default=-1), len(names)), dtype=np.int64)
                for j, g in enumerate(got):
                    table[g >> 35, j] = g & low
                sums = matrix_product(batch.column("matrix")[r].as_py(), len(n_bytes), table)
                yield pa.RecordBatch.from_arrays(
                    [ids, n_bytes, *[pa.array(sums[:, j]) for j in range(len(names))]], names=["doc_id", "n_bytes", *names])

    return held.mapInArrow(work, "doc_id long, n_bytes long, " + ", ".join(f"{n} long" for n in names))


def piece_counter(path: str):
    """Column function word -> number of pieces."""

    @F.pandas_udf("long")
    def count(words: pd.Series) -> pd.Series:
        tok = load_tokenizer(path)
        return pd.Series([len(e) for lo in range(0, len(words), 10_000)
                          for e in tok.encode_batch_fast(words[lo:lo + 10_000].tolist(), add_special_tokens=False)], dtype="int64")

    return count.asNondeterministic()


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """The rows of ``op6``: doc_id, n_bytes, n_tokens, over_limit."""
    path = tokenizer_file(tokenizer)

    def make_split():
        import json

        added = json.loads(load_tokenizer(path).to_str())["added_tokens"]
        return pretoken_splitter([t["content"] for t in added])

    units = batch_units(docs, make_split, "token-units", 2 * BATCH_CHARS)
    sums = sum_per_document(units, lambda words: words.withColumn("n_tokens", piece_counter(path)("word")), ["n_tokens"])
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
