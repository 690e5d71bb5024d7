"""Ranked lexical search: accumulators of the short lists as one iterator among the long ones.

1. The items' terms are the vocabulary. One pass over the documents stores an index: a row per
   shard (a stretch of a partition, bounded by its text size) with the posting lists of the
   vocabulary's terms, each document's number of terms, and the shard's totals.
2. The totals give the number of documents and terms and the terms' document frequencies, hence
   the weights.
3. For every item and shard the postings of its short lists are summed term at a time into
   accumulators. They become one iterator, bounded by the largest sum, beside those of the long
   lists, each bounded by its largest contribution. Documents are then taken in ascending order,
   a range at a time: iterators whose bounds together stay below the score of the item's tenth
   best document are not read but skipped to the documents the others hold, and only where that
   document can still get in.
4. The best of every task are merged, first in groups of tasks.

Items are taken in blocks of at most about ``BLOCK_TERMS`` terms, so what goes to the tasks
is bounded however many items there are; every block passes over all documents.

Edge cases: null texts have no terms; documents without terms do not count; items without terms
or without a document above 0 give no rows; repeated items are ranked each; repeated documents
are separate; a null doc_id sorts last among equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.bpe_pairs import slices
from kpiforge.llm.common import stored

TOP, BLOCK_TERMS, SHARD_CHARS, MERGE_GROUPS = 10, 200_000, 8_000_000, 64
#: A list is short if it holds at most this share of the shard's documents.
SHORT_SHARE = 1 / 16
FIRST_RANGE, LAST_RANGE = 128, 8192
#: Letters, digits and everything beyond ASCII; A-Z become a-z, the rest blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = ("doc_ids array<long>, n_terms array<int>, terms array<int>, lengths array<int>, docs array<int>, tfs array<int>, "
         "with_terms long, all_terms long")


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def index_shard(ids: list, texts: list[str], vocabulary: dict) -> dict:
    """Posting lists of the vocabulary's terms, one after the other in order of their numbers."""
    found, n_terms = [], np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        words = terms_of(text)
        n_terms[d] = len(words)
        numbers = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
        found.append(numbers[numbers >= 0] * len(texts) + d)
    codes, tfs = np.unique(np.concatenate(found), return_counts=True)
    terms, lengths = np.unique(codes // len(texts), return_counts=True)
    return {"doc_ids": ids, "n_terms": n_terms, "terms": terms, "lengths": lengths, "docs": codes % len(texts), "tfs": tfs,
            "with_terms": int((n_terms > 0).sum()), "all_terms": int(n_terms.sum())}


def build_index(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """``docs(doc_id, text)`` -> stored index, a row per shard."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most about BLOCK_TERMS terms
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("n_terms", "terms", "lengths", "docs", "tfs")],
                        ("with_terms", pa.int64()), ("all_terms", pa.int64())])

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts, SHARD_CHARS):
                row = index_shard(ids[lo:hi], texts[lo:hi], shipped.value)
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    light = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return stored(light.mapInArrow(work, INDEX), "search-index")


class Iterator:
    """Sorted documents with their scores, the largest score as bound, and a cursor."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray):
        self.docs, self.scores, self.bound, self.at = docs, scores, int(scores.max()), 0

    def skip_to(self, doc: int) -> int:
        self.at += int(np.searchsorted(self.docs[self.at:], doc))
        return self.at

    def upto(self, doc: int) -> slice:
        """Places of the documents from the cursor on that lie below ``doc``."""
        lo = self.at
        return slice(lo, self.skip_to(doc))

    def scores_of(self, docs: np.ndarray) -> np.ndarray:
        """Scores of sorted ``docs``, 0 where there is none; the cursor skips to the first."""
        lo = self.skip_to(int(docs[0]))
        at = lo + np.searchsorted(self.docs[lo:], docs)
        inside = at < len(self.docs)
        at[~inside] = 0
        return np.where(inside & (self.docs[at] == docs), self.scores[at], 0)


def summed(docs: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each document once, in ascending order, with the sum of its scores."""
    if len(docs) == 1:
        return docs[0], scores[0]
    both, each = np.concatenate(docs), np.concatenate(scores)
    order = np.argsort(both, kind="stable")
    both, each = both[order], each[order]
    starts = np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])
    return both[starts], np.add.reduceat(each, starts) if len(starts) else each


class Best:
    """The item's best documents so far: (score, doc_id), highest first."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 0

    def offer(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(s, i) for s, i in zip(scores.tolist(), ids) if s > 0]
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        del self.rows[self.top:]
        self.least = self.rows[-1][0] if len(self.rows) == self.top else 0


def search_shard(lists: list[tuple[np.ndarray, np.ndarray]], doc_ids: list, best: Best) -> None:
    """One item in one shard; ``lists`` holds documents and scores of its terms' postings."""
    n = len(doc_ids)
    short = [x for x in lists if len(x[0]) <= SHORT_SHARE * n]
    iterators = [Iterator(d, s) for d, s in lists if len(d) > SHORT_SHARE * n]
    if short:  # term at a time
        iterators.append(Iterator(*summed([d for d, _ in short], [s for _, s in short])))
    iterators.sort(key=lambda x: x.bound)
    reach = np.cumsum([x.bound for x in iterators]).tolist()  # the most that the first ones give together
    lo, width = 0, FIRST_RANGE
    while lo < n:
        # documents of the first ones alone cannot get in; equal scores may, by a smaller id
        needed = next((i for i, r in enumerate(reach) if r >= best.least), len(iterators))
        if needed == len(iterators):
            return
        lo, width, hi = lo + width, min(2 * width, LAST_RANGE), lo + width
        places = [x.upto(hi) for x in iterators[needed:]]
        docs, scores = summed([x.docs[p] for x, p in zip(iterators[needed:], places)],
                              [x.scores[p] for x, p in zip(iterators[needed:], places)])
        for i in range(needed - 1, -1, -1):
            able = scores + reach[i] >= best.least
            docs, scores = docs[able], scores[able]
            if not len(docs):
                break
            scores = scores + iterators[i].scores_of(docs)
        able = scores >= max(best.least, 1)
        if able.any():
            docs, scores = docs[able], scores[able]
            if len(docs) > best.top:  # whatever lies below the tenth of these cannot get in either
                able = scores >= np.partition(scores, -best.top)[-best.top]
                docs, scores = docs[able], scores[able]
            best.offer(scores, [doc_ids[d] for d in docs.tolist()])


def search_block(docs: DataFrame, items: list, top: int) -> DataFrame:
    """``items``: rows of (row, item_id, terms) -> (row, item_id, doc_id, score), best of every task."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for x in items for t in x["terms"]}))}
    index = build_index(docs, vocabulary)
    total = index.agg(F.sum("with_terms").alias("n"), F.sum("all_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = {r["x"]["terms"]: r["df"] for r in index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x"))
          .groupBy(F.struct("x.terms").alias("x")).agg(F.sum("x.lengths").alias("df")).collect()}  # at most one per term of the block
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    wanted = [(x["row"], x["item_id"], [(t, k) for t, k in Counter(vocabulary[bytes(t)] for t in x["terms"]).items() if weights.get(t)])
              for x in items]
    shipped = spark.sparkContext.broadcast((wanted, weights, n_docs, n_terms))  # bounded as the block is

    def work(batches):
        from pyspark import TaskContext

        wanted, weights, n_docs, n_terms = shipped.value
        best = [Best(top) for _ in wanted]
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r].values for c in ("doc_ids", "n_terms", "terms", "lengths", "docs", "tfs")}
                doc_ids = cell["doc_ids"].to_pylist()
                number = {c: cell[c].to_numpy().astype(np.int64) for c in ("n_terms", "terms", "lengths", "docs", "tfs")}
                length_part = 100 - 75 + 75 * number["n_terms"] * n_docs // max(n_terms, 1)
                weight = np.repeat([weights[t] for t in number["terms"].tolist()], number["lengths"]).astype(np.int64)
                tf = number["tfs"]
                score = weight * (1_000_000_000 * tf // (1000 * tf + 8 * length_part[number["docs"]]))
                ends = np.cumsum(number["lengths"]).tolist()
                lists = {t: (number["docs"][e - k:e], score[e - k:e]) for t, e, k in zip(number["terms"].tolist(), ends, number["lengths"].tolist())}
                for (_, _, terms), found in zip(wanted, best):
                    held = [(lists[t][0], lists[t][1] * k if k > 1 else lists[t][1]) for t, k in terms if t in lists]
                    if held:
                        search_shard(held, doc_ids, found)
        task = TaskContext.get().partitionId()
        out = [(row, item, i, s, task) for (row, item, _), found in zip(wanted, best) for s, i in found.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 5)],
                                         names=["row", "item_id", "doc_id", "score", "task"])

    return index.drop("with_terms", "all_terms").mapInArrow(work, "row long, item_id long, doc_id long, score long, task long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The rows of ``op13``: item_id, rank, doc_id, score; the ``top`` best documents of each item."""
    @F.pandas_udf("array<binary>")
    def item_terms(texts):
        return texts.map(terms_of)

    rows = stored(items.select(F.monotonically_increasing_id().alias("row"), items["item_id"].cast("long").alias("item_id"),
                               item_terms(F.coalesce(items["text"].cast("string"), F.lit(""))).alias("terms")).where(F.size("terms") > 0), "search-items")
    count = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(count / BLOCK_TERMS))
    number = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [search_block(docs, rows.where(number == b).collect(), top) for b in range(blocks)])
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    group = Window.partitionBy("row", F.pmod("task", F.lit(MERGE_GROUPS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS nn, coalesce(sum(len(ts)), 0)::BIGINT AS ll FROM d),
q0 AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT qid, item_id, term, count(*) AS qtf FROM (SELECT qid, item_id, unnest(ts) AS term FROM q0) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
c AS (SELECT qid, item_id, rid, doc_id,
             sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY qid, item_id, rid, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
      FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
