"""Interaction audit of document filters by sorted posting lists.

1. One pass over the texts gives part, doc_id, a digest of the text and the text's own failures;
   repeated rows are counted. The first document of every digest comes from one aggregate.
2. Both are dealt by ranges of (doc_id, digest), so neither a large part nor a large group of
   copies meets in one task. In its range every part gets one sorted list of failing ids per
   filter; the list of the copies is the part's list minus the first documents.
3. Unions of the lists (all 32 sets of filters) and what each filter's list has beyond such a
   union come from merges whose cursors gallop from one id range to the next. Only their sizes
   leave the task and are summed per part.
4. Every order and step is looked up in these sizes.

Edge cases: null text counts as empty, a null lang is the part ''; a null doc_id has no smaller
one and is nobody's smaller one; rows that agree in all of part, doc_id and text are counted as
often as they occur, and fail E only beside a smaller doc_id; several labels of a document count
as set if one is; texts of any length stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import stored

FILTERS = "ABCDE"
ID_RANGE, ROWS_PER_TASK = 8192, 40_000
ANY, ALL = len(FILTERS), len(FILTERS) + 1  # rows of a union's size and of a part's size
UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"


def text_failures(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = text.encode()
    words = raw.split()  # bytes: at blank and the controls 9 to 13 only
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (
        100 * (len(raw) - len(raw.translate(None, UPPER))) > 10 * len(text)) + 8 * (raw != raw.translate(None, SYMBOLS))


def document_facts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> (part, doc_id, digest, fails), one row per row."""

    def work(batches):
        for batch in batches:
            doc_ids, texts, parts = batch.columns
            digests, fails = [], []
            for lo in range(0, batch.num_rows, 256):
                for t in texts.slice(lo, 256).to_pylist():
                    digests.append(hashlib.blake2b(t.encode(), digest_size=16).digest())
                    fails.append(text_failures(t))
            yield pa.RecordBatch.from_arrays([parts, doc_ids, pa.array(digests, pa.binary()), pa.array(fails, pa.int32())],
                                             names=["part", "doc_id", "digest", "fails"])

    empty = F.lit("")
    light = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), empty),
                        F.coalesce(docs["lang"].cast("string"), empty))
    return light.mapInArrow(work, "part string, doc_id long, digest binary, fails int")


def gallop(ids: np.ndarray, at: int, bound: int) -> int:
    """First place from ``at`` on whose id is not below ``bound``: doubling steps, then bisection."""
    low, step, n = at, 1, len(ids)
    while at < n and ids[at] < bound:
        low, at, step = at + 1, at + step, 2 * step
    return low + int(np.searchsorted(ids[low:min(at, n)], bound))


def ranges(lists: list[np.ndarray], width: int = ID_RANGE):
    """Walks sorted lists together: the slices of all lists in the next range of ids that holds any."""
    cursors = [0] * len(lists)
    while heads := [x[c] for x, c in zip(lists, cursors) if c < len(x)]:
        bound = min(heads) + width
        ends = [gallop(x, c, bound) for x, c in zip(lists, cursors)]
        yield [x[c:e] for x, c, e in zip(lists, cursors, ends)]
        cursors = ends


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted ids of any list: a range that one list alone reaches is copied as it is."""
    out = [np.zeros(0, np.int64)]
    for runs in ranges(lists):
        held = [r for r in runs if len(r)]
        if len(held) == 1:
            out += held
        else:
            both = np.sort(np.concatenate(held), kind="stable")
            out.append(both[np.append(True, both[1:] != both[:-1])])
    return np.concatenate(out)


def minus(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sorted ids that ``others`` lacks."""
    out = [np.zeros(0, np.int64)]
    for run, gone in ranges([ids, others]):
        at = np.searchsorted(gone, run)
        out.append(run if not len(gone) else run[np.append(gone, -1)[at] != run])
    return np.concatenate(out)


def set_sizes(lists: list[np.ndarray], weights: np.ndarray):
    """(filter or ANY, set of filters before, sums of ``weights`` rows): sizes of what the filter's
    list has beyond the union of the set's lists, and of that union."""
    for before in range(1 << len(lists)):
        members = [x for f, x in enumerate(lists) if before >> f & 1]
        gone = union(members) if len(members) > 1 else members[0] if members else np.zeros(0, np.int64)
        yield ANY, before, weights[gone].sum(axis=0)
        for f, ids in enumerate(lists):
            if not before >> f & 1:
                yield f, before, weights[minus(ids, gone)].sum(axis=0)


def audit_sizes(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Summed sizes: (part, filter, before, n, good, toxic); sizes of nothing are left out."""
    rows = facts.groupBy("part", "doc_id", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    firsts = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    zero = F.lit(0).cast("long")
    rows = rows.join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "fails", "n", *[(F.col("n") * F.coalesce(c, zero)).alias(c) for c in ("good", "toxic")])
    firsts = firsts.select("doc_id", "digest", F.lit(None).cast("string").alias("part"), F.lit(0).alias("fails"),
                           zero.alias("n"), zero.alias("good"), zero.alias("toxic"))
    tasks = max(1, math.ceil(facts.count() / ROWS_PER_TASK))
    dealt = rows.unionByName(firsts).repartitionByRange(tasks, "doc_id", "digest")

    def work(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        doc_ids = table["doc_id"].combine_chunks()
        null = np.asarray(doc_ids.is_null())
        ids = np.asarray(doc_ids.fill_null(0))
        digest = np.frombuffer(b"".join(table["digest"].to_pylist()), ">u8").reshape(-1, 2)
        order = np.lexsort((digest[:, 1], digest[:, 0], ids, ~null))
        keys = np.stack([~null, ids, *digest.astype("<u8").view(np.int64).T], axis=1)[order]
        dense = np.empty(len(order), np.int64)  # number of (doc_id, digest) in the range, in their order
        dense[order] = np.append(0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1)))
        parts = table["part"].combine_chunks().dictionary_encode()
        part = np.asarray(parts.indices.fill_null(-1))
        fails = np.asarray(table["fails"])
        counts = np.stack([np.asarray(table[c]) for c in ("n", "good", "toxic")], axis=1)
        firsts = np.sort(dense[part < 0])
        out = []
        for p, name in enumerate(parts.dictionary.to_pylist()):
            mine = np.flatnonzero(part == p)
            mine = mine[np.argsort(dense[mine], kind="stable")]
            lists = [np.flatnonzero(fails[mine] >> f & 1) for f in range(4)]  # ids count within part and range
            copies = minus(dense[mine[~null[mine]]], firsts)
            lists.append(np.searchsorted(dense[mine], copies))
            out.append((name, ALL, 0, *counts[mine].sum(axis=0).tolist()))
            out += [(name, f, before, *s.tolist()) for f, before, s in set_sizes(lists, counts[mine]) if s[0]]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "filter", "before", "n", "good", "toxic"), r)) for r in out], schema=pa.schema(
            [("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), *[(c, pa.int64()) for c in ("n", "good", "toxic")]]))

    sizes = dealt.mapInArrow(work, "part string, filter int, before int, n long, good long, toxic long")
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def orders_of(sizes: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from at most 113 sizes a part."""
    span = 1 << len(FILTERS)
    entry = F.struct((F.col("filter") * span + F.col("before")).alias("key"), F.struct("n", "good", "toxic").alias("value"))
    parts = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("sizes"))
    steps = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)]))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    numbers = F.transform(F.split("filter_order", ""), lambda c: F.instr(F.lit(FILTERS), c) - 1)
    steps = steps.withColumn("f", F.get(numbers, F.col("step") - 1)).withColumn("before", F.aggregate(
        F.slice(numbers, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, c: a + F.pow(F.lit(2), c).cast("int")))
    own = F.pow(F.lit(2), F.col("f")).cast("int")

    def size(key, field="n"):
        return F.coalesce(F.col("sizes")[key.cast("int")][field], F.lit(0).cast("long"))

    f = F.col("f") * span
    removed = size(f + F.col("before"))
    weighted = [math.factorial(k) * math.factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    shapley = sum((size(f + s) * weighted[s.bit_count()] for s in range(span - 1)), F.lit(0).cast("long"))  # sets with f have no size
    return steps.select(
        "part", "filter_order", "step", (size(F.lit(ALL * span)) - size(F.lit(ANY * span) + F.col("before") + own)).alias("kept"),
        removed.alias("removed"), (size(f) - removed).alias("redundant"), size(f + (span - 1) - own).alias("unique_fails"),
        size(f + F.col("before"), "good").alias("good_lost"), size(f + F.col("before"), "toxic").alias("toxic_lost"),
        shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``op11``: one per part, filter_order and step."""
    return orders_of(audit_sizes(stored(document_facts(docs), "audit-facts"), labels))


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part,
        (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END)
      + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
      + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
      + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
      FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, bit)),
o AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
      FROM f a, f b, f x, f y, f z WHERE a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k),
r AS (SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
      FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
