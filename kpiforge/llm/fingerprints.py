"""Quartile bucket digest of whole texts.

Byte triplets (adjacent ones, and two kinds with gaps, so a window of five bytes) are hashed
into ``BUCKETS`` counters. The digest holds a logarithmic length code and, per bucket, the
quartile (0-3) its counter falls into. Two digests differ by the summed quartile distance
(opposite quartiles count double, 6) plus the length distance, at most ``MOST``; likeness is
1 - difference / MOST.

The next document (ascending doc_id) is met without a global sort in one task: documents are
dealt to ranges of doc_id whose borders are quantiles of the ids, sorted inside a range, and
read one after the other. The first document of each range is also sent to the range before.

Edge cases: null text counts as empty; texts under three bytes have only zero counters; null
doc_ids come last; rows that share a doc_id follow each other by text; a table of one row is
its own next; an empty table gives no rows. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, LENGTH_WEIGHT, LENGTH_CAP = 256, 4, 60
MOST = BUCKETS * 6 + LENGTH_WEIGHT * LENGTH_CAP
ROWS_PER_RANGE, MOST_RANGES = 4000, 4096
#: (gap pattern, odd multipliers, salt); any odd numbers do.
KINDS = (((0, 1, 2), (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), 0x27D4EB2F),
         ((0, 1, 3), (0x165667B1, 0xD3A2646D, 0xFD7046C5), 0xB55A4F09),
         ((0, 2, 4), (0x2545F491, 0x9FB21C65, 0xE6546B65), 0x85157AF5))


def bucket_counts(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for gaps, mult, salt in KINDS:
        n = len(v) - gaps[2]
        if n > 0:
            h = np.full(n, salt, dtype=np.uint32)
            for gap, m in zip(gaps, mult):
                h ^= v[gap:gap + n] * np.uint32(m)
                h *= np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> shift, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> bytes:
    """One length byte and two bits per bucket."""
    counts = bucket_counts(data)
    quarter = BUCKETS // 4
    ranked = np.sort(counts)
    code = np.zeros(BUCKETS, dtype=np.uint8)
    for i in (1, 2, 3):
        code += (counts > ranked[i * quarter - 1]).astype(np.uint8)
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    length = min(255, round(8 * math.log2(1 + len(data))))
    return bytes([length]) + packed.tobytes()


def difference(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8, offset=1), np.frombuffer(b, np.uint8, offset=1)
    total = 0
    for s in (0, 2, 4, 6):
        d = np.abs((x >> s & 3).astype(np.int16) - (y >> s & 3))
        total += int(d.sum()) + 3 * int((d == 3).sum())
    return total + LENGTH_WEIGHT * min(LENGTH_CAP, abs(a[0] - b[0]))


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n] if n else text


def range_borders(ids: DataFrame, rows_per_range: int) -> list[int]:
    """Quantiles of doc_id (reads the id column only): at most ``MOST_RANGES`` - 1 numbers."""
    parts = min(MOST_RANGES, math.ceil(ids.count() / rows_per_range))
    if parts <= 1:
        return []
    at = ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
    return sorted({int(x) for x in at})


def fingerprint_documents(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows of ``op5``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    light = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    borders = np.array(range_borders(ids, rows_per_range), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(known: pd.Series, doc: pd.Series) -> pd.Series:
        found = np.searchsorted(borders, doc.to_numpy(dtype=np.int64), side="right")
        return pd.Series(np.where(known.to_numpy(dtype=bool), found, len(borders) + 1).astype(np.int32))

    part = range_of(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)))  # null ids: a range of their own
    first = ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("first"))
    filled = sorted((r["part"], r["first"]) for r in first.collect())  # one row per range
    before = {p: filled[i - 1][0] for i, (p, _) in enumerate(filled)}  # the first range follows the last
    back = np.array([before.get(p, 0) for p in range(len(borders) + 2)], dtype=np.int32)

    @F.pandas_udf("int")
    def range_before(p: pd.Series) -> pd.Series:
        return pd.Series(back[p.to_numpy()])

    # rows that may open a range: those with its smallest id (of null ids: all)
    opens = F.col("doc_id").isNull() | F.col("doc_id").isin([f for _, f in filled if f is not None])
    own = F.struct(F.lit(0).alias("guest"), F.col("part").alias("range"))
    guest = F.struct(F.lit(1).alias("guest"), F.col("prev").alias("range"))
    dealt = (light.withColumn("part", part).withColumn("prev", range_before("part"))
             .withColumn("at", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own))))
             .select(F.col("at.range").alias("range"), F.col("at.guest").alias("guest"), "doc_id", "text"))

    def work(batches):
        waiting = None  # (range, doc_id, text, digest) whose next document is not known yet
        out, size = [], 0

        def finish(nxt_text, nxt_digest):
            _, doc, text, own = waiting
            new = edited(text, nxt_text)
            raw = new.encode()
            changed = digest(raw) if new != text else own
            out.append((doc, len(text), hashlib.sha256(raw).hexdigest(), own.hex(), changed.hex(),
                        likeness(own, changed), likeness(own, nxt_digest)))

        def rows():
            cols = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

        for batch in batches:
            ranges, guests, docs_, texts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                rng, guest, doc, text = ranges[i].as_py(), guests[i].as_py(), docs_[i].as_py(), texts[i].as_py()
                if guest and (waiting is None or waiting[0] != rng):
                    continue  # a second guest: only the first one follows the range's last row
                own = digest(text.encode())
                if waiting is not None and waiting[0] == rng:
                    finish(text, own)
                waiting = None if guest else (rng, doc, text, own)
            yield rows()
            out.clear()

    # by range: own rows by id (null ids last) and text, then the guest
    order = ["range", "guest", F.col("doc_id").asc_nulls_last(), "text"]
    # dealt by the range's number, not its hash: a task per range
    return (dealt.repartitionById(len(borders) + 2, "range").sortWithinPartitions(*order)
            .mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                              "edited_fingerprint string, near_edited double, near_next double"))
