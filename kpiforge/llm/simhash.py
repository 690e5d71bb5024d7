"""SimHash near-duplicate groups with BK-trees over shards of fingerprints.

Fingerprint: XXH64 (seed 42) of every word shingle; a bit is set if it is set in over half
of them. Two texts link at ``radius`` or fewer differing bits; groups are the connected
components of the links.

Search: fingerprints are compared once per distinct value. With the 64 bits cut into
``blocks`` parts, two values within ``radius`` bits agree in at least ``blocks - radius``
whole parts, so each value is dealt to one shard per choice of that many parts (exact, by
pigeonhole). Inside a shard the values form a BK-tree whose children are keyed by integer
Hamming distance to the parent; a query at distance d follows only edges with key in
[d - radius, d + radius]. A task emits one edge per merge (a star per group), so a group of
many near copies never becomes all its pairs.

A shard over ``tree_limit`` values is cut into trees of about that size by a hash, and each
tree is sent to all query groups of that shard: no task holds more than two such groups, and
no pair is lost. Trees travel by shuffle to the tasks that probe them; they are not broadcast
to all executors, as no bound on their total size can be proven.

Edge cases: null text counts as empty (no words: fingerprint zero, linked like any other);
a null doc_id is scored and grouped, but never a group's id while a non-null one exists;
repeated rows keep their number; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import stored
from kpiforge.llm.components import components

RADIUS, SHINGLE, BLOCKS, TREE_LIMIT = 4, 4, 6, 4096


def fingerprint(text: str, width: int) -> int:
    """Signed 64-bit SimHash of one text."""
    import xxhash

    words = text.encode().lower().split()  # bytes: lower-cases A-Z only, splits at 9-13 and 32 only
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = ends[width - 1:] or ends[-1:]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, last)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, width: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return run.asNondeterministic()(F.coalesce(text, F.lit("")))  # or it may be evaluated twice


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One long per choice of ``blocks - radius`` parts: the choice's number and its bits."""
    size = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    start = [sum(size[:i]) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        bits = F.lit(number).cast("long")
        for i in chosen:
            part = F.shiftrightunsigned(fp, start[i]).bitwiseAND(F.lit((1 << size[i]) - 1).cast("long"))
            bits = F.shiftleft(bits, size[i]).bitwiseOR(part)
        keys.append(bits)
    return F.array(*keys)


def build_tree(values: np.ndarray) -> list[dict[int, int]]:
    """BK-tree over distinct unsigned values: node i is values[i]; children by distance."""
    ints, children = values.tolist(), [{} for _ in range(len(values))]
    for i in range(1, len(ints)):
        at = 0
        while True:
            d = (ints[at] ^ ints[i]).bit_count()
            nxt = children[at].get(d)
            if nxt is None:
                children[at][d] = i
                break
            at = nxt
    return children


def probe_tree(values: np.ndarray, children: list, queries: np.ndarray, radius: int):
    """Yields (node, indices of queries within the radius); a batch walks the tree at once."""
    stack = [(0, np.arange(len(queries)))] if len(values) else []
    while stack:
        node, at = stack.pop()
        d = np.bitwise_count(queries[at] ^ values[node]).astype(np.int64)
        near = at[d <= radius]
        if len(near):
            yield node, near
        for key, child in children[node].items():
            follow = at[np.abs(d - key) <= radius]
            if len(follow):
                stack.append((child, follow))


def shard_links(trees: np.ndarray, others: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the groups within a shard: its trees' values against themselves, or
    against the values of another query group."""
    values = trees if others is None else np.concatenate([trees, others])
    offset = 0 if others is None else len(trees)
    label = np.arange(len(values))
    for node, near in probe_tree(trees, build_tree(trees), values[offset:], radius):
        found = np.unique(np.append(label[near + offset], label[node]))
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    moved = np.nonzero(label != np.arange(len(values)))[0]
    return values[moved], values[label[moved]]


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
               tree_limit: int = TREE_LIMIT) -> DataFrame:
    """``fps(fp)`` of distinct longs -> edges (u, v) that connect exactly the components of
    all pairs within ``radius`` bits."""
    if blocks <= radius or comb(blocks, radius) > 4096:
        raise ValueError("blocks must exceed radius, with a moderate number of choices")
    keyed = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("shard"))
    hot = keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_limit).select(
        "shard", F.ceil(F.col("n") / tree_limit).cast("int").alias("parts"))
    dealt = keyed.join(hot, "shard", "left").withColumn(
        "mine", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
                        lambda b: F.struct(F.least("mine", b).alias("lo"), F.greatest("mine", b).alias("hi")))
    rows = dealt.withColumn("p", F.explode(pairs)).select(
        "fp", "shard", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), (F.col("mine") == F.col("p.hi")).alias("query"))

    def work(batches):
        held, key = [], None

        def flush():
            if not held or sum(len(x[0]) for x in held) < 2:
                return None
            fp = np.concatenate([x[0] for x in held]).view(np.uint64)
            query = np.concatenate([x[1] for x in held])
            same = key[1] == key[2]
            if not same and (query.all() or not query.any()):
                return None
            u, v = shard_links(fp, None, radius) if same else shard_links(fp[~query], fp[query], radius)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}) if len(u) else None

        for pdf in batches:
            cols = pdf[["shard", "lo", "hi"]].to_numpy()
            cuts = np.nonzero((cols[1:] != cols[:-1]).any(axis=1))[0] + 1
            fp, query, out = pdf["fp"].to_numpy(), pdf["query"].to_numpy(), []
            for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
                if b == a:
                    continue
                k = tuple(cols[a])
                if k != key:
                    out.append(flush())
                    held, key = [], k
                held.append((fp[a:b], query[a:b]))
            out = [x for x in out if x is not None]
            if out:
                yield pd.concat(out, ignore_index=True)
        last = flush()
        if last is not None:
            yield last

    return (rows.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
            .mapInPandas(work, "u long, v long"))


def near_groups(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
                tree_limit: int = TREE_LIMIT) -> DataFrame:
    """``fingerprints(doc_id, fp)`` -> (fp, root, component_id): ``root`` names the group (a
    fingerprint of it), ``component_id`` is its smallest doc_id (null if none has one)."""
    values = stored(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-values")
    linked = components(near_links(values.select("fp"), radius, blocks, tree_limit))
    rooted = values.join(linked, values.fp == linked.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """The rows of ``op3``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(docs.select("doc_id", fingerprint_column(F.col("text"), width).alias("fp")), "simhash-docs")
    groups = near_groups(prints, radius)
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """Pipeline form: one row of each group, the one with the smallest doc_id, with the
    columns of ``docs``. Where several rows of a group share that id (or none has an id),
    one of them stays. Texts are shuffled once; rows are counted on the ids alone first."""
    cols = docs.columns
    marked = stored(docs.withColumn("__sh_fp", fingerprint_column(docs["text"], width)), "simhash-rows")
    ids = marked.select(F.col("doc_id").alias("__sh_doc"), "__sh_fp")
    groups = near_groups(ids.select(F.col("__sh_doc").alias("doc_id"), F.col("__sh_fp").alias("fp")), radius)
    groups = stored(groups.select(F.col("fp").alias("__sh_fp"), F.col("root").alias("__sh_root"),
                                  F.col("component_id").alias("__sh_id")), "simhash-groups")
    rows = (ids.join(groups, "__sh_fp").where(F.col("__sh_doc").eqNullSafe(F.col("__sh_id")))
            .groupBy("__sh_root").agg(F.count("*").alias("__sh_n")))
    won = marked.join(groups.join(rows, "__sh_root"), "__sh_fp").where(F.col("doc_id").eqNullSafe(F.col("__sh_id")))
    several = won.where("__sh_n > 1").dropDuplicates(["__sh_root"])
    return won.where("__sh_n = 1").unionByName(several).select(*cols)
