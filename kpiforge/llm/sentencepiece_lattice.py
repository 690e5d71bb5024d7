"""SentencePiece encoding and decoding as a relational lattice.

Texts become words: blanks are written U+2581, and a text is cut between two characters that
no piece of the vocabulary holds together (a letter and a blank, for one), where no edge of
the lattice can cross. Encoding works once per distinct word of the corpus:

1. the words that are usual in a sample of the texts are encoded beforehand by steps 2 to 4 and told to every task (a
   bounded list; the sample decides only which way a word goes). Every batch of texts (bounded by its size) becomes one
   stored row with the texts as sequences of word numbers, and one row per distinct other word; only these are shuffled, once;
2. explode the substrings of a distinct word (start, size; sizes that a piece with the same first
   characters has),
3. equi-join with the piece table (bounded by the vocabulary file, hence broadcast); single
   characters that are no piece stay as unknown edges,
4. group the edges by word and fold them in order of their end with ``aggregate``: for every
   position the best score and its ids (Viterbi). At equal scores the edge that starts
   earlier wins. Unknown characters cost the lowest score minus 10 and become byte pieces,
5. join the words' ids to the batches that hold the words; a batch's row puts the ids of its
   texts together. The batches' rows are stored in buckets, so that they stay where they are.

Decoding looks the bytes of every id up in the piece table, text by text, without a shuffle.

The segmentation is the one with the highest sum of piece scores (the tests compare with
brute force). A vocabulary that was made for merging, like piece_bpe_32k.model, is cut
differently by the library's merge mode; decoding is the same for both.

Edge cases: null text counts as empty (no pieces); null or repeated doc_ids are separate
rows; an empty table gives no rows; words over ``LONG_WORD`` characters are folded by the same
recurrence in a linear-time helper, as growing arrays would cost their square.
"""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.llm.bpe_pairs import slices, spread
from kpiforge.llm.common import tokenizer_file
from kpiforge.llm.token_counts import BATCH_BITS, PLACE_BITS
from kpiforge.session import scratch_path

UNKNOWN_PENALTY, LONG_WORD, ID_BASE = 10.0, 256, 1 << 30
#: A batch ends at so many characters or texts; its texts are cut by stretches of so many.
BATCH_CHARS, BATCH_TEXTS, CUT_CHARS, CUT_TEXTS = 13_000_000, 100_000, 500_000, 256
#: Bounds of the words told beforehand; distinct words of a task.
SAMPLE_TEXTS, USUAL_WORDS, WORDS_PER_TASK = 20_000, 250_000, 40_000
#: Pairs of more kinds of characters are searched instead of looked up; Spark's own limit of buckets; ids decoded at a time.
TABLE_KINDS, MOST_BUCKETS, DECODE_IDS = 4096, 100_000, 1_000_000
BLANK = "▁"
UNITS = "batch long, doc_ids array<long>, n_bytes array<long>, digests binary, sizes array<int>, words binary, place long, word string"


class WordCutter:
    """Cuts texts (blanks written) wherever no piece holds the two neighbours together, many texts at a time."""

    def __init__(self, bigrams: frozenset):
        pairs = np.array([[ord(c) for c in b] for b in sorted(bigrams)], np.int64).reshape(-1, 2)
        chars = np.unique(pairs)
        self.kind = np.zeros(0x110000, np.int32)  # 0: in no pair
        self.kind[chars] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        self.held = np.sort(self.kind[pairs[:, 0]].astype(np.int64) * self.kinds + self.kind[pairs[:, 1]])
        self.table = None
        if self.kinds <= TABLE_KINDS:
            self.table = np.zeros(self.kinds ** 2, bool)
            self.table[self.held] = True

    def together(self, codes: np.ndarray) -> np.ndarray:
        """For every character but the last: does a piece hold it and the next one?"""
        kind = self.kind[codes]
        if self.table is not None:
            return self.table[kind[:-1] * self.kinds + kind[1:]]
        return np.isin(kind[:-1].astype(np.int64) * self.kinds + kind[1:], self.held)

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words; which of them the words of all texts are, one text after the other; how many each
        text has. Texts begin with the dummy blank."""
        whole = "".join([BLANK + t.replace(" ", BLANK) if t else "" for t in texts])
        bounds = np.append(0, np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64))
        if not whole:
            return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.append(True, ~self.together(codes))
        first[bounds[:-1][bounds[:-1] < len(codes)]] = True
        starts = np.flatnonzero(first)
        size = (codes > 0x7F).view(np.int8) + (codes > 0x7FF).view(np.int8) + (codes > 0xFFFF).view(np.int8) + np.int8(1)
        offsets = np.append(0, np.cumsum(size, dtype=np.int64))[np.append(starts, len(codes))]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(whole.encode())).dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), np.diff(np.searchsorted(starts, bounds))


class PieceTable:
    """Pieces of a model file: (id, piece, score) rows, byte ids, longest piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.rows = [(i, sp.id_to_piece(i), float(sp.get_score(i))) for i in normal]
        found = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.byte_ids = [found.get(b, sp.unk_id()) for b in range(256)]
        self.bigrams = frozenset(p[i:i + 2] for _, p, _ in self.rows for i in range(len(p) - 1))
        self.longest = max(len(p) for _, p, _ in self.rows)
        self.unknown_score = min(s for _, _, s in self.rows) - UNKNOWN_PENALTY

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "id int, piece string, score double")

    def starts_frame(self, spark: SparkSession) -> DataFrame:
        """First four characters of the longer pieces -> the sizes of such pieces, 1 to 3 included."""
        sizes: dict[str, set] = {}
        for _, p, _ in self.rows:
            if len(p) > 3:
                sizes.setdefault(p[:4], {1, 2, 3}).add(len(p))
        return spark.createDataFrame([(k, sorted(v)) for k, v in sizes.items()], "start string, sizes array<int>")

    def piece_bytes(self) -> list[bytes]:
        """id -> the bytes it stands for, with blanks."""
        out = [b""] * (1 + max([i for i, _, _ in self.rows] + self.byte_ids))
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        for i, piece, _ in self.rows:
            out[i] = piece.replace(BLANK, " ").encode()
        return out


def lattice_edges(words: DataFrame, pieces: PieceTable) -> DataFrame:
    """Steps 1 and 2: ``words(word, first)`` -> (word, first, e, s, score, id): id -1 - s for
    unknown. ``first`` only passes through."""
    n = F.length("word")
    spans = words.select("word", "first", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = spans.select("word", "first", "s", F.substr("word", F.col("s") + 1, F.lit(pieces.longest)).alias("rest"))
    # no longer piece starts with these four characters: only one to three can be pieces here
    starts = F.broadcast(pieces.starts_frame(words.sparkSession))
    spans = spans.join(starts, F.substr("rest", F.lit(1), F.lit(4)) == F.col("start"), "left").drop("start")
    spans = spans.select("word", "first", "s", "rest", F.explode(F.coalesce("sizes", F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("size")).where(
        F.col("size") <= F.length("rest"))
    spans = spans.select("word", "first", "s", (F.col("s") + F.col("size")).alias("e"), F.left("rest", "size").alias("piece"))
    table = F.broadcast(pieces.frame(words.sparkSession))  # bounded by the vocabulary file
    edges = spans.join(table, "piece", "left").where(F.col("id").isNotNull() | (F.col("e") - F.col("s") == 1))
    return edges.select("word", "first", "e", "s", F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
                        F.coalesce("id", -1 - F.col("s")).alias("id"))


def byte_pieces(word: Column, s: Column, byte_ids: Column) -> Column:
    """Ids of the bytes of one character."""
    raw = F.hex(F.substr(word, s + 1, F.lit(1)).cast("binary"))
    return F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda i: F.get(
        byte_ids, F.conv(F.substr(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))


def edge_code(s: Column, id: Column) -> Column:
    """Start and id of an edge in one number, larger for earlier starts: rows of few plain fields are cheaper to collect."""
    return F.shiftleft((-s).cast("long"), 32) + id + F.lit(ID_BASE)


def viterbi(edges: Column, length: Column) -> Column:
    """Fold of the edges array<struct<e,s,score,code>> over the positions: the ids along the best edges. The state is
    an array<struct<score,code>>, the best edge that ends at each position, from position 0 on."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("code")))

    def step(acc: Column, k: Column) -> Column:
        ending = F.transform(F.filter(edges, lambda x: x["e"] == k), lambda x: F.struct(
            (F.get(acc, x["s"])["score"] + x["score"]).alias("score"), x["code"].alias("code")))
        return F.concat(acc, F.array(F.array_max(ending)))

    # traced as the fold ends: a column between the two would be copied
    return F.aggregate(F.sequence(F.lit(1), length), start, step, lambda best: best_path(best, length))


def best_path(best: Column, length: Column) -> Column:
    """Ids along the best edges, from the word's end back to its start."""
    start = F.struct(length.alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, k: Column) -> Column:
        code = F.get(best, k)["code"]
        id = (code.bitwiseAND(F.lit(0xFFFFFFFF)) - ID_BASE).cast("int")
        return F.when(acc["at"] == k, F.struct((-F.shiftright(code, 32)).cast("int").alias("at"), F.concat(F.array(id), acc["ids"]).alias("ids"))).otherwise(acc)

    return F.aggregate(F.sequence(length, F.lit(1), F.lit(-1)), start, step, lambda acc: acc["ids"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def viterbi_long(edges: pd.Series) -> pd.Series:
    """The same recurrence with back pointers, for very long words (no edges: not asked for)."""
    out = []
    for row in edges:
        if not len(row):
            out.append(None)
            continue
        best = {0: (0.0, 0, 0)}
        for x in sorted(row, key=lambda x: (x["e"], x["s"])):
            score = best[x["s"]][0] + x["score"]
            if x["e"] not in best or score > best[x["e"]][0]:
                best[x["e"]] = (score, x["s"], (x["code"] & 0xFFFFFFFF) - ID_BASE)
        parts = []
        last = max(best)
        while last:
            parts.append(best[last][2])
            last = best[last][1]
        out.append(parts[::-1])
    return pd.Series(out)


def encode_words(words: DataFrame, pieces: PieceTable, longest: int) -> DataFrame:
    """``words(word, first)``, distinct, of ``longest`` characters at most -> (word, first, ids)."""
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
    length, far = F.length("word"), F.length("word") > LONG_WORD
    edges = lattice_edges(words, pieces).select("word", "first", F.struct("e", "s", "score", edge_code(F.col("s"), F.col("id")).alias("code")).alias("edge"))
    grouped = edges.groupBy("word").agg(F.min("first").alias("first"), F.collect_list("edge").alias("x"))
    folded = viterbi(F.col("x"), length)
    if longest > LONG_WORD:  # else no row need go through Python
        grouped = grouped.withColumn("far", viterbi_long(F.filter("x", lambda e: far)))
        folded = F.coalesce("far", F.when(~far, folded))
    traced = grouped.select("word", "first", folded.alias("ids"))
    # an unknown character's edge carries -1 - its place
    spelled = F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(byte_pieces(F.col("word"), -1 - i, byte_ids))))
    return traced.select("word", "first", F.when(F.exists("ids", lambda i: i < 0), spelled).otherwise(F.col("ids")).alias("ids"))


@contextmanager
def grouped_in_memory(spark: SparkSession, groups: int):
    """Lets ``collect_list`` keep that many groups per task before it sorts instead; the
    default of 128 would sort every edge. Tasks hold at most about ``groups`` words here."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(2 * groups))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Batch:
    """Texts one after the other, as numbers of their distinct words."""

    def __init__(self):
        self.doc_ids, self.n_bytes, self.digests, self.counts, self.words, self.which, self.chars = [], [], [], [], [], [], 0

    def add(self, doc_ids: list, texts: list[str], cutter: WordCutter) -> None:
        words, which, counts = cutter.cut(texts)
        self.doc_ids += doc_ids
        self.n_bytes += [len(t.encode()) for t in texts]
        self.digests += map(digest, texts)
        self.counts.append(counts)
        self.words.append(words)
        self.which.append(which)
        self.chars += sum(map(len, texts))

    def numbered(self, usual: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words in their order, the usual ones left out; their numbers (the frequent ones first, above the
        usual ones' places); the numbers of the words of all texts."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        number, low, parts = coded.indices.to_numpy(), 0, []
        for words, which in zip(self.words, self.which):
            parts.append(number[low:low + len(words)][which])
            low += len(words)
        sequence = np.concatenate(parts)
        rank = pc.fill_null(pc.index_in(coded.dictionary, value_set=usual), -1).to_numpy().copy()
        rare = np.flatnonzero(rank < 0)
        rank[rare[np.argsort(-np.bincount(sequence, minlength=len(rank))[rare], kind="stable")]] = np.arange(len(usual), len(usual) + len(rare))
        words, rank_of = coded.dictionary.take(pa.array(rare)), rank[rare]
        order = pc.sort_indices(words)
        return words.take(order).cast(pa.string()), rank_of[order.to_numpy()].astype(np.int64), rank[sequence]


def packed(numbers: np.ndarray) -> bytes:
    """Low bytes together, then the higher ones: mostly small numbers."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def stored_in_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``df`` stored by the hash of ``column``, so that a join on it need not shuffle these rows again."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = os.path.basename(path).replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry only: the files stay, and ``out`` knows them
    return out


def light_texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def usual_words(docs: DataFrame, pieces: PieceTable) -> tuple[pa.Array, pa.ListArray]:
    """Words found twice in about ``SAMPLE_TEXTS`` texts, the most frequent ``USUAL_WORDS`` at most, and their ids. The sample
    only tells which words every task is told beforehand; the others are numbered and joined per batch."""
    spark, bigrams = docs.sparkSession, pieces.bigrams

    def work(batches):
        cutter = WordCutter(bigrams)
        for batch in batches:
            for low in range(0, batch.num_rows, CUT_TEXTS):
                texts = batch.column(1).slice(low, CUT_TEXTS).to_pylist()
                for lo, hi in slices(texts, CUT_CHARS):
                    words, which, _ = cutter.cut(texts[lo:hi])
                    yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(which, minlength=len(words)))], names=["word", "n"])

    some = light_texts(docs).sample(min(1.0, SAMPLE_TEXTS / max(1, docs.count())), 1)
    counted = some.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    words = counted.where(F.length("word") <= LONG_WORD).orderBy(F.desc("n"), "word").limit(USUAL_WORDS).select("word").toArrow().column("word").combine_chunks()
    told = spark.createDataFrame(pa.table({"word": words, "first": pa.array(np.arange(len(words)))}), "word string, first long")
    dealt = told.repartition(max(1, math.ceil(len(words) / WORDS_PER_TASK)), "word")
    ids = encode_words(dealt, pieces, 0).toArrow().sort_by("first").column("ids").combine_chunks()
    return words.cast(pa.large_string()), ids.cast(pa.list_(pa.int32()))


def batch_rows(docs: DataFrame, pieces: PieceTable, told, buckets: int) -> DataFrame:
    """Step 1, stored: a row per batch (``word`` null) and a row per batch and word that is not ``told``, in order of the words."""
    bigrams = pieces.bigrams
    schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("digests", pa.binary()),
                        ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("place", pa.int64()), ("word", pa.string())])

    def work(batches):
        from pyspark import TaskContext

        cutter, number, held = WordCutter(bigrams), TaskContext.get().partitionId() << BATCH_BITS, Batch()

        def rows():
            words, numbers, sequence = held.numbered(told.value[0])
            if (len(words) + len(told.value[0])) >> PLACE_BITS or (number & ((1 << BATCH_BITS) - 1)) == (1 << BATCH_BITS) - 1:
                raise ValueError("more words or batches than a place can number")
            one = [[number], [held.doc_ids], [held.n_bytes], [b"".join(held.digests)], [np.concatenate(held.counts)], [packed(sequence)], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, schema)], schema=schema)
            for at in range(0, len(words), 50_000):
                mine = words.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), number)), *[pa.nulls(len(mine), f.type) for f in schema][1:6],
                                                  pa.array((number << PLACE_BITS) + numbers[at:at + 50_000]), mine], schema=schema)

        for batch in batches:
            for low in range(0, batch.num_rows, CUT_TEXTS):
                ids, texts = (batch.column(c).slice(low, CUT_TEXTS).to_pylist() for c in (0, 1))
                for lo, hi in slices(texts, CUT_CHARS):
                    held.add(ids[lo:hi], texts[lo:hi], cutter)
                    if held.chars >= BATCH_CHARS or len(held.doc_ids) >= BATCH_TEXTS:
                        yield from rows()
                        number, held = number + 1, Batch()
                        pa.default_memory_pool().release_unused()
        if held.doc_ids:
            yield from rows()

    return stored_in_buckets(light_texts(docs).mapInArrow(work, UNITS), "piece-units", "batch", buckets)


def decoder(pieces: PieceTable):
    """Function lists of ids -> the texts they stand for, without the dummy blank."""
    table = pieces.piece_bytes()

    def texts_of(ids: pa.Array) -> pa.Array:
        held, out, bounds = pa.array(table, pa.large_binary()), [], ids.offsets.to_pylist()
        for lo, hi in zip(bounds, bounds[1:]):
            data = b""
            for at in range(lo, hi, DECODE_IDS):
                found = held.take(ids.values.slice(at, min(DECODE_IDS, hi - at)))
                ends = np.frombuffer(found.buffers()[1], np.int64)[:len(found) + 1]
                data += bytes(memoryview(found.buffers()[2])[ends[0]:ends[-1]])
            out.append(data.decode("utf-8", "replace").removeprefix(" "))
        return pa.array(out, pa.string())

    return texts_of


def encode_texts(docs: DataFrame, model: str = "piece_bpe_32k.model", read_back: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_bytes, digest, ids): the ids of every whole text in order, a
    row per row; ``digest`` is the text's, to compare with a decoded one. With ``read_back`` the ids are decoded as
    ``decode_texts`` does, in the task that puts them together, and (.., same_text) tells whether they give the text."""
    pieces = PieceTable(tokenizer_file(model))
    if any(b[1] == BLANK and b[0] != BLANK for b in pieces.bigrams):
        raise ValueError("a piece holds a blank behind another character")
    told = docs.sparkSession.sparkContext.broadcast(usual_words(docs, pieces))
    buckets = min(MOST_BUCKETS, 2 * max(4, docs.rdd.getNumPartitions()))
    units = batch_rows(docs, pieces, told, buckets)
    places = units.where("word is not null and place is not null").select("word", "place")
    n, longest = places.agg(F.count("*"), F.max(F.length("word"))).first()
    parts = max(1, math.ceil(n / WORDS_PER_TASK))
    dealt = places.repartition(parts, "word")
    with grouped_in_memory(docs.sparkSession, WORDS_PER_TASK):  # at most about that many words in a task
        encoded = encode_words(dealt.groupBy("word").agg(F.min("place").alias("first")), pieces, longest or 0).select(
            F.col("word").alias("unit"), "first", "ids")
        number = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        # coalesce, first: as in token_counts, so that both sides read one exchange
        found = (dealt.join(encoded, (F.col("word") == F.col("unit")) & (F.col("place") >= F.col("first")))
                 .select(F.coalesce(F.shiftright("place", PLACE_BITS), F.lit(-1)).alias("batch"), F.concat(F.array(number), "ids").alias("ids"))
                 .repartition(buckets, "batch").groupBy("batch").agg(F.collect_list("ids").alias("x")))
        held = units.where("word is null").select("batch", "doc_ids", "n_bytes", "digests", "sizes", "words").join(found, "batch", "left")

    texts_of = decoder(pieces)

    def work(batches):
        usual, usual_ends = told.value[1].values.to_numpy(), told.value[1].offsets.to_numpy().astype(np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r] for c in ("doc_ids", "n_bytes", "sizes")}
                n = len(cell["doc_ids"])
                lists = batch.column("x")[r].values  # [word number, id, id, ...]
                flat, ends = (lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)) if lists is not None and len(lists) else (
                    np.zeros(0, np.int32), np.zeros(1, np.int64))
                words = flat[ends[:-1]] if len(flat) else np.zeros(0, np.int64)
                starts, sizes = (np.append(v, np.zeros(len(words), np.int64)) for v in (usual_ends[:-1], np.diff(usual_ends)))
                starts[words], sizes[words] = len(usual) + ends[:-1] + 1, np.diff(ends) - 1
                flat = np.concatenate([usual, flat])
                sequence = unpacked(batch.column("words")[r].as_py())
                digests = batch.column("digests")[r].as_py()
                per_text = cell["sizes"].values.to_numpy().astype(np.int64)
                bounds = np.append(0, np.cumsum(per_text))
                for lo in range(0, n, CUT_TEXTS):
                    hi = min(lo + CUT_TEXTS, n)
                    at = sequence[bounds[lo]:bounds[hi]]
                    reached = np.append(0, np.cumsum(sizes[at]))[bounds[lo:hi + 1] - bounds[lo]]
                    ids = pa.ListArray.from_arrays(pa.array(reached, pa.int32()), pa.array(flat[spread(starts[at], sizes[at])], pa.int32()))
                    own = [digests[16 * k:16 * k + 16] for k in range(lo, hi)]
                    last = pa.array([digest(t) == d for t, d in zip(texts_of(ids).to_pylist(), own)], pa.bool_()) if read_back else pa.array(own, pa.binary())
                    yield pa.RecordBatch.from_arrays([cell["doc_ids"].values.slice(lo, hi - lo), cell["n_bytes"].values.slice(lo, hi - lo), ids, last],
                                                     names=["doc_id", "n_bytes", "ids", "same_text" if read_back else "digest"])
                pa.default_memory_pool().release_unused()

    return held.mapInArrow(work, "doc_id long, n_bytes long, ids array<int>, " + ("same_text boolean" if read_back else "digest binary"))


def decode_texts(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``encoded`` plus text: what the ids stand for, without the dummy blank."""
    return encoded.withColumn("text", F.arrow_udf(decoder(PieceTable(tokenizer_file(model))), "string")("ids"))


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows of ``op10``: doc_id, n_bytes, n_pieces, ids, same_text.

    ``ids`` are those of the whole text in order, dummy blank at its start included; ``same_text``
    tells whether the text decoded from them is the text."""
    read_back = encode_texts(docs, model, read_back=True)
    return read_back.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_pieces"), "ids", "same_text")
