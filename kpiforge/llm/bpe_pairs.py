"""Byte-pair encoding by a pair occurrence index, and decoding.

Encoding a batch of distinct pre-tokens:

1. their bytes become one flat array of symbols with links to the left and right neighbour
   inside the same pre-token;
2. the index maps every pair of neighbours that has a rank to all its positions;
3. the active ranks are taken in ascending order from a heap. All positions of the pair are
   merged at once, from left to right where they overlap; only the lists of the pairs that
   arise beside a merged position get new entries. An entry whose symbols have changed since
   is skipped when its list is read.

A pair that arises holds the symbol just made, so its rank is above the current one in every
trained file (checked when the file is read); taking ranks in ascending order over all
pre-tokens at once therefore equals encoding each of them alone.

A text is cut at its blanks, where the split pattern always cuts unless both neighbours of the
blank are white space; each distinct part is cut into pre-tokens and encoded once per worker (a
bounded table). Nothing is shuffled: a partition holds whole texts and its index is its own.

Edge cases: null text counts as empty (no ids); null or repeated doc_ids are separate rows; an
empty table gives no rows; texts of any length stay whole. Strings of added special tokens
inside a text become those tokens, as the library's default has it. Only byte-level files
without normalizer are read; any other raises.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import tokenizer_file
from kpiforge.llm.token_counts import _SPACE, pretoken_splitter

BATCH_CHARS, BATCH_ROWS, TABLE_LIMIT = 8_000_000, 2048, 600_000
DECODE_IDS = 500_000
SEPARATOR = "\v"  # between parts that are cut into pre-tokens together; a part that holds it is cut alone
END, DEAD = -1, -2  # symbols of the place after the last one, and of merged-away places
_TABLES: dict = {}
_KNOWN: dict = {}


class MergeTable:
    """Merges of a byte-level file: rank -> (left id, right id, made id), and the ids' bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                               "byte_fallback", "ignore_merges"))
        if not (model["type"] == "BPE" and plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True) and not pre.get("add_prefix_space")):
            raise ValueError("only byte-level BPE files without normalizer, prefix blank or special model settings are read")
        # printable bytes stand for themselves, the others for the signs from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        sign = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        byte_of = {c: b for b, c in sign.items()}
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(
            *[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])) if pairs else (np.zeros(0, np.int64),) * 3
        self.span = 1 + max(vocab.values())
        ranks = np.arange(len(pairs))
        makes = np.full(self.span, -1)
        makes[self.made] = ranks  # the last merge that makes a symbol
        if (makes[self.left] >= ranks).any() or (makes[self.right] >= ranks).any():
            raise ValueError("a merge ranks before one that makes its symbol")
        keys = self.left * self.span + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([self.span - 1, *self.specials.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.byte_sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none (also for END and DEAD symbols)."""
        keys = left * self.span + right
        at = np.searchsorted(self.keys, keys)
        ranks = np.append(self.order, -1)[at]
        ranks[(self.keys[at] != keys) | (left < 0) | (right < 0)] = -1
        return ranks


def merge_table(path: str) -> MergeTable:
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


class PairIndex:
    """Symbols of a batch of units and the positions of every pair that has a rank."""

    def __init__(self, units: list[bytes], table: MergeTable):
        self.table = table
        self.sizes = np.fromiter(map(len, units), np.int64, len(units))
        n = int(self.sizes.sum())
        self.sym = np.append(table.byte_ids[np.frombuffer(b"".join(units), np.uint8)], END)
        self.next, self.prev = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(self.sizes[self.sizes > 0])
        self.next[ends - 1] = n  # the place n stands beyond every unit's end and start
        self.prev[np.append(0, ends[:-1]) if len(ends) else []] = n
        self.next[n] = self.prev[n] = n
        self.at: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.arange(n))
        heapify(self.active)

    def add(self, places: np.ndarray) -> None:
        """Enters the pairs that begin at ``places`` into the lists of their ranks."""
        ranks = self.table.ranks_of(self.sym[places], self.sym[self.next[places]])
        held = ranks >= 0
        ranks, places = ranks[held], places[held]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, lo, hi in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            if rank in self.at:
                self.at[rank].append(places[lo:hi])
            else:
                self.at[rank] = [places[lo:hi]]
                heappush(self.active, rank)

    def merge_next(self) -> None:
        """Merges every position of the active pair with the lowest rank."""
        rank, table, sym = heappop(self.active), self.table, self.sym
        lists = self.at.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = np.sort(at)
        at = at[np.append(True, at[1:] != at[:-1])]
        a, b = table.left[rank], table.right[rank]
        after = self.next[at]
        valid = (sym[at] == a) & (sym[after] == b)
        at, after = at[valid], after[valid]
        if a == b and len(at) > 1:  # in a run of overlapping positions every second one counts
            begins = np.append(True, after[:-1] != at[1:])
            index = np.arange(len(at))
            first = np.maximum.accumulate(np.where(begins, index, 0))
            every = (index - first) % 2 == 0
            at, after = at[every], after[every]
        if not len(at):
            return
        sym[at], sym[after] = table.made[rank], DEAD
        beyond = self.next[after]
        self.next[at] = beyond
        self.prev[beyond] = at
        self.add(np.concatenate([self.prev[at], at]))

    def encode(self) -> tuple[np.ndarray, np.ndarray]:
        """Merges all; sizes in ids and the ids of all units, one after the other."""
        while self.active:
            self.merge_next()
        alive = self.sym >= 0
        count = np.append(0, np.cumsum(alive))
        ends = np.cumsum(self.sizes)
        return count[ends] - count[ends - self.sizes], self.sym[alive]


class Numbers(dict):
    """Part -> number in the store; ``lead`` stands before the part in the text."""

    def __init__(self, store, lead: str):
        super().__init__()
        self.store, self.lead = store, lead

    def __missing__(self, part: str) -> int:
        n = self[part] = self.store.count + len(self.store.new)
        self.store.new.append(self.lead + part)
        return n


class Store:
    """Ids of known parts: those of part n are ``flat[starts[n]:starts[n] + sizes[n]]``."""

    def __init__(self, table: MergeTable):
        self.table, self.split = table, pretoken_splitter(list(table.specials))
        self.new: list[str] = []
        self.count = self.used = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.parts, self.heads = Numbers(self, " "), Numbers(self, "")

    def units_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of the units of all texts, how many each text has, and the distinct units."""
        units: dict[str, int] = {}
        apart = [SEPARATOR, *self.table.specials]
        plain = [i for i, t in enumerate(texts) if t[:1] == " " and t[1:2] not in SPACES and t[-1] not in SPACES and not any(x in t for x in apart)]
        others = sorted(set(range(len(texts))) - set(plain))
        counts, found = np.zeros(len(texts), np.int64), []
        pieces: list[np.ndarray] = []
        if plain:  # white space between a sign and a blank before a sign is a unit of its own
            found = self.split(SEPARATOR.join([texts[i] for i in plain]))
            units = dict.fromkeys(found)
            units = dict(zip(units, range(len(units))))
            numbers = np.fromiter(map(units.__getitem__, found), np.int64, len(found))
            feed = numbers == units.get(SEPARATOR, -1)
            bounds = np.append(np.flatnonzero(feed), len(numbers))
            counts[plain] = np.diff(bounds, prepend=-1) - 1
            pieces.append(numbers[~feed])
        for i in others:
            got = [units.setdefault(u, len(units)) for u in self.split(texts[i])]
            counts[i] = len(got)
            pieces.append(np.array(got, np.int64))
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        order = np.array(plain + others, np.int64)  # texts in the order of ``flat``
        starts = np.zeros(len(texts), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(starts, counts)], counts, list(units)

    def learn(self) -> None:
        """Encodes the new parts in one batch."""
        if not self.new:
            return
        numbers, counts, units = self.units_of(self.new)
        special = self.table.specials
        sizes, ids = PairIndex([b"" if u in special else u.encode() for u in units], self.table).encode()
        for k, u in enumerate(units):
            if u in special:  # one id of its own
                at = int(sizes[:k].sum())
                ids, sizes[k] = np.insert(ids, at, special[u]), 1
        starts = np.cumsum(sizes) - sizes
        flat = ids[spread(starts[numbers], sizes[numbers])].astype(np.int32)
        per_unit = np.append(0, np.cumsum(sizes[numbers]))
        ends = np.cumsum(counts)
        per_part = per_unit[ends] - per_unit[ends - counts]
        n = len(self.new)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used:self.used + len(flat)] = flat
        self.sizes[self.count:self.count + n] = per_part
        self.starts[self.count:self.count + n] = self.used + np.cumsum(per_part) - per_part
        self.used, self.count, self.new = self.used + len(flat), self.count + n, []


#: White space of the split pattern; the empty string stands for a missing neighbour.
SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c)) | {""}
#: A blank that is a cut, and one that is none.
CUT, UNCUT = re.compile(f"(?<![{_SPACE}]) | (?=[^{_SPACE}])"), re.compile(rf" (?=[{_SPACE}]|\Z)(?<=[{_SPACE}] )")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every stretch, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def cut_at_blanks(texts: list[str], store: Store) -> list[np.ndarray]:
    """Numbers of every text's parts. A blank between two white spaces is no cut, nor is any blank
    of a text with special strings; all other texts are cut together, and each part that
    occurs among them is looked up once."""
    out: list = [None] * len(texts)
    plain = []
    for i, text in enumerate(texts):
        if any(s in text for s in store.table.specials):
            out[i] = np.array([store.heads[text]])
        elif UNCUT.search(text):
            head, *rest = CUT.split(text)
            out[i] = np.array([store.heads[head], *map(store.parts.__getitem__, rest)])
        else:
            plain.append(i)
    if plain:
        cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        bounds, parts = cut.offsets.to_numpy(), cut.values
        head = np.zeros(len(parts), bool)
        head[bounds[:-1]] = True
        known = parts.filter(pa.array(~head)).dictionary_encode()
        words = known.dictionary.to_pylist()
        numbers = np.empty(len(parts), np.int64)
        numbers[~head] = np.fromiter(map(store.parts.__getitem__, words), np.int64, len(words))[known.indices.to_numpy()]
        firsts = parts.filter(pa.array(head)).to_pylist()
        numbers[head] = np.fromiter(map(store.heads.__getitem__, firsts), np.int64, len(firsts))
        for i, lo, hi in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = numbers[lo:hi]
    return out


def encode_batch(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each text has."""
    store = _KNOWN.pop(path, None)  # back when complete: a failed task leaves no half-filled store
    if store is None or store.count > TABLE_LIMIT:
        store = Store(merge_table(path))
    cut = cut_at_blanks(texts, store)
    store.learn()
    _KNOWN[path] = store
    per_text = np.fromiter(map(len, cut), np.int64, len(cut))
    at = np.concatenate(cut) if cut else np.zeros(0, np.int64)
    sizes = store.sizes[at]
    ends, reached = np.cumsum(per_text), np.append(0, np.cumsum(sizes))
    return store.flat[spread(store.starts[at], sizes)], reached[ends] - reached[ends - per_text]


def slices(texts: list[str], limit: int = BATCH_CHARS):
    """Bounds of stretches of about ``limit`` characters, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def texts_of(ids: np.ndarray, counts: np.ndarray, table: MergeTable) -> pa.Array:
    """The texts that the ids stand for, ``counts`` ids each; bytes that are no UTF-8 become U+FFFD."""
    out, ends = [], np.cumsum(counts)
    lo = 0
    while lo < len(counts):  # stretches of about DECODE_IDS ids, one text at least
        begin = ends[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + DECODE_IDS, side="right")))
        some = ids[begin:ends[hi - 1]]
        sizes = table.byte_sizes[some]
        data = table.byte_flat[spread(table.byte_starts[some], sizes)].tobytes()
        reached = np.append(0, np.cumsum(sizes))[np.append(0, ends[lo:hi] - begin)].tolist()
        out += [data[x:y].decode("utf-8", "replace") for x, y in zip(reached, reached[1:])]
        lo = hi
    return pa.array(out, pa.string())


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", decoded: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, ids array<int>), one row per row. With ``decoded``
    also the text the ids stand for, made in the same pass."""
    path = tokenizer_file(tokenizer)
    names = ["doc_id", "ids", *["text"] * decoded]

    def work(batches):
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, BATCH_ROWS):
                some = texts.slice(low, BATCH_ROWS).to_pylist()
                for lo, hi in slices(some):
                    ids, counts = encode_batch(some[lo:hi], path)
                    ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(low + lo, hi - lo), lists, *[
                        texts_of(ids, counts, merge_table(path)) for _ in names[2:]]], names=names)

    light = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return light.mapInArrow(work, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``encoded(doc_id, ids)`` -> the same plus text: special tokens are kept, null ids give ''."""
    path = tokenizer_file(tokenizer)

    def work(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([])
            ids, counts = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts_of(ids, counts, merge_table(path))], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The rows of ``op12``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, tokenizer, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
