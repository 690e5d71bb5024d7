"""Sum-of-squares online packing of token ids into fixed windows.

Documents of a partition arrive one by one. Each is tokenized, an end id is appended, whole
windows are cut off its front, and the rest goes to the fill level that keeps the sum of the
squared counts of partially filled windows smallest (the level array ``counts[fill]``); at
ties to the fullest window. A new window is the level 0. Only partially filled windows are
held in memory, so the state is a few windows however many documents pass.

What is left open when a partition ends is poured together in order of fill and cut at the
window length; the last remainder is cut into pieces of powers of two, the lengths that are
not padded. So only the last few windows of a partition hold documents cut for that reason.

Tokens come from the ``tokenizers`` library. A text is cut at single blanks between
non-blank characters - always a boundary of the byte-level pre-tokenizer - and each distinct
part is encoded once per worker (a bounded cache); texts with blanks next to other white
space are encoded whole. Parts of the first 256 characters are cut into pre-tokens here, whose
kinds no Unicode version changes, and each distinct pre-token is encoded once; the library's
own pre-tokenizer, which takes most of its time, cuts the others.

Edge cases: null text counts as empty and yields the end id alone; a null doc_id is passed
through; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import tokenizer_file

WINDOW, END_ID, CACHE_LIMIT, BATCH_TEXTS = 2048, 1, 800_000, 2048
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
#: The byte-level split pattern, for the first 256 characters only.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Parts that are cut by it: white space at neither end, and neither of the signs put between parts and pre-tokens.
LATIN_PART = re.compile(r"(?!\s)[\x01-\x0a\x0c-\xff]+(?<!\s)")
_TOKENIZERS: dict = {}
_PARTS: dict = {}


def load_tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class IdTable(dict):
    """Distinct strings -> numbers; the ids of number n are ``flat[starts[n]:starts[n] + sizes[n]]``.
    New strings wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n

    def numbers(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))

    def take_new(self) -> tuple[int, list[str]]:
        """The new strings, of size -1 until they are put, and the number of the first."""
        new, self.new = self.new, []
        while len(self) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.sizes[len(self) - len(new):len(self)] = -1
        return len(self) - len(new), new

    def put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` holds those of all ``numbers``, one after the other."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += len(ids)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of all ``numbers``, one after the other."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PartTable(IdTable):
    """Parts after a blank. Size -1 marks a part whose blank is no boundary."""

    def __init__(self, tok):
        super().__init__()
        self.tok, self.bare, self.pretokens = tok, BareModel.of(tok), IdTable()
        self.specials = [t.content for t in tok.get_added_tokens_decoder().values()]

    def learn(self) -> None:
        """Encodes the new parts; white space at an end of one means its blank is no boundary."""
        first, new = self.take_new()
        latin = [i for i, p in enumerate(new) if LATIN_PART.fullmatch(p)] if self.bare else []
        text = "\v".join([new[i] for i in latin])
        if any(s in text for s in self.specials):
            latin = [i for i in latin if not any(s in new[i] for s in self.specials)]
        self.cut(first, new, latin)
        rest = set(range(len(new))).difference(latin)
        rest = [i for i in sorted(rest) if new[i] and not (new[i][0].isspace() or new[i][-1].isspace())]
        for lo in range(0, len(rest), 4096):
            some = rest[lo:lo + 4096]
            got = [e.ids for e in self.tok.encode_batch_fast([" " + new[i] for i in some], add_special_tokens=False)]
            self.put(np.array(some) + first, np.array([len(x) for x in got]), np.array([i for x in got for i in x], "<u4"))

    def cut(self, first: int, new: list[str], latin: list[int]) -> None:
        """The same for some of them by their pre-tokens: all are cut in one go with a sign between them that is,
        before a blank and a sign that is no white space, a pre-token of its own."""
        if not latin:
            return
        known = self.pretokens
        numbers = known.numbers(PRETOKEN.findall(" " + "\v ".join([new[i] for i in latin]) + "\v"))
        start, units = known.take_new()
        for lo in range(0, len(units), 1024):
            some = units[lo:lo + 1024]
            known.put(np.arange(start + lo, start + lo + len(some)), *self.bare.encode(some))
        between = numbers == known["\v"]
        ends = np.cumsum(np.where(between, 0, known.sizes[numbers]))[between]
        self.put(np.array(latin) + first, np.diff(ends, prepend=0), known.ids(numbers[~between]))


def byte_signs() -> np.ndarray:
    """Byte -> its sign in a byte-level vocabulary: printable bytes stand for themselves, the others for the
    signs from 256 on. Zero stays, to stand between pre-tokens."""
    printable = np.zeros(256, bool)
    for lo, hi in ((33, 127), (161, 173), (174, 256)):
        printable[lo:hi] = True
    signs = np.where(printable, np.arange(256), 255 + np.cumsum(~printable))
    signs[0] = 0
    return signs.astype("<u2")


class BareModel:
    """The model of a tokenizer for pre-tokens written in the byte-level signs, with zeros between them."""

    signs = byte_signs()

    def __init__(self, tok):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer(tok.model)
        self.tok.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.spans = np.zeros(1 + max(vocab.values()), np.int64)  # bytes an id stands for
        self.spans[list(vocab.values())] = [len(token) for token in vocab]

    @classmethod
    def of(cls, tok) -> BareModel | None:
        """None if ``tok`` is not of the kind whose pre-tokens ``PRETOKEN`` finds."""
        from tokenizers import models, pre_tokenizers

        pre = tok.pre_tokenizer
        if not (isinstance(tok.model, models.BPE) and tok.model.dropout is None and isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex
                and not pre.add_prefix_space and tok.normalizer is None and tok.truncation is None and tok.padding is None):
            return None
        bare = cls(tok)
        signs = bare.signs[1:].tobytes().decode("utf-16-le")
        return bare if all(bare.tok.token_to_id(sign) is not None for sign in signs) else None  # no byte is lost

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the pre-tokens, none of which holds a zero."""
        raw = np.frombuffer("\0".join(units).encode(), np.uint8)
        got = self.tok.encode_batch_fast([self.signs[raw].tobytes().decode("utf-16-le")], add_special_tokens=False)[0]
        ids = np.array(got.ids, "<u4")
        ends = np.append(np.flatnonzero(raw == 0), len(raw)) - np.arange(len(units))
        return np.diff(np.searchsorted(np.cumsum(self.spans[ids]), ends, "right"), prepend=0), ids


def encode_texts(texts: list[str] | pa.Array, path: str) -> list[bytes]:
    """Ids of every text as little-endian unsigned 32-bit numbers, without special tokens
    added. The same ids as ``Tokenizer.encode``; see the module text for the shortcut."""
    tok = load_tokenizer(path)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    known = _PARTS.pop(path, None)  # back when complete: a failed task leaves no half-filled table
    if known is None or len(known) > CACHE_LIMIT:
        known = PartTable(tok)
    parts = pc.split_pattern(texts, " ")
    bounds, parts = parts.offsets.to_numpy().astype(np.int64), parts.values
    heads = parts.take(pa.array(bounds[:-1])).to_pylist()
    later = np.ones(bounds[-1] - bounds[0], bool)
    later[bounds[:-1] - bounds[0]] = False
    coded = parts.slice(bounds[0], len(later)).filter(pa.array(later)).dictionary_encode()
    at = known.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
    bounds = bounds - bounds[0] - np.arange(len(bounds))  # without the heads
    known.learn()
    _PARTS[path] = known
    first = tok.encode_batch_fast(heads, add_special_tokens=False)
    out = []
    for n, (head, lo, hi, enc) in enumerate(zip(heads, bounds[:-1].tolist(), bounds[1:].tolist(), first)):
        mine = at[lo:hi]
        if hi > lo and (not head or head[-1].isspace() or known.sizes[mine].min() < 0):
            out.append(np.array(tok.encode(texts[n].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes())
        else:
            out.append(np.array(enc.ids, dtype="<u4").tobytes() + known.ids(mine).tobytes())
    return out


class Packer:
    """State of one partition. ``emit`` collects (doc, start, length, crc, total, seq, offset)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next_sequence = window, first_sequence
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.emit: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.emit.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_sequence, at))
            at += len(ids) // 4
        self.next_sequence += 1

    def add(self, doc, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        whole = total - total % w
        for start in range(0, whole, w):
            self.close([(doc, start, ids[4 * start:4 * (start + w)], total)])
        size = total - whole
        if not size:
            return
        piece = (doc, whole, ids[4 * whole:], total)
        # change of the sum of squares if the piece moves a window from fill h to h + size
        c = self.counts
        levels = np.arange(0, w - size + 1)
        change = 2 * c[levels + size] + 1 - np.where(levels > 0, 2 * c[levels] - 1, 0)
        change[-1] -= 2 * c[w] + 1  # a full window is no partially filled one
        change[1:][c[1:w - size + 1] == 0] = np.iinfo(np.int64).max
        fill = int(len(change) - 1 - np.argmin(change[::-1]))
        pieces = self.open[fill].pop() if fill else []
        if fill:
            c[fill] -= 1
        pieces.append(piece)
        if fill + size == w:
            self.close(pieces)
        else:
            c[fill + size] += 1
            self.open.setdefault(fill + size, []).append(pieces)

    def finish(self) -> None:
        w = self.window
        rest = [p for fill in sorted(self.open, reverse=True) for pieces in self.open[fill] for p in pieces]
        left = sum(len(p[2]) // 4 for p in rest)
        room, pieces = None, []
        for doc, start, ids, total in rest:
            while ids:
                if room is None:
                    room = w if left >= w else 1 << (left.bit_length() - 1)
                    size = room
                n = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[:4 * n], total))
                start, ids, room = start + n, ids[4 * n:], room - n
                if room == 0:
                    self.close(pieces)
                    left, room, pieces = left - size, None, []
        self.open.clear()


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW,
                   end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Every partition packs its own rows; sequence ids hold the partition number in their
    upper half, so a retried task gives the same ids."""
    path = tokenizer_file(tokenizer)

    def work(batches):
        from pyspark import TaskContext

        packer = Packer(window, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([(n, pa.int64()) for n in
                            ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def rows():
            out, packer.emit = packer.emit, []
            cols = list(zip(*out)) or [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                for doc, enc in zip(ids.slice(lo, BATCH_TEXTS).to_pylist(), encode_texts(texts.slice(lo, BATCH_TEXTS), path)):
                    packer.add(doc, enc + end)
                yield rows()
        packer.finish()
        yield rows()

    light = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return light.mapInArrow(work, SCHEMA)
