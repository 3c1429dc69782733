"""Packing token sequences by bounded-space online best-fit.

Every document's ids, with the separator id behind them, are cut into pieces of at most
`capacity`; pieces that fill a sequence go alone. The rest are dealt to packers by hash and
each packer works online: a fixed number of bins is open, their free space is kept in a
bitset (bit f is set if some open bin has f tokens free), a piece goes to the fullest bin
into which it fits, which is the lowest set bit at or above its length, and when a new bin
would be one too many the fullest open bin closes. Only ids, lengths and places are
shuffled, never tokens. The number of packers follows the number of pieces, so that what
stays open at their ends is a vanishing share.

Cases: null or empty text is one piece with the separator alone; repeated rows are packed
each for itself; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import column, ragged, slices, stored

OPEN = 512
#: Pieces per packer, on average.
SHARE = 60_000
#: Runs whose ids a worker keeps at once.
CACHE = 400_000


#: Of a byte in lower case: 1 letters and digits of ASCII, 2 its punctuation, 3 apostrophes, 0 the rest.
_KIND = np.array([1 if 97 <= c <= 122 or 48 <= c <= 57 else 3 if c == 39 else 2 if 33 <= c <= 126 and not 65 <= c <= 90 else 0 for c in range(256)], np.uint8)


def _runs(text: str | None) -> list[bytes]:
    """Runs between ASCII white space, cut where the tokenizer cuts whatever stands around: between an ASCII letter or
    digit and punctuation, either way, but not behind an apostrophe, which may take letters with it."""
    raw = (text or "").encode().lower()
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    left, right = kind[:-1], kind[1:]
    cut = np.flatnonzero(((left == 1) & (right > 1)) | ((left == 2) & (right == 1)))
    return (np.insert(np.frombuffer(raw, np.uint8), cut + 1, 32).tobytes() if len(cut) else raw).split()


class _Numbers(dict):
    """Numbers of runs, in order of first appearance; `new` has those without ids."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, run: bytes) -> int:
        n = self[run] = len(self)
        self.new.append(run)
        return n


class WordTokens:
    """Ids of texts by a tokenizer of lower case that never lets a token cross ASCII white space: what a run of other characters gives is kept.

    Texts with one of the tokenizer's markers, which it takes for tokens of their own, go to it as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.runs = _Numbers()
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.runs) > CACHE:
            self.forget()
        number = self.runs.__getitem__
        marked = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if t and any(m in t for m in self.markers)}
        rows = []
        for i, t in enumerate(texts):
            own = [] if i in marked else _runs(t)
            rows.append(np.fromiter(map(number, own), np.int64, len(own)))
        new, self.runs.new = self.runs.new, []
        ids, lens = [self.ids], [self.lens]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            # as one text that is cut already: a token knows its run's number
            got = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            lens.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        self.ids, self.lens = np.concatenate(ids), np.concatenate(lens)
        self.starts = np.cumsum(self.lens) - self.lens
        return [np.array(marked[i], np.uint32) if i in marked else self.ids[ragged(self.starts[at], self.lens[at])] for i, at in enumerate(rows)]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int, separator: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of documents cut at the capacity."""

    def run(batches):
        use = word_tokens(path)
        for batch in slices(batches, "text"):
            cols: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), use.encode(column(batch, "text").to_pylist())):
                ids = np.append(ids, np.uint32(separator)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    for col, x in zip(cols, (doc, piece, start, len(own), zlib.crc32(own.tobytes()), own if with_ids else None)):
                        col.append(x)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            upto = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds))[:upto]], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:upto])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


class BestFit:
    """Online best-fit over a bounded number of open bins."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f: an open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, free = self.next, self.capacity
            self.next += 1
        if left := free - length:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free &= ~(1 << free)
        self.open -= 1
        return number


def pack(cut: DataFrame, capacity: int = 2048, most: int = OPEN) -> DataFrame:
    """cut (doc_id, piece, length, ...) with sequence_id and offset."""
    cut = stored(cut, "pieces")
    packers = max(1, round(cut.count() / SHARE))
    names = cut.columns
    # places are found for (hash, doc_id, piece) in a fixed order, so that a task that runs again finds the same
    h = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    dealt = cut.withColumns({"_h": h, "_packer": F.pmod(h, F.lit(packers)).cast("int")})

    def run(batches):
        last, bins = None, None
        for batch in batches:
            numbers, offsets = [], []
            for packer, n in zip(column(batch, "_packer").to_pylist(), column(batch, "length").to_pylist()):
                if packer != last:
                    last, bins = packer, BestFit(capacity, most)
                number, offset = bins.place(n)
                numbers.append((packer << 40) | number)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    schema = cut.schema.simpleString()[len("struct<") : -1]
    sorted_ = dealt.repartition(packers, "_packer").sortWithinPartitions("_packer", "_h", "doc_id", "piece", "start")
    return sorted_.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pack(pieces(docs, path, capacity, separator, with_ids), capacity)
