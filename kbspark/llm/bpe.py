"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces of similar length share a padded matrix of token ids. In every round each
row merges its leftmost pair of minimum rank; the merged cell is compacted away, so
that all rows that are still at work stay equally wide. Pair ranks come from a hash
table with open addressing that is looked up for whole columns at once.

Cases: null text counts as empty and has no tokens; an empty table gives an empty
table; repeated rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import column, ragged, slices

NONE = np.int32(2**31 - 1)
#: White space of Unicode, as \s in the pretokenizer's pattern means it.
_WS = r"\t-\r \x85\xa0  -     　"
#: A run of other characters with the one blank that a piece may take along, or white space: no piece crosses these.
_CHUNK = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: Wider pieces go one by one through block minima.
WIDE = 1024
CELLS = 1 << 20


class PairTable:
    """Ranks by (left id, right id): open addressing with linear probing, built and read in whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(4 * len(rank)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several for one slot the last one wins
            won = self.keys[at[todo]] == keys[todo]
            self.ranks[at[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class BytePairCodec:
    """The ranks of a tiktoken file and the pattern that cuts a text into pieces."""

    def __init__(self, path: str, pattern: str, cache: int = 1_000_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.cache_size = regex.compile(pattern), cache
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        cols = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pair = PairTable(cols[0], cols[1], cols[2].astype(np.int32))
        vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            vocabulary[r] = t
        self.token_lens = np.array([len(t) for t in vocabulary], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[str, int] = {}
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece, each taken for itself."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[i] = np.array([r], np.int32)
            elif p:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        a = 0
        while a < len(todo):
            shortest = len(pieces[todo[a]])
            if shortest > WIDE:
                out[todo[a]] = self._merge_wide(self.byte_ids[np.frombuffer(pieces[todo[a]], np.uint8)])
                a += 1
                continue
            width = min(WIDE, shortest + max(2, shortest // 4))
            b = a
            while b < len(todo) and len(pieces[todo[b]]) <= width and (b - a) * width < CELLS:
                b += 1
            self._merge([pieces[i] for i in todo[a:b]], todo[a:b], out)
            a = b
        return out

    def _merge(self, pieces: list[bytes], where: list[int], out: list[np.ndarray]) -> None:
        lens = np.array([len(p) for p in pieces])
        n, width = len(pieces), int(lens.max())
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self._ranks_of(ids)
        rows = np.array(where)
        while len(rows):
            k = np.arange(len(rows))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[k, at] if rank.shape[1] else np.full(len(rows), NONE)
            if (over := best == NONE).any():
                for row, own in zip(rows[over].tolist(), ids[over]):
                    out[row] = own[own >= 0]
                go = ~over
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    break
                k = np.arange(len(rows))
            ids[k, at] = best
            stay = np.ones(ids.shape, bool)
            stay[k, at + 1] = False
            ids = ids[stay].reshape(len(rows), -1)
            stay = np.ones(rank.shape, bool)
            stay[k, at] = False
            rank = rank[stay].reshape(len(rows), -1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pair(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < rank.shape[1])
            following = ids[right, at[right] + 1]
            rank[right, at[right]] = np.where(following < 0, NONE, self.pair(best[right], following))

    def _ranks_of(self, ids: np.ndarray) -> np.ndarray:
        if ids.shape[1] < 2:
            return np.zeros((len(ids), 0), np.int32)
        rank = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rank[ids[:, 1:] < 0] = NONE
        return rank

    def _merge_wide(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: the same rounds, but cells are linked and compacted at the end, and minima kept by block."""
        n, block = len(ids), max(64, int(len(ids) ** 0.5))
        ids = ids.copy()
        blocks = -(-n // block)
        rank = np.full(blocks * block, NONE, np.int32)
        rank[: n - 1] = self.pair(ids[:-1], ids[1:])
        grid = rank.reshape(blocks, block)
        least = grid.min(1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            key = (int(ids[a]), int(ids[b]))
            if key not in known:
                known[key] = int(self.pair(ids[a : a + 1], ids[b : b + 1])[0])
            return known[key]

        while True:
            b = int(least.argmin())
            if least[b] == NONE:
                return ids[ids >= 0]
            i = b * block + int(grid[b].argmin())
            j = after[i]
            ids[i], ids[j] = rank[i], -1
            rank[j] = NONE
            k = after[i] = after[j]
            touched = {b, j // block}
            if k < n:
                before[k] = i
                rank[i] = pair(i, k)
            else:
                rank[i] = NONE
            if (h := before[i]) >= 0:
                rank[h] = pair(h, i)
                touched.add(h // block)
            for b in touched:
                least[b] = grid[b].min()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. What a run of characters between white space gives is kept, up to a bounded number of runs."""
        cut = [_CHUNK.findall(t) for t in texts]
        if len(self.chunks) > self.cache_size:
            self.forget()
        known = self.chunks
        new = list({c for own in cut for c in own if c not in known})
        if new:
            self._learn(new)
        out = []
        for own in cut:
            at = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            out.append(self.ids[ragged(self.starts[at], self.lens[at])])
        return out

    def _learn(self, new: list[str]) -> None:
        number: dict[str, int] = {}
        owns = [[number.setdefault(p, len(number)) for p in self.pattern.findall(c)] for c in new]
        ids = self.encode_pieces([p.encode() for p in number])
        lens = np.array([len(x) for x in ids], np.int64)
        flat, starts = np.concatenate(ids), np.cumsum(lens) - lens
        pieces = np.fromiter((p for own in owns for p in own), np.int64)
        counts = np.array([len(own) for own in owns], np.int64)
        ends = np.cumsum(np.concatenate([[0], lens[pieces]]))
        firsts = np.cumsum(counts) - counts
        size = len(self.ids)
        for i, c in enumerate(new, len(self.chunks)):
            self.chunks[c] = i
        self.starts = np.concatenate([self.starts, size + ends[firsts]])
        self.lens = np.concatenate([self.lens, ends[firsts + counts] - ends[firsts]])
        self.ids = np.concatenate([self.ids, flat[ragged(starts[pieces], lens[pieces])]])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged(self.token_starts[ids], self.token_lens[ids])].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): one row per row of docs; ids only if asked for."""

    def run(batches):
        use = codec(path, pattern)
        for batch in slices(batches, "text"):
            rows = use.encode([t or "" for t in column(batch, "text").to_pylist()])
            raw = [x.astype("<u4").tobytes() for x in rows]
            cols = [
                column(batch, "id"),
                pa.array([len(x) for x in rows], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([hashlib.sha256(use.decode(x)).hexdigest() for x in rows], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([x.tolist() for x in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for an array column of ids; null ids give an empty text, bytes that are no UTF-8 are replaced."""

    def run(batches):
        use = codec(path, pattern)
        for batch in batches:
            ids = column(batch, "ids").to_pylist()
            texts = [use.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
