"""Exact deduplication with counting quotient filters.

Texts are normalised by deleting ASCII white space and hashed. Every partition builds counting
quotient filters of its 64-bit fingerprints, one per segment of the fingerprint space; the
filters of a segment are decoded to sorted remainders, merged with their counts summed, and
encoded again, which loses nothing. Only texts whose fingerprint has a count above one go on:
they are grouped by their normalised bytes themselves. A fingerprint is one entry of a
filter however often it occurs, so that no group of copies meets in one task, and grouping by
bytes combines copies within each task before it shuffles.

Cases: null text counts as empty, and empty or blank texts are equal to one another; of equal
texts the row with most code points and then the smallest id stays, rows without an id last;
repeated rows are each returned, and all of them are `kept` if their id is; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, column, partitions, slices, stored

#: Fingerprints that one task gathers before it writes out its filters.
FLUSH = 4_000_000


class CountingQuotientFilter:
    """An immutable counting quotient filter over 64-bit fingerprints of one segment.

    A fingerprint without its segment bits is a quotient (the home slot) and a remainder. Slots
    hold the remainders of all runs in order; `occupied` marks quotients that have a run,
    `run_end` the last slot of a run, `counted` slots whose counter is above one.
    """

    def __init__(self, segment_bits: int, quotient_bits: int, remainders: np.ndarray, occupied: np.ndarray, run_end: np.ndarray, counted: np.ndarray, counters: np.ndarray):
        self.segment_bits, self.quotient_bits = segment_bits, quotient_bits
        self.remainders, self.occupied, self.run_end, self.counted, self.counters = remainders, occupied, run_end, counted, counters

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, segment_bits: int) -> CountingQuotientFilter:
        """keys: sorted distinct fingerprints of one segment."""
        quotient_bits = min(24, max(1, int(len(keys)).bit_length()))
        shift = np.uint64(64 - segment_bits - quotient_bits)
        quotient = ((keys >> shift) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotient] = True
        run_end = np.ones(len(keys), bool)
        run_end[:-1] = quotient[1:] != quotient[:-1]
        counted = counts > 1
        return cls(segment_bits, quotient_bits, keys & ((np.uint64(1) << shift) - np.uint64(1)), occupied, run_end, counted, counts[counted])

    def items(self, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        shift = np.uint64(64 - self.segment_bits - self.quotient_bits)
        run = np.cumsum(self.run_end) - self.run_end
        quotient = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        top = np.uint64((segment << (64 - self.segment_bits)) & 0xFFFFFFFFFFFFFFFF if self.segment_bits else 0)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.counted] = self.counters
        return top | (quotient << shift) | self.remainders, counts

    def to_bytes(self) -> bytes:
        """Remainders take as many whole bytes as their bits need."""
        width = -(-(64 - self.segment_bits - self.quotient_bits) // 8)
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counted)]
        return struct.pack("<BBQQ", self.segment_bits, self.quotient_bits, len(self.remainders), len(self.counters)) + low.tobytes() + b"".join(bits) + self.counters.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        segment_bits, quotient_bits, n, c = struct.unpack_from("<BBQQ", raw)
        width, at = -(-(64 - segment_bits - quotient_bits) // 8), 18
        low = np.zeros((n, 8), np.uint8)
        low[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        bits = []
        for size in (1 << quotient_bits, n, n):
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(segment_bits, quotient_bits, low.view("<u8").ravel(), *bits, np.frombuffer(raw, "<i8", c, at))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], segment: int) -> CountingQuotientFilter:
        keys, counts = zip(*(f.items(segment) for f in filters))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")  # runs that are sorted already
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return cls.build(keys[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].segment_bits)


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACES)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, sha, fp) of the rows' normalised texts."""

    def run(batches):
        for batch in slices(batches, "text"):
            texts = column(batch, "text").to_pylist()
            shas = [hashlib.sha256(normalised(t)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(shas, pa.binary()), pa.array([struct.unpack("<q", s[:8])[0] for s in shas], pa.int64())],
                ["doc_id", "n_points", "sha", "fp"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_points bigint, sha binary, fp bigint")


def repeated(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) for the fingerprints (column fp) that occur more than once, through merged filters."""
    spark = fingerprints.sparkSession
    parts = partitions(spark)
    bits = max(2, (4 * parts - 1).bit_length())  # segments grow with the number of partitions

    def write(keys: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        segment = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(segment)) + 1
        blocks = [(int(segment[a]), CountingQuotientFilter.build(keys[a:b], counts[a:b], bits).to_bytes()) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in blocks], pa.int32()), pa.array([f for _, f in blocks], pa.binary())], ["segment", "filter"])

    def build(batches):
        held, n = [], 0
        for batch in batches:
            held.append(column(batch, "fp").to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= FLUSH:
                yield write(held)
                held, n = [], 0
        if n:
            yield write(held)

    def merge(batches):
        last, held = None, []

        def over():
            keys, counts = CountingQuotientFilter.merge(held, last).items(last)
            return pa.RecordBatch.from_arrays([pa.array(keys[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["fp", "n"])

        for batch in batches:
            for segment, raw in zip(column(batch, "segment").to_pylist(), column(batch, "filter").to_pylist()):
                if held and segment != last:
                    yield over()
                    held = []
                elif len(held) > 64:
                    held = [CountingQuotientFilter.merge(held, segment)]
                last = segment
                held.append(CountingQuotientFilter.from_bytes(raw))
        if held:
            yield over()

    filters = fingerprints.select("fp").mapInArrow(build, "segment int, filter binary")
    return filters.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(merge, "fp bigint, n bigint")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stored(digests(docs), "digests")
    twice = stored(repeated(found), "repeated")
    ids = stored(found.join(twice, "fp", "left_semi").select("doc_id").distinct(), "ids")
    same = docs["doc_id"].eqNullSafe(ids["doc_id"])
    texts = docs.join(ids, same, "left_semi").select("doc_id", F.translate(F.coalesce("text", F.lit("")), SPACES.decode(), "").alias("bytes"), F.length(F.coalesce("text", F.lit(""))).alias("points"))
    best = F.max(F.struct(F.col("points"), (-F.col("doc_id")).alias("minus")))
    groups = texts.groupBy("bytes").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select(F.unhex(F.sha2(F.col("bytes").cast("binary"), 256)).alias("sha"), (-F.col("best.minus")).alias("keep"), "n"), "groups")
    out = found.join(groups, "sha", "left")
    # a group's only row keeps itself; rows whose id is that of the one that stays are copies of it
    return out.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
