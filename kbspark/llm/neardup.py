"""Near duplicates by HyperMinHash.

A document is its set of distinct shingles of words. Every shingle is hashed once and
falls into one of REGISTERS buckets; a bucket keeps the least hash, compressed to its
number of leading zeros (6 bits) and 10 mantissa bits. Buckets that stay empty are filled
by further passes with other hash functions (a pass counts as so many more leading zeros),
so that any two sets agree in a bucket with the probability of their Jaccard similarity,
however small they are. Bands of ROWS registers propose candidates in three turns: every member
of a bucket against the bucket's smallest id; where a bucket still holds several components, the
members outside its main component against one member of that; and where it holds several
even then, all pairs of members from different components, in bounded blocks that confirm what
they find themselves, so that no pairs are written. The estimate
from the registers, corrected for chance collisions, sieves the candidates; whole sets of
shingle hashes confirm them. The components of confirmed links are the groups.

At similarity 0.8, 32 bands of 4 miss a pair with probability (1 - 0.8^4)^32 < 5e-8; the
sieve stands 4.5 standard deviations below the threshold (a miss in 300,000 at the threshold).

Cases: null and blank texts have an empty set and link with nothing; fewer words than a
shingle make one shingle; texts with equal sets are collapsed to a class before banding, so
copies cost nothing there; repeated rows give repeated results; extra columns are ignored;
an empty table gives an empty table. Classes have numbers of their own, so that an id that stands on
several texts, or none at all, loses nothing: rows without an id take part by their text, and
component_id is null where no row of a component has an id; kept is true where the id equals the component's,
two nulls being equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, mix, partitions, slices, stored
from .graph import components, extended

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BUCKET_BITS = 7
#: A block of a bucket has about so many rows, and so many shingle hashes (or one row) on either side.
BLOCK, BLOCK_HASHES = 256, 1 << 19
#: Bytes of the words whose hashes a task remembers, about.
CACHE = 24 << 20
#: Longer words (bytes) aren't remembered.
LONG = 64


class _Words(dict):
    """Hashes of words; a task has one, and it goes with the task."""

    def __init__(self):
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            self[word] = h
            self.bytes += 150 + len(word)
        return h


def shingles(texts: list[str | None], k: int, known: _Words | None = None) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of k words."""
    known = _Words() if known is None else known
    out = []
    for t in texts:
        if known.bytes > CACHE:
            known.clear()
            known.bytes = 0
        own = (t or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        width = min(k, len(h))
        if not width:
            out.append(h)
            continue
        acc = mix(h[: len(h) - width + 1], width)
        with np.errstate(over="ignore"):
            for i in range(1, width):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i], i)
        out.append(np.unique(acc))
    return out


def registers(sets: list[np.ndarray], most_passes: int = 4096) -> np.ndarray:
    """len(sets) x REGISTERS compressed registers; the sets are not empty."""
    lens = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    out = np.zeros((n, REGISTERS), np.uint16)
    empty = np.ones((n, REGISTERS), bool)
    rows, flat = np.repeat(np.arange(n), lens), np.concatenate(sets) if n else np.zeros(0, np.uint64)
    for turn in range(most_passes):
        if not len(flat):
            break
        h = mix(flat, 1000 + turn)
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, rows * REGISTERS + bucket, h << np.uint64(BUCKET_BITS))
        least = least.reshape(n, REGISTERS)
        fill = empty & (least != np.iinfo(np.uint64).max)
        v = least[fill]
        zeros = (64 - BUCKET_BITS) - np.ceil(np.log2((v >> np.uint64(BUCKET_BITS)).astype(np.float64) + 1)).astype(np.int64)
        zeros = np.clip(zeros, 0, 64 - BUCKET_BITS)
        with np.errstate(over="ignore"):
            kept = (v << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        if turn:  # of a later pass: the number of zeros is full, and the pass marks the mantissa
            kept = mix((kept << np.uint64(6)) | zeros.astype(np.uint64), turn) >> np.uint64(64 - MANTISSA)
            zeros = np.full(len(zeros), 63)
        out[fill] = (zeros.astype(np.uint16) << MANTISSA) | kept.astype(np.uint16)
        empty &= ~fill
        go = empty.any(1)[rows]
        rows, flat = rows[go], flat[go]
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the share that agrees by chance (about 0.17 / 2^mantissa bits)."""
    chance = 0.1699 / 2**MANTISSA
    return np.maximum(0, ((a == b).mean(-1) - chance) / (1 - chance))


def _sieve(similarity: float) -> float:
    return similarity - 4.5 * (similarity * (1 - similarity) / REGISTERS) ** 0.5


def _regs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, mark, n, set_key, regs) of (id, mark, text); key and registers are null for empty sets."""

    def run(batches):
        known = _Words()
        for batch in slices(batches, "text"):
            sets = shingles(column(batch, "text").to_pylist(), k, known)
            regs = iter(registers([s for s in sets if len(s)]))
            rows = [(_set_key(s), next(regs).astype("<u2").tobytes()) if len(s) else (None, None) for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "mark"), *cols], ["id", "mark", "n", "set_key", "regs"])

    return docs.select("id", "mark", "text").mapInArrow(run, "id bigint, mark bigint, n bigint, set_key binary, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(band, key, id): one row per band of each representative."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _regs(column(batch, "regs")).astype(np.uint64).reshape(batch.num_rows, -1, ROWS)
            key = np.broadcast_to(np.arange(regs.shape[1], dtype=np.uint64), regs.shape[:2])
            for i in range(ROWS):
                key = mix((key << np.uint64(16)) ^ regs[:, :, i] ^ mix(key, 7), 50 + i)
            ids = np.repeat(column(batch, "id").to_numpy(zero_copy_only=False), regs.shape[1])
            band = np.tile(np.arange(regs.shape[1], dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(key.ravel().view(np.int64)), pa.array(ids)], ["band", "key", "id"])

    return reps.select("id", "regs").mapInArrow(run, "band int, key bigint, id bigint")


def _likely(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b), those whose registers leave the similarity possible."""
    least = _sieve(similarity)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = estimate(_regs(column(batch, "ra")), _regs(column(batch, "rb"))) >= least
                yield batch.filter(pa.array(ok)).select(["a", "b"])

    one = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a bigint, b bigint")


class _Sets:
    """Whole shingle sets of the classes that candidates name, each computed once, from the row that stands for the class.

    docs: id, mark, text; where: id (the class), low (its row's id), mark, set_key.
    """

    def __init__(self, docs: DataFrame, where: DataFrame, k: int):
        self.docs, self.where, self.k, self.known = docs, where, k, None

    def _add(self, ids: DataFrame) -> None:
        k = self.k

        def run(batches):
            known, done = _Words(), set()  # done: classes, so that repeated rows count once
            for batch in slices(batches, "text"):
                classes, keys = column(batch, "rep").to_pylist(), column(batch, "set_key").to_pylist()
                sets = shingles(column(batch, "text").to_pylist(), k, known)
                own = []
                for i, (c, key, s) in enumerate(zip(classes, keys, sets)):
                    if c not in done and _set_key(s) == key:
                        done.add(c)
                        own.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([classes[i] for i in own], pa.int64()), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["id", "hashes"])

        wanted = self.where.join(ids, "id", "left_semi").select(F.col("id").alias("rep"), "low", F.col("mark").alias("row_mark"), "set_key")
        # shuffled at every size: the classes grow with the documents
        same = F.col("id").eqNullSafe(F.col("low")) & (F.col("mark") == F.col("row_mark"))
        new = stored(self.docs.join(wanted.hint("merge"), same).select("rep", "set_key", "text").mapInArrow(run, "id bigint, hashes array<bigint>"), "sets")
        self.known = new if self.known is None else self.known.union(new)

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, hashes) of all that are known, those of the ids among them."""
        if self.known is not None:
            ids = stored(ids.join(self.known.select("id"), "id", "left_anti"), "ids")
        if self.known is None or not ids.isEmpty():
            self._add(ids)
        return self.known

    def confirmed(self, pairs: DataFrame, per_cent: int) -> DataFrame:
        """Of the pairs (a, b), those with 100 * intersection >= per_cent * union."""
        known = self.of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        one = lambda x: known.select(F.col("id").alias(x), F.col("hashes").alias(f"s{x}"))
        joined = pairs.join(one("b").hint("merge"), "b").join(one("a").hint("merge"), "a")
        common = joined.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
        return common.where((F.col("n") * 100) >= (F.col("na") + F.col("nb") - F.col("n")) * per_cent).select("a", "b").distinct()


def _mixed(multi: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bucket members (band, key, id, label), and the buckets of more than two that hold several
    components: (band, key, main, head), with the main component and one of its members."""
    own = stored(multi.join(labels.withColumnRenamed("component", "label"), "id", "left").select("band", "key", "id", F.coalesce("label", "id").alias("label")), "own")
    per = own.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.max(F.struct(F.xxhash64("id", "band"), "id")).alias("head"))
    main = F.max(F.struct("n", "label", "head"))
    buckets = per.groupBy("band", "key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), main.alias("m")).where("labels > 1 and n > 2")
    return own, stored(buckets.select("band", "key", F.col("m.label").alias("main"), F.col("m.head.id").alias("head")), "mixed")


def _second(own: DataFrame, mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a member of a bucket's main component and each member outside it."""
    outside = own.join(mixed, ["band", "key"]).where("label <> main")
    return outside.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct()


def _rest(own: DataFrame, mixed: DataFrame, reps: DataFrame, sets: _Sets, similarity: float, per_cent: int) -> DataFrame:
    """Confirmed links (a, b) between members of one bucket but of different components: those
    outside a bucket's main component against all its members, in blocks of about BLOCK rows or
    BLOCK_HASHES shingles on either side. A pair that meets in several buckets counts in the first. A first pass over
    the registers finds the rows of a block that have a likely partner; only these get
    their sets, and a second pass confirms the pairs where they stand and gives a spanning forest of the links."""
    rows = own.join(mixed.select("band", "key", "main"), ["band", "key"]).select("band", "key", "id", "label", (F.col("label") != F.col("main")).alias("minor"))
    rows = stored(rows.join(reps.select("id", "n", "regs"), "id"), "rows")
    blocks = lambda of: F.greatest(F.ceil(F.count_if(of) / F.lit(BLOCK)), F.ceil(F.sum(F.when(of, F.col("n"))) / F.lit(BLOCK_HASHES))).cast("int")
    sizes = stored(rows.groupBy("band", "key").agg(blocks(F.lit(True)).alias("nb"), blocks(F.col("minor")).alias("mb")), "sizes")
    rows = rows.join(sizes, ["band", "key"])
    block = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where("minor").withColumn("i", block(1, F.col("mb"))).withColumn("j", every(F.col("nb"))).withColumn("side", F.lit(0))
    right = rows.withColumn("j", block(2, F.col("nb"))).withColumn("i", every(F.col("mb"))).withColumn("side", F.lit(1))
    keys = ["band", "key", "i", "j"]
    cols = [*keys, "side", "id", "label", "n", "regs"]
    least = _sieve(similarity)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(own.sparkSession), *keys).sortWithinPartitions(*keys, "side")

    def likely(group: pa.Table):
        """(row, rows of the other side) that may be linked and that meet here first."""
        at, band = int(np.searchsorted(group["side"].to_numpy(), 1)), group["band"][0].as_py()
        label, n, regs = group["label"].to_numpy(), group["n"].to_numpy(), _regs(group["regs"])
        for x in range(at):
            y = np.arange(at, len(n))
            y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]) - 1e-6)]
            if len(y):
                y = y[estimate(regs[x], regs[y]) >= least]
            if len(y):
                shared = (regs[y] == regs[x]).reshape(len(y), -1, ROWS).all(2)
                y = y[shared.argmax(1) == band]
            if len(y):
                yield x, y

    def sieve(batches):
        for group in groups(batches, keys):
            use = np.zeros(group.num_rows, bool)
            for x, y in likely(group):
                use[x] = use[y] = True
            yield from group.filter(pa.array(use)).combine_chunks().to_batches()

    def confirm(batches):
        for group in groups(batches, keys):
            lists = group["hashes"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            own_sets = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
            ids, label = group["id"].to_numpy(), group["label"].to_numpy()
            root = {int(v): int(v) for v in label}

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            found = []
            for x, many in likely(group):
                for y in many.tolist():
                    a, b = find(int(label[x])), find(int(label[y]))
                    if a != b:
                        both = len(np.intersect1d(own_sets[x], own_sets[y], assume_unique=True))
                        if both * 100 >= (len(own_sets[x]) + len(own_sets[y]) - both) * per_cent:
                            root[a] = b
                            found.append((int(ids[x]), int(ids[y])))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    all_rows = left.select(cols).unionByName(right.select(cols))
    active = stored(dealt(all_rows).mapInArrow(sieve, all_rows.schema), "active")
    known = sets.of(active.select("id").distinct())
    return dealt(active.join(known.hint("merge"), "id").select(*cols, "hashes")).mapInArrow(confirm, "a bigint, b bigint").distinct()


def groups(batches, keys: list[str]):
    """Tables of the rows with equal keys, from sorted batches; only one group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), t.num_rows]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", words: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs."""
    similarity = per_cent / 100
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    sigs = stored(signatures(docs, words), "sigs")
    # a class is stood for by the row with the smallest id (rows without one last); its number is fixed by writing it
    row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("row")
    classes = sigs.where("set_key is not null").groupBy("set_key").agg(row, F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), F.col("row.id").alias("low"), F.col("row.mark").alias("mark"), "set_key", "n", "regs"), "classes")
    reps = classes.select("id", "n", "regs")

    bands = stored(_bands(reps), "bands")
    leaders = stored(bands.groupBy("band", "key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    multi = stored(bands.join(leaders, ["band", "key"]).select("band", "key", "id", "leader"), "multi")
    sets = _Sets(docs, classes.select("id", "low", "mark", "set_key"), words)
    labels = None
    for turn in range(3):
        if turn == 0:
            pairs = multi.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        else:
            own, mixed = _mixed(multi, labels)
            pairs = _second(own, mixed)
        if turn < 2:
            new = sets.confirmed(stored(_likely(pairs, reps, similarity), "likely"), per_cent)
        else:
            new = _rest(own, mixed, reps, sets, similarity, per_cent)
        new = stored(new, "links")
        labels = stored(components(new), "labels") if labels is None else extended(labels, new)
    linked = stored(labels.join(classes.select("id", "low"), "id"), "linked")
    least = stored(linked.groupBy("component").agg(F.min("low").alias("least")), "least")
    per = linked.join(least, "component").select("id", "least")
    per = stored(classes.select("id", "set_key", "low").join(per, "id", "left").select("set_key", F.coalesce("least", "low").alias("component_id")), "components")
    out = sigs.select("id", "n", "set_key").join(per, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
