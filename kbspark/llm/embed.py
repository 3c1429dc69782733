"""Near duplicates of vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; each projection is shifted and cut
into cells of width WIDTH, PROJECTIONS cells make a key, and there are TABLES tables. Vectors
that share a key in some table are compared by exact cosine in double precision. Identical
vectors are one class throughout. Buckets are compared in blocks of about BLOCK classes
on either side, so that no task holds a whole large bucket; a block gives the number of links of
each class and a spanning forest of them, never its pairs. A pair that shares several keys
counts in its first table only: keys are computed in exact (integer-valued) arithmetic, so that
every task finds the same ones.

At cosine 0.9 (distance 0.447) two vectors share a cell with probability 0.822, so 48 tables of
12 miss a pair with probability (1 - 0.822^12)^48 < 0.01, and at 0.95 with less than 3e-5.

Cases: null and zero vectors, and those with null or non-finite components, link with nothing;
vectors of different length are never compared; repeated rows are links of one another; classes have numbers
of their own, so that rows without an id, and vectors that share one, are compared like others: component_id is
null where no row of a component has an id, and kept is true where the id equals the component's, two nulls
being equal; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, mix, partitions, ragged, stored
from .graph import components, forest

TABLES, PROJECTIONS, WIDTH, BLOCK = 48, 12, 2.0, 512
#: Groups of at most so many rows are multiplied together with others of their size, so many numbers at once.
SMALL, PART = 64, 1 << 20
#: Vectors and directions are rounded to multiples of these, so that sums of products are exact.
GRID, GRAIN = float(1 << 20), float(1 << 14)


@functools.lru_cache(maxsize=8)
def _directions(dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_000 + dims)
    a = np.rint(rng.standard_normal((dims, TABLES * PROJECTIONS)) * GRAIN)
    return a, np.rint(rng.uniform(0, WIDTH, TABLES * PROJECTIONS) * GRID * GRAIN)


def table_keys(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """n x tables keys of normalised vectors: those of the first tables."""
    a, shift = _directions(unit.shape[1])
    a, shift = a[:, : tables * PROJECTIONS], shift[: tables * PROJECTIONS]
    cells = np.floor((np.rint(unit * GRID) @ a + shift) / (WIDTH * GRID * GRAIN)).astype(np.int64).view(np.uint64).reshape(len(unit), tables, PROJECTIONS)
    key = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 8), (len(unit), tables))
    for i in range(PROJECTIONS):
        key = mix(key ^ cells[:, :, i], i)
    return key.view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> DataFrame:
    """(id, key, vector): key and vector (doubles) are null where the vector links with nothing."""

    def run(batches):
        for batch in batches:
            keys, raws = [], []
            for v in column(batch, "vector").to_pylist():
                ok = bool(v) and None not in v
                x = np.array(v, np.float64) if ok else None
                ok = ok and np.isfinite(x).all() and x.any()
                raws.append(x.astype("<f8").tobytes() if ok else None)
                keys.append(hashlib.blake2b(raws[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["id", "key", "vector"])

    return vectors.mapInArrow(run, "id bigint, key binary, vector binary")


def _table_rows(reps: DataFrame) -> DataFrame:
    """(slot, bucket, id): one row per table."""

    def run(batches):
        for batch in batches:
            raws, ids = column(batch, "vector").to_pylist(), column(batch, "id").to_numpy(zero_copy_only=False)
            sizes = np.array([len(r) for r in raws])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for a in range(0, len(at), 2000):
                    own = at[a : a + 2000]
                    keys = table_keys(_unit(np.frombuffer(b"".join(raws[i] for i in own), "<f8").reshape(len(own), -1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(own))), pa.array(keys.ravel()), pa.array(np.repeat(ids[own], TABLES))], ["slot", "bucket", "id"])

    return reps.select("id", "vector").mapInArrow(run, "slot int, bucket bigint, id bigint")


def _whole(batches, keys: list[str]):
    """Tables of whole groups of rows with equal keys, from sorted batches; a group that isn't whole yet waits for the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in (t[k].to_numpy() for k in keys)], axis=0))
        if held and any(held[-1][k][-1].as_py() != t[k][0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        if len(ends):
            yield pa.concat_tables([*held, t.slice(0, int(ends[-1]) + 1)])
            held = []
        held.append(t.slice(int(ends[-1]) + 1 if len(ends) else 0))
    if held:
        yield pa.concat_tables(held)


def _near_pairs(unit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of one group each whose vectors are near: small groups of one size at once, each larger block for itself."""
    xs, ys = [], []
    least = cosine - 1e-9
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        upper = np.triu(np.ones((size, size), bool), 1)
        first = starts[sizes == size]
        step = max(1, PART // (size * unit.shape[1]))
        for a in range(0, len(first), step):
            at = first[a : a + step, None] + np.arange(size)
            vectors = unit[at]
            g, x, y = np.nonzero((vectors @ vectors.transpose(0, 2, 1) >= least) & upper)
            xs.append(at[g, x])
            ys.append(at[g, y])
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        rows = np.arange(start, start + size)
        left = rows[own[rows] == i[start]]
        right = left if i[start] == j[start] else rows[own[rows] == j[start]]
        near = unit[left] @ unit[right].T >= least
        if i[start] == j[start]:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        xs.append(left[x])
        ys.append(right[y])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    exact = np.ones(len(x), bool)
    for a in range(0, len(x), 20_000):
        exact[a : a + 20_000] = np.einsum("ij,ij->i", unit[x[a : a + 20_000]], unit[y[a : a + 20_000]]) >= cosine
    return x[exact], y[exact]


def _compare(groups: pa.Table, cosine: float, keys: list[str]) -> pa.RecordBatch:
    """(a, b, n) of whole groups: the number n of links of class a if b is null, else an edge."""
    ids, copies, own = (groups[k].to_numpy() for k in ("id", "copies", "own"))
    slot, i, j = (groups[k].to_numpy() for k in ("slot", "i", "j"))
    raws = groups["vector"].to_pylist()
    starts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in (groups[k].to_numpy() for k in keys)], axis=0)) + 1])
    sizes = np.diff(np.append(starts, len(ids)))
    links, a, b = np.zeros(len(ids), np.int64), [], []
    dims = np.array([len(raws[s]) for s in starts.tolist()])  # of one bucket all are equal
    for size in np.unique(dims):
        use = np.flatnonzero(dims == size)
        rows = ragged(starts[use], sizes[use])
        unit = _unit(np.frombuffer(b"".join(raws[r] for r in rows.tolist()), "<f8").reshape(len(rows), -1))
        x, y = _near_pairs(unit, np.cumsum(sizes[use]) - sizes[use], sizes[use], own[rows], i[rows], j[rows], cosine)
        if not len(x):
            continue
        involved, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        p, q = back[: len(x)], back[len(x) :]
        new, upto = np.ones(len(x), bool), slot[rows[x]]
        known = np.concatenate([table_keys(unit[involved[c : c + 2000]], int(upto.max())) for c in range(0, len(involved), 2000)])
        for t in range(known.shape[1]):
            new &= (known[p, t] != known[q, t]) | (upto <= t)
        x, y = rows[x[new]], rows[y[new]]
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        if len(x):
            stars = forest(ids[x], ids[y])
            a.append(stars[0])
            b.append(stars[1])
    has = np.flatnonzero(links)
    a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ids[has], a]), pa.int64()), pa.array(np.concatenate([ids[has], b]), pa.int64(), mask=np.arange(len(has) + len(a)) < len(has)), pa.array(np.concatenate([links[has], np.zeros(len(a), np.int64)]), pa.int64())],
        ["a", "b", "n"],
    )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row."""
    spark = vectors.sparkSession
    rows = stored(_classes(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers are fixed by writing them
    reps = classes.select("id", "copies", "vector")

    slots = stored(_table_rows(reps), "slots")
    full = stored(slots.groupBy("slot", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("slot", "bucket", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks")), "buckets")
    members = slots.join(full, ["slot", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("slot", "bucket", "id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = stored(members, "members").join(reps, "id")
    keys = ["slot", "bucket", "i", "j"]
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for whole in _whole(batches, keys):
            yield _compare(whole, cosine, keys)

    found = stored(dealt.mapInArrow(run, "a bigint, b bigint, n bigint"), "found")
    links = stored(found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")), "links")
    labels = stored(components(found.where("b is not null").select("a", "b")).join(classes.select("id", "low"), "id"), "labels")
    least = stored(labels.groupBy("component").agg(F.min("low").alias("least")), "least")
    linked = labels.join(least, "component").select("id", "least")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    per = classes.select("id", "key", "low", "copies").join(links.withColumnRenamed("a", "id"), "id", "left").join(linked, "id", "left")
    per = stored(per.select("key", n_links, F.coalesce("least", "low").alias("component_id")), "per")
    out = rows.select("id", "key").join(per, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
