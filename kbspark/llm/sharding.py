"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has CELLS positions. Every shard owns `vnodes` of them, its virtual nodes; a row
belongs to the arc that ends at the next virtual node clockwise from the hash of its id, whatever its text.
Loads are bounded by rows: of n rows, n mod shards shards hold one row more than the rest,
so counts are at most one apart. What an arc's shard cannot hold continues clockwise to the
next shard with room. How many rows overflow where depends only on the number of rows of
each cell, a table of CELLS rows whatever the input, so the walk is made on
the driver and sent back as a table of (arc, ranks from..to, shard, slot), bounded likewise.
Rows are ranked within their cell by id, size and checksum; a cell that holds very many rows,
which takes an id that repeats, is ranked in SALTS parts. Texts are read once: ids, sizes and
checksums are written, and nothing else is shuffled.

Law: `rows`. Another shard moves only what the new shard takes and what overflows differently.

Cases: null text has size 16 and checksum 0; null ids are placed like any other; rows that
repeat share a cell and are placed one by one, ties in any order; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

CELLS, SALTS = 1 << 16, 64
#: A cell is ranked in parts if it has more rows than this and than SALTS times the mean.
HOT = 100_000


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; the first of two for one cell keeps it."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        x = (shard + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        for _ in range(vnodes):
            x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
            h = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
            taken.setdefault((h ^ (h >> 31)) % CELLS, shard)
    return sorted(taken.items())


def placed(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first) by walking the arcs' overflow clockwise.

    counts: rows by arc; owners: the shard of each arc, clockwise. In round r what is left of
    every arc is offered to the r-th node after its own.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, left = [], {a: (0, n) for a, n in sorted(counts.items()) if n}
    step = 0
    while left:
        for arc in list(left):
            at, n = left[arc]
            shard = owners[(arc + step) % len(owners)]
            take = min(n, room[shard] - used[shard])
            if take:
                out.append((arc, at, at + take, shard, used[shard]))
                used[shard] += take
                left[arc] = (at + take, n - take)
            if take == n:
                del left[arc]
        step += 1
    return out


def shard_rows(docs: DataFrame, shards: int = 40, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")
    # written, so that a part that is read again has the same rows
    keyed = stored(rows.withColumns({"cell": cell, "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}), "rows")
    counts = {r["cell"]: r["count"] for r in keyed.groupBy("cell").count().collect()}  # at most CELLS rows
    mean = sum(counts.values()) / CELLS
    large = [c for c, n in counts.items() if n > max(hot, SALTS * mean)]  # at most CELLS / SALTS
    parts: list[tuple[int, int, int]] = []
    if large:
        own = keyed.join(F.broadcast(spark.createDataFrame([(c,) for c in large], "cell int")), "cell").groupBy("cell", "salt").count().collect()
        before: dict[int, int] = {}
        for r in sorted(own):
            parts.append((r["cell"], r["salt"], before.get(r["cell"], 0)))
            before[r["cell"]] = before.get(r["cell"], 0) + r["count"]
    nodes = ring(shards, vnodes)
    # cells up to and with a node's own belong to its arc; those past the last node to the first
    cells, arc, sizes, split = [], 0, {}, set(large)
    for c in range(CELLS):
        while arc < len(nodes) and nodes[arc][0] < c:
            arc += 1
        a = arc % len(nodes)
        cells.append((c, a, sizes.get(a, 0), c in split))
        sizes[a] = sizes.get(a, 0) + counts.get(c, 0)
    table = F.broadcast(spark.createDataFrame(cells, "cell int, arc int, first bigint, split boolean"))
    offsets = F.broadcast(spark.createDataFrame(parts, "cell int, part int, before bigint"))
    ranges = F.broadcast(spark.createDataFrame(placed(sizes, [s for _, s in nodes], shards), "own int, lo bigint, hi bigint, shard int, base bigint"))
    at = keyed.join(table, "cell").withColumn("part", F.when(F.col("split"), F.col("salt")).otherwise(0))
    number = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    at = at.withColumn("number", number).join(offsets, ["cell", "part"], "left")
    at = at.withColumn("rank", F.col("first") + F.coalesce("before", F.lit(0)) + F.col("number"))
    at = at.join(ranges, (F.col("arc") == F.col("own")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return at.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
