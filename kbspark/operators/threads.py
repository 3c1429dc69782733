"""Threads: comments by (thread_id, pos), as rows or as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def search_text(*parts: Column) -> Column:
    """Parts joined by a blank, null parts as empty ones."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def joined(df: DataFrame, key: str, order: str, text: str, sep: str = " ") -> DataFrame:
    """(key, text): a thread's texts in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["t"]), sep).alias("text"))


def before_close(created: Column, closed: Column) -> Column:
    """Unclosed threads keep all; comments without a date don't count as before."""
    return closed.isNull() | F.coalesce(created <= closed, F.lit(False))


def first_before_close(comments: Column, closed: Column, k: int = 10) -> Column:
    """The first k comments (structs with created_at) before the close, in the order they stand."""
    return F.slice(F.filter(comments, lambda c: before_close(c["created_at"], closed)), 1, k)


def keep_comments(df: DataFrame, key: str, created: str, closed: str, tie: str, head: int = 15, tail: int = 25, least: int = 10) -> DataFrame:
    """Of the comments before the close, all or the first `head` and last `tail`; if fewer than `least`, later ones fill up."""
    d = df.withColumn("_pre", F.coalesce(before_close(F.col(created), F.col(closed)), F.lit(False)))
    side = Window.partitionBy(key, "_pre")
    d = d.withColumns({"_n": F.row_number().over(side.orderBy(F.asc_nulls_first(created), tie)), "_c": F.count("*").over(side)})
    d = d.withColumn("_pres", F.count_if("_pre").over(Window.partitionBy(key)))
    inside = (F.col("_c") <= head + tail) | (F.col("_n") <= head) | (F.col("_n") > F.col("_c") - tail)
    fill = ~F.col("_pre") & (F.col("_pres") < least) & (F.col("_n") <= least - F.col("_pres"))
    return d.where((F.col("_pre") & inside) | fill).drop("_pre", "_n", "_c", "_pres")


def within_budget(df: DataFrame, key: str, pos: str, text: str, budget: int = 14000) -> DataFrame:
    """Blocks left when the middle block is dropped until their lengths fit the budget.

    That leaves the first ceil(m/2) and last floor(m/2) of n blocks, for the largest m that fits; the
    least is one block, cut to the budget. Running sums replace the loop.
    """
    by = Window.partitionBy(key)
    d = df.withColumn("_l", F.length(text))
    d = d.withColumns({"_i": F.row_number().over(by.orderBy(pos)), "_n": F.count("*").over(by), "_up": F.sum("_l").over(by.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)), "_down": F.sum("_l").over(by.orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0))})
    # the length with m blocks: sum of the first ceil(m/2) and of the last floor(m/2)
    ups = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_up", "_down"))), lambda x: x)
    sums = d.groupBy(key).agg(ups.alias("u"), F.max("_n").alias("n"))
    size = lambda m: F.element_at(F.col("u"), F.ceil(m / F.lit(2)).cast("int"))["_up"] + F.when(m > 1, F.element_at(F.col("u"), (F.col("n") - F.floor(m / F.lit(2)) + 1).cast("int"))["_down"]).otherwise(F.lit(0))
    most = F.array_max(F.filter(F.sequence(F.lit(1), F.col("n").cast("int")), lambda m: size(m) <= budget))
    kept = sums.select(key, F.coalesce(most, F.lit(1)).alias("_m"))
    d = d.join(kept, key).where((F.col("_i") <= F.ceil(F.col("_m") / 2)) | (F.col("_i") > F.col("_n") - F.floor(F.col("_m") / 2)))
    return d.withColumn(text, F.when(F.col("_m") == 1, F.substring(F.col(text), 1, budget)).otherwise(F.col(text))).drop("_l", "_i", "_n", "_up", "_down", "_m")


def first_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by order; aggregated before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(order, *[c for c in rest if c != order])).alias("_f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the last by order: what arrives again replaces what was there."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_f")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])
