"""Incremental work: watermarked sync in batches, and the same as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import upsert


def changed(listing: DataFrame, saved: DataFrame, key: str, updated: str, watermark=None) -> DataFrame:
    """What must be fetched: keys that aren't saved and, with a watermark, saved ones that moved since."""
    new = listing.join(saved.select(key).distinct(), key, "left_anti")
    if watermark is None:
        return new
    moved = listing.join(saved.select(key).distinct(), key, "left_semi").where(F.col(updated) > F.lit(watermark))
    return new.unionByName(moved)


def watermark(listing: DataFrame, updated: str):
    """The greatest update time, nulls aside, to be taken when a run starts."""
    return listing.agg(F.max(updated)).first()[0]


def summary(listing: DataFrame, by: str, is_pr: Column, saved: Column) -> DataFrame:
    """Counts of a sync per source, in one pass; saved: what is there afterwards."""
    return listing.groupBy(by).agg(
        F.count_if(~is_pr).alias("seen"),
        F.count_if(is_pr).alias("pr_skipped"),
        F.count_if(~is_pr & ~saved).alias("fetched"),
        F.count_if(~is_pr & saved).alias("skipped"),
        F.count_if(~is_pr).alias("saved"),
    )


def saved_list(saved: DataFrame, by: str, number: str) -> DataFrame:
    """(by, numbers): what is saved of each source, each number once, in order. For reports: a list is as long as its source."""
    return saved.groupBy(by).agg(F.array_sort(F.collect_set(number)).alias("numbers"))


def sync(listing: DataFrame, saved: DataFrame, fetch: Callable[[DataFrame], DataFrame], target: str, key: str, updated: str, mark=None, force: bool = False) -> DataFrame:
    """Fetches what is new or has moved since the mark (force: all) and puts it into the table at target; gives the keys fetched.

    listing has no pull requests any more. A run that ends early is taken up by the next: what is saved isn't fetched again.
    """
    todo = listing if force else changed(listing, saved, key, updated, mark)
    upsert(fetch(todo), target, [key], updated)
    return todo.select(key)


def stream_upsert(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], *order: str, files: int = 100) -> None:
    """Takes all files that are new in the folder, some at a time, into the table at target, and stops.

    The checkpoint says which files are done; a batch that runs again changes nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = stream.writeStream.foreachBatch(lambda df, _: upsert(df, target, keys, *order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window; on a stream, rows later than the watermark are dropped by Spark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
