"""Sinks: routed, all-or-nothing, upserts, manifests."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.threads import latest
from ..operators.validate import GateError, routed


def write_routed(df: DataFrame, accepted: str, rejected: str, column: str = "errors") -> None:
    """Accepted and rejected rows to a folder each. df should be stored: it is read twice."""
    ok, bad = routed(df, column)
    ok.write.mode("append").parquet(accepted)
    bad.write.mode("append").parquet(rejected)


def write_all_or_nothing(df: DataFrame, path: str, column: str = "errors") -> None:
    """Writes df only if no row has errors. The count runs first, on what was stored."""
    n = df.where(F.size(column) > 0).count()
    if n:
        raise GateError(f"{n} rows with errors; nothing was written")
    df.drop(column).write.mode("overwrite").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _renamed(fs, a, b) -> bool:
    """Whether a became b; a file system may say no or raise."""
    try:
        return fs.rename(a, b) and fs.exists(b)
    except Py4JJavaError:
        return False


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Renames a finished table over another. If that fails, the old one is put back; nothing is deleted before the new one stands."""
    fs, to = _fs(spark, path)
    old, source = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")[1], _fs(spark, new)[1]
    there = fs.exists(to)
    if there and not _renamed(fs, to, old):
        raise OSError(f"{path} can't be renamed")
    if not _renamed(fs, source, to):
        if there and not _renamed(fs, old, to):
            raise OSError(f"{new} can't be renamed to {path}; the table is kept as {old}")
        raise OSError(f"{new} can't be renamed to {path}")
    if there:
        fs.delete(old, True)


def upsert(new: DataFrame, path: str, keys: list[str], *order: str) -> None:
    """The table at path with the new rows; per key the last by order stays. Running it again changes nothing."""
    spark = new.sparkSession
    fs, p = _fs(spark, path)
    rows = new if not fs.exists(p) else spark.read.parquet(path).unionByName(new, allowMissingColumns=True)
    staging = f"{path}.new-{uuid.uuid4().hex}"
    latest(rows, keys, *order).write.parquet(staging)
    swap(spark, staging, path)


def write_json(df: DataFrame, path: str, key: str | None = None) -> None:
    """One object a row; with a key each of its values has a folder. What was there before goes."""
    (df.repartition(key).write.partitionBy(key) if key else df.write).mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Raw rows as lines behind those that are there."""
    df.write.mode("append").json(path)


def write_roster(roster: DataFrame, path: str, column: str = "name") -> None:
    """Names for a later scan, each once. They are personal data: the path must be private."""
    roster.select(column).distinct().write.mode("overwrite").json(path)


def write_docs(pages: DataFrame, path: str) -> DataFrame:
    """Markdown files of pages (name, url, body, error) that were fetched, a folder for each name, with their source on the first line; gives the rest."""
    ok = pages.where(F.col("error").isNull())
    text = F.concat(F.lit("# Source: "), F.col("url"), F.lit("\n\n"), F.col("body"))
    ok.select("name", text.alias("value")).repartition("name").write.partitionBy("name").mode("overwrite").text(path)
    return pages.where(F.col("error").isNotNull()).select("name", "url", "error")


def manifest(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("rows")).orderBy(by)
