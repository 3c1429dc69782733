"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def ship(spark: SparkSession, folder: str) -> None:
    """Lets Python workers import from the folder. On a cluster the package is installed or given by --py-files; there this does no harm."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if folder not in paths:
        env["PYTHONPATH"] = ":".join([folder, *paths])


def local(name: str = "kbspark", cores: str = "*", partitions: int = 8, settings: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=settings or {})
        .getOrCreate()
    )
