"""One Parquet table per name below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Lazy scan; filters and column choices reach the Parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names=TABLES) -> None:
    """One temporary view per table, so that plain SQL can name them."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
