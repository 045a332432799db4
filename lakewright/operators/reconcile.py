"""Local against remote: what to send, what is left over, do the counts agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_upload(local: DataFrame, remote: DataFrame, keys: Sequence[str] = ("key", "size")) -> DataFrame:
    """Local files that are not there remotely with the same size."""
    return local.join(remote.select(*keys), list(keys), "left_anti")


def orphans(local: DataFrame, remote: DataFrame, table: str = "table", ending: str = ".parquet") -> DataFrame:
    """Remote files without a local one, only in tables that exist locally."""
    known = local.select(table).distinct()
    return (
        remote.filter(F.endswith("key", F.lit(ending)))
        .join(local.select("key"), "key", "left_anti")
        .join(known, table, "left_semi")
    )


def compare_counts(local: DataFrame, remote: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of both sides per key and whether they differ; a key may be on one side only."""
    a = local.groupBy(*keys).agg(F.count("*").alias("local"))
    b = remote.groupBy(*keys).agg(F.count("*").alias("remote"))
    return a.join(b, list(keys), "full_outer").withColumn("differs", ~F.col("local").eqNullSafe(F.col("remote")))
