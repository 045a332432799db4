"""Typed Parquet writes: by year, in one piece, or replacing single partitions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.unify import Unified

ROWS_PER_FILE = 5_000_000


def watched(df: DataFrame, watch: Observation | None) -> DataFrame:
    """Lets ``watch`` count the rows that pass here as ``rows``.

    Only the last stage of a job adds each task once however often it is tried, so this comes after every exchange.
    """
    return df if watch is None else df.observe(watch, F.count(F.lit(1)).alias("rows"))


def write_by_year(
    df: DataFrame, path: str, time_column: str, year: str = "ano", rows_per_file: int = ROWS_PER_FILE, watch: Observation | None = None,
) -> None:
    """ZSTD Parquet below ``ano=YYYY``. Rows without a time are stored too, in the partition of the null year.

    ``rebalance`` groups rows of a year to avoid small files, while AQE splits a year that is too big
    for one task; ``maxRecordsPerFile`` bounds the files. ``watch`` counts the rows on their way.
    """
    if year in df.columns:
        raise ValueError(f"the table already has a column {year}")
    (
        watched(df.withColumn(year, F.year(time_column)).hint("rebalance", year), watch)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", "static")
        .partitionBy(year)
        .parquet(path)
    )


def write_plain(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, watch: Observation | None = None) -> None:
    """Without partitions; ``rebalance`` makes few files of a small table. ``watch`` counts the rows on their way."""
    out = watched(df.hint("rebalance"), watch).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    out.option("compression", "zstd").parquet(path)


def write_unified(table: Unified, path: str, layout: str) -> int:
    """All rows of the table in the layout asked for, ``year`` or ``plain``; returns how many were stored.

    The write itself counts what it stores, which is held against the rows that were read; nothing is read back.
    """
    watch = Observation()
    if layout == "year":
        if not table.time_column:
            raise ValueError("a table without a time column has no years")
        write_by_year(table.df, path, table.time_column, watch=watch)
    elif layout == "plain":
        write_plain(table.df, path, watch=watch)
    else:
        raise ValueError(f"no layout {layout}")
    stored = watch.get.get("rows", 0)
    if stored != table.rows:
        raise RuntimeError(f"{stored} of {table.rows} rows were stored in {path}")
    return stored


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions present in ``df``; a rerun of the same day replaces that day."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_inventory(df: DataFrame, path: str) -> None:
    """Inventory as CSV, sorted by path across files."""
    df.orderBy("path").write.mode("overwrite").option("header", True).csv(path)


def write_catalog(entries: DataFrame, path: str) -> None:
    """Catalogue as JSON lines, one object per table with its columns as an array."""
    entries.write.mode("overwrite").json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents under their content id. Ids that the store has already are not stored again."""
    new = docs.dropDuplicates(["doc_id"])
    try:
        new = new.join(docs.sparkSession.read.parquet(path).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").option("compression", "zstd").parquet(path)
