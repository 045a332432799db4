"""Helpers that several operators share: scratch tables, checked broadcasts, ranks and components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

BROADCAST_ROWS = 500_000  #: rows of a few numbers that may be broadcast after they were counted


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def released(spark: SparkSession):
    """Shuffle files of what runs inside the block go when it ends, not when the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def by_some_keys(spark: SparkSession):
    """Joins inside the block take sides as they are that were both dealt out by some of the keys, and do not deal them anew."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors, leaves no shuffle files."""
    path = scratch_path(df.sparkSession, label)
    with released(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_rows(df: DataFrame) -> int:
    with released(df.sparkSession):
        return df.count()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that the join shuffles as usual.

    ``most`` is a number of rows that ``df`` surely does not exceed; where it is small enough, they are not counted. Every
    count is a plan and some exchanges more for the driver.
    """
    if most is not None and most <= rows:
        return F.broadcast(df)
    return F.broadcast(df) if counted_rows(df) <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Row limit of Arrow batches while plans are run inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ranked(df: DataFrame, keys: list[str], order: str, name: str, buckets: int) -> DataFrame:
    """Adds ``name``: 0-based gapless rank of each row among the rows with the same ``keys`` (few values, any one hot).

    Rows of a key are dealt to ``buckets`` by a hash of ``order``; each bucket is ordered on its own and starts where
    the smaller buckets of its key end, so a hot key is never in one task. ``order`` must be unique within a key.
    """
    at = F.pmod(F.xxhash64(order), F.lit(buckets))
    df = df.withColumn("_bucket", at)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)) - 1
    same = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.withColumn("_within", within).join(starts, same)
    return out.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop(
        "_bucket", "_within", "_start", "_kb", *[f"_k{i}" for i in range(len(keys))]
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``: component is the smallest node that can be reached.

    Alternating large and small stars: each step is one aggregate and one join over the edges, written to the shared
    folder; steps grow with the logarithm of the longest path. Null ends and loops are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    e = store(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        linked = both.join(low, "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = state(e)
    while seen[0]:
        e = store(star(star(e, True), False), "edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once even where ``body`` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc32(text: Column) -> Column:
    return F.crc32(F.encode(text, "utf-8"))
