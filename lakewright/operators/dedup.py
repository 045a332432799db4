"""Exact duplicates by content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Order in which folders are preferred as the home of a duplicated file.
PREFERRED = ("data/", "dados/ons/", "dados/rio_ev/", "dados/data/")


def repeated_sizes(df: DataFrame, size: str) -> DataFrame:
    """Sizes that occur more than once; counted on the map side, only the size column is read."""
    return df.groupBy(size).count().filter("count > 1").select(size)


BROADCAST_SIZES = 1_000_000


def hash_repeated(df: DataFrame, size: str, content: Column, out: str = "sha256") -> DataFrame:
    """Adds the SHA-256 of the content where the size repeats, else null.

    The repeated sizes are written once and counted. Up to a million of them (some 16 MB) are broadcast,
    so that contents neither move nor are hashed in vain. Beyond that, hashes are taken first and only
    narrow rows are joined by size.
    """
    sizes = materialize(repeated_sizes(df, size), "sizes").withColumn("again__", F.lit(True))
    if sizes.limit(BROADCAST_SIZES + 1).count() <= BROADCAST_SIZES:
        marked = df.join(F.broadcast(sizes), size, "left")
        return marked.withColumn(out, F.when(F.col("again__"), F.sha2(content, 256))).drop("again__")
    hashed = df.withColumn(out, F.sha2(content, 256)).join(sizes, size, "left")
    return hashed.withColumn(out, F.when(F.col("again__"), F.col(out))).drop("again__")


def preference(path: Column, prefixes: Sequence[str] = PREFERRED) -> Column:
    """Sort key of a path: preferred folder, then short, then alphabetical."""
    rank = F.lit(len(prefixes))
    for i, p in reversed(list(enumerate(prefixes))):
        rank = F.when(F.startswith(path, F.lit(p)), i).otherwise(rank)
    return F.struct(rank.alias("rank"), F.length(path).alias("length"), path.alias("path"))


def canonical_paths(files: DataFrame, key: str = "sha256", path: str = "path", prefixes: Sequence[str] = PREFERRED) -> DataFrame:
    """Adds ``canonical`` and ``duplicate``. Files without a hash stand for themselves.

    The best path per hash is an aggregate, so a hash shared by a third of all files is reduced before
    it moves; only groups of two or more are joined back.
    """
    best = (
        files.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.min(preference(F.col(path), prefixes))["path"].alias("best__"), F.count("*").alias("n__"))
        .filter("n__ > 1").select(key, "best__")
    )
    out = files.join(best, key, "left").withColumn("canonical", F.coalesce("best__", path)).drop("best__")
    return out.withColumn("duplicate", F.col(path) != F.col("canonical"))


def summary(files: DataFrame, key: str, size: str) -> DataFrame:
    """Files, bytes, duplicates and what unique files remain, from one count per content."""
    per = files.groupBy(key).agg(F.count("*").alias("n"), F.first(size).alias("b"))
    return per.agg(
        F.sum("n").alias("files"), F.sum(F.col("n") * F.col("b")).alias("bytes"),
        F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.col("b")).alias("duplicate_bytes"),
        F.count("*").alias("unique_files"), F.sum("b").alias("unique_bytes"),
    )


def raw_selection(files: DataFrame, prefix: str, excluded: Sequence[str], new_prefix: str) -> DataFrame:
    """Canonical files below a prefix, without excluded endings, under their new key."""
    p = F.col("path")
    drop = F.greatest(F.lit(False), *[F.endswith(p, F.lit(e)) for e in excluded])
    return files.filter(~F.col("duplicate") & F.startswith(p, F.lit(prefix)) & ~drop).withColumn(
        "key", F.concat(F.lit(new_prefix), F.substring(p, len(prefix) + 1, 1 << 20))
    )
