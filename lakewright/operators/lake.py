"""Tables of a lake, as their files' footers and folders describe them."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import looked_up, search

YEAR = "ano"  # fixed value: name of the folders by year


def signature(columns: Column) -> Column:
    """Names and types in the order of names: files with equal signatures hold the same columns."""
    return F.array_join(F.array_sort(F.transform(columns, lambda c: F.concat(c["name"], F.lit(":"), c["type"]))), ",")


def placed(footers: DataFrame, root: str) -> DataFrame:
    """Adds layer, name and part (folders below the table) of files in ``<root>/<layer>/<name>/...``."""
    below = F.substring_index("path", (urlparse(root).path or root).rstrip("/") + "/", -1)
    folders = F.split(F.regexp_replace(below, "/?[^/]*$", ""), "/")
    rest = F.array_join(F.slice(folders, 3, F.greatest(F.size(folders) - 2, F.lit(0))), "/")
    return footers.withColumn("layer", F.get(folders, F.lit(0))).withColumn("name", F.get(folders, F.lit(1))).withColumn("part", rest)


def schema_variants(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and signature: folders, rows, and the smallest path as an example."""
    return files.groupBy(*keys, signature(F.col("columns")).alias("signature")).agg(
        F.count_distinct("part").alias("parts"), F.sum("rows").alias("rows"), F.min("path").alias("example"),
    )


def year_of(part: Column) -> Column:
    return F.nullif(F.regexp_extract(part, f"(?:^|/){YEAR}=(-?\\d+)(?:/|$)", 1), F.lit("")).cast("int")


def partition_variants(files: DataFrame) -> DataFrame:
    """Column names of the files of every table by year, with the years that have them, and whether there are several such lists."""
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ",")
    years = files.withColumn("year", year_of(F.col("part"))).filter("year is not null").withColumn("names", names)
    lists = years.groupBy("layer", "name", "names").agg(
        F.count_distinct("year").alias("partitions"), F.min("year").alias("first"), F.max("year").alias("last")
    )
    kinds = lists.groupBy("layer", "name").agg((F.count("*") > 1).alias("differs"))
    return lists.join(kinds, ["layer", "name"])


def entries(files: DataFrame, root: str, time_columns: Mapping[str, str] | None = None) -> DataFrame:
    """One catalogue row per table, from footers and folders alone.

    name, layer, path, by_year, hive, first_year, last_year, time_column, first, last, row_count, columns. Columns are those of the
    table's first file and the folders' keys, which are whole numbers where all their values are.
    """
    table = ["layer", "name"]
    wanted = looked_up(F.col("name"), time_columns or {})
    span = F.get(F.filter("spans", lambda s: s["name"] == F.lower(wanted)), F.lit(0))
    files = files.withColumn("year", year_of(F.col("part"))).withColumn("span", span)
    found = files.groupBy(*table).agg(
        F.bool_or(F.col("year").isNotNull()).alias("by_year"), F.bool_or(F.contains("part", F.lit("="))).alias("hive"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("rows").alias("row_count"),
        F.min("span.first").alias("first"), F.max("span.last").alias("last"), F.min(F.struct("path", "columns")).alias("example"),
    )
    pair = F.explode(F.regexp_extract_all("part", F.lit("([^/=]+=[^/]*)"), F.lit(1)))
    pairs = files.select(*table, pair.alias("pair")).select(*table, F.split_part("pair", F.lit("="), F.lit(1)).alias("key"), F.split_part("pair", F.lit("="), F.lit(2)).alias("value"))
    kind = F.when(F.bool_and(F.col("value").rlike("^-?\\d{1,9}$")), "int").otherwise("string")
    keys = pairs.groupBy(*table, "key").agg(kind.alias("type")).groupBy(*table).agg(F.array_sort(F.collect_list(F.struct(F.col("key").alias("name"), "type"))).alias("keys"))
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")}
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("layer"), F.lit("/"), F.col("name"))
    out = found.join(keys, table, "left").withColumns(shown).withColumn("path", path).withColumn("time_column", F.nullif(wanted, F.lit("")))
    columns = F.concat("example.columns", F.coalesce("keys", F.array().cast("array<struct<name:string,type:string>>")))
    return out.select("name", "layer", "path", "by_year", "hive", "first_year", "last_year", "time_column", "first", "last", "row_count", columns.alias("columns"))


def register(spark: SparkSession, catalogue: DataFrame) -> list[str]:
    """One view per entry over its folders, with the folders' keys as columns; filters on them choose folders."""
    names = []
    for row in catalogue.select("name", "path").orderBy("name").toLocalIterator():  # one small row per table
        spark.read.parquet(row["path"]).createOrReplaceTempView(row["name"])
        names.append(row["name"])
    return names


def listing(catalogue: DataFrame, words: str = "", theme: str = "") -> DataFrame:
    """Per source: how many tables match, and a line for each, by name.

    A table matches if its name, description and theme hold every word, and its theme is the one asked for; case and accents do
    not count. Lines show rows, period (or years) and, when something was asked for, the description.
    """
    target = F.concat_ws(" ", "name", "description", "theme")
    found = search(catalogue, words, target, F.col("theme"), theme)
    period = F.when(F.col("first").isNotNull(), F.concat(F.substring("first", 1, 10), F.lit(" a "), F.substring("last", 1, 10)))
    period = F.coalesce(period, F.concat(F.col("first_year").cast("string"), F.lit(" a "), F.col("last_year").cast("string")))
    facts = F.concat_ws(" · ", F.concat(F.format_number("row_count", 0), F.lit(" linhas")), period, F.when(F.col("by_year") & F.lit(bool(words or theme)), "particionada por ano"))
    label = F.col("name") if words or theme else F.concat("name", F.lit(" ["), "theme", F.lit("]"))
    line = F.concat(F.lit("- "), label, F.lit(" ("), facts, F.lit(")"), *([F.lit(": "), F.substring("description", 1, 400)] if words or theme else []))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda s: s["line"])
    return found.groupBy("source").agg(F.count("*").alias("tables"), F.array_join(lines, "\n").alias("lines"))
