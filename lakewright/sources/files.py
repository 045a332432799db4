"""File readers: tolerant CSV, charset repair, archives, inventories and layouts."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.schema import signature


def read_typed_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Header and types taken from the whole file."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, samplingRatio=1.0)


def header_of(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """First line of one file; the only data the driver sees."""
    row = spark.read.option("encoding", encoding).text(path).limit(1).first()
    return row[0].lstrip("﻿") if row else ""


def sniff_delimiter(header: str) -> str:
    return ";" if header.count(";") >= header.count(",") else ","


def read_text_csv(spark: SparkSession, path: str | list[str], sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text. Short rows are padded with nulls; rows with too many fields are skipped.

    Several files with the same header are one scan.
    """
    header = header_of(spark, path if isinstance(path, str) else path[0], encoding)
    sep = sep or sniff_delimiter(header)
    names = next(csv.reader([header], delimiter=sep))
    names = [n.strip() or f"coluna_{i}" for i, n in enumerate(names)]
    extra = "extra__"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, extra]])
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, mode="PERMISSIVE", quote='"', escape='"',
                        encoding=encoding, enforceSchema=True)
    return df.filter(F.col(extra).isNull()).drop(extra)


def charset_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding): UTF-8 where the bytes are valid, else windows-1252."""
    files = spark.read.format("binaryFile").load(path)
    ok = F.is_valid_utf8(F.col("content"))
    return files.select("path", F.when(ok, "UTF-8").otherwise("windows-1252").alias("encoding"))


def read_csv_files(spark: SparkSession, path: str) -> list[DataFrame]:
    """One frame per CSV dialect (charset, delimiter, header); no dialect is dropped.

    The driver only sees one small row per file.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for row in charset_of_files(spark, path).toLocalIterator():
        header = header_of(spark, row.path, row.encoding)
        groups.setdefault((row.encoding, header), []).append(row.path)
    out = []
    for (encoding, _), paths in sorted(groups.items()):
        out.append(read_text_csv(spark, sorted(paths), encoding=encoding))
    return out


def read_parquet_variants(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Parquet files grouped by schema, one scan per variant: the plan grows with drift, not with files."""
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        groups.setdefault(signature(spark.read.parquet(p)), []).append(p)
    return [spark.read.parquet(*same) for same in groups.values()]


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    base = info.filename.rsplit("/", 1)[-1]
                    if base.lower().endswith((".csv", ".parquet")):
                        yield pd.DataFrame({"archive": [path], "member": [f"{stem}__{base}"], "content": [archive.read(info)]})


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """CSV and Parquet members of ZIP files, one row each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_members, "archive string, member string, content binary")


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, extension, bytes, modified) of all files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        .select("path", "length", "modificationTime")
    )
    skip = "/(\\.git|node_modules|__pycache__|\\.venv)/"  # fixed value: folders that are never data
    return files.filter(~F.col("path").rlike(skip)).select(
        "path", extension(F.col("path")).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def direct_children(files: DataFrame, prefix: str) -> DataFrame:
    """Files right below the prefix, without those of nested folders."""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 20)
    return files.filter(F.startswith(F.col("path"), F.lit(prefix)) & (rest != "") & ~F.contains(rest, F.lit("/")))


def layout_of_paths(files: DataFrame, table_at: int = 2) -> DataFrame:
    """Per table: partitioned by year, and partitioned at all, told from ``key=`` folders."""
    key = F.regexp_extract("path", "/([^/=]+)=", 1)
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(table_at)).alias("name")).agg(
        F.bool_or(key == "ano").alias("by_year"), F.bool_or(key != "").alias("hive")
    )


def read_metadata(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON document per file, keyed by the file name without its ending."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return df.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))


DICTIONARY = T.StructType([
    T.StructField("dicionario_simplificado", T.ArrayType(T.StructType([
        T.StructField("codigo", T.StringType()), T.StructField("descricao", T.StringType()),
    ])))
])


def dictionary_entries(documents: DataFrame, column: str = "value") -> DataFrame:
    """Column descriptions from dictionary JSON, one row per entry."""
    parsed = F.from_json(column, DICTIONARY)["dicionario_simplificado"]
    return documents.select(F.inline(parsed)).select(
        F.trim("codigo").alias("codigo"), F.trim(F.coalesce("descricao", F.lit(""))).alias("descricao")
    )
