"""Parquet footers as rows: schema, row counts and time spans of many files without reading any data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

COLUMNS = "columns array<struct<name:string,type:string>>"
SPANS = "spans array<struct<name:string,first:timestamp_ntz,last:timestamp_ntz>>"


def _opened(path: str) -> pq.ParquetFile:
    local = re.match(r"file:/+(.*)", path)
    system, inside = (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path)
    return pq.ParquetFile(inside, filesystem=system)


def _times(meta: pq.FileMetaData, schema: pa.Schema) -> list[dict]:
    """First and last value of every time column; nulls where a row group does not tell."""
    out = []
    flat = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    for field in schema:
        if not pa.types.is_timestamp(field.type) or field.name not in flat:
            continue
        found, known = [], True
        for g in range(meta.num_row_groups):
            chunk = meta.row_group(g).column(flat[field.name])
            s = chunk.statistics
            if s is not None and s.has_min_max:
                found += [s.min, s.max]
            elif s is None or s.null_count != chunk.num_values:
                known = known and chunk.num_values == 0
        found = [t.replace(tzinfo=None) for t in found] if known else []
        out.append({"name": field.name.lower(), "first": min(found, default=None), "last": max(found, default=None)})
    return out


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, columns, spans) of every Parquet file below ``path``.

    The driver lists the files; each task reads some footers. Names are lower-cased, columns stand in the file's order
    without those that only the folders name; ``spans`` has the first and last value of the time columns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    kinds = pa.schema([
        ("path", pa.string()), ("rows", pa.int64()), ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
        ("spans", pa.list_(pa.struct([("name", pa.string()), ("first", pa.timestamp("us")), ("last", pa.timestamp("us"))]))),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with _opened(name) as file:
                    columns = [{"name": f.name.lower(), "type": f.dataType.simpleString()} for f in from_arrow_schema(file.schema_arrow, prefer_timestamp_ntz=True).fields]
                    rows.append({"path": name, "rows": file.metadata.num_rows, "columns": columns, "spans": _times(file.metadata, file.schema_arrow)})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    tasks = 4 * spark.sparkContext.defaultParallelism
    return files.select("path").repartition(tasks, "path").mapInArrow(read, f"path string, rows long, {COLUMNS}, {SPANS}")
