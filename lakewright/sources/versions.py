"""A table that is rebuilt while others read it: rows are staged, then one small manifest makes them a version.

``<root>/data/<name>`` holds the rows of one version, ``<root>/manifests/<number>.json`` says which. A manifest is written
beside its place and renamed into it, which happens at once or not at all and never over another one. Readers look up a
version once and read its folder from then on, so they see one version whole, whatever is published meanwhile. A write
that fails leaves a folder no manifest names. Old versions stay until their owner removes them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession

from .sinks import watched

MANIFEST = "version long, data string, rows long"


@dataclass(frozen=True)
class Version:
    """One published state of a table."""

    number: int
    path: str
    rows: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def resolve(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version below ``root``, or the one with this number; None if there is none."""
    try:
        known = spark.read.schema(MANIFEST).json(f"{root}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if number is not None:
        known = known.where(known.version == number)
    row = known.orderBy(known.version.desc()).first()
    return row and Version(row.version, f"{root}/data/{row.data}", row.rows)


def _name(spark: SparkSession, root: str, manifest: dict) -> bool:
    """Puts the manifest in its place; false if another writer has taken the number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/_{uuid.uuid4().hex}")
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{manifest['version']:012d}.json")
    out = staged.getFileSystem(conf).create(staged, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.getFileSystem(conf).getUri(), conf)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(staged, place, none)
    except Py4JJavaError as failed:
        if not failed.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        files.delete(staged, False)
        return False
    return True


def publish(df: DataFrame, root: str) -> Version:
    """Writes all rows of ``df`` and makes them the newest version; of two writers at once, the later one follows the first."""
    spark, data, watch = df.sparkSession, uuid.uuid4().hex, Observation()
    watched(df.hint("rebalance"), watch).write.option("compression", "zstd").parquet(f"{root}/data/{data}")
    rows = watch.get.get("rows", 0)
    last = resolve(spark, root)
    number = last.number + 1 if last else 1
    while not _name(spark, root, {"version": number, "data": data, "rows": rows}):
        number += 1
    return Version(number, f"{root}/data/{data}", rows)
