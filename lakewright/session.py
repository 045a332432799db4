"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # windows-1252 is only known to the reader with the JVM charset list
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # rows of long texts reach Python in batches of bounded size, whatever the partition holds
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # no call-site capture per column expression: plans are built noticeably faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Of SETTINGS, those that a session given by the caller needs for right results.
NEEDED = ("spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode", "spark.sql.legacy.javaCharsets")

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Prepares a session that was made elsewhere; every registered query calls it.

    Sets the run-time settings that results depend on, and sends this package to the executors, whose Python workers
    import it by name.
    """
    for key in NEEDED:
        if spark.conf.get(key, None) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="lakewright-ship-"), "lakewright.zip")  # the driver serves it to all
        with zipfile.ZipFile(path, "w") as out:
            for top, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("lakewright", os.path.relpath(full, package)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of a batch sent to Python; results do not depend on it, but the memory of the workers does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) != SETTINGS[key]:
        spark.conf.set(key, SETTINGS[key])
    return spark


def local_session(app: str = "lakewright", cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster, use the one that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/").rsplit("/", 1)[0]
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lakewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
