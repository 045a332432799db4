"""Incremental jobs. Each runs over what has arrived and stops, and can be run again.

Results go to tables by batch number in a shared folder. A batch that is repeated after a failure
overwrites its own partition, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BATCH = "batch__"


def folder_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table below ``folder`` as a stream, whether it is one Parquet file or a folder of them.

    A stream takes a single file only as a pattern; ``basePath`` keeps the columns of a partitioned folder.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("basePath", folder).parquet(f"{folder}/{{{name}}}.parquet")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, then stop."""
    job = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(each).start()
    )
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{BATCH}={batch}")


def slot_totals(stream: DataFrame, ts: str, value: str, path: str, checkpoint: str, minutes: int = 30, watermark: str | None = None) -> None:
    """Running totals per slot in update mode; each batch writes the slots it touched.

    The state holds one row per slot. Without a watermark late events are never dropped; give one for an
    endless stream whose old slots may be closed.
    """
    rows = stream.select(F.col(ts).cast("timestamp").alias("ts__"), F.col(value).alias("v__"))
    if watermark:
        rows = rows.withWatermark("ts__", watermark)
    totals = rows.groupBy(F.window("ts__", f"{minutes} minutes").alias("w__")).agg(
        F.sum("v__").alias("total"), F.count("*").alias("events")
    )
    shaped = totals.select(F.col("w__.start").cast("timestamp_ntz").alias("slot"), "total", "events")
    run_available(shaped, lambda df, n: write_batch(df, path, n), checkpoint, mode="update")


def latest_slots(spark: SparkSession, path: str) -> DataFrame:
    """Last written state of every slot."""
    log = spark.read.parquet(path)
    last = F.max(F.struct(BATCH, "total", "events"))
    return log.groupBy("slot").agg(last.alias("l__")).select("slot", "l__.total", "l__.events")


def _read_log(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame:
    """Change log up to a batch; empty before the first one."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.IntegerType())])
    try:
        log = spark.read.schema(full).parquet(path)
    except Exception as error:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], full)
    return log.filter(F.col(BATCH) < before)


#: Keyed state lives in RocksDB on the executors, beyond the heap, and is saved with the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State store settings for queries that are started inside the block."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LastHash(StatefulProcessor):
    """Keeps the hash of the last version of a key; emits a row when the last version of a batch has another hash."""

    def __init__(self, key: str, seq: str, keep: Sequence[str]) -> None:
        self.key, self.seq, self.keep = key, seq, list(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("sha256", T.StringType())]))

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        def order(row):  # nulls first, then the hash, as a tie's order
            return row[self.seq] is not None, row[self.seq] if row[self.seq] is not None else 0, row["sha256"] or ""

        best = max(rows, key=order)  # rows pass one by one; only the best is held
        known = self.last.get()  # None without a state; every call asks the JVM, so one reads and one writes
        if known is not None and known[0] == best["sha256"]:
            return
        self.last.update((best["sha256"],))
        yield Row(**{self.key: key[0], "sha256": best["sha256"], "status": "new" if known is None else "changed", **{c: best[c] for c in self.keep}})

    def close(self) -> None:
        pass


def change_feed(stream: DataFrame, key: str, content: Column, seq: str, path: str, checkpoint: str, keep: Sequence[str] = ()) -> None:
    """Emits only new and changed documents, as status ``new`` or ``changed``.

    A value state per key holds the last hash, so a batch reads what has arrived and the states of its keys, whatever the
    history. Only key, order, hash and ``keep`` are moved, never the content; a hot key's rows pass as a stream. A batch that
    is repeated starts from the state of its checkpoint and overwrites its own partition.
    """
    hashed = stream.select(key, seq, *keep, F.sha2(content, 256).alias("sha256"))
    schema = T.StructType([
        T.StructField(key, hashed.schema[key].dataType), T.StructField("sha256", T.StringType()), T.StructField("status", T.StringType()),
        *[hashed.schema[c] for c in keep],
    ])
    with keyed_state(stream.sparkSession):
        changes = hashed.groupBy(key).transformWithState(LastHash(key, seq, keep), schema, "Update", "None")
        run_available(changes, lambda df, n: write_batch(df, path, n), checkpoint, mode="update")


def distinct_contents(stream: DataFrame, content: Column, seq: str, path: str, checkpoint: str) -> None:
    """First arrival of every content; equality of hashes is the only rule, at any distance in time."""
    keyed = stream.select(F.sha2(content, 256).alias("key"), content.alias("c__"), F.col(seq))
    spark = stream.sparkSession
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField(seq, stream.schema[seq].dataType)])

    def step(df: DataFrame, batch: int) -> None:
        fresh = df.groupBy("key").agg(F.min(seq).alias(seq))
        seen = _read_log(spark, path, schema, batch).select("key")
        write_batch(fresh.join(seen, "key", "left_anti"), path, batch)

    run_available(keyed.drop("c__"), step, checkpoint)


WATERMARKS = "watermarks"


def _watermark(spark: SparkSession, path: str, batch: int, delay: str) -> Column:
    """Latest time of the batches before ``batch`` less the delay, as a literal; null before the first."""
    schema = T.StructType([T.StructField("latest", T.TimestampType())])
    latest = _read_log(spark, f"{path}/{WATERMARKS}", schema, batch).agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).first()[0]
    return F.lit(latest).cast("timestamp")


def distinct_in_time(stream: DataFrame, keys: Sequence[str], ts: str, seq: str, delay: str, path: str, checkpoint: str) -> None:
    """First arrival of every key among those that are not late; late ones are kept aside.

    A row is late if its time is not after the latest time of all earlier batches less ``delay``. ``<path>/late`` holds
    these rows, ``<path>/timely`` the first of each key of every batch, and ``<path>/first`` what
    ``dropDuplicatesWithinWatermark`` leaves of them. Its watermark is never ahead of the one used here, so nothing is dropped
    unseen, and its state of a key goes once the watermark has passed the key's time by ``delay``. Rows without a time or a
    key are late rows, too.
    """
    spark = stream.sparkSession
    rows = stream.select(*keys, F.col(ts).cast("timestamp").alias(ts), seq)

    def split(df: DataFrame, batch: int) -> None:
        mark = _watermark(spark, path, batch, delay)
        whole = F.col(ts).isNotNull()
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        marked = df.withColumn("late__", ~whole | F.coalesce(F.col(ts) <= mark, F.lit(False)))
        write_batch(marked.filter("late__").drop("late__"), f"{path}/late", batch)
        first = F.min(F.struct(seq, ts))
        timely = marked.filter("not late__").groupBy(*keys).agg(first.alias("f__"), F.max(ts).alias("latest__"))
        write_batch(timely.select(*keys, f"f__.{ts}", f"f__.{seq}", "latest__"), f"{path}/timely", batch)
        # the latest time comes from the written table, so the arrivals are read once for it
        latest = spark.read.parquet(f"{path}/timely/{BATCH}={batch}").agg(F.max("latest__").alias("latest"))
        write_batch(latest, f"{path}/{WATERMARKS}", batch)

    run_available(rows, split, f"{checkpoint}/split")
    shape = T.StructType([*[rows.schema[k] for k in keys], rows.schema[ts], rows.schema[seq], T.StructField("latest__", T.TimestampType())])
    timely = spark.readStream.schema(shape).parquet(f"{path}/timely").drop("latest__")
    with keyed_state(spark):
        first = timely.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
        run_available(first, lambda df, n: write_batch(df, f"{path}/first", n), f"{checkpoint}/first")


# How often sources are collected.
FREQUENCIES = ("diaria", "semanal", "mensal")


def due_sources(descriptors: DataFrame, frequency: str) -> DataFrame:
    """Active sources of one frequency. A scheduler outside starts one run per frequency."""
    if frequency not in FREQUENCIES:
        raise ValueError(f"unknown frequency {frequency}")
    return descriptors.filter(F.col("active") & (F.col("frequency") == frequency)).select("source")


def counts_of_due(stream: DataFrame, due: DataFrame, path: str, checkpoint: str) -> None:
    """Arrivals per source that is due in this run."""
    def step(df: DataFrame, batch: int) -> None:
        write_batch(df.groupBy("source").agg(F.count("*").alias("n")), path, batch)

    run_available(stream.select("source").join(due, "source", "left_semi"), step, checkpoint)


def snapshot(rows: DataFrame, markers: DataFrame, source: str = "source") -> DataFrame:
    """Rows of the sources that are completely written: their count equals the marker's."""
    counts = rows.groupBy(source).agg(F.count("*").alias("n__"))
    whole = counts.join(markers, source).filter(F.col("n__") == F.col("rows")).select(source)
    return rows.join(whole, source, "left_semi")
