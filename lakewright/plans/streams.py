"""Streaming jobs over the given tables, run to completion; results equal the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import versions
from ..sources.tables import table
from ..streaming import jobs
from .registry import query


@query("stream_slots", """
SELECT strftime(time_bucket(INTERVAL '30 minutes', ts), '%Y-%m-%d %H:%M:%S') AS slot, round(sum(value), 2) AS total, count(*) AS events FROM events GROUP BY 1
""")
def stream_slots(spark, folder):
    stream = jobs.table_stream(spark, folder, "events")
    path = scratch_path(spark, "slots")
    jobs.slot_totals(stream, "ts", "value", path, f"{path}-checkpoint")
    out = jobs.latest_slots(spark, path)
    return out.select(F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"), F.round("total", 2).alias("total"), "events")


@query("stream_changed_docs", """
WITH u AS (SELECT source || '/' || doc_id AS url, text, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT url, sha256(text) AS sha256, 'new' AS status FROM u
UNION ALL SELECT url, sha256(text || ' v2'), 'changed' FROM u WHERE quality = 0
""")
def stream_changed_docs(spark, folder):
    """Two runs on one checkpoint: first all documents, then all labelled ones, some of them changed."""
    docs = table(spark, folder, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), "text", F.lit(1).alias("seq"), "doc_id"
    )
    second = docs.join(table(spark, folder, "labels"), "doc_id").withColumn(
        "text", F.when(F.col("quality") == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    ).withColumn("seq", F.lit(2))
    inbox, log = scratch_path(spark, "inbox"), scratch_path(spark, "changes")
    names = ["url", "text", "seq"]
    for arrival in (docs, second):
        arrival.select(*names).write.mode("append").parquet(inbox)
        stream = jobs.folder_stream(spark, inbox, docs.select(*names).schema)
        jobs.change_feed(stream, "url", F.col("text"), "seq", log, f"{log}-checkpoint")
    return spark.read.parquet(log).select("url", "sha256", "status")


@query("stream_dedup", """
SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1
""")
def stream_dedup(spark, folder):
    stream = jobs.table_stream(spark, folder, "documents")
    path = scratch_path(spark, "contents")
    jobs.distinct_contents(stream, F.col("text"), "doc_id", path, f"{path}-checkpoint")
    return spark.read.parquet(path).select("key", "doc_id")


@query("stream_late_events", """
WITH e AS (SELECT event_id, ts, event_id % 4 AS batch FROM events),
a AS (SELECT * FROM e UNION ALL SELECT event_id, ts, batch + 1 FROM e WHERE event_id % 5 = 0),
b AS (SELECT batch, max(ts) AS latest FROM a GROUP BY 1),
m AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 DAY AS mark FROM b),
s AS (SELECT event_id, a.batch, coalesce(ts <= mark, false) AS late FROM a JOIN m USING (batch))
SELECT event_id, count(*) FILTER (WHERE late) AS late, count(DISTINCT CASE WHEN NOT late THEN event_id END) AS kept FROM s GROUP BY 1
""")
def stream_late_events(spark, folder):
    """Events that arrive in five batches, a fifth of them twice; what is more than twelve days behind is kept aside."""
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4).alias("batch"))
    again = events.filter("event_id % 5 = 0").withColumn("batch", F.col("batch") + 1)
    inbox, path = scratch_path(spark, "arrivals"), scratch_path(spark, "in-time")
    arrivals = events.unionByName(again)
    for batch in range(5):  # each run takes up what has arrived since the last one
        arrivals.filter(F.col("batch") == batch).write.mode("append").parquet(inbox)
        stream = jobs.folder_stream(spark, inbox, arrivals.schema)
        jobs.distinct_in_time(stream, ["event_id"], "ts", "batch", "12 days", path, f"{path}-checkpoint")
    late = spark.read.parquet(f"{path}/late").groupBy("event_id").agg(F.count("*").alias("late"))
    kept = spark.read.parquet(f"{path}/first").groupBy("event_id").agg(F.count("*").alias("kept"))
    return late.join(kept, "event_id", "full").fillna(0, ["late", "kept"])


@query("stream_frequency_subset", """
WITH s AS (SELECT source, count(*) AS n, substring(source, 4)::INT % 3 AS f FROM documents GROUP BY 1) SELECT source, n FROM s WHERE f = 1 AND source <> 'src4'
""")
def stream_frequency_subset(spark, folder):
    """Only the sources of the weekly run; one of them is switched off."""
    documents = table(spark, folder, "documents")
    number = F.substring("source", 4, 10).cast("int")
    descriptors = documents.select("source").distinct().select(
        "source", F.element_at(F.array(*[F.lit(f) for f in jobs.FREQUENCIES]), number % 3 + 1).alias("frequency"), (F.col("source") != "src4").alias("active"),
    )
    stream = jobs.table_stream(spark, folder, "documents")
    path = scratch_path(spark, "due")
    jobs.counts_of_due(stream, jobs.due_sources(descriptors, "semanal"), path, f"{path}-checkpoint")
    return spark.read.parquet(path).groupBy("source").agg(F.sum("n").alias("n"))


@query("snapshot_refresh", """
WITH m AS (SELECT source, count(*) AS "rows" FROM documents GROUP BY 1),
w AS (SELECT source, count(*) FILTER (WHERE source < 'src3' OR n_chars > 50) AS n FROM documents GROUP BY 1)
SELECT source, n FROM w JOIN m USING (source) WHERE n = "rows"
""")
def snapshot_refresh(spark, folder):
    """A reader between two writes sees only the sources whose rows are all there."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    markers = documents.groupBy("source").agg(F.count("*").alias("rows"))
    path = scratch_path(spark, "index")
    documents.filter("source < 'src3' or n_chars > 50").write.partitionBy("source").parquet(path)
    visible = jobs.snapshot(spark.read.parquet(path), markers)
    return visible.groupBy("source").agg(F.count("*").alias("n"))


@query("snapshot_versions", """
SELECT reader, source, count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM documents, (SELECT unnest(['early', 'late']) AS reader) WHERE reader = 'late' OR n_chars > 200 GROUP BY 1, 2
""")
def snapshot_versions(spark, folder):
    """An index rebuilt while it is read: who looked it up before goes on with the old version, who comes later has the new one."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    root = scratch_path(spark, "index-versions")
    versions.publish(documents.filter("n_chars > 200"), root)
    early = versions.resolve(spark, root)
    versions.publish(documents, root)
    parts = [v.read(spark).withColumn("reader", F.lit(name)) for name, v in (("early", early), ("late", versions.resolve(spark, root)))]
    return parts[0].unionByName(parts[1]).groupBy("reader", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
