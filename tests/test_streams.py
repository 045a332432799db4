from pyspark.sql import functions as F

from lakewright.operators import catalog as cat
from lakewright.streaming import jobs


def arrive(spark, path, rows):
    spark.createDataFrame(rows, "url string, text string, seq int").coalesce(1).write.mode("append").parquet(path)


def feed(spark, inbox, log):
    schema = spark.createDataFrame([], "url string, text string, seq int").schema
    stream = jobs.folder_stream(spark, inbox, schema, files_per_batch=1)
    jobs.change_feed(stream, "url", F.col("text"), "seq", log, log + "-checkpoint")


def test_change_feed_follows_the_last_state(spark, tmp_path):
    inbox, log = str(tmp_path / "in"), str(tmp_path / "log")
    arrive(spark, inbox, [("u", "A", 1), ("v", "B", 1), ("u", "A0", 0)])
    feed(spark, inbox, log)
    arrive(spark, inbox, [("u", "A", 2), ("v", "C", 2)])
    feed(spark, inbox, log)
    arrive(spark, inbox, [("v", "B", 3)])  # back to an old version: still a change
    feed(spark, inbox, log)
    feed(spark, inbox, log)  # nothing new arrived
    got = sorted((r[jobs.BATCH], r.url, r.status) for r in spark.read.parquet(log).collect())
    assert got == [(0, "u", "new"), (0, "v", "new"), (1, "v", "changed"), (2, "v", "changed")]


def test_change_feed_reads_no_history(spark, tmp_path):
    """A batch reads its own arrivals only, and a batch that is repeated after a failure changes nothing."""
    import shutil

    inbox, log = str(tmp_path / "in"), str(tmp_path / "log")
    arrive(spark, inbox, [(f"u{i}", "A", 1) for i in range(50)] + [(None, "x", 1), ("n", None, 1)])
    feed(spark, inbox, log)
    shutil.copytree(log + "-checkpoint", log + "-before")
    arrive(spark, inbox, [("u1", "A", 2), ("u2", "B", 2), ("n", None, 2), (None, "x", 2), ("u2", "Z", None)])
    feed(spark, inbox, log)
    want = [(1, "u2", "changed")]
    got = lambda: [tuple(r) for r in spark.read.parquet(log).where(f"{jobs.BATCH} = 1").select(jobs.BATCH, "url", "status").collect()]
    assert got() == want
    schema = spark.createDataFrame([], "url string, text string, seq int").schema
    jobs.change_feed(jobs.folder_stream(spark, inbox, schema), "url", F.col("text"), "seq", log, log + "-before")
    assert got() == want
    shutil.rmtree(f"{log}/{jobs.BATCH}=0")  # the log's history is not needed for what comes next
    arrive(spark, inbox, [("u3", "A", 3), ("u4", "C", 3)])
    feed(spark, inbox, log)
    assert [r.url for r in spark.read.parquet(log).where(f"{jobs.BATCH} = 2").collect()] == ["u4"]


def test_late_rows_are_kept_aside(spark, tmp_path):
    import datetime as dt

    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda day: None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    batches = [
        [("a", 1, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4), ("c", None, 5)],
        [("a", 8, 6), ("d", 3, 7), ("b", 9, 8), ("e", 20, 9)],  # d is more than five days behind 9
        [("b", 16, 10), ("f", 14, 11), ("e", 21, 12)],  # b's state is gone, so it is first again; f is late
    ]
    schema = "k string, ts timestamp, seq long"
    for rows in batches:
        spark.createDataFrame([(k, at(d), n) for k, d, n in rows], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = jobs.folder_stream(spark, inbox, spark.createDataFrame([], schema).schema)
        jobs.distinct_in_time(stream, ["k"], "ts", "seq", "5 days", out, out + "-checkpoint")
    late = sorted(r.seq for r in spark.read.parquet(f"{out}/late").collect())
    first = sorted((r.k, r.seq) for r in spark.read.parquet(f"{out}/first").collect())
    assert late == [4, 5, 7, 11]
    assert first == [("a", 1), ("b", 3), ("b", 10), ("e", 9)]  # the second a came while the first was still held


def test_slots_over_several_batches_equal_the_batch(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    inbox, out = str(tmp_path / "ev"), str(tmp_path / "slots")
    events.repartition(3).write.parquet(inbox)
    stream = jobs.folder_stream(spark, inbox, events.schema, files_per_batch=1)
    jobs.slot_totals(stream, "ts", "value", out, out + "-checkpoint")
    got = jobs.latest_slots(spark, out).select("slot", F.round("total", 2).alias("t"), "events")
    want = events.groupBy(F.window("ts", "30 minutes").start.alias("slot")).agg(
        F.round(F.sum("value"), 2).alias("t"), F.count("*").alias("events"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_snapshot_skips_half_written_sources(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source string, n int")
    markers = spark.createDataFrame([("a", 2), ("b", 5), ("c", 0)], "source string, rows long")
    assert {r.source for r in jobs.snapshot(rows, markers).collect()} == {"a"}


def test_read_only_sql(spark):
    import pytest

    spark.range(300).createOrReplaceTempView("t_numbers")
    out = cat.limited(cat.read_only(spark, "with q as (select id, 'set drop;' as s from t_numbers) select * from q where id in (select id from t_numbers);"), 200)
    assert out.count() == 200 and out.first().truncated
    assert not cat.limited(cat.read_only(spark, "select count(*) from t_numbers"), 200).first().truncated
    columns, rows, more = cat.answer(spark, "select id from t_numbers order by id desc", rows=3)
    assert (columns, rows, more) == (["id"], [(299,), (298,), (297,)], True)
    assert cat.answer(spark, "select 'set' as w")[1:] == ([("set",)], False)
    for bad in ("drop table t_numbers", "select 1; select 2", "create view x as select 1", "insert into t_numbers select 1", "set a=b", "show tables", "describe t_numbers",
                "cache table t_numbers", "explain select 1", "select 1) as q; drop table t_numbers --"):
        with pytest.raises(Exception):
            cat.read_only(spark, bad)


def _as_folders(spark, data, root, *names):
    """The tables as folders of several files, as a cluster's writer leaves them."""
    for name in names:
        spark.read.parquet(f"{data}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_contents_of_a_table_in_several_files(spark, tmp_path, data):
    from lakewright.plans import QUERIES

    folder = _as_folders(spark, data, tmp_path, "documents", "events")
    for name in ("stream_dedup", "stream_slots"):
        one, many = (QUERIES[name](spark, f) for f in (data, folder))
        assert one.count() == many.count() > 0 and many.exceptAll(one).isEmpty(), name


def test_table_stream_keeps_partition_columns(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.write.partitionBy("lang").parquet(str(tmp_path / "documents.parquet"))
    out = str(tmp_path / "out")
    stream = jobs.table_stream(spark, str(tmp_path), "documents").select("doc_id", "lang")
    jobs.run_available(stream, lambda df, n: jobs.write_batch(df, out, n), out + "-checkpoint")
    got = spark.read.parquet(out).select("doc_id", "lang")
    want = docs.select("doc_id", "lang")
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()


def test_due_sources_of_a_table_in_several_files(spark, tmp_path, data):
    from lakewright.plans import QUERIES

    folder = _as_folders(spark, data, tmp_path, "documents")
    one, many = (QUERIES["stream_frequency_subset"](spark, f) for f in (data, folder))
    assert one.count() == many.count() > 0 and many.exceptAll(one).isEmpty()


def test_change_feed_asks_the_state_twice_a_key():
    calls = []

    class State:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    feed = jobs.LastHash("url", "seq", [])
    feed.last = State()
    got = [[r.status for r in feed.handleInputRows(("u",), iter([{"seq": 1, "sha256": h}]), None)] for h in (None, None, "a", "a")]
    assert got == [["new"], [], ["changed"], []]
    assert calls == ["get", "update", "get", "get", "update", "get"]
