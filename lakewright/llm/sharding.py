"""Shards of nearly equal bytes whose groups stay whole, by Karmarkar-Karp differencing.

Documents with equal text are one group. Groups are gathered into a fixed number of bundles by a hash of the text, so
what is differenced is bounded whatever the corpus, and a group that is larger than others is a larger bundle that the
rest makes up for. Each bundle starts as a partial partition, a tuple of shard sizes; the two with the largest spread
are combined in opposite order until one is left. With fewer groups than bundles, nearly every bundle is one group.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, ranked, store

BUNDLES = 1 << 14  #: sums that the driver sees, at most


def difference(tuples: np.ndarray) -> np.ndarray:
    """Shard of each column of each tuple: a permutation per row that makes the column sums nearly equal.

    ``tuples`` has a row per partial partition and a column per shard. Rows are combined two at a time, those with the
    largest spread first, the largest column of one with the smallest of the other.
    """
    rows, shards = tuples.shape
    order = np.argsort(-tuples, axis=1, kind="stable")
    sums = np.take_along_axis(tuples, order, 1)
    # a node keeps which (row, column) pairs are in each of its places, as links to the two nodes it was made of
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    value = list(sums)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = value[a] + value[b][::-1]
        turn = np.argsort(-total, kind="stable")
        value[a] = value[b] = None
        made.append((a, b, turn))
        value.append(total[turn])
        heapq.heappush(heap, (int(total.min() - total.max()), rows + len(made) - 1))
    out = np.empty((rows, shards), np.int64)
    places: dict[int, np.ndarray] = {rows + len(made) - 1: np.arange(shards)} if rows else {}
    for k in range(len(made) - 1, -1, -1):
        a, b, turn = made[k]
        own = places.pop(rows + k)
        before = np.empty(shards, np.int64)
        before[turn] = own  # place of each column before it was sorted
        places[a], places[b] = before, before[::-1]
    for i, own in places.items():
        out[i, order[i]] = own
    return out


def balanced(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``; the law is ``bytes``.

    ``size`` is the UTF-8 length plus 1. Rows with equal text share a shard; null counts as the empty text. ``slot`` is
    gapless from 0 within a shard. Repeated rows and rows without doc_id each have their own slot. grown_shard is null.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        crc32(text).cast("long").alias("text_crc32"), F.pmod(F.xxhash64(text), F.lit(BUNDLES)).cast("int").alias("bundle"),
    )
    narrow = store(narrow.withColumn("_id", F.monotonically_increasing_id()), "sizes")
    rows = narrow.groupBy("bundle").agg(F.sum("size").alias("bytes")).orderBy("bundle").collect()  # at most BUNDLES
    tuples = np.zeros((len(rows), shards), np.int64)
    tuples[:, 0] = [r["bytes"] for r in rows]
    places = difference(tuples)[:, 0].tolist()
    named = spark.createDataFrame([(r["bundle"], p) for r, p in zip(rows, places)], "bundle int, shard int")
    out = narrow.join(F.broadcast(named), "bundle").drop("bundle")  # at most BUNDLES rows of two numbers
    out = ranked(out, ["shard"], "_id", "slot", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
