"""Packing of token pieces into sequences of fixed length by minimum bin slack.

How many pieces there are of each length is all that the search needs: at most ``room`` numbers, whatever the corpus.
Per sequence, a bitset subset-sum over the lengths still available finds the fullest combination that holds the longest
one left; it is taken as often as the counts allow at once, so each search uses up a length and there are at most
``room`` of them. The plan (combinations with how often each is used) goes to all tasks: a few numbers per length and
combination, bounded by ``room`` too. Each piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import ranked, store
from .tokens import Encoder


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination {length: times} with the largest sum up to ``room`` that holds the longest length of ``counts``.

    One bitset per item in binary portions (1, 2, 4 ... of a length): bit s is set if some combination sums to s.
    Of equal sums, the one with longer pieces first is taken.
    """
    longest = max(counts)
    mask = (1 << (room - longest + 1)) - 1
    steps, reach = [], 1
    for length in sorted(counts):
        left = min(counts[length] - (length == longest), (room - longest) // length)
        portion = 1
        while left > 0:
            portion = min(portion, left)
            steps.append((length, portion, reach))
            reach |= (reach << (length * portion)) & mask
            left -= portion
            portion *= 2
    total, out = reach.bit_length() - 1, {longest: 1}
    for length, portion, before in reversed(steps):
        if total >= length * portion and (before >> (total - length * portion)) & 1:
            out[length] = out.get(length, 0) + portion
            total -= length * portion
    return out


def plan(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is used, until nothing of ``counts`` is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        found = fullest(left, room)
        times = min(left[k] // n for k, n in found.items())
        out.append((found, times))
        for k, n in found.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def pieces(docs: DataFrame, vocabulary: str, room: int, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; its ids are those of the text, then ``end``.

    Documents over ``room`` ids are cut into pieces of ``room``; the first piece takes what is over.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder = Encoder.of(shared.value)
        for batch in batches:
            for part in W.slices(batch):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    ids += tail
                    total = len(ids) // 4
                    start, stop, k = 0, total % room or room, 0
                    while start < total:
                        rows.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, k = stop, stop + room, k + 1
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32()] + [pa.int64()] * 3)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    Null and empty texts are one piece, the end id. Pieces that fill a sequence stand alone. Offsets in a sequence are
    gapless from 0. Rows without doc_id and repeated rows are packed like any others, each row for itself.
    """
    spark = docs.sparkSession
    cut = store(pieces(docs, vocabulary, room, end).withColumn("_id", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    used, base, rows = {}, 0, []
    for found, times in plan(counts, room):
        offset = 0
        for length in sorted(found, reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, found[length], base, offset))
            used[length] = first + found[length] * times
            offset += length * found[length]
        base += times
    rows.sort()
    lengths = np.array([r[0] for r in rows], np.int64)
    table = [np.array([r[i] for r in rows], np.int64) for i in range(1, 5)]
    shared = spark.sparkContext.broadcast((lengths, table))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranked(cut, ["length"], "_id", "_rank", buckets).drop("_id")

    def place(batches):
        lengths, (firsts, times, bases, offsets) = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            # the last row of this length whose first rank is not above ours
            low, high = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
            at = np.empty(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                lo, hi = low[own][0], high[own][0]
                at[own] = lo + np.searchsorted(firsts[lo:hi], rank[own], "right") - 1
            turn, slot = np.divmod(rank - firsts[at], times[at])
            batch = batch.drop_columns(["_rank"])
            batch = batch.append_column("sequence_id", pa.array(bases[at] + turn))
            yield batch.append_column("offset", pa.array(offsets[at] + slot * length))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, schema)
