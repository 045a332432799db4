"""Passages that repeat across or within documents, found as runs of consecutive sentences and removed.

A sentence ends behind ``.``, ``!`` or ``?`` before white space, and at a newline; one of more than ``PIECE`` words is
cut every ``PIECE`` words, so that text without stops has sentences too, or, with ``by_content``, at places that its words
choose (``content_cuts``), so that equal passages are cut alike behind any number of other words. From every sentence the shortest run with
``least_sentences`` sentences and ``least_words`` words is hashed (128 bits over lower-cased words) and all runs of all
documents are joined by hash. With ``ends``, so is the shortest such run that ends at every sentence; the two cover every
longer repeated run whole, where the runs from its sentences alone leave a tail of few words. The first place of a run, by doc_id and sentence, stays; sentences that any other place
covers go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import fresh, small, store

PIECE = 20
REACH = 10  #: words to each side among which a cut's hash is the smallest
CONTEXT = 3  #: words that make this hash


def content_cuts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that begin a piece inside sentences of more than ``PIECE`` words; ``first`` has the sentences' first words.

    A cut is behind a word whose hash, over it and the words before it, is the smallest of all up to ``REACH`` words
    away. All of these lie in the sentence, so a cut follows from the words around it and not from where they stand.
    Of equal hashes, as in text that repeats itself, the first counts, and the next one that is out of its reach.
    """
    n, reach = len(hashes), 2 * REACH + 1
    if n < reach + CONTEXT or not (np.diff(first) > PIECE).any():
        return np.zeros(0, np.int64)
    ends = np.arange(CONTEXT, n + 1)
    value = np.concatenate([np.zeros(CONTEXT - 1, np.uint64), W.run_hash(hashes, ends - CONTEXT, ends)])
    low = np.lib.stride_tricks.sliding_window_view(value, reach).min(axis=1)
    at = np.flatnonzero(value[REACH : n - REACH] == low) + REACH
    sentence = np.searchsorted(first, at, "right") - 1
    inside = (at - first[sentence] >= REACH + CONTEXT - 1) & (first[sentence + 1] - at > REACH)
    at = at[inside & (np.diff(first)[sentence] > PIECE)]
    if (np.diff(at) <= REACH).any():
        kept = [-reach]
        for one in at.tolist():
            if one - kept[-1] > REACH:
                kept.append(one)
        at = np.array(kept[1:], np.int64)
    return at + 1


def _sentences(part: pa.RecordBatch, by_content: bool):
    """Bytes and offsets, word hashes, each sentence's first word and byte, and each row's first sentence."""
    data, offsets = W.text_bytes(part.column("text"))
    n = len(data)
    sep = W.separators(data)
    stop = (data == 46) | (data == 33) | (data == 63)
    ends = np.zeros(n + 1, bool)
    if n:
        ends[1:] = data == 10
        ends[2:] |= stop[:-1] & sep[1:]
    ends[offsets] = True
    starts, _, hashes, first = W.words(data, np.flatnonzero(ends))
    first = np.unique(np.append(first, len(starts)))  # sentences without words go
    if by_content:
        word = np.sort(np.concatenate([first[:-1], content_cuts(hashes, first)]))
    else:
        pieces = -(-np.diff(first) // PIECE)
        border = np.concatenate([[0], np.cumsum(pieces)])
        row = np.repeat(np.arange(len(pieces)), pieces)
        word = first[row] + PIECE * (np.arange(border[-1]) - border[row])
    at = starts[word]
    return data, offsets, hashes, word, at, np.searchsorted(at, offsets)


def _runs(words: int, word: np.ndarray, border: np.ndarray, least_sentences: int, least_words: int, ends: bool):
    """Start and end sentence of the shortest run from (with ``ends``, and to) each sentence that is long enough inside its row."""
    edge = np.append(word, words)
    i = np.arange(len(word))
    j = np.maximum(i + least_sentences, np.searchsorted(edge, edge[:-1] + least_words))
    last = np.repeat(border[1:], np.diff(border))
    good = j <= last
    i, j = i[good], j[good]
    if ends:
        back = np.arange(1, len(word) + 1)  # end sentences
        start = np.minimum(back - least_sentences, np.searchsorted(edge, edge[back] - least_words, "right") - 1)
        good = start >= np.repeat(border[:-1], np.diff(border))
        both = np.unique(np.concatenate([i * (len(word) + 1) + j, start[good] * (len(word) + 1) + back[good]]))
        i, j = both // (len(word) + 1), both % (len(word) + 1)
    return i, j, edge


def _spans(docs: DataFrame, least_sentences: int, least_words: int, ends: bool, by_content: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                _, _, hashes, word, _, border = _sentences(part, by_content)
                i, j, edge = _runs(len(hashes), word, border, least_sentences, least_words, ends)
                row = np.searchsorted(border, i, "right") - 1
                columns = [
                    pa.array(W.run_hash(hashes, edge[i], edge[j], s).view(np.int64)) for s in (0, 1)
                ] + [part.column("doc_id").take(pa.array(row)), pa.array((i - border[row]).astype(np.int32)), pa.array((j - i).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "s", "k"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, s int, k int")


def repeated_spans(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, ends: bool = False, by_content: bool = False) -> DataFrame:
    """(doc_id, lo, hi): disjoint ranges of sentences, lo counted from 0, hi not included, that repeat an earlier place.

    Rows without doc_id or text take no part. Repeated rows of one doc_id stand at the same place and keep their text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    spans = _spans(docs, least_sentences, least_words, ends, by_content)
    first = spans.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count("*").alias("c"))
    first = store(first.where("c > 1").select("h1", "h2", "first"), "firsts")  # a plain table, so that a hot hash's spans can be split
    again = spans.join(first, ["h1", "h2"])
    again = again.where("struct(doc_id, s) != first").select("doc_id", "s", (F.col("s") + F.col("k")).alias("e"))
    again = again.distinct()
    by = Window.partitionBy("doc_id").orderBy("s")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    marked = again.withColumn("_new", new).withColumn("_part", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "_part").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).drop("_part")


def dedup_spans(docs: DataFrame, least_sentences: int = 2, least_words: int = 20, counts: bool = False, ends: bool = False, by_content: bool = False) -> DataFrame:
    """``docs`` with its columns and without the sentences of ``repeated_spans``; a sentence goes with the space behind it.

    Every row stays, also when no sentence is left (empty text). With ``counts``, adds n_removed, the sentences taken out.
    """
    ranges = repeated_spans(docs, least_sentences, least_words, ends, by_content)
    ranges = store(ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("r")), "ranges")
    weight = ranges.agg(F.sum(F.size("r"))).first()[0] or 0
    key, cut, gone = fresh(docs, "_doc"), fresh(docs, "_ranges"), fresh(docs, "n_removed")
    ranges = ranges.select(F.col("doc_id").alias(key), F.col("r").alias(cut))
    wide = docs.join(small(ranges) if weight <= 500_000 else ranges, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    schema = docs.withColumn(gone, F.lit(0)).schema

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                data, _, _, _, at, border = _sentences(part, by_content)
                text, removed = part.column("text").to_pylist(), np.zeros(part.num_rows, np.int32)
                _, offsets = W.text_bytes(part.column("text"))
                for r, found in enumerate(part.column(cut).to_pylist()):
                    if not found or text[r] is None:
                        continue
                    edge = np.append(at[border[r] : border[r + 1]], offsets[r + 1])
                    keep, lo = [], int(offsets[r])
                    for one in sorted(found, key=lambda x: x["lo"]):
                        keep.append(data[lo : edge[one["lo"]]].tobytes())
                        lo = int(edge[one["hi"]])
                        removed[r] += one["hi"] - one["lo"]
                    keep.append(data[lo : int(offsets[r + 1])].tobytes())
                    text[r] = b"".join(keep).decode()
                part = part.drop_columns([cut])
                at_text = part.schema.get_field_index("text")
                part = part.set_column(at_text, pa.field("text", pa.string()), pa.array(text, pa.string()))
                yield part.append_column(gone, pa.array(removed))

    out = wide.mapInArrow(run, schema)
    return out.withColumnRenamed(gone, "n_removed") if counts else out.drop(gone)
