"""Lines that repeat an earlier line, exactly or nearly, found by an exact set-similarity join and removed.

A line's set holds the hashes of its words (``size=1``, as the query and the pipeline take it) or of its shingles.
Elements are ordered by rarity; the prefix, positional and length filters and sketches choose candidates inside the list
join, so that lists of usual words make few pairs; the Jaccard similarity of whole sets decides (``setjoin``). Before that,
lines that share smallest elements meet the first of them only, so near copies are gone before lists are joined.

Equal sets are one class, whose place is its first line. A line goes if an earlier line has an equal or similar set,
whether that line itself stays or not, so the result does not depend on an order of work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import setjoin as S
from . import words as W
from .common import by_some_keys, counted_rows, fresh, let, small, store


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row offsets with one more entry behind every newline inside a row."""
    return np.sort(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]), kind="stable")


def _lines(part: pa.RecordBatch, size: int, least: int, counts: np.ndarray | None):
    """Row and number of every line with a word and ``least`` words or more, and their sets end to end with borders.

    With ``counts``, the rarest elements of a set come first."""
    data, offsets = W.text_bytes(part.column("text"))
    cuts = line_offsets(data, offsets)
    _, _, hashes, first = W.words(data, cuts)
    grams, border = W.shingles(hashes, first, size)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])[offsets]  # newlines before each row
    row = np.repeat(np.arange(part.num_rows), np.diff(newlines) + 1)
    number = np.arange(len(row)) - (newlines[:-1] + np.arange(part.num_rows))[row]
    wanted = np.diff(first) >= max(least, 1)
    line = np.repeat(np.cumsum(wanted) - 1, np.diff(border))
    inside = np.repeat(wanted, np.diff(border))
    if not wanted.all():
        grams, line = grams[inside], line[inside]
    grams, line = S.distinct_sets(grams, line, counts)
    k = np.flatnonzero(wanted)
    return row[k], number[k], grams, np.searchsorted(line, np.arange(len(k) + 1))


def _print(grams: np.ndarray, border: np.ndarray, seed: int) -> pa.Array:
    if not len(grams):
        return pa.array([], pa.int64())
    fold = (np.bitwise_xor, np.add)[seed]
    return pa.array(fold.reduceat(W.mix(grams + np.uint64(W._BASES[seed])), border[:-1]).view(np.int64))


def _line_sets(docs: DataFrame, size: int, least: int, schema: str, finish, counts=None) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                row, number, grams, border = _lines(part, size, least, counts and counts.value)
                ids = part.column("doc_id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), *finish(grams, border)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _alike(pairs: DataFrame, n_pairs: int, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that whole sketches do not rule out; pairs of a set without one stay."""
    ends = store(reps.select("id", "n", "sketch").where("sketch is not null").join(small(_ends(pairs), most=2 * n_pairs), "id", "left_semi"), "ends")
    x, y = ends.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x")), ends.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    near = S.alike(F.col("n"), F.col("m"), F.col("x"), F.col("y"), percent)
    return store(pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce(near, F.lit(True))).select("a", "b"), "alike")


def _later(docs: DataFrame, pairs: DataFrame, reps: DataFrame, places: DataFrame, size: int, least: int, percent: int) -> tuple[DataFrame, int]:
    """(id): the later line of every pair (a, b) of line ids that reaches the threshold, from whole sets of just these lines;
    and a number of rows that it does not exceed."""
    n_pairs = counted_rows(pairs)
    few = 2 * n_pairs  # lines, at most
    pairs = _alike(pairs, n_pairs, reps, percent)
    ids = store(places.join(small(_ends(pairs), most=few), "id", "left_semi"), "lines")
    of = small(ids.select(F.col("doc_id").alias("_doc")).distinct(), most=few)
    wanted = docs.join(of, F.col("doc_id") == F.col("_doc"), "left_semi")
    sets = _line_sets(
        wanted, size, least, "doc_id long, line int, p1 long, items array<long>",
        lambda grams, border: [_print(grams, border, 0), pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(grams.view(np.int64)))],
    )
    sets = sets.join(small(ids, most=few), ["doc_id", "line", "p1"]).select("id", "items").dropDuplicates(["id"])  # rows of one doc_id may repeat
    links = store(S.verified(pairs, sets, percent), "links")
    x, y = (small(ids.select(F.col("id").alias(c), F.struct("doc_id", "line").alias(f"at_{c}")), most=few) for c in "ab")
    links = links.join(x, "a").join(y, "b").where("at_a != at_b")
    return store(links.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct(), "gone"), n_pairs


def repeated_lines(docs: DataFrame, size: int = 5, percent: int = 80, least: int = 5) -> DataFrame:
    """(doc_id, line) of every line to be removed; lines count from 0 in a text split at ``\\n``.

    Order is by doc_id, then line. Lines with fewer than ``least`` words, empty lines, and rows without doc_id or text
    neither match nor go. Repeated rows of one doc_id stand at the same place and so do not remove each other's lines.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    counts = docs.sparkSession.sparkContext.broadcast(S.rarity(docs, size, line_offsets))

    def finish(grams, border):
        keys = S.likeness_keys(grams, border).values.to_numpy().reshape(-1, 3)
        return [
            pa.array(np.diff(border), pa.int32()), _print(grams, border, 0), _print(grams, border, 1),
            S.tokens(S.first_elements(grams, border, percent)), *S.sketch_columns(S.flat_sketches(grams, border)),
            *(pa.array(np.ascontiguousarray(k)) for k in keys.T),
        ]

    schema = "doc_id long, line int, n int, p1 long, p2 long, prefix array<int>, s0 long, s1 long, sketch array<long>, k0 long, k1 long, k2 long"
    sig = _line_sets(docs, size, least, schema, finish, counts)
    sig = store(sig.withColumn("id", F.monotonically_increasing_id()), "line-signatures")  # ids are as stored
    narrow = sig.select("doc_id", "line", "p1", "p2", "n")
    # the first line of each class of equal sets, moved once with all its columns
    first = F.row_number().over(Window.partitionBy("p1", "p2", "n").orderBy("doc_id", "line", "id"))
    sets = store(sig.withColumn("_first", first).where("_first = 1").drop("_first"), "sets")
    places = sets.select("id", "doc_id", "line", "p1")

    # where not even one more element may stand in a similar set, only equal sets are similar
    reps = sets.where(100 * F.col("n") >= percent * (F.col("n") + 1))

    # lines that share smallest elements: those like the first of them go, so near copies of one line do not meet all with all
    part = range(S.NARROW // 64)
    own = F.struct("doc_id", "line", "id", "n", *[f"s{k}" for k in part])
    keyed = reps.select(F.explode(F.array("k0", "k1", "k2")).alias("key"), own.alias("own"))
    pairs = keyed.withColumn("hub", F.min("own").over(Window.partitionBy("key")))
    pairs = pairs.where((F.col("hub.id") != F.col("own.id")) & S.near("hub", "own", part, percent, rest="n"))
    pairs = store(pairs.select(F.col("hub.id").alias("a"), F.col("own.id").alias("b")).distinct(), "pairs")
    gone, n_gone = _later(docs, pairs, reps, places, size, least, percent)

    # then every line that is still there against the others in its lists; each entry moves once, whatever it meets
    some = small(gone.select(F.col("id").alias("_gone")), most=n_gone)
    entries = S.listed(reps.join(some, F.col("id") == F.col("_gone"), "left").withColumn("past", F.col("_gone").isNotNull()), part)
    both = S.met(entries, part, percent).distinct()
    both = both.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    with by_some_keys(docs.sparkSession):
        both = store(both, "open")
    more, _ = _later(docs, both, reps, places, size, least, percent)
    gone = gone.union(more).distinct()

    classes = sets.select("p1", "p2", "n", "id", F.struct("doc_id", "line").alias("at"))
    named = classes.join(gone.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left")
    named = named.select("p1", "p2", "n", "at", F.col("_gone").isNotNull().alias("gone"))
    marked = narrow.join(named, ["p1", "p2", "n"])
    return marked.where("gone or struct(doc_id, line) != at").select("doc_id", "line").distinct()


def dedup_lines(docs: DataFrame, size: int = 5, percent: int = 80, least: int = 5, counts: bool = False) -> DataFrame:
    """``docs`` with its columns, texts without their repeated lines (``repeated_lines``), the rest joined by ``\\n``.

    Every row stays, also when no line is left (empty text). With ``counts``, adds n_lines and n_removed (0 for null).
    """
    gone = repeated_lines(docs, size, percent, least).groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    gone = store(gone, "removals")
    key, lines = fresh(docs, "_doc"), fresh(docs, "_lines")
    out = docs.join(
        small(gone.select(F.col("doc_id").alias(key), F.col("lines").alias(lines))),
        F.col("doc_id").cast("long") == F.col(key), "left",
    )
    parts = F.split("text", "\n")

    def rest(parts):
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lines))
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(let(parts, rest))
    extra = [F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size(lines), F.lit(0)).alias("n_removed")]
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *(extra if counts else []))
