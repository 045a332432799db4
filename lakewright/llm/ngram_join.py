"""Documents linked by the Jaccard similarity of their word n-grams, found by a grouped prefix join.

1. Documents with equal n-gram sets are one class. Classes with the same set size and the same prefix are one group.
2. One list per prefix element holds groups, not documents. Group pairs pass the length and positional filters.
3. Groups expand into classes, and only class pairs are verified, on whole sets made from whole texts.

Links are wanted up to reachability, so pairs of one component need no check: each list's hub is compared first
(``setjoin.hub_pairs``); after the components of these links are known, every pair of list members that still lie in
different components is compared, but for the hub's pairs, which are known. Sketches (``setjoin.alike``) and, for long
texts, counters (``setjoin.counted``) rule out most of these before whole sets are fetched. No link between different components is lost, and near copies of one text do not
meet all with all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin as S
from . import words as W
from .common import components, counted_rows, small, store


def _sets(docs: DataFrame, size: int, schema: str, finish) -> DataFrame:
    """Runs ``finish(ids, sets)`` on the n-gram set of every whole text; it returns the columns of ``schema``."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                _, _, hashes, first = W.words(*W.text_bytes(part.column("text")))
                grams, border = W.shingles(hashes, first, size)
                sets = [np.unique(grams[border[i] : border[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(*finish(part.column("doc_id").cast(pa.int64()), sets))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, p1, p2, sketch, counters, prefix): set size, 128 bits that stand for the set, its sketches and rarest elements."""
    counts = docs.sparkSession.sparkContext.broadcast(S.rarity(docs, size))

    def finish(ids, sets):
        prints = np.array([W.set_print(s) for s in sets], np.int64).reshape(-1, 2)
        columns = [
            ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
            S.lists([S.sketch(s).view(np.uint64) for s in sets]), pa.array([S.counters(s) for s in sets], pa.binary()),
            S.lists([S.prefix(s, counts.value, percent) for s in sets]),
        ]
        return columns, ["doc_id", "n", "p1", "p2", "sketch", "counters", "prefix"]

    return _sets(docs, size, "doc_id long, n long, p1 long, p2 long, sketch array<long>, counters binary, prefix array<long>", finish)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _members(docs: DataFrame, ids: DataFrame, most: int, size: int) -> DataFrame:
    """Whole sets of the documents in ``ids``."""
    wanted = docs.select("doc_id", "text").join(small(ids, most=most), F.col("doc_id") == F.col("id"), "left_semi")
    rows = _sets(wanted, size, "id long, items array<long>", lambda ids, sets: ([ids, S.lists(sets)], ["id", "items"]))
    return store(rows, "sets")


def _check(docs: DataFrame, pairs: DataFrame, most: int, size: int, percent: int) -> DataFrame:
    return store(S.verified(pairs, _members(docs, _ends(pairs), most, size), percent), "links")


def _near(pairs: DataFrame, most: int, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the counters of their long texts do not rule out."""
    long = sig.where("counters is not null").select(F.col("doc_id").alias("id"), "n", "counters")
    return store(S.counted(pairs, store(long.join(small(_ends(pairs), most=most), "id", "left_semi"), "counters"), percent), "near")


def _likely(pairs: DataFrame, most: int, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sketches do not rule out."""
    ends = store(classes.select("id", "n", "sketch").join(small(_ends(pairs), most=most), "id", "left_semi"), "ends")
    x = ends.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    y = ends.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    both = both.where(S.alike(F.col("n"), F.col("m"), F.col("x"), F.col("y"), percent))
    return store(both.select("a", "b").distinct(), "likely")


def linked_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text and any other columns).

    Two documents link when their sets of distinct ``size``-word n-grams (lower-cased, fewer words: all of them as one)
    have ``100 * intersection >= percent * union``. ``component_id`` is the smallest doc_id that can be reached.
    Null, empty and wordless texts have an empty set, link with nothing and are their own component. Repeated rows come
    back as often as they come in. Rows without doc_id keep their size, link with nothing and have a null component.
    """
    mark = F.struct("n", F.xxhash64("prefix"), F.hash("prefix"))
    sig = store(signatures(docs, size, percent).withColumn("mark", mark), "signatures")
    known = sig.where("doc_id is not null and n > 0")
    # mark and sketch follow from the set, so they may stand among the keys
    classes = store(known.groupBy("p1", "p2", "n", "mark", "sketch").agg(F.min("doc_id").alias("id")), "classes")

    groups = store(classes.groupBy("mark").agg(F.min("id").alias("group"), F.count("*").alias("members")), "groups")
    of_group = classes.select("id", "mark").join(groups.where("members > 1"), "mark").select("group", "id")
    of_group = store(of_group.distinct(), "members")

    chosen = groups.select(F.col("group").alias("id"), F.col("mark").alias("_mark"), F.least("members", F.lit(2)).alias("members"))
    rep = known.select(F.col("doc_id").alias("id"), "mark", "n", "prefix").join(chosen, "id").where("mark = _mark")
    rep = rep.select("id", "n", "members", "prefix").dropDuplicates(["id", "n"])
    entries = S.shared(rep.select("id", "n", "members", F.posexplode("prefix").alias("pos", "token"))).drop("members")
    entries = store(entries.withColumn("plen", S.prefix_size(F.col("n"), percent)), "entries")

    hubs = store(S.hubs(entries), "hubs")
    pairs = S.hub_pairs(entries, hubs, percent)  # group pairs, expanded: the hub's first class against all of the other group
    spread = pairs.join(of_group.select(F.col("group").alias("b"), F.col("id").alias("c")), "b", "left")
    first = spread.select("a", F.coalesce("c", "b").alias("b"))
    within = of_group.where("id != group").select(F.col("group").alias("a"), F.col("id").alias("b"))
    checked = store(first.union(within).distinct(), "pairs")
    most = 2 * counted_rows(checked)  # documents in these pairs, at most
    links = _check(docs, _near(_likely(checked, most, classes, percent), most, sig, percent), most, size, percent)
    parts = components(links)

    # every other pair of members of one list that is still in two components
    wide = entries.join(of_group.select(F.col("group").alias("id"), F.col("id").alias("c")), "id", "left")
    wide = wide.select("token", F.coalesce("c", "id").alias("id"), "n", "pos")
    wide = wide.join(hubs, "token").where("id != hub.id").drop("hub")
    wide = wide.join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id"))
    wide = store(wide.select("token", F.struct("id", "n", "pos", "part").alias("own")), "wide")
    mixed = wide.groupBy("token").agg(F.min("own.part").alias("lo"), F.max("own.part").alias("hi")).where("lo != hi")
    wide = wide.join(mixed.select("token"), "token", "left_semi").select("token", "own.*")
    wide = wide.join(classes.select("id", "n", "sketch"), ["id", "n"])
    wide = store(wide.select("token", F.struct("id", "n", "pos", "part", "sketch").alias("own")), "mixed")
    left, right = wide.withColumnRenamed("own", "x"), wide.withColumnRenamed("own", "y")
    open_pairs = left.join(right, "token").where(
        (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & S.fits("x", "y", percent)
        & S.alike(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), percent)
    )
    open_pairs = open_pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    either = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_pairs = store(open_pairs.join(either, ["a", "b"], "left_anti"), "open")
    most = 2 * counted_rows(open_pairs)
    last = parts
    if most and not (more := _check(docs, _near(open_pairs, most, sig, percent), most, size, percent)).isEmpty():
        last = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    named = classes.join(last, F.col("id") == F.col("node"), "left")
    named = named.select("p1", "p2", F.col("n").alias("m"), F.coalesce("component", "id").alias("component_id"))
    out = sig.select("doc_id", "n", "p1", "p2")
    done = out.where("doc_id is not null and n > 0").join(named, ["p1", "p2"]).where("n = m")
    rest = out.where("doc_id is null or n = 0")
    return done.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(
        rest.select("doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")))
    )
