"""Prefix trie of conversations, with totals of subtrees by centroid decomposition.

A turn's hash depends on its place, role and text; a prefix is named by the exclusive or of its turns' hashes (two of 64
bits), so names come from running totals of buckets and never from following pointers. A node's ancestors are the prefixes
of its smallest member, so a path to the top is a join by conversation and depth.

Totals of subtrees come from a centroid decomposition of the forest of parent edges. Each round takes the centroid of
every component (the deepest node that holds more than half of the component's weight below it), adds the totals of what
hangs there to every node from the centroid to the component's top, takes the centroid out and goes on with the parts.
A node and a node below it are parted once, by a centroid between them, so every pair counts once. A node weighs as
many members as it has; what hangs below it then weighs the turns that its members still have to come, which one aggregate
gives. Weight halves each round, so rounds grow with the logarithm, also for chains. Components of at most ``WHOLE`` nodes
are finished inside tasks, in the same way.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import join_keys, positions
from .common import crc32, small, store

WHOLE = 1 << 11  #: nodes of a component that one task may finish
NAME = ["k1", "k2"]
TOP = 3  #: turns at most that are taken from another conversation


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, print, words): turns in order, places from 0; the print is the md5 of the text.

    Order is by turn (nulls first), role and print. Null role and text are empty; rows without conv_id take no part.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.unhex(F.md5(F.encode(text, "utf-8"))).alias("print"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    bare = F.col("turn").isNull()
    bucket = F.struct(F.floor(F.col("turn") / 64), F.when(bare, F.col("role")), F.when(bare, F.substring(F.hex("print"), 1, 2)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]
    return positions(rows, ["conv_id"], order, bucket, "place").drop("turn")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as ``turns`` gives them, and conversations (conv_id, length), of conversations that share beginnings.

    Conversation c takes the first h turns of conversation c - c % 20, h being crc32(c) % 4, and its own from the h-th on.
    ``%`` has the sign of c, so small negative numbers share conversation 0.
    """
    own = store(turns(conversations), "turns")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    # what may be lent is short: at most TOP turns of each
    lent = own.where(f"conv_id % 20 = 0 and place < {TOP}")
    lenders = lent.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("given"))
    c = F.col("conv_id")
    members = sizes.select("conv_id", "n", (c - c % 20).alias("base"), (crc32(c.cast("string")) % 4).alias("h"))
    members = members.join(lenders, "base", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0))).cast("long"))
    members = store(members.withColumn("length", F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("given")), "members")
    rest = own.join(members.select("conv_id", "h", "given"), "conv_id").where("place >= h")
    rest = rest.withColumn("place", F.col("place") - F.col("h") + F.col("given")).drop("h", "given")
    first = members.where("given > 0").select("conv_id", "base", "given").join(lent.withColumnRenamed("conv_id", "base"), "base").where("place < given")
    return rest.unionByName(first.select(*rest.columns)), members.select("conv_id", "length")


def _exclusive_or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), parts)


def prefixes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, left): the node of every prefix, its parent's name, and turns from here on."""
    hashed = rows.select("conv_id", "place", "words", *[F.xxhash64(F.lit(i), "place", "role", "print").alias(f"x{i}") for i in (1, 2)])
    hashed = hashed.withColumn("bucket", F.floor(F.col("place") / 64))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = hashed.groupBy("conv_id", "bucket").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    totals = totals.select("conv_id", "bucket", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    named = hashed.select("*", *[F.bit_xor(f"x{i}").over(inside).alias(f"r{i}") for i in (1, 2)]).join(totals, ["conv_id", "bucket"])
    for i in (1, 2):
        named = named.withColumn(f"k{i}", _exclusive_or([F.col(f"r{i}"), F.col(f"s{i}")]))
        named = named.withColumn(f"p{i}", _exclusive_or([F.col(f"k{i}"), F.col(f"x{i}")]))
    named = named.join(members, "conv_id")
    return named.select("conv_id", (F.col("place") + 1).alias("depth"), "k1", "k2", "p1", "p2", "words", (F.col("length") - F.col("place")).alias("left"))


def _decompose(parents: list[int], leaves: list[int], saved: list[int]) -> tuple[list[int], list[int]]:
    """Totals of subtrees of one component; nodes are given parents first, the top's parent is -1."""
    n = len(parents)
    out_leaves, out_saved = [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(parents):
        if p >= 0:
            children[p].append(v)
    above, alive, sizes = list(parents), [True] * n, [0] * n
    tops = [v for v, p in enumerate(parents) if p < 0]
    while tops:
        top = tops.pop()
        order = [top]
        for v in order:
            order.extend(w for w in children[v] if alive[w])
        for v in reversed(order):
            sizes[v] = 1 + sum(sizes[w] for w in children[v] if alive[w])
        c = top
        while (heavy := next((w for w in children[c] if alive[w] and 2 * sizes[w] > sizes[top]), None)) is not None:
            c = heavy
        hanging = [c]
        for v in hanging:
            hanging.extend(w for w in children[v] if alive[w])
        a, b = sum(leaves[v] for v in hanging), sum(saved[v] for v in hanging)
        v = c
        while True:
            out_leaves[v] += a
            out_saved[v] += b
            if v == top:
                break
            v = above[v]
        tops.extend(w for w in children[c] if alive[w])
        alive[c] = False
        if c != top:
            tops.append(top)
    return out_leaves, out_saved


def _finished(live: DataFrame) -> DataFrame:
    """(k1, k2, leaves, saved) of the nodes of small components (c1, c2), each as a whole in one task."""
    schema = "k1 long, k2 long, leaves long, saved long"

    def run(batches):
        held: list[tuple] = []

        def close():
            at = {(r[2], r[3]): i for i, r in enumerate(held)}
            totals = _decompose([at.get((r[4], r[5]), -1) for r in held], [r[6] for r in held], [r[7] for r in held])
            out = [[r[2] for r in held], [r[3] for r in held], *totals]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["k1", "k2", "leaves", "saved"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if held and held[0][:2] != row[:2]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    dealt = live.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "depth")
    return dealt.select("c1", "c2", "k1", "k2", "p1", "p2", "leaves", "saved").mapInArrow(run, schema)


def subtree_totals(nodes: DataFrame, paths: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(k1, k2, leaves, saved): sums over every node's subtree.

    ``nodes``: k1, k2, p1, p2, depth, conv_id (a member), weight (of the subtree), leaves and saved (of the node alone).
    ``paths``: conv_id, depth, k1, k2, p1, p2 of every prefix of a member. Nodes at depth 1 are tops.
    """
    own = ["k1", "k2", "p1", "p2", "depth", "conv_id", "weight", "leaves", "saved"]
    comp, lookup = ["c1", "c2"], paths.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), *[F.col(c).alias(f"_{c}") for c in ("k1", "k2", "p1", "p2")])
    # which tree a node is in: the first prefix of its member
    first = lookup.where("_depth = 1").select("_conv", F.col("_k1").alias("c1"), F.col("_k2").alias("c2"))
    live = store(nodes.select(*own).join(first, F.col("conv_id") == F.col("_conv")).drop("_conv"), "components")
    done: list[DataFrame] = []
    while True:
        stats = live.groupBy(*comp).agg(F.count("*").alias("n"), F.max("weight").alias("all"), F.min("depth").alias("top"))
        large = store(stats.where(F.col("n") > whole), "large-components")
        if large.isEmpty():
            done.append(_finished(live))
            break
        large = small(large.drop("n"))
        done.append(_finished(live.join(large, comp, "left_anti")))
        live = live.join(large, comp)
        deepest = F.max(F.when(2 * F.col("weight") > F.col("all"), F.struct("depth", "k1", "k2", "conv_id", "weight")))
        centroid = live.groupBy(*comp).agg(deepest.alias("c"), F.first("top").alias("_top"))
        centroid = store(centroid.select(*comp, "_top", "c.*").withColumnsRenamed({c: f"c_{c}" for c in ("depth", "k1", "k2", "conv_id", "weight")}), "centroids")
        live = live.drop("all", "top").join(small(centroid), comp)
        below = F.col("depth") > F.col("c_depth")  # these have a prefix one deeper than the centroid: is it the centroid's child?
        deeper = (F.col("conv_id") == F.col("_conv")) & (F.col("_depth") == F.col("c_depth") + 1) & below
        live = live.join(lookup, deeper, "left")
        held = F.coalesce(below & (F.col("_p1") == F.col("c_k1")) & (F.col("_p2") == F.col("c_k2")), F.lit(False))
        itself = (F.col("k1") == F.col("c_k1")) & (F.col("k2") == F.col("c_k2"))
        live = store(live.select(*own, *comp, F.col("_k1").alias("n1"), F.col("_k2").alias("n2"), held.alias("held"), itself.alias("itself")), "parts")

        totals = live.where("held or itself").groupBy(*comp).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        upward = (F.col("c_conv_id") == F.col("_conv")) & F.col("_depth").between(F.col("_top"), F.col("c_depth"))
        path = centroid.join(totals, comp).join(lookup, upward)
        path = store(path.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "leaves", "saved", F.col("c_weight").alias("less")), "centroid-paths")
        done.append(path.drop("less"))
        inner = live.where("held").select(*own, F.col("n1").alias("c1"), F.col("n2").alias("c2"))
        outer = live.where("not held and not itself").join(path.select(*NAME, "less"), NAME, "left")
        outer = outer.withColumn("weight", F.col("weight") - F.coalesce("less", F.lit(0)))
        live = store(inner.unionByName(outer.select(*own, *comp)), "components")
    return reduce(DataFrame.union, done).groupBy(*NAME).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _end_prints(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): hash of the ascending ids, joined by commas.

    The ids of a node pass as a sorted stream; a task holds one batch and the hash.
    """
    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (k1, k2) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield _prints(out)
        if now is not None:
            yield _prints([(*now, state.hexdigest())])

    def _prints(rows):
        kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)

    dealt = ends.repartition(*NAME).sortWithinPartitions(*NAME, "conv_id").select(*NAME, "conv_id")
    return dealt.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, members: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per node.

    ``rows``: turns (conv_id, place, role, print, words), places gapless from 0; ``members``: every conversation with its
    length, also those of no turns, which end at the root. A node is named by its smallest member and its depth. Without
    members there is no root. Repeated rows of one conversation are turns like others.
    """
    paths = store(prefixes(rows, members), "prefixes")
    found = paths.groupBy(*NAME).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.sum("left").alias("weight"), F.min("words").alias("words"), F.min(F.when(F.col("left") == 1, 1)).alias("ends"),
    )
    found = store(found, "nodes")
    kids = store(found.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")), "children")
    nodes = found.join(kids, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = store(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "valued-nodes")
    totals = store(subtree_totals(nodes, paths, whole), "subtree-totals")

    inner = found.join(kids, NAME, "left_semi").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    smallest = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = smallest.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs")
    root = store(root, "root")
    parents = inner.unionByName(root.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    below = nodes.select(*NAME, "p1", "p2", "conv_id", "depth", "n_convs", "n_children").join(totals, NAME).join(small(parents), ["p1", "p2"])
    under = nodes.where("depth = 1").select(*NAME).join(totals, NAME).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole_tree = root.crossJoin(F.broadcast(under)).select(  # one row and one row
        *NAME, "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    )
    every = below.select(*whole_tree.columns).unionByName(whole_tree)
    ends = paths.where("left = 1").select(*NAME, "conv_id").unionByName(
        members.where("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    )
    out = every.join(_end_prints(ends), NAME, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, whole: int = WHOLE) -> DataFrame:
    """``trie`` of the conversations as ``rebuilt`` makes them.

    Rows without conv_id take no part; null turns come first; null role and text are empty; ties go by role and md5 of the
    text; further columns are ignored. An empty table gives an empty result.
    """
    rows, members = rebuilt(conversations)
    return trie(rows, members, whole)


#: DuckDB has no crc32, so it is written out, a bit at a time. Prefixes are named by the text of all their turns.
SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM t),
crc(conv_id, i, c) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM
    (SELECT conv_id, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1))::BIGINT) ELSE c END AS x
     FROM crc WHERE i < 8 * length(conv_id::VARCHAR))),
m AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h FROM crc WHERE i = 8 * length(conv_id::VARCHAR)),
g AS (SELECT m.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = m.base)) AS given FROM m),
r AS (
  SELECT g.conv_id, place - h + given AS place, role, text FROM g JOIN t ON t.conv_id = g.conv_id WHERE place >= h
  UNION ALL SELECT g.conv_id, place, role, text FROM g JOIN t ON t.conv_id = g.base WHERE place < h),
p AS (
  SELECT conv_id, place + 1 AS depth, text, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, ';') OVER (PARTITION BY conv_id ORDER BY place)) AS k,
    row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1 AS last FROM r
  UNION ALL SELECT conv_id, 0, '', '', NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = g.conv_id) FROM g),
n AS (
  SELECT k, depth, min(conv_id) AS rep, count(*) AS n_convs, min(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM p GROUP BY k, depth),
e AS (SELECT n.k, n.depth, n.rep, n.n_convs, n.words, n.ends, q.rep AS parent FROM n LEFT JOIN p ON p.conv_id = n.rep AND p.depth = n.depth - 1 LEFT JOIN n q ON q.k = p.k AND q.depth = p.depth),
kids AS (SELECT parent AS rep, depth - 1 AS depth, count(*) AS n FROM e WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT e.rep, e.depth, (e.n_convs - 1) * e.words AS saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf FROM e LEFT JOIN kids ON kids.rep = e.rep AND kids.depth = e.depth),
s AS (SELECT p.k, p.depth, sum(v.saved) AS saved, sum(v.leaf) AS leaves FROM v JOIN p ON p.conv_id = v.rep AND p.depth <= v.depth GROUP BY 1, 2)
SELECT e.rep AS conv_id, e.depth, e.parent AS parent_conv_id, e.n_convs, coalesce(kids.n, 0) AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN s ON s.k = e.k AND s.depth = e.depth LEFT JOIN kids ON kids.rep = e.rep AND kids.depth = e.depth
"""
