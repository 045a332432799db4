"""Approximate nearest neighbours by inner product with a forest of hash prefixes.

Rows are dealt to blocks of bounded size by a hash of their id. In each block every tree holds the block's distinct
vectors as a sorted array of long hash strings (signs of random orthogonal projections, first sign highest). A query
descends each tree by binary search to its longest matching prefixes, then all trees ascend together, one sign at a
time, until the ranges of all trees hold ``gather`` entries; these are scored on the original vectors in double
precision. Vectors get one more component that makes all lengths equal, so that a larger inner product is a smaller angle.

Nothing is fitted: projections come from a seed, every row is indexed, and equal vectors are one entry with their ids.
Queries meet every block, themselves in blocks; the best of each block are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192  #: vectors per block, on average
QUERIES = 4096  #: queries per block, on average
TREES = 24
SIGNS = 24
GATHER = 0.9  #: entries that all trees together gather per query and block, repeats counted, as a share of BLOCK


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector without nulls and non-finite numbers, not all zero."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _signs(tree: int, width: int) -> np.ndarray:
    """Projections of one tree: random, orthogonal to each other as far as there is room."""
    draw = np.random.default_rng([20_240_607, tree, width])
    parts = [np.linalg.qr(draw.standard_normal((width, width)))[0] for _ in range(-(-SIGNS // width))]
    return np.concatenate(parts, axis=1)[:, :SIGNS]


def _codes(x: np.ndarray, tree: int) -> np.ndarray:
    signs = x @ _signs(tree, x.shape[1]) >= 0
    return signs @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))


def search_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, longest: float, k: int, gather: float):
    """(query, id, score) of the best ``k`` found for each query among one block's rows other than its own id."""
    _, first, inverse = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    classes = x[first]
    members = np.lexsort((ids, inverse))
    border = np.searchsorted(inverse[members], np.arange(len(first) + 1))
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", classes, classes), 0))
    wide, asked = np.column_stack([classes, rest]), np.column_stack([q, np.zeros(len(q))])
    n, m = len(classes), len(q)
    depth = min(SIGNS, max(1, n.bit_length() + 2))
    lows, highs = (np.empty((TREES, depth + 1, m), np.int32) for _ in range(2))
    orders = []
    for t in range(TREES):
        codes, wanted = _codes(wide, t), _codes(asked, t)
        order = np.argsort(codes, kind="stable")
        orders.append(order.astype(np.int32))
        codes = codes[order]
        for level in range(depth + 1):
            shift = SIGNS - level
            top = (wanted >> shift) << shift
            lows[t, level] = np.searchsorted(codes, top, "left")
            highs[t, level] = np.searchsorted(codes, top + (1 << shift), "left")
    found = (highs - lows).sum(axis=0, dtype=np.int64)  # level, query
    enough = found >= min(gather, TREES * n)
    level = depth - np.argmax(enough[::-1], axis=0)  # the deepest that has enough; level 0 always has
    out_q, out_id, out_score = [], [], []
    seen = np.zeros(n, bool)
    for j in range(m):
        if level[j]:
            seen[:] = False
            for t in range(TREES):
                seen[orders[t][lows[t, level[j], j] : highs[t, level[j], j]]] = True
            at = np.flatnonzero(seen)
        else:
            at = np.arange(n)
        near = classes[at] @ q[j]
        if len(at) > k + 1:  # the query's own row may be one of them
            edge = np.partition(near, len(at) - k - 1)[len(at) - k - 1]
            at = at[near >= edge - 1e-9 * (1 + abs(edge))]
        score = (classes[at] * q[j]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
        own = [members[border[c] : min(border[c] + k + 1, border[c + 1])] for c in at]
        name = ids[np.concatenate(own)] if own else np.zeros(0, np.int64)
        score = np.repeat(score, [len(o) for o in own])
        other = name != q_ids[j]
        name, score = name[other], score[other]
        best = np.lexsort((name, -score))
        best = best[np.concatenate([[True], name[best][1:] != name[best][:-1]])] if len(best) else best
        best = best[:k]
        out_q.append(np.full(len(best), q_ids[j]))
        out_id.append(name[best])
        out_score.append(score[best])
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in ((out_q, np.int64), (out_id, np.int64), (out_score, float)))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = GATHER) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` found nearest to each row of ``queries``.

    Both are (id, v) as ``usable`` gives them. A row is no candidate for a query of its own id. Ties go to smaller ids.
    Vectors of different lengths never meet. Repeated rows of one id and vector count once.
    """
    vectors, queries = vectors.dropDuplicates(), queries.dropDuplicates(["id"])
    total, longest = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    asked = queries.count()
    parts, turns = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERIES))
    longest, gather = float(longest or 0.0) ** 0.5, share * BLOCK
    rows = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("width", F.size("v"))
    some = queries.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int"))
    some = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("width", F.size("v"))
    some = some.withColumn("part", F.col("part").cast("long"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = search_block(*_matrix(left), *_matrix(right), longest, k, gather)
        return pa.table([pa.array(c) for c in found], names)

    keys = ["part", "turn", "width"]
    found = rows.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
