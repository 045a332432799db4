"""Exact Jaccard self-join of shingle sets by rarity-ordered prefixes: the parts that two operators share.

Sets are never compared all with all, and copies are never expanded into pairs. Two sets can only reach the threshold
if they share an element among the first ``n - ceil(t*n) + 1`` of each, under one global order of elements. Rare
elements come first, so a passage that a third of all texts share stands last and makes no candidates.

Rarity is counted over all elements of all texts in a table of fixed size (``BUCKETS``); elements that share a bucket
share a count, and their hash breaks the tie. Any fixed order keeps the join exact, so the table bounds what is
broadcast without a loss.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import words as W

BUCKETS = 1 << 17  #: entries of the table of element counts, whatever the corpus
_SHIFT = np.uint64(64 - 17)


def bucket(values: np.ndarray) -> np.ndarray:
    return (values >> _SHIFT).astype(np.int64)


def rarity(docs: DataFrame, size: int, cut=None) -> np.ndarray:
    """How often the shingles of each bucket occur in all texts of ``docs``; ``BUCKETS`` numbers.

    ``cut`` may turn the bytes and row offsets into finer offsets that shingles do not cross.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in W.slices(batch):
                data, offsets = W.text_bytes(part.column("text"))
                _, _, hashes, first = W.words(data, cut(data, offsets) if cut else offsets)
                total += np.bincount(bucket(W.shingles(hashes, first, size)[0]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["k", "n"])

    rows = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(BUCKETS, np.int64)
    table[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return table


def prefix(values: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest ``n - ceil(percent*n/100) + 1`` of a set of hashes, rarest first."""
    n = len(values)
    keep = n + (-percent * n) // 100 + 1 if n else 0
    return values[np.lexsort((values, counts[bucket(values)]))[:keep]]


def prefix_size(n: Column, percent: int) -> Column:
    """How many elements ``prefix`` takes of a set of ``n``."""
    return (n - F.ceil(percent * n / F.lit(100)) + 1).cast("int")


SKETCH = 512  #: bits of a set's sketch


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in ``SKETCH`` hash buckets, as signed 64-bit words.

    An element that only one of two sets has turns one bit, so sketches that differ in ``d`` bits belong to sets that
    differ in ``d`` elements or more.
    """
    at = (W.mix(values + np.uint64(SKETCH)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def alike(n: Column, m: Column, x: Column, y: Column, percent: int, words=range(SKETCH // 64)) -> Column:
    """Whether sets of these sizes and sketches may reach the threshold; false only where they surely do not."""
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in words), F.lit(0))
    return enough(n, m, F.shiftright(n + m - apart, 1), percent)


COUNTERS = 1024  #: counters of a set of more than SKETCH elements, whose parities say little
MOST = 255  #: where a counter stops


def counters(values: np.ndarray) -> bytes | None:
    """Numbers of elements in ``COUNTERS`` hash buckets, one byte each; None for sets of at most ``SKETCH``.

    An element that only one of two sets has moves one counter by one at most, so counters that are ``d`` apart belong to
    sets that differ in ``d`` elements or more.
    """
    if len(values) <= SKETCH:
        return None
    at = (W.mix(values + np.uint64(COUNTERS)) % np.uint64(COUNTERS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=COUNTERS), MOST).astype(np.uint8).tobytes()


def counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the counters of ``sets`` (id, n, counters) do not rule out; pairs of sets without them stay."""
    x = sets.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("counters").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("counters").alias("y"))

    def run(batches):
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int16) for c in "xy")
            apart = np.abs(one - other).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "abnm"), pa.array(apart)], ["a", "b", "n", "m", "apart"])

    both = pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "n", "m", "x", "y")
    whole = F.col("x").isNotNull() & F.col("y").isNotNull()
    near = both.where(whole).mapInArrow(run, "a long, b long, n long, m long, apart long")
    near = near.where(enough(F.col("n"), F.col("m"), F.shiftright(F.col("n") + F.col("m") - F.col("apart"), 1), percent))
    return near.select("a", "b").union(both.where(~whole).select("a", "b")).distinct()


NARROW = 128  #: bits of the sketch of every entry of a list; sets with more elements than that carry ``SKETCH`` bits behind


def flat_sketches(values: np.ndarray, border: np.ndarray) -> pa.Array:
    """For each of many sets, laid end to end, its narrow sketch and, where it is long, the whole one."""
    at = (W.mix(values + np.uint64(SKETCH)) % np.uint64(SKETCH)).astype(np.int64)
    sizes = np.diff(border)
    owner = np.repeat(np.arange(len(sizes)), sizes)

    def parities(at, owner, sets, bits):
        odd = np.bincount(owner * bits + at, minlength=sets * bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(sets, bits // 64)

    narrow, long = parities(at % NARROW, owner, len(sizes), NARROW), np.flatnonzero(sizes > NARROW)
    inside = (sizes > NARROW)[owner]
    wide = parities(at[inside], np.searchsorted(long, owner[inside]), len(long), SKETCH)
    counts = np.where(sizes > NARROW, (NARROW + SKETCH) // 64, NARROW // 64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    flat = np.empty(ends[-1], np.int64)
    for i in range(NARROW // 64):
        flat[ends[:-1] + i] = narrow[:, i]
    for i in range(SKETCH // 64):
        flat[ends[long] + NARROW // 64 + i] = wide[:, i]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def sketch_columns(sketches: pa.Array) -> list[pa.Array]:
    """``flat_sketches`` as plain columns, a narrow sketch's words, and a column of whole ones, null where there is none.

    Parquet and shuffles take plain columns at a fraction of the time of lists.
    """
    ends, flat, part = sketches.offsets.to_numpy(), sketches.values.to_numpy(), NARROW // 64
    rest = np.ones(len(flat), bool)
    for i in range(part):
        rest[ends[:-1] + i] = False
    sizes = np.diff(ends) - part
    whole = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return [*(pa.array(flat[ends[:-1] + i]) for i in range(part)), pa.ListArray.from_arrays(whole, pa.array(flat[rest]), mask=pa.array(sizes == 0))]


def flat_prefixes(values: np.ndarray, border: np.ndarray, counts: np.ndarray, percent: int) -> pa.Array:
    """``prefix`` of each of many sets, laid end to end."""
    sizes = np.diff(border)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ordered = values[np.lexsort((values, counts[bucket(values)], owner))]
    keep = sizes + (-percent * sizes) // 100 + 1
    ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
    inside = np.arange(len(values)) - border[owner] < keep[owner]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ordered[inside].view(np.int64)))


def distinct_sets(values: np.ndarray, owner: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``values`` by owner (ascending), each once, rarest first as ``prefix`` orders them, and their owners.

    A bucket is the top bits of a hash, so its rank in their place makes one number that sorts like (count, hash).
    """
    code = values
    if counts is not None:
        rank = np.empty(BUCKETS, np.uint64)
        rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
        code = (rank[bucket(values)] << _SHIFT) | (values & np.uint64((1 << int(_SHIFT)) - 1))
    order = None
    if len(owner) and owner[-1] < 1 << 20:  # one number for both: the owner and the top 44 bits
        key = (owner.astype(np.uint64) << np.uint64(44)) | (code >> np.uint64(20))
        order = np.argsort(key)
        key, code = key[order], code[order]
        if ((key[1:] == key[:-1]) & (code[1:] != code[:-1])).any():
            order, code = None, code[np.argsort(order)]
    if order is None:
        order = np.lexsort((code, owner))
        code = code[order]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def first_elements(values: np.ndarray, border: np.ndarray, percent: int) -> pa.Array:
    """``flat_prefixes`` of sets that are in order already."""
    sizes = np.diff(border)
    keep = sizes + (-percent * sizes) // 100 + 1
    ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
    inside = np.arange(len(values)) < np.repeat(border[:-1] + keep, sizes)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[inside].view(np.int64)))


_ODD = [(0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k) % (1 << 64) | 1 for k in range(1, 7)]


def likeness_keys(values: np.ndarray, border: np.ndarray) -> pa.Array:
    """Three numbers for each of many sets, laid end to end; each is the same for two sets with the chance of their squared
    similarity, because it holds the smallest elements by two hashes."""
    spread, three = W.mix(values + np.uint64(COUNTERS)), []
    for one, other in zip(_ODD[::2], _ODD[1::2]):
        x, y = (np.minimum.reduceat(spread * np.uint64(k), border[:-1]) if len(values) else spread for k in (one, other))
        three.append(W.mix(x ^ W.mix(y + np.uint64(one))))
    keys = np.stack(three, axis=1).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, 3, dtype=np.int32)), pa.array(keys.view(np.int64)))


def tokens(prefixes: pa.Array) -> pa.Array:
    """The ends of the hashes of ``first_elements``, 31 bits each; where two meet, a pair is a candidate more."""
    return pa.ListArray.from_arrays(prefixes.offsets, pa.array((prefixes.values.to_numpy() & 0x7FFFFFFF).astype(np.int32)))


def lists(column_values: list[np.ndarray]) -> pa.Array:
    """Arrays of hashes as an Arrow list column of signed numbers."""
    ends = np.concatenate([[0], np.cumsum([len(v) for v in column_values])]).astype(np.int32)
    flat = np.concatenate([*column_values, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def enough(n: Column, m: Column, common: Column, percent: int) -> Column:
    """percent/100 of the union or more is common, in whole numbers."""
    return 100 * common >= percent * (n + m - common)


def fits(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for two entries of one element's list (structs with n and pos)."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    length = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    return length & enough(n, m, F.least(n - i, m - j), percent)


def shared(entries: DataFrame) -> DataFrame:
    """Of ``entries`` (token, id, n, pos, members) those whose token stands for two sets or more.

    A set's entries are dealt out by token, so even sets that make up a third of all rows spread over as many tasks as
    their prefixes have tokens.
    """
    total = F.sum("members").over(Window.partitionBy("token"))
    return entries.withColumn("_total", total).where("_total > 1").drop("_total")


def listed(sets: DataFrame, words: range) -> DataFrame:
    """Entries of ``sets`` (id, n, past, prefix and the words s0, s1 ... of sketches): token, rest (elements from here on), past and sketch words.

    The words are plain columns: array access makes a join condition too long for the JVM to compile. Prefixes are ``tokens``.
    """
    one = sets.select("id", F.col("n").cast("int").alias("n"), "past", *[f"s{i}" for i in words], F.posexplode("prefix").alias("pos", "token"))
    return one.withColumn("rest", (F.col("n") - F.col("pos")).cast("int")).drop("pos")


def near(x: str, y: str, words: range, percent: int, rest: str = "rest") -> Column:
    """Length and positional filter and sketches, for the entries ``x`` and ``y`` of one list of ``listed``; ``rest`` is
    the column with the most that a set can have in common."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(1, len(words))), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    common = F.least(F.col(f"{x}.{rest}"), F.col(f"{y}.{rest}"), F.shiftright(both - apart, 1))
    return (100 + percent) * common >= percent * both


def level(n: Column, percent: int) -> Column:
    """Number of a size's class; similar sets are of one class or of two that are next to each other."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent))).cast("int")


def met(entries: DataFrame, words: range, percent: int) -> DataFrame:
    """(a, b): entries of ``listed`` of one token that pass ``near``, a < b; those that are ``past`` do not meet each other.

    The smaller set ``x`` of a similar pair looks for the larger. With ``rest`` elements from the first common one on, it
    can only be like sets of at most ``most`` elements, so the end of its prefix meets none, and the others stand in the
    size classes up to there; ``y`` stands in its own. Odd keys hold what past entries meet. Classes are made behind one exchange
    by token that both sides share, and a list is a hash table of its entries, so nothing is sorted.
    """
    rest, n = F.col("rest"), F.col("n")
    most = (F.floor((100 + percent) * rest / F.lit(percent)) - n).cast("int")
    odd = F.col("past").cast("int")
    keys = F.sequence(2 * level(n, percent) + odd, 2 * level(F.greatest(most, n), percent) + odd, F.lit(2))
    entries = entries.repartition("token")
    x = entries.select("*", F.explode(F.when(most >= n, keys)).alias("key")).alias("x")
    own = 2 * level(n, percent)
    y = entries.select("*", F.explode(F.when(F.col("past"), F.array(own)).otherwise(F.array(own, own + 1))).alias("key")).alias("y")
    before = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    both = x.hint("shuffle_hash").join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.key") == F.col("y.key")) & before & near("x", "y", words, percent))
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def hubs(entries: DataFrame) -> DataFrame:
    """(token, hub): for every list of ``shared`` entries its hub, a struct (id, n, pos).

    The hub is the entry whose prefix has the largest share of such tokens, so the text that others were copied from
    comes before its altered copies.
    """
    common = entries.groupBy(F.col("id").alias("_id")).agg((F.count("*") / F.max("plen")).alias("share"))
    e = entries.join(common, F.col("id") == F.col("_id"))
    first = e.groupBy("token").agg(F.min(F.struct((-F.col("share")).alias("o"), "id", "n", "pos")).alias("hub"))
    return first.select("token", F.struct("hub.id", "hub.n", "hub.pos").alias("hub"))


def hub_pairs(entries: DataFrame, hub: DataFrame, percent: int) -> DataFrame:
    """(a, b): the hub of every list against the others that pass the filters; at most as many as there are entries."""
    both = entries.withColumn("own", F.struct("id", "n", "pos")).join(hub, "token")
    return both.where((F.col("hub.id") != F.col("id")) & fits("hub", "own", percent)).select(
        F.col("hub.id").alias("a"), F.col("id").alias("b")
    ).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets (id, items) reach the threshold; ``sets`` has the ids of the pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(enough(F.size("x"), F.size("y"), common, percent)).select("a", "b").distinct()
