"""Set joins, line and passage removal against brute force."""

import math

import pytest

from lakewright.llm import line_dedup, ngram_join, span_dedup

WORD = "abcdefghijklmnopqrstuvwxyz"


def _words(text):
    out, word = [], ""
    for c in text.translate({65 + i: 97 + i for i in range(26)}):
        if c in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def _set(text, size):
    w = _words(text or "")
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _similar(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def _texts(seed=3, n=60):
    import random

    r = random.Random(seed)
    text = lambda k: " ".join("".join(r.choice(WORD) for _ in range(r.randint(1, 6))) for _ in range(k))
    base = [text(r.randint(60, 160)) for _ in range(8)]
    passage = text(40)
    out = []
    for i in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = text(1)
        if r.random() < 0.3:
            w += passage.split(" ")
        if r.random() < 0.2:
            w = w[: r.randint(1, len(w))]
        out.append(" ".join(w).upper() if r.random() < 0.1 else " ".join(w))
    return out


EDGES = [(901, None), (902, ""), (903, " \n\t"), (904, "one"), (905, "one"), (906, "One  two"), (907, "one two"), (None, "one two"), (908, "x " * 30_000)]


def _frame(spark, rows):
    data = [(i, t, "clash", 1) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, n string, component_id int").repartition(3)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, size, percent):
    rows = list(enumerate(_texts())) + EDGES + [(3, _texts()[3])]  # one row twice
    found = [tuple(r) for r in ngram_join.linked_documents(_frame(spark, rows), size, percent).collect()]
    sets = {i: _set(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and _similar(sets[a], sets[b], percent):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    wanted = [(i, len(_set(t, size)), None if i is None else top(i)) for i, t in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(found, key=key) == sorted(wanted, key=key)
    assert len({r[2] for r in found}) < len(rows) - 20


def _lines():
    texts = [t.split(" ") for t in _texts(5, 40)]
    docs = ["\n".join(" ".join(w[i : i + 17]) for i in range(0, len(w), 17)) for w in texts]
    return list(enumerate(docs)) + [(i, t) for i, t in EDGES] + [(950, "a b c d e\n\na b c d e\nshort\nshort\n")]


def test_line_dedup(spark):
    rows = _lines()
    found = {r.doc_id: r for r in line_dedup.dedup_lines(_frame(spark, rows), counts=True).collect()}
    lines = [(i, k, x) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for a in range(len(lines)):
        for b in range(a):
            if all(len(_words(lines[x][2])) >= 5 for x in (a, b)) and _similar(_set(lines[a][2], 5), _set(lines[b][2], 5), 80):
                gone.add(lines[a][:2])
    assert gone and len(found) == len(rows)
    for i, t in rows:
        if i is None or t is None:
            assert found[i].text == t and found[i].n_removed == 0
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        assert found[i].text == "\n".join(kept) and found[i].n_removed == len(t.split("\n")) - len(kept)
        assert found[i].n == "clash"


def _sentences(text):
    """(start, end, words) of pieces, by a plain scan."""
    cuts = [0] + [i for i in range(1, len(text)) if text[i - 1] == "\n" or (i > 1 and text[i - 1] in " \t\n\v\f\r" and text[i - 2] in ".!?")]
    out = []
    for lo, hi in zip(cuts, cuts[1:] + [len(text)]):
        at, word = [], None
        for i in range(lo, hi):
            space = text[i] in " \t\n\v\f\r"
            if not space and word is None:
                word = i
                at.append(i)
            elif space:
                word = None
        for k in range(0, len(at), 20):
            out.append((at[k], _words(text[lo:hi])[k : k + 20]))
    return out


def test_span_dedup(spark):
    import random

    r = random.Random(9)
    say = lambda: " ".join("".join(r.choice(WORD) for _ in range(4)) for _ in range(r.choice([1, 3, 8, 12, 30]))).capitalize() + r.choice(". ! ? \n".split(" "))
    shared = [[say() for _ in range(6)] for _ in range(3)]
    rows = []
    for i in range(30):
        parts = [say() for _ in range(r.randint(1, 8))]
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, len(parts))
            parts[k:k] = r.choice(shared)
        rows.append((i, " ".join(parts)))
    rows += EDGES + [(960, rows[2][1])]
    first, spans = {}, []
    for i, t in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
        s = _sentences(t)
        for a in range(len(s)):
            b = a + 2
            while b <= len(s) and sum(len(x[1]) for x in s[a:b]) < 20:
                b += 1
            if b <= len(s):
                run = tuple(w for x in s[a:b] for w in x[1])
                spans.append((run, i, a, b))
                first.setdefault(run, (i, a))
    gone = {(i, k) for run, i, a, b in spans if first[run] != (i, a) for k in range(a, b)}
    found = {x.doc_id: x for x in span_dedup.dedup_spans(_frame(spark, rows), counts=True).collect()}
    assert gone and len(found) == len(rows)
    for i, t in rows:
        if i is None or t is None:
            assert found[i].text == t
            continue
        s = _sentences(t)
        text, lo = "", 0
        for k, (at, _) in enumerate(s):
            end = s[k + 1][0] if k + 1 < len(s) else len(t)
            text += t[lo:at] + ("" if (i, k) in gone else t[at:end])
            lo = end
        text += t[lo:]
        assert found[i].text == text, i
        assert found[i].n_removed == sum(x[0] == i for x in gone)


@pytest.mark.parametrize("work", [
    lambda d: ngram_join.linked_documents(d), lambda d: line_dedup.dedup_lines(d, counts=True), lambda d: span_dedup.dedup_spans(d, counts=True)
])
def test_empty_table(spark, work):
    assert work(_frame(spark, []).limit(0)).collect() == []


def test_sketch_never_rules_out_a_link(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from lakewright.llm import setjoin

    r, rows = random.Random(5), []
    for _ in range(300):
        n = r.choice([1, 2, 7, 40, 200, 900])
        a = [r.getrandbits(64) for _ in range(n)]
        b = a[r.randint(0, max(1, n // 4)) :] + [r.getrandbits(64) for _ in range(r.randint(0, n // 8))]
        common, both = len(set(a) & set(b)), len(set(a) | set(b))
        rows.append((len(a), len(b), *[setjoin.sketch(np.array(s, np.uint64)).tolist() for s in (a, b)], 100 * common >= 80 * both))
    rows.append((200, 200, *[setjoin.sketch(np.array([r.getrandbits(64) for _ in range(200)], np.uint64)).tolist() for _ in "ab"], False))
    df = spark.createDataFrame(rows, "n int, m int, x array<long>, y array<long>, linked boolean")
    found = df.select("linked", setjoin.alike(F.col("n"), F.col("m"), F.col("x"), F.col("y"), 80).alias("alike")).collect()
    assert all(f["alike"] for f in found if f["linked"]) and sum(f["linked"] for f in found) > 50
    assert not found[-1]["alike"]  # unrelated sets are told apart


def test_prefix_length():
    import numpy as np

    from lakewright.llm import setjoin

    for n in range(1, 60):
        values = np.arange(n, dtype=np.uint64) << np.uint64(40)
        for percent in (80, 85):
            assert len(setjoin.prefix(values, np.zeros(setjoin.BUCKETS, int), percent)) == n - math.ceil(percent * n / 100) + 1


def test_stored_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from lakewright.llm import common

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 5_003).alias("k")).agg(F.collect_list("id").alias("x"))
    at = disk.getAllFiles().mkString().count("shuffle_")
    kept = common.small(common.store(rows, "kept").join(common.small(rows), "k"))
    assert disk.getAllFiles().mkString().count("shuffle_") <= at  # before, until the driver collected its garbage
    assert kept.count() == 5_003 and spark.conf.get(key) == before


def test_counters_never_rule_out_a_link(spark):
    import random

    import numpy as np

    from lakewright.llm import setjoin

    r, sets, pairs, linked = random.Random(6), [], [], set()
    for i in range(120):
        n = r.choice([400, 600, 3000, 9000])
        a = [r.getrandbits(64) for _ in range(n)]
        b = a[r.randint(0, n // 6) :] + [r.getrandbits(64) for _ in range(r.randint(0, n // 10))]
        sets += [(2 * i, a), (2 * i + 1, b)]
        pairs.append((2 * i, 2 * i + 1))
        if _similar(set(a), set(b), 85):
            linked.add(pairs[-1])
    strange = [(0, b) for b in range(3, 240, 2) if len(sets[0][1]) > 512 and len(sets[b][1]) > 512] + [(2 * i, 2 * i + 2) for i in range(100)]
    rows = spark.createDataFrame([(i, len(s), setjoin.counters(np.array(s, np.uint64))) for i, s in sets], "id long, n long, counters binary")
    ask = spark.createDataFrame(pairs + strange, "a long, b long")
    found = {tuple(x) for x in setjoin.counted(ask, rows.where("counters is not null"), 85).collect()}
    assert linked <= found and len(linked) > 30
    long = {i for i, s in sets if len(s) > 512}
    assert not any(x in found for x in strange if long.issuperset(x))  # parities of so many elements say nothing
    assert all(x in found for x in strange if not long.issuperset(x))


def test_met_entries_lose_no_similar_sets(spark):
    import itertools

    import numpy as np

    from lakewright.llm import common, setjoin

    random = np.random.default_rng(11)
    pool = random.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [pool[np.sort(random.choice(60, random.integers(5, 50), replace=False))] for _ in range(40)]
    for s in list(sets):  # similar ones, up to the largest size that a set can be like
        more = np.setdiff1d(pool, s)
        sets += [s[1:], np.concatenate([s, more[: len(s) // 4]]), np.concatenate([s[1:], more[:1]])]
    counts = np.zeros(setjoin.BUCKETS, np.int64)
    sets = [s[np.lexsort((s, counts[setjoin.bucket(s)]))] for s in sets]
    border = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    values = np.concatenate(sets)
    prefixes = setjoin.tokens(setjoin.first_elements(values, border, 80)).to_pylist()
    sketches = [c.to_pylist() for c in setjoin.sketch_columns(setjoin.flat_sketches(values, border))]
    assert sketches[2] == [None] * len(sets)
    rows = [(i, len(s), i % 3 == 0, prefixes[i], sketches[0][i], sketches[1][i]) for i, s in enumerate(sets)]
    rows = spark.createDataFrame(rows, "id long, n int, past boolean, prefix array<int>, s0 long, s1 long")
    met = setjoin.met(setjoin.listed(rows, range(2)), range(2), 80)
    with common.by_some_keys(spark):
        plan = met._jdf.queryExecution().executedPlan().toString()
        found = {(r.a, r.b) for r in met.collect()}
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    words = [set(s.tolist()) for s in sets]
    similar = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(words[a] & words[b]) >= 80 * len(words[a] | words[b])}
    assert len(similar) > 100
    assert {(a, b) for a, b in similar if a % 3 or b % 3} <= found
    assert all(a % 3 or b % 3 for a, b in found)  # lines that are gone do not meet each other


def test_tables_known_to_be_small_are_not_counted(spark):
    from lakewright.llm import common

    def never(_):
        raise AssertionError("counted")

    rows = spark.range(10)
    rows.count = lambda: never(rows)
    assert common.small(rows, most=10) is not None
    assert common.small(spark.range(10), rows=5, most=10).count() == 10
    with pytest.raises(AssertionError, match="counted"):
        common.small(rows, rows=5, most=10)
