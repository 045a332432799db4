"""What the queries and stages ask of the operators: lines and passages that an earlier cut had left out."""

import corpus_pipeline
from lakewright.llm import line_dedup
from lakewright.llm.queries import QUERIES
from test_joins import WORD, _frame, _lines, _sentences, _set, _similar


def _table(spark, rows, tmp_path):
    _frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_short_lines_go_too(spark, tmp_path):
    rows = [(1, "Home\nShare this page\na b c d e"), (2, "home\nshare  this page\nother"), (3, "\nHome\n \nOTHER")]
    wanted = {1: rows[0][1], 2: "other", 3: "\n "}
    found = QUERIES["op3_line_dedup"](spark, _table(spark, rows, tmp_path)).collect()
    assert {r.doc_id: r.text for r in found} == wanted
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 2, 3: 2}
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    assert {r.doc_id: r.text for r in stage(spark, _frame(spark, rows), None).collect()} == wanted


def test_lines_with_one_changed_word_go(spark, tmp_path):
    line = " ".join(f"w{i}" for i in range(20))
    rows = _lines() + [(970, line), (971, "start\n" + line.replace("w10", "other") + "\nw1 w2 w3 w4"), (972, "w4 w3 w2 w1 w5")]
    found = {r.doc_id: r.text for r in QUERIES["op3_line_dedup"](spark, _table(spark, rows, tmp_path)).collect()}
    lines = [(i, k, x) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[:2])
    sets = [_set(x, 1) for *_, x in lines]
    gone = {lines[a][:2] for a in range(len(lines)) for b in range(a) if _similar(sets[a], sets[b], 80)}
    assert {(971, 1), (972, 0)} <= gone and (971, 2) not in gone
    for i, t in rows:
        kept = t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert found[i] == kept, i


def test_flat_sketches_and_prefixes():
    import numpy as np

    from lakewright.llm import setjoin

    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 3, 128, 129, 700, 20)]
    border, counts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), r.integers(0, 9, setjoin.BUCKETS)
    found = setjoin.flat_sketches(np.concatenate(sets), border).to_pylist()
    prefixes = setjoin.flat_prefixes(np.concatenate(sets), border, counts, 80).to_pylist()
    for s, got, prefix in zip(sets, found, prefixes):
        whole = setjoin.sketch(s)
        assert got[:2] == np.bitwise_xor.reduce(whole.reshape(-1, 2), axis=0).tolist()
        assert got[2:] == (whole.tolist() if len(s) > 128 else [])
        assert prefix == setjoin.prefix(s, counts, 80).view(np.int64).tolist()


def _all_runs(rows):
    """Sentences that any run of 2 or more sentences and 20 or more words repeats from an earlier place."""
    first, places = {}, []
    for i, t in sorted(rows):
        s = [tuple(w) for _, w in _sentences(t)]
        for a in range(len(s)):
            for b in range(a + 2, len(s) + 1):
                if sum(map(len, s[a:b])) >= 20:
                    places.append((first.setdefault(tuple(s[a:b]), (i, a)), i, a, b))
    return {(i, k) for at, i, a, b in places if at != (i, a) for k in range(a, b)}


def test_passages_go_whole(spark, tmp_path):
    import random

    r = random.Random(11)
    say = lambda k: " ".join("".join(r.choice(WORD) for _ in range(5)) for _ in range(k)) + "."
    rows = [(1, " ".join(tail := [say(19), say(6), say(6)])), (2, " ".join([say(9), *tail, say(7)])), (3, " ".join([say(4), say(9)]))]
    shared = [[say(r.choice([1, 2, 5, 9, 19])) for _ in range(r.randint(2, 9))] for _ in range(6)]
    for i in range(4, 30):
        parts = [say(r.choice([1, 3, 8, 14])) for _ in range(r.randint(1, 6))]
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(parts))
            parts[k:k] = r.choice(shared)
        rows.append((i, " ".join(parts)))
    gone = _all_runs(rows)
    assert {k for i, k in gone if i == 2} == {1, 2, 3} and len(gone) > 40
    folder = _table(spark, rows, tmp_path)
    found = {x.doc_id: x for x in QUERIES["op5_span_dedup"](spark, folder).collect()}
    stage = dict(corpus_pipeline.STAGES)["substring dedup"]
    staged = {x.doc_id: x.text for x in stage(spark, _frame(spark, rows), None).collect()}
    for i, t in rows:
        s = _sentences(t)
        edge = [at for at, _ in s] + [len(t)]
        kept = "".join(t[edge[k] : edge[k + 1]] for k in range(len(s)) if (i, k) not in gone)
        assert found[i].text == staged[i] == kept and found[i].n_removed == sum(x[0] == i for x in gone), i


def test_passages_without_stops_are_cut_alike(spark, tmp_path):
    import random

    r = random.Random(13)
    text = lambda k: [f"{r.choice(WORD)}{r.randrange(900)}" for _ in range(k)]
    passage, again = text(500), ["la", "li", "lu"] * 100
    rows = [(i, " ".join(text(k) + passage + text(60))) for i, k in enumerate((3, 7, 0, 11, 100, 259))]
    rows += [(10, " ".join(text(30) + again)), (11, " ".join(text(44) + again)), (12, " ".join(text(400)))]
    found = {x.doc_id: x.text.split() for x in QUERIES["op5_span_dedup"](spark, _table(spark, rows, tmp_path)).collect()}
    assert " ".join(found[0]) == rows[0][1] and " ".join(found[12]) == rows[-1][1]
    for i in range(1, 6):
        words = rows[i][1].split()
        lo = len(words) - 560
        assert len(found[i]) < len(words) - 380
        assert found[i][:lo] == words[:lo] and found[i][-60:] == words[-60:]
    assert len(found[11]) < 120


def test_sets_are_distinct_and_in_order():
    import numpy as np

    from lakewright.llm import setjoin

    r = np.random.default_rng(5)
    pool, counts = r.integers(0, 2**64, 300, dtype=np.uint64), r.integers(0, 4, setjoin.BUCKETS)
    pool[:4] = [7 << 40, (7 << 40) + 1, (7 << 40) + 2, (7 << 40) + 1]  # alike in their top bits
    for shift in (0, 1 << 20):  # so many owners that their number and a hash are not one key
        owner = np.sort(r.integers(0, 40, 4000)) + shift
        values = r.choice(pool, 4000)
        for table in (counts, None):
            found, of = setjoin.distinct_sets(values, owner, table)
            for i in np.unique(owner):
                own = np.unique(values[owner == i])
                wanted = own if table is None else own[np.lexsort((own, table[setjoin.bucket(own)]))]
                assert found[of == i].tolist() == wanted.tolist()
    border = np.array([0, 3, 6, 10])
    keys = setjoin.likeness_keys(np.concatenate([pool[10:13], pool[[12, 10, 11]], pool[20:24]]), border).to_pylist()
    assert keys[0] == keys[1] != keys[2] and len(keys[2]) == 3
    assert setjoin.likeness_keys(pool[:0], np.zeros(1, int)).to_pylist() == []


def test_lines_of_unlike_texts_under_one_id(spark):
    """Each text's lines are held against others by their own sets, not by those of another row at the same place."""
    say = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = []
    for k in range(30):
        rows += [(k, say(2 * k, 20)), (k, say(2 * k + 1, 20)), (100 + k, f"{say(2 * k, 20)} more\n{say(2 * k + 1, 20)} more")]
    found = line_dedup.dedup_lines(_frame(spark, rows), size=1, least=1, counts=True).collect()
    assert all(r.n_removed == (2 if r.doc_id >= 100 else 0) for r in found) and len(found) == 90
