"""The pipeline's stages: columns, order, and what goes and stays."""

import corpus_pipeline as pipeline


def test_stages(spark, data):
    words = lambda k, n=40: " ".join(f"{k}w{i}" for i in range(n))
    junk = "### " * 30
    passage = ". ".join(words(f"p{i}", 12).capitalize() for i in range(6)) + ". "
    near = words("n", 400)
    rows = [
        (1, words("a"), "x"), (2, words("a"), "x"), (3, junk, "x"), (4, None, "x"), (5, near, None), (6, near.replace("nw200", "other"), None),
        (7, words("b") + ". " + passage + words("c"), "x"), (8, words("d") + ". " + passage + words("e"), "x"), (1, words("a"), "x"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, source string, n_chars long, _doc string")
    kept = docs
    seen = {}
    for name, stage in pipeline.STAGES:
        before = kept
        kept = stage(spark, kept, data)
        seen[name] = kept.collect()
        if name != "best-fit packing":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(seen[name], before.schema)
    ids = lambda name: sorted({r.doc_id for r in seen[name]})
    assert ids("quality rules") == [1, 2, 5, 6, 7, 8]
    lines = {r.doc_id: r.text for r in seen["line dedup"]}
    assert lines[1] == words("a") and lines[2] == "" and lines[7] == rows[6][1]
    assert [r.doc_id for r in seen["n-gram Jaccard join"]].count(1) == 1
    passages = {r.doc_id: r for r in seen["substring dedup"]}
    assert passages[7].text == rows[6][1] and "P3w5" not in passages[8].text and words("d").split()[0] in passages[8].text
    assert passages[8].n_chars == len(passages[8].text)
    assert {r.doc_id for r in seen["best-fit packing"]} == set(passages)


def test_run(spark, data):
    rows = pipeline.run(spark, data).collect()
    assert rows and all(0 < r.length <= 2048 for r in rows)
    assert sum(r.length for r in rows) > 2048 * (len({r.sequence_id for r in rows}) - 2)


def test_no_text_is_lost_among_equal_ids(spark):
    a, b, c = (" ".join(f"{name}{i}" for i in range(30)) for name in "abc")
    rows = [(1, a), (1, b), (2, b), (3, c), (1, a), (None, c), (4, None)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (1, b), (3, c), (None, c), (4, None)], key=str)
