"""Language identification: features against plain counts, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakewright.llm import language_id as L
from lakewright.llm import words as W


def _plain(text):
    counts = np.zeros(L.WIDTH)
    for word in "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in (text or "").lower()).split(" "):
        if not word:
            continue
        b = word.encode()
        for size in range(1, L.LONGEST + 1):
            padded = b" " + b + b" "
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if size == 1 and gram == b" ":
                    continue
                code = size
                for x in gram:
                    code = (code * 257 + x) % (1 << 64)
                counts[int(W.mix(np.array([code], np.uint64))[0] % np.uint64(L.WIDTH))] += 1
    return np.sqrt(counts / max(counts.sum(), 1))


def test_features_equal_plain_counts():
    texts = ["Der Hund, 42 Äpfel!", "", None, "a", "  ÉTÉ  à\nla", "x-y", "...", "ß"]
    assert np.allclose(L.features(pa.array(texts)), [_plain(t) for t in texts])
    one_by_one = [L.features(pa.array([t], pa.string()))[0] for t in texts]  # neighbours in a batch make no difference
    assert np.allclose(L.features(pa.array(texts)), one_by_one)


def _docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_held_out_accuracy(spark):
    docs = _docs(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.predicted(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang_pred != L.UNKNOWN]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


def test_the_label_is_no_input(spark):
    docs = _docs(spark, "/root/testdata/sf0.001")
    other = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'zz' else lang end as lang", "source as score")
    a, b = ({r.doc_id: r.lang_pred for r in L.predicted(d).collect()} for d in (docs, other))
    assert a == b and "zz" not in a.values()


def test_three_in_a_family_and_strangers(spark):
    words = {"de": "schön über", "en": "the think", "nl": "ijs zijn", "xx": "qqq wzz"}
    rows = [(i, f"{words[lang]} " * (1 + i % 3), lang) for i in range(160) for lang in [sorted(words)[i % 4]]]
    got = L.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == sorted(words)[r.doc_id % 4] for r in got)


@pytest.mark.parametrize("known", [True, False])
def test_odd_rows(spark, known):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "de"), (None, "the cat", "en"), (5, "the cat", None), (5, "the cat", None), (6, "wörter " * 100_000, None), (7, "слово", None)]
    if known:
        rows += [(100 + i, "the cat sat", "en") for i in range(8)]
    got = sorted(map(tuple, L.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id < 100 or doc_id is null").collect()), key=str)
    und = (L.UNKNOWN, 0.0)
    other = ("en", 1.0) if known else und
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    want = [(d, held(d), *(und if d in (1, 2, 3) else other)) for d in (1, 2, 3, None, 5, 5, 6, 7)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert L.predicted(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
