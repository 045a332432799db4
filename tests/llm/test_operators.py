"""The other operators against brute force, round trips and held-out accuracy, with nulls, ties and odd texts."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from lakewright.llm import hash_forest, host_rules, packing, pieces, rule_ensemble, sharding, simple8b
from lakewright.llm.queries import vocabulary
from lakewright.llm.tokens import Encoder

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    None, "", " ", "\n", "a\n", "\na", "a  b", "a \n b", "x\t\ty", "é́ ½²　z", "it's 's 'll", "<|endoftext|> <s>", "🙂🙂 \x1c q", "▁ ▁▁x",
    "word " * 5000, "same text", "same text",
]


def _frame(spark, texts=ODD):
    rows = [(i * 3 % 1000, t, "s" if i % 2 else None, 7) for i, t in enumerate(texts)] + [(None, "no id", "s", 7), (3, texts[1] if len(texts) > 1 else "", "s", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, length int").repartition(3)


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary(BYTE_BPE))


def test_tokens_equal_the_library():
    r = random.Random(2)
    texts = [t for t in ODD if t] + ["".join(r.choice("ab '.,!1é \n\t ") for _ in range(r.randint(1, 60))) for _ in range(800)]
    ours, library = Encoder(vocabulary(BYTE_BPE)), _library()
    for got, text in zip(ours.encode(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_equal_the_library(spark):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("abcdething  \n\té▁0x<>中文字　\x00") for _ in range(r.randint(1, 60))) for _ in range(400)]
    model = vocabulary(PIECES, binary=True)
    library = pieces.Pieces.of(model).library
    found = sorted(map(tuple, pieces.digests(_frame(spark, texts), model).collect()), key=str)
    wanted = []
    for row in _frame(spark, texts).collect():
        ids = library.encode(row.text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((row.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    assert found == sorted(wanted, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 2**63, 3000, dtype=np.uint64) >> draw.integers(0, 64, 3000).astype(np.uint64)
    values[: 700 * (seed % 3)] = 0
    values[-4:] = [2**64 - 1, 2**60 - 1, 2**60 - 2, 2**60]
    words, escapes = simple8b.encode_block(values)
    assert (simple8b.decode_block(words, escapes, len(values)) == values).all() and len(escapes) >= 3
    assert simple8b.encode_block(values[:0])[0].size == 0
    data = simple8b.to_bytes(values, [(None, 1000), (5, 0), (6, 2000)])
    back, docs = simple8b.from_bytes(data)
    assert (back == values).all() and docs == [(None, 1000), (5, 0), (6, 2000)]


def test_id_files(spark):
    library = _library()
    docs = _frame(spark)
    found = simple8b.round_trip(docs, vocabulary(BYTE_BPE), end=2, file_ids=300).orderBy("start").collect()
    assert [r.start for r in found] == list(itertools.accumulate([0] + [r.n_tokens for r in found[:-1]]))
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted = []
    for row in docs.collect():
        own = np.array(library.encode(row.text or "", add_special_tokens=False).ids + [2], "<u4")
        wanted.append((row.doc_id, len(own), zlib.crc32(own.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(wanted, key=str)
    assert simple8b.round_trip(docs.limit(0), vocabulary(BYTE_BPE)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_fullest_combination(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
    items = [k for k, n in counts.items() for _ in range(n)]
    best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= 40 and max(counts) in c)
    found = packing.fullest(counts, 40)
    assert sum(k * n for k, n in found.items()) == best and all(n <= counts[k] for k, n in found.items()) and max(counts) in found


def test_packing(spark):
    docs, library = _frame(spark), _library()
    rows = packing.pack(docs, vocabulary(BYTE_BPE), room=64, end=0).collect()
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= 64 and (r.piece == 0 or r.length == 64)
    for places in of.values():
        assert [o for o, _ in sorted(places)] == list(itertools.accumulate([0] + [n for _, n in sorted(places)][:-1]))
        assert sum(n for _, n in places) <= 64
    total = sum(r.length for r in rows)
    assert len(of) <= -(-total // 64) + 1
    wanted = []
    for row in docs.collect():
        ids = np.array(library.encode(row.text or "", add_special_tokens=False).ids + [0], "<u4")
        lo, hi, k = 0, len(ids) % 64 or 64, 0
        while lo < len(ids):
            wanted.append((row.doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            lo, hi, k = hi, hi + 64, k + 1
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(wanted, key=str)
    assert packing.pack(docs.limit(0), vocabulary(BYTE_BPE)).collect() == []


def test_differencing_uses_every_shard_once():
    draw = np.random.default_rng(1)
    tuples = draw.integers(0, 1000, (200, 5))
    places = sharding.difference(tuples)
    assert (np.sort(places, axis=1) == np.arange(5)).all()
    sums = np.zeros(5, int)
    np.add.at(sums, places.ravel(), tuples.ravel())
    assert sums.max() - sums.min() <= 20


def test_sharding(spark):
    r = random.Random(4)
    texts = ODD + ["x" * r.randint(1, 400) + str(i) for i in range(300)]
    docs = _frame(spark, texts)
    rows = sharding.balanced(docs, shards=4).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    sums, slots = {}, {}
    for row in rows:
        sums[row.shard] = sums.get(row.shard, 0) + row["size"]
        slots.setdefault(row.shard, []).append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # one text has more than a shard's share: it stands nearly alone, and the other shards are equal
    largest = max(len((t or "").encode()) + 1 for t in texts)
    rest = sorted(sums.values())
    assert rest[-1] <= largest + 50 and rest[-2] - rest[0] <= 50
    assert all(len({r.shard for r in rows if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in rows})
    wanted = sorted((len((x.text or "").encode()) + 1, zlib.crc32((x.text or "").encode())) for x in docs.collect())
    assert sorted((x["size"], x.text_crc32) for x in rows) == wanted
    assert sharding.balanced(docs.limit(0)).collect() == []


def _near(rows, queries, k):
    out = {}
    for q, v in queries:
        best = sorted({(-float(np.dot(v, x)), i) for i, x in rows if i != q})[:k]
        out[q] = [i for _, i in best]
    return out


def test_forest_recall_and_edges(spark, monkeypatch):
    draw = np.random.default_rng(5)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(draw.standard_normal((1500, 16)) * draw.uniform(0.5, 2, (1500, 1)))]
    data += [(2000 + i, data[7][1]) for i in range(200)]  # one hot vector
    rows = data + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (None, data[0][1]), (3004, [1.0]), (5, data[5][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    vectors = hash_forest.usable(frame)
    monkeypatch.setattr(hash_forest, "BLOCK", 600)
    found = {}
    for r in hash_forest.nearest(vectors, vectors.where("id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    clean = {i: np.array(v) for i, v in data}
    asked = [(i, v) for i, v in clean.items() if i % 20 == 0]
    wanted = _near(list(clean.items()), asked, 20)
    assert set(found) == set(wanted)
    assert all([r["rank"] for r in rs] == list(range(1, 21)) for rs in found.values())
    assert all(abs(r.score - float(np.dot(clean[q], clean[r.vec_id]))) < 1e-9 and r.vec_id != q for q, rs in found.items() for r in rs)
    hit = sum(len({r.vec_id for r in found[q]} & set(wanted[q])) for q in wanted) / sum(map(len, wanted.values()))
    assert hit >= 0.9
    assert [r.vec_id for r in found[2000]] == wanted[2000]  # ties go to smaller ids
    assert hash_forest.nearest(vectors.limit(0), vectors.limit(0)).collect() == []


def test_forest_recall_on_given_rows(spark, data):
    frame = hash_forest.usable(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/embeddings.parquet"))
    rows = {r.id: np.array(r.v) for r in frame.collect()}
    wanted = _near(list(rows.items()), [(i, v) for i, v in rows.items() if i % 20 == 0], 20)
    found = hash_forest.nearest(frame, frame.where("id % 20 = 0")).collect()
    assert sum(r.vec_id in wanted[r.query_id] for r in found) >= 0.9 * 20 * len(wanted)


def test_rules_of_odd_texts(spark):
    texts = ODD + ["a b c d e f g h " * 6, "l one\n\nl one\nx | #"]
    rows = {(r.doc_id, r.text): r for r in host_rules.judged(_frame(spark, texts)).collect()}
    assert len(rows) >= len(set(texts))
    for (_, text), r in rows.items():
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)) and r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {i + k for i, x in enumerate(runs) if runs.count(x) > 1 for k in range(8)} if len(runs) < 2000 else set(range(len(words)))
        assert r.n_repeat_words == len(covered), repr(text)[:50]
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.kept and r.base_failed)
    assert rows[(45 + 9, "l one\n\nl one\nx | #")].n_dup_lines == 1
    kept = host_rules.keep_documents(_frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "source", "length"]
    assert host_rules.judged(_frame(spark).limit(0)).collect() == []


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = "word other thing " * 3 + " ".join(f"w{i}" for i in range(40)), "# | $ %"
    rows = [(i, good, f"h{i % 10}") for i in range(300)] + [(1000 + i, bad, "junk") for i in range(100)] + [(1100, good, "junk"), (1101, good, "tiny"), (1102, bad, "tiny")]
    found = {r.doc_id: r for r in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i].kept for i in range(300)) and not found[1100].kept and found[1101].kept and not found[1102].kept


def test_tree_rules():
    text = "x\n  If (feature 0 <= 1.5)\n   If (feature 1 > -2.0)\n    Predict: 1.0\n   Else (feature 1 <= -2.0)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    a, b = ("n", "<=", 1.5), ("m", ">", -2.0)
    assert rule_ensemble.tree_rules(text, ["n", "m"]) == {(a,), tuple(sorted([a, b])), tuple(sorted([a, ("m", "<=", -2.0)])), (("n", ">", 1.5),)}


def test_ensemble_held_out_accuracy(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra).withColumn("score", docs.doc_id * 0)
    rows = {r.doc_id: r for r in rule_ensemble.scored(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values()) and len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels.collect() if x.doc_id in rows and rows[x.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    none = rule_ensemble.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
