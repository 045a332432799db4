import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakewright.functions import chunking, html as hx, text as tx
from lakewright.operators import corpus as co
from lakewright.operators import index as ix
from lakewright.operators import qa_eval as qa
from lakewright.operators import search as se


def docs(spark, rows):
    return spark.createDataFrame(rows, "url string, source string, text string")


def test_second_run_changes_nothing(spark):
    empty = spark.createDataFrame([], "url string, sha256 string")
    incoming = docs(spark, [("u1", "s", "a" * 400), ("u2", "s", "b" * 400), ("u3", "s", "short")])
    first = co.upsert(incoming, empty, F.col("text"))
    assert {r.url: r.status for r in first.marked.collect()} == {"u1": "new", "u2": "new", "u3": "too_short"}
    state = co.next_state(empty, first.changes)
    second = co.upsert(incoming, state, F.col("text"))
    assert second.changes.count() == 0
    assert tuple(second.counters().first()) == ("s", 0, 2, 1)
    third = co.upsert(docs(spark, [("u1", "s", "c" * 400)]), state, F.col("text"))
    assert third.changes.first().status == "changed"
    after = co.next_state(state, third.changes)
    assert after.count() == 2


def test_cut_comes_before_hash_and_gate(spark):
    row = docs(spark, [("u", "s", "x" * 1500)]).select(co.cut(F.col("text"), 1000).alias("t")).first()
    assert row.t == "x" * 1000 + "\n\n[... documento truncado em 1,000 caracteres ...]"


def test_titles(spark):
    text = "blá **LEI** [Nº 14.300,] DE 6 DE JANEIRO DE 2022 resto"
    rows = [("L14300", text), ("Um título bem longo", text), ("L14300", "nada"), (None, "LEI Nº 9.427, DE 26 DE DEZEMBRO DE 1996"),
            ("x", "RESOLUÇÃO NORMATIVA Nº 5, DE 1º DE MARÇO DE 2020")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, x string").select(co.rescued_title(F.col("t"), F.col("x"))).collect()]
    assert got == ["LEI Nº 14.300, DE 6 DE JANEIRO DE 2022", "Um título bem longo", "L14300", "LEI Nº 9.427, DE 26 DE DEZEMBRO DE 1996",
                   "RESOLUÇÃO NORMATIVA Nº 5, DE 1º DE MARÇO DE 2020"]


def test_clean_text(spark):
    raw = "  Início da frase\nque continua  aqui\n\n\n\n- item\n# Título\nhttps://facebook.com/sharer?x\nCompartilhe: já\n| a |\n| b |\nfim "
    got = docs(spark, [("u", "s", raw)]).select(hx.clean_text(F.col("text"))).first()[0]
    assert "Início da frase que continua aqui\n\n- item\n# Título" in got
    assert "facebook" not in got and "Compartilhe" not in got and "| a |\n| b |" in got and "\n\n\n" not in got


def test_hidden_content_is_dropped():
    page = ("<html><head><title> T &amp; U </title><style>x</style></head><body><nav>menu</nav><div hidden>inject</div>"
            "<p aria-hidden='true'>no</p><div style='display:none'><article class='main'><h2>Head</h2><p>Um\n<b>dois</b></p><ul><li>a</li></ul>"
            "<script>bad()</script><!-- c -->z​w</article></div><p>outside</p></body></html>")
    title, text = hx.page_text(page, "article")
    assert title == "T & U"
    assert text == "## Head\n\nUm dois\n\n- a\n\nzw"
    assert hx.page_text(page, ".main")[1] == text and hx.page_text(page, "#absent")[1] == ""
    assert "inject" not in hx.page_text(page)[1] and "menu" not in hx.page_text(page)[1] and "outside" in hx.page_text(page)[1]


def test_charset_chain(spark):
    late = "x" * 5000 + '<meta charset="cp1252">'  # behind any prefix
    cases = [
        ("ação".encode("latin-1"), "text/html; charset=iso-8859-1", "ação"), ((late + "“x”").encode("cp1252"), None, late + "“x”"),
        ("“é”".encode("cp1252"), "text/html; charset=bogus", "“é”"), ("é".encode("cp1252"), None, "é"), ("é☂".encode(), None, "é☂"),
        ("é".encode(), "text/html; charset=UTF-8", "é"),
    ]
    df = spark.createDataFrame([(bytearray(b), t, w) for b, t, w in cases], "content binary, content_type string, wanted string")
    assert all(r.html == r.wanted for r in hx.decode_pages(df).collect())


def test_chunk_sizes():
    assert [len(c) for c in chunking.chunk_text("x" * 1600)] == [1500, 300]
    assert [len(c) for c in chunking.chunk_text("a" * 900 + "\n\n" + "b" * 900)] == [900, 1102]
    assert chunking.chunk_text("---\ntitulo: x\n---\n\ncorpo") == ["corpo"]
    assert chunking.chunk_text("só um bloco") == ["só um bloco"]
    assert chunking.chunk_text("# A\ntexto\n## B\noutro") == ["# A\ntexto\n\n## B\noutro"]
    assert chunking.chunk_text(" \n\n ") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=400), max_size=12), st.integers(0, 3))
def test_chunks_cover_every_word(pieces, k):
    text = "\n\n".join(pieces) + " word" * (k * 200)
    chunks = chunking.chunk_text(text)
    assert all(0 < len(c) <= chunking.LIMIT + chunking.OVERLAP + 2 for c in chunks)
    joined = " ".join(chunks)
    body = chunking.body_of(text)
    assert all(w in joined for w in body.split() if len(w) <= chunking.OVERLAP)


def test_bounded_crawl_equals_a_loop(spark):
    rnd = random.Random(2)
    edges = sorted({(f"n{rnd.randint(0, 40):02d}", f"n{rnd.randint(0, 40):02d}") for _ in range(120)})
    queued, frontier, depth = {"n00": 0, "n01": 0}, ["n00", "n01"], 0
    while frontier and len(queued) < 30:
        depth += 1
        found = sorted({d for s, d in edges if s in frontier} - set(queued))[: 30 - len(queued)]
        queued.update(dict.fromkeys(found, depth))
        frontier = found
    want = sorted(queued.items(), key=lambda x: (x[1], x[0]))[:10]
    e = spark.createDataFrame(edges, "src string, dst string")
    got = co.bounded_crawl(e, spark.createDataFrame([("n00",), ("n01",)], "url string"), max_pages=10)
    assert sorted([(r.url, r.depth) for r in got.collect()], key=lambda x: (x[1], x[0])) == want


def test_cosine_matches_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(30, 8)).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(30, [0.0] * 8), (31, None), (32, [1.0])]
    q = [float(x) for x in rnd.normal(size=8)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r.id: r.cosine for r in se.cosine(df, "v", q).collect()}
    want = m.astype("float64") @ np.array(q) / np.linalg.norm(m.astype("float64"), axis=1) / np.linalg.norm(q)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(30))
    assert got[30] == 0.0 and got[31] is None and got[32] is None
    plain = {r.id: r.c for r in df.filter("id < 31").select("id", se.cosine_column(F.col("v"), q).alias("c")).collect()}
    assert all(abs(plain[i] - got[i]) < 1e-9 for i in range(31))


def test_links_in_all_quoting_styles(spark):
    page = """<a href="x?a=1&amp;b=2">1</a><A class=k HREF='y'>2</a><a href=z>3</a><a data-href="no" href = "w">4</a><abbr href="no">"""
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(hx.hrefs(F.col("h"))).first()[0] == ["x?a=1&b=2", "y", "z", "w"]


def test_every_parent_step_is_resolved(spark):
    base = "http://h/a/b/c/d/e/f/g/h.html"
    df = spark.createDataFrame([("../../../../../x",), ("../" * 20 + "x",), ("./y/./z",), ("../i/",), ("k?q=/../1",), ("..",)], "h string")
    got = [r[0] for r in df.select(tx.resolve_url(F.lit(base), F.col("h"))).collect()]
    assert got == [
        "http://h/a/b/x", "http://h/x", "http://h/a/b/c/d/e/f/g/y/z", "http://h/a/b/c/d/e/f/i/", "http://h/a/b/c/d/e/f/g/k?q=/../1", "http://h/a/b/c/d/e/f/",
    ]


def test_arrivals_of_one_url_follow_their_sequence(spark):
    rows = [("u", 1, "a" * 400), ("u", 2, "b" * 400), ("u", 3, "short"), ("u", 4, "b" * 400), ("u", 5, "a" * 400), ("v", 6, "c" * 6000 + "1"), (None, 7, "d" * 400)]
    came = spark.createDataFrame(rows, "url string, seq int, text string").withColumn("source", F.lit("s"))
    state = spark.createDataFrame([("v", "x")], "url string, sha256 string")
    run = co.upsert(came, state, F.col("text"), order="seq")
    got = {r.seq: r.status for r in run.marked.collect()}
    assert got == {1: "new", 2: "changed", 3: "too_short", 4: "unchanged", 5: "changed", 6: "changed", 7: "new"}
    after = co.next_state(state, run.changes, order="seq")
    known = {r.url: r.sha256 for r in after.collect()}
    marked = {r.seq: r.sha256 for r in run.marked.collect()}
    assert known["u"] == marked[5] and known["v"] == marked[6] and len(known) == 3
    assert {r.seq for r in co.current_documents(run.changes, after).collect()} == {1, 5, 6, 7}


@pytest.mark.parametrize("attack", [
    "select * from parquet.`/etc`", "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'exit', '1')",
    "select * from nowhere", "select 1; drop table x", "select * from range(5)", "select * from csv.`/etc/passwd`",
])
def test_sql_runner_refuses(spark, attack):
    from pyspark.errors import PySparkException

    from lakewright.operators import catalog

    with pytest.raises((ValueError, PySparkException)):
        catalog.answer(spark, attack)


def test_sql_runner_answers_over_views(spark):
    from lakewright.operators import catalog

    spark.range(5).createOrReplaceTempView("some_rows")
    assert catalog.answer(spark, "with t as (select id from some_rows where id > 1) select max(id) as m from t") == (["m"], [(4,)], False)


def test_cap_per_document(spark):
    rows = [("hot", i, 1.0 - i / 1000) for i in range(50)] + [("x", 0, 0.5), ("y", 0, 0.4)]
    df = spark.createDataFrame(rows, "doc string, chunk int, score double")
    best = se.capped_top_k(df, "score", 8, "doc", ["doc", "chunk"])
    assert [(r.doc, r.chunk) for r in best.collect()] == [("hot", 0), ("hot", 1), ("hot", 2), ("x", 0), ("y", 0)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_index_replaces_only_its_source(spark, tmp_path):
    path = str(tmp_path / "index")
    ix.write_index(spark.createDataFrame([("a", 1), ("b", 1)], "source string, n int"), path)
    ix.write_index(spark.createDataFrame([("a", 2)], "source string, n int"), path)
    assert sorted((r.source, r.n) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]


def test_embedding_is_unit_and_stable(spark):
    df = spark.createDataFrame([(1, "energia solar"), (2, "ENERGIA Solár"), (3, "vento")], "id int, t string")
    got = {r.id: r.v for r in ix.hashing_embedder(64)(df, "t", "v").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[3]) - 1) < 1e-5


def test_small_talk_guard(spark):
    rows = [("conversa", "simples", "Olá, tudo bem?"), ("conversa", "simples", "Quantos veículos há no Rio?"),
            ("conversa", "simples", "oi " + "x " * 20), ("fora_escopo", "simples", "k"), ("dados", "complexa", "k"), ("documentos", "simples", "k"),
            ("dados", "simples", "k"), ("misto", "simples", "k")]
    df = spark.createDataFrame(rows, "r string, l string, m string")
    got = [x[0] for x in df.select(qa.profile(F.col("r"), F.col("l"), F.col("m"))).collect()]
    assert got == ["rapido", "dados", "dados", "dados", "raciocinio", "documentos", "dados", "raciocinio"]


def test_hybrid_score_over_a_stored_index(spark, tmp_path):
    from lakewright.functions.text import lexical_share, terms

    rows = [("a", "Lei 14.300", "Sistema de Compensação", [1.0, 0.0]), ("b", "Notícia", "vento forte", [1.0, 0.0]), ("c", "x", "y", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "source string, title string, text string, vector array<float>")
    ix.write_index(ix.searchable(chunks), str(tmp_path / "ix"))
    wanted = spark.range(1).select(terms(F.lit("O que a lei 14.300 diz sobre compensação?"))).first()[0]
    stored = spark.read.parquet(str(tmp_path / "ix"))
    scored = se.cosine(stored, "vector", [2.0, 0.0]).withColumn("score", se.hybrid_score(F.col("cosine"), F.col("norm"), wanted))
    got = {r.source: round(r.score, 6) for r in scored.collect()}
    assert got == {"a": 1.15, "b": 1.0, "c": 0.0}
    assert stored.select(lexical_share(F.col("norm"), [])).first()[0] == 0.0


@pytest.mark.parametrize("name", ["doc_chunks", "embed_default", "lexical_score"])
def test_texts_reach_python_in_small_batches(spark, tmp_path, name):
    from lakewright.plans import QUERIES

    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 5000).alias("text"), F.lit("src1").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")  # 25 MB of text, before in one batch
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")  # as Spark has it
    try:
        rows = QUERIES[name](spark, str(tmp_path)).count()

        def sizes(batches):
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        largest = spark.read.parquet(f"{tmp_path}/documents.parquet").select("text").coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    finally:
        spark.conf.set(key, before)
    assert rows >= 1000 and largest < 10_000_000
