import random

import pytest
from pyspark.sql import functions as F

from lakewright.operators import select as sel


def greedy(items, budget):
    total, kept = 0, []
    for i, size in items:
        if kept and total + size > budget:
            continue
        total += size
        kept.append(i)
    return kept


def run(spark, groups, budget, fold_rows):
    data = [(g, i, s) for g, items in groups.items() for i, s in items]
    df = spark.createDataFrame(data, "g string, i long, size long")
    out = sel.budget_greedy(df, ["g"], F.col("i"), F.floor(F.col("i") / 8), "size", budget, fold_rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append(r.i)
    return {g: sorted(v) for g, v in got.items()}


@pytest.mark.parametrize("fold_rows", [0, 3, 5000])
def test_greedy_budget_in_rounds_equals_the_loop(spark, fold_rows):
    rnd = random.Random(5)
    groups = {g: [(i, rnd.choice([1, 3, 8, 30, 70])) for i in range(n)] for g, n in (("hot", 60), ("small", 2), ("mid", 15))}
    groups["alone"] = [(0, 500), (1, 1), (2, 99)]
    groups["edge"] = [(0, 0), (1, 500), (2, 100)]
    want = {g: greedy(items, 100) for g, items in groups.items()}
    assert run(spark, groups, 100, fold_rows) == want


@pytest.mark.parametrize("fold_rows", [0, 5000])
def test_greedy_budget_with_ties(spark, fold_rows):
    """Tied order keys go by the other columns, in folds and in rounds alike."""
    df = spark.createDataFrame([("g", 1, 20, "a"), ("g", 1, 20, "b"), ("g", 1, 3, "c"), ("h", 2, 4, "x"), ("h", 2, 4, "x"), ("h", 2, 4, "x")], "g string, i long, size long, n string")
    out = sel.budget_greedy(df, ["g"], F.col("i"), F.lit(0), "size", 10, fold_rows)
    assert sorted((r.g, r["size"], r.n) for r in out.collect()) == [("g", 3, "c"), ("h", 4, "x"), ("h", 4, "x")]


def test_greedy_rounds_stay_logarithmic(spark, monkeypatch):
    """Sizes that leave a little less each time, and items that just fail to fit between them."""
    rounds = []
    real = sel.materialize
    monkeypatch.setattr(sel, "materialize", lambda df, label: (rounds.append(label), real(df, label))[1])
    budget, left, items = 1 << 10, 1 << 10, []
    while left > 1:
        items += [(len(items), left), (len(items) + 1, left // 2 + 1), (len(items) + 2, 1)]
        left //= 2
    items = [(i, s) for i, (_, s) in enumerate(items)]
    items = [(0, 1), *[(i + 1, s) for i, (_, s) in enumerate(items)], *[(100 + i, 1 + i % 7) for i in range(300)]]
    assert run(spark, {"g": items}, budget, 0) == {"g": greedy(items, budget)}
    assert rounds.count("greedy-round") <= 12


def test_budget_examples(spark):
    items = [(0, 500), (1, 600), (2, 300), (3, 100)]
    assert run(spark, {"g": items}, 900, 5000) == {"g": [0, 2, 3]}
    df = spark.createDataFrame([("g", i, s) for i, s in items], "g string, i long, size long")
    crossed = sel.budget_crossing(df, ["g"], [F.col("i")], F.floor(F.col("i") / 2), "size", 900)
    assert sorted(r["i"] for r in crossed.collect()) == [0, 1]


def test_formats_names_and_years(spark):
    df = spark.createDataFrame(
        [("", "https://x/y.parquet", "Dados PARQUET"), ("csv", "u", "n"), ("", "u/file.XLSX", "n"), ("", "u", "n")], "f string, u string, n string"
    )
    got = [r[0] for r in df.select(sel.detect_format(F.col("f"), F.col("u"), F.col("n"))).collect()]
    assert got == ["?", "csv", "xlsx", "?"]
    row = spark.createDataFrame([("Contrato  Agenté - 2020.csv", "pld_2019_2021")], "a string, b string").select(
        sel.table_name("siget", F.col("a")), sel.last_year_token(F.col("b")), sel.last_year_token(F.lit("none"))
    ).first()
    assert tuple(row) == ("siget_contrato_agente_2020", "2021", "0")


def test_routes(spark):
    urls = ["https://a.org/login", "https://a.org/x.pdf", "https://a.org/noticias/", "https://a.org/noticias/2024/k", "https://a.org/sobre"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    way = sel.route(F.col("u"), allow=["/noticias"], pdfs=[r"\.pdf$"])
    assert [r[0] for r in df.select(way).collect()] == ["skip", "pdf", "index", "follow", "none"]


def test_canonical_path(spark):
    from lakewright.operators import dedup

    data = [("dados/ons/a.csv", "h"), ("data/raw/ons/a.csv", "h"), ("x/b", None), ("outros/c", "k"), ("outros/cc", "k")]
    out = dedup.canonical_paths(spark.createDataFrame(data, "path string, sha256 string"))
    assert {r.path: r.canonical for r in out.collect()} == {
        "dados/ons/a.csv": "data/raw/ons/a.csv", "data/raw/ons/a.csv": "data/raw/ons/a.csv", "x/b": "x/b", "outros/c": "outros/c", "outros/cc": "outros/c",
    }


def test_longest_prefix(spark):
    from lakewright.operators import catalog as cat

    df = spark.createDataFrame([("analytics_corte_usina",), ("analytics_consumo_rj",), ("ons_cmo_x",)], "n string")
    themes = {"ons": "operacao", "ons_cmo": "precos", "analytics_corte": "restricao"}
    sources = {"ons": "ONS", "analytics": "Equipe (análises)"}
    got = [tuple(r) for r in df.select(cat.longest_prefix(F.col("n"), themes, cat.OTHER_THEME), cat.source_of(F.col("n"), sources)).collect()]
    assert got == [("restricao", "Equipe (análises)"), ("outros", "Equipe (análises)"), ("precos", "ONS")]


def test_hashes_only_where_sizes_repeat(spark, monkeypatch):
    from lakewright.operators import dedup

    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 2, "zz")], "k string, n int, t string")
    want = {"a", "b"}
    for bound in (1_000_000, 0):
        monkeypatch.setattr(dedup, "BROADCAST_SIZES", bound)
        out = dedup.hash_repeated(df, "n", F.col("t"))
        assert {r.k for r in out.collect() if r.sha256} == want and out.count() == 3
