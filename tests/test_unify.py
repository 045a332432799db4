import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.operators import schema as rules
from lakewright.operators import unify as un
from lakewright.sources import sinks

I, L, D, S, B, TS = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()


def test_names():
    assert rules.normal_name("Dat. Geração (MW)") == "dat_geracao_mw"
    assert rules.normal_name("Nº Processo") == "no_processo"
    assert rules.normal_name("%%") == "coluna"
    assert rules.looks_like_date("din_instante") and rules.looks_like_date("datprog") and not rules.looks_like_date("horas")
    assert rules.is_code("id_x") and rules.is_code("num_cnpj") and not rules.is_code("idade")


@pytest.mark.parametrize("name,types,probe,want", [
    ("val", [I, L], (5, 0, 0), L), ("val", [I, D], (5, 0, 0), D), ("val", [D, S], (5, 5, 0), D), ("val", [D, S], (5, 5, 1), S),
    ("cod_x", [S], (5, 5, 0), S), ("dat_x", [S], (5, 0, 5), TS), ("pld_media_dia", [S], (5, 5, 0), D), ("flg", [B, I], (5, 5, 5), S),
    ("note", [S], (0, 0, 0), S), ("t", [TS, S], (5, 0, 5), TS), ("flg", [B], (0, 0, 0), B),
])
def test_reconciliation(name, types, probe, want):
    assert rules.reconciled_type(name, types, *probe) == want


def test_convention_types():
    assert [rules.convention_type(n) for n in ("din_instante", "dat_programacao", "num_minutos_x", "val_y", "flg_z", "nom")] == [
        TS, T.DateType(), L, D, I, S,
    ]
    assert rules.fixed_time_column(["x", "dat_programacao", "din_instante"]) == "din_instante"


def test_name_collision_is_an_error(spark):
    with pytest.raises(ValueError):
        rules.normalize_columns(spark.createDataFrame([(1, 2)], "`Ação` int, acao int"))


def parts(spark):
    a = spark.createDataFrame([("001", 1, "1.234,5", "01/02/2024", ""), ("002", 2, "7", "1900-01-01", "")], "`Código` string, n int, val string, dat_x string, vazio string")
    b = spark.createDataFrame([(3, 2.5, "03", dt.datetime(2023, 5, 6), "x")], "n long, val double, `codigo` string, dat_x timestamp_ntz, extra string")
    return [a, b]


def test_unify_mixed_files(spark):
    u = un.unify(parts(spark))
    assert {k: t.simpleString() for k, t in u.types.items()} == {
        "codigo": "string", "n": "bigint", "val": "double", "dat_x": "date", "vazio": "string", "extra": "string",
    }
    got = sorted(tuple(r) for r in u.df.select("codigo", "n", "val", "dat_x", "extra").collect())
    assert got == [("001", 1, 1234.5, dt.date(2024, 2, 1), None), ("002", 2, 7.0, None, None), ("03", 3, 2.5, dt.date(2023, 5, 6), "x")]
    assert (u.time_column, u.rows, u.null_time_rows, u.files) == ("dat_x", 3, 1, 2)
    assert u.kept.count() + u.quarantine.count() == 3


def test_unify_of_any_split_is_the_table(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    pieces = [orders.filter(F.col("o_orderkey") % 3 == k) for k in range(3)]
    pieces[1] = pieces[1].select(*reversed(orders.columns))
    pieces[2] = pieces[2].withColumn("o_totalprice", F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy"))
    u = un.unify(pieces)
    want = orders.withColumn("o_orderdate", F.to_date("o_orderdate")).select(u.df.columns)
    assert u.df.exceptAll(want).count() == 0 and want.exceptAll(u.df).count() == 0


def test_write_by_year_prunes_and_keeps_quarantine(spark, tmp_path):
    u = un.unify(parts(spark))
    path = str(tmp_path / "t")
    assert sinks.write_unified(u, path, "year") == 3 == spark.read.parquet(path).count()
    back = spark.read.parquet(path).filter("ano = 2023")
    assert back.count() == 1 and u.quarantine.count() == 1
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan


def test_plain_write_and_rebuild(spark, tmp_path):
    u = un.unify(parts(spark))
    path = str(tmp_path / "p")
    for _ in range(2):
        assert sinks.write_unified(u, path, "plain") == 3
    assert spark.read.parquet(path).count() == 3
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 1


def test_signature_groups_bound_the_plan(spark):
    same = [spark.createDataFrame([(i, "a")], "a int, b string") for i in range(6)]
    assert len(un.merge_by_signature(same)) == 1


def test_declared_and_helpers(spark):
    df = spark.createDataFrame([(" x ", "1.234,5", "2024-01-02"), ("", "a", "2024")], "Nome string, VlrTE string, DatX string")
    got = [tuple(r) for r in un.declared(df, ["VlrTE"], ["DatX"]).collect()]
    assert got == [("x", 1234.5, dt.date(2024, 1, 2)), (None, None, None)]
    assert un.described(["a", "b"], {"a": "x", "c": "y"}) == {"a": "x", "b": ""}
    packed = un.packed_or_year(spark.createDataFrame([(1999,), (2001,)], "data int"), "data")
    assert packed.columns == ["ano"]
    untouched = un.packed_or_year(spark.createDataFrame([(5,), (2001,)], "data int"), "data")
    assert untouched.columns == ["data"]


def test_parquet_variants_and_catalogue(spark, tmp_path):
    from lakewright.operators import catalog as cat
    from lakewright.sources.files import read_parquet_variants

    for i, df in enumerate([spark.range(3), spark.range(4), spark.range(2).withColumn("x", F.lit("a"))]):
        df.write.parquet(str(tmp_path / f"f{i}"))
    variants = read_parquet_variants(spark, [str(tmp_path / f"f{i}") for i in range(3)])
    assert [v.count() for v in variants] == [7, 2]
    entries = cat.build([cat.entry(v, f"ons_cmo_{i}") for i, v in enumerate(variants)], {"ons_cmo": "precos"}, {}, manual={"ons_cmo_0": "m"}, generated={"ons_cmo_0": "g", "ons_cmo_1": "h"})
    sinks.write_catalog(entries, str(tmp_path / "catalog"))
    back = spark.read.json(str(tmp_path / "catalog"))
    assert sorted((r["name"], r.theme, r.row_count, r.description, len(r.columns)) for r in back.collect()) == [
        ("ons_cmo_0", "precos", 7, "m", 1), ("ons_cmo_1", "precos", 2, "h", 2),
    ]


def test_documents_and_report(spark, tmp_path):
    from lakewright.operators import forecast_eval as fe

    docs = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "doc_id string, text string")
    for _ in range(2):  # a second time adds nothing
        sinks.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2
    table = fe.markdown(spark.createDataFrame([("model", 1234.56, None)], "method string, mae double, r2 double"))
    assert table == "| method | mae | r2 |\n|---|---|---|\n| model | 1.234,6 | — |"
