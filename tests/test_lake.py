import datetime as dt

from pyspark.sql import functions as F

from lakewright.operators import lake
from lakewright.sources.footers import footers


def _lake(spark, root):
    t = dt.datetime
    a = spark.createDataFrame([(1, t(2024, 1, 5), 2024), (2, t(2024, 3, 1, 12), 2024), (3, None, 2025)], "ID long, ts timestamp_ntz, ano int")
    a.repartition("ano").write.partitionBy("ano").parquet(f"{root}/curated/wind")
    a.drop("ano").withColumn("extra", F.lit("x")).coalesce(1).write.parquet(f"{root}/curated/wind/ano=2026")
    spark.createDataFrame([(1, "2024-01-01"), (2, "a b")], "v int, data_emissao string").write.partitionBy("data_emissao").parquet(f"{root}/analytics/tariff")
    spark.range(5).write.parquet(f"{root}/analytics/plain")
    spark.range(0).write.parquet(f"{root}/analytics/empty")


def test_entries_come_from_footers_and_folders(spark, tmp_path):
    root = str(tmp_path)
    _lake(spark, root)
    files = lake.placed(footers(spark, root), root)
    got = {r["name"]: r for r in lake.entries(files, root, {"wind": "ts"}).collect()}
    wind = got["wind"]
    assert (wind.layer, wind.by_year, wind.hive, wind.first_year, wind.last_year, wind.row_count) == ("curated", True, True, 2024, 2026, 6)
    assert (wind["first"], wind["last"]) == ("2024-01-05 00:00:00", "2024-03-01 12:00:00")
    assert [tuple(c) for c in wind.columns] == [("id", "bigint"), ("ts", "timestamp_ntz"), ("ano", "int")]
    tariff = got["tariff"]
    assert (tariff.by_year, tariff.hive, tariff.first_year, tariff.row_count) == (False, True, None, 2)
    assert tariff.columns[-1].asDict() == {"name": "data_emissao", "type": "string"}
    assert (got["plain"].hive, got["plain"].row_count, got["empty"].row_count) == (False, 5, 0)


def test_partition_variants_and_views(spark, tmp_path):
    root = str(tmp_path)
    _lake(spark, root)
    files = lake.placed(footers(spark, root), root)
    lists = {r.names: (r.partitions, r["first"], r["last"], r.differs) for r in lake.partition_variants(files).collect()}
    assert lists == {"id,ts": (2, 2024, 2025, True), "id,ts,extra": (1, 2026, 2026, True)}
    signatures = {(r.name, r.signature): (r.parts, r.rows) for r in lake.schema_variants(files.filter("layer = 'curated'"), ["name"]).collect()}
    assert signatures == {("wind", "id:bigint,ts:timestamp_ntz"): (2, 3), ("wind", "extra:string,id:bigint,ts:timestamp_ntz"): (1, 3)}
    found = lake.entries(files, root).filter("name in ('wind', 'tariff')")
    assert lake.register(spark, found) == ["tariff", "wind"]
    assert spark.sql("select count(*) from wind where ano = 2024").first()[0] == 2
    assert spark.sql("select v from tariff where data_emissao = 'a b'").first()[0] == 2


def test_footers_read_no_data(spark, tmp_path):
    root = str(tmp_path)
    _lake(spark, root)
    plan = lake.entries(lake.placed(footers(spark, root), root), root)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan or "BinaryFile" in plan or "FileScan" in plan
    assert "content" not in plan and "parquet [" not in plan


def test_listing_by_source(spark):
    rows = [
        ("ons_cmo", "ONS", "precos", "Custo marginal", 1234, "2020-01-01 00:00:00", "2024-05-02 00:00:00", 2020, 2024, True),
        ("ons_carga", "ONS", "carga", "Carga horária", 10, None, None, 2021, 2022, True),
        ("siga", "ANEEL", "cadastro", "", 7, None, None, None, None, False),
    ]
    c = spark.createDataFrame(rows, "name string, source string, theme string, description string, row_count long, first string, last string, first_year int, last_year int, by_year boolean")
    assert {r.source: (r.tables, r.lines) for r in lake.listing(c).collect()} == {
        "ONS": (2, "- ons_carga [carga] (10 linhas · 2021 a 2022)\n- ons_cmo [precos] (1,234 linhas · 2020-01-01 a 2024-05-02)"),
        "ANEEL": (1, "- siga [cadastro] (7 linhas)"),
    }
    assert [r.lines for r in lake.listing(c, "HORARIA", "Carga").collect()] == ["- ons_carga (10 linhas · 2021 a 2022 · particionada por ano): Carga horária"]
