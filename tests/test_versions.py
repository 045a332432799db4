import pytest
from pyspark.sql import functions as F

from lakewright.operators.unify import unify
from lakewright.sources import sinks, versions


def test_readers_see_whole_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    assert versions.resolve(spark, root) is None
    first = versions.publish(spark.range(10), root)
    early = versions.resolve(spark, root)
    assert (first, early.number, early.rows) == (early, 1, 10)
    second = versions.publish(spark.range(100, 103), root)
    assert early.read(spark).count() == 10
    assert versions.resolve(spark, root) == second and second.read(spark).count() == 3
    assert versions.resolve(spark, root, 1) == early and versions.resolve(spark, root, 9) is None


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "index")
    versions.publish(spark.range(4), root)
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), root)
    assert versions.resolve(spark, root).rows == 4 and versions.resolve(spark, root).read(spark).count() == 4
    assert versions.publish(spark.range(0), root).rows == 0
    assert versions.resolve(spark, root).read(spark).count() == 0


def test_two_writers_never_share_a_number(spark, tmp_path):
    root = str(tmp_path / "index")
    manifest = {"version": 1, "data": "a", "rows": 1}
    assert versions._name(spark, root, manifest) and not versions._name(spark, root, {**manifest, "data": "b"})
    assert [p.name for p in (tmp_path / "index" / "manifests").iterdir() if not p.name.startswith(".")] == ["000000000001.json"]
    assert versions.publish(spark.range(2), root).number == 2


def test_a_unified_write_counts_itself(spark, tmp_path):
    table = unify([spark.createDataFrame([(1, "2024-01-02"), (2, None)], "a int, dat_x string")])
    for layout in ("plain", "year"):
        path = str(tmp_path / layout)
        assert sinks.write_unified(table, path, layout) == 2 == spark.read.parquet(path).count()
