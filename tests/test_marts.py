import datetime as dt
import math
import random

from pyspark.sql import functions as F

from lakewright.operators import marts as mt
from lakewright.sources.feeds import feed_items


def _apart(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * mt.EARTH_RADIUS * math.asin(math.sqrt(min(x, 1)))


def test_radius_on_the_whole_sphere(spark):
    r = random.Random(1)

    def spot():
        lat = r.choice([r.uniform(-90, 90), 90 - r.random() ** 4 * 5, -90 + r.random() ** 4 * 5, 70.0, -90.0, 90.0, 0.0])
        return lat, r.choice([r.uniform(-180, 180), 180 - r.random() / 50, -180 + r.random() / 50, 180.0, -180.0, 0.0])

    targets = [spot() for _ in range(250)]
    points = [spot() for _ in range(400)] + [(min(max(a + r.uniform(-0.1, 0.1), -90.0), 90.0), b + r.uniform(-0.1, 0.1)) for a, b in targets for _ in range(3)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(-1, None, 1.0)], "id long, lat double, lon double")
    t = spark.createDataFrame([*targets, (None, 0.0)], "lat double, lon double")
    for metres in (500.0, 10_000.0, 900_000.0, 11_000_000.0):
        want = {i for i, x in enumerate(points) if any(_apart(x, y) <= metres for y in targets)}
        assert {x.id for x in mt.within_radius(p, t, metres).collect()} == want, metres


def test_radius_over_the_date_line_and_far_north(spark):
    p = spark.createDataFrame([(1, 0.0, 179.999), (2, 70.0, 10.0)], "id long, lat double, lon double")
    t = spark.createDataFrame([(0.0, -179.999), (70.0, 10.2)], "lat double, lon double")
    assert {x.id for x in mt.within_radius(p, t, 10_000.0).collect()} == {1, 2}


def test_validity_equals_the_loop(spark):
    r = random.Random(2)
    at = lambda: dt.datetime(2000, 1, 1) + dt.timedelta(hours=r.choice([r.randint(-200_000, 200_000), 24 * r.randint(-9000, 9000), r.randint(0, 500)]))
    relation = [(r.choice("ab"), i, at(), at() if r.random() < 0.8 else None) for i in range(150)] + [("a", 900, None, at()), (None, 901, at(), None)]
    facts = [(r.choice("abc"), i, at()) for i in range(300)] + [("a", 900, None)]
    rel = spark.createDataFrame(relation, "k string, rel long, a timestamp_ntz, z timestamp_ntz")
    fact = spark.createDataFrame(facts, "k string, fact long, t timestamp_ntz")
    want = sorted((f, i) for k, f, t in facts for q, i, a, z in relation if k == q and t and a and t >= a and (z is None or t < z))
    assert sorted((x.fact, x.rel) for x in mt.validity_join(fact, rel, "k", "t", "a", "z").collect()) == want


def test_long_relations_are_few_blocks(spark):
    days = spark.createDataFrame([(730_000, 730_045), (730_001, 800_003), (5, mt.RADIX**mt.LEVELS), (9, 9)], "a long, z long")
    rows = days.select("a", "z", mt.aligned_blocks(F.col("a"), F.col("z")).alias("b")).collect()
    for x in rows:
        covered = [(b.block * mt.RADIX**b.level, (b.block + 1) * mt.RADIX**b.level) for b in x.b]
        covered.sort()
        assert sum(hi - lo for lo, hi in covered) == x.z - x.a and all(p[1] == q[0] for p, q in zip(covered, covered[1:]))
        assert not covered or (covered[0][0], covered[-1][1]) == (x.a, x.z)
    assert max(len(x.b) for x in rows) <= 2 * (mt.RADIX - 1) * mt.LEVELS


def test_one_scan_of_the_facts(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "k string, t timestamp_ntz").write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    rel = spark.createDataFrame([("a", dt.datetime(2023, 1, 1), None)], "k string, a timestamp_ntz, z timestamp_ntz")
    plan = mt.validity_join(facts, rel, "k", "t", "a", "z")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_hourly_variables(spark):
    one = '{"hourly":{"time":["t0","t1","t2"],"wind":[1,2.5],"temp":[3],"odd":["x"]}}'
    rows = [(1, one), (2, f"[{one}, {{}}]"), (3, "broken"), (4, None), (5, '{"hourly":{"time":["t0"],"new one":[null]}}')]
    df = spark.createDataFrame(rows, "id int, j string")
    wide = sorted(tuple(r) for r in mt.hourly_rows(df, "j", ["id"], ["wind", "temp"]).where("id < 3").collect())
    assert wide == sorted((i, *r) for i in (1, 2) for r in [("t0", 1.0, 3.0), ("t1", 2.5, None), ("t2", None, None)])
    long = [tuple(r) for r in mt.hourly_values(df, "j", ["id"]).collect()]
    assert (1, "wind", "t1", 2.5) in long and (1, "temp", "t2", None) in long and (5, "new one", "t0", None) in long
    assert {r[0] for r in long} == {1, 2, 5}


def test_items_beside_the_channel(spark):
    rdf = "<RDF><channel><title>C</title></channel><item><title>one</title><link>l1</link></item><item><title>two</title><link>l2</link></item></RDF>"
    mixed = "<rss><channel><title>D</title><item><title>in</title></item></channel><item><title>out</title></item></rss>"
    df = spark.createDataFrame([("https://h/x", rdf), ("https://h/y", mixed)], "feed string, xml string")
    got = sorted((r.outlet, r.title, r.link) for r in feed_items(df).collect())
    assert got == [("C", "one", "l1"), ("C", "two", "l2"), ("D", "in", ""), ("D", "out", "")]


def test_noise_floor_sums_and_ties_are_exact(spark):
    many = spark.range(200_000).select(F.lit("a").alias("k"), F.lit(29.27).alias("g"), F.lit(304.0).alias("r"))
    two = spark.createDataFrame([("b", 1.0, 44.103646), ("b", 1.0, 44.103647)], "k string, g double, r double")
    odd = spark.createDataFrame([("c", 1.0, 1e300), ("c", 1.0, 1.5), ("d", 1.0, float("inf")), ("e", None, 1.0)], "k string, g double, r double")
    fact = many.union(two).union(odd).withColumn("restricted", F.lit(False))
    got = {x.k: x for x in mt.noise_floor(fact, ["k"], "g", "r").collect()}
    assert got["a"].phantom_mwh == 27_473_000.0  # added as doubles it is off by more than a millionth
    assert got["b"].error_p50 == 43.103647  # the middle is 43.103646499999996 as a double
    assert got["c"].phantom_mwh == 5e299 and got["d"].phantom_mwh == float("inf") and got["e"].phantom_mwh == 0


def test_validity_multiplies_neither_side(spark):
    """Relations of usual keys are not cut into days; keys with many relations give the same rows."""
    day = F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, cast(id % 3000 as int))")
    rel = spark.range(600).select((F.col("id") % 20).alias("k"), F.col("id").alias("rel"), day.alias("a"), F.when(F.col("id") % 3 > 0, F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, cast(id % 3000 + 45 as int))")).alias("z"))
    rel = rel.union(spark.range(100, 400).select(F.lit(99), "id", day, F.when(F.col("id") % 2 > 0, F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, cast(id % 3000 + id as int))"))))
    fact = spark.range(900).select(F.when(F.col("id") % 3 == 0, 99).otherwise(F.col("id") % 25).alias("k"), F.col("id").alias("fact"), day.alias("t"))
    got = mt.validity_join(fact, rel, "k", "t", "a", "z").select("fact", "rel")
    want = fact.join(rel, "k").where("t >= a and (z is null or t < z)").select("fact", "rel")
    assert got.count() == want.count() > 1000 and got.exceptAll(want).isEmpty()
    light = mt.validity_join(fact, rel.where("k < 20"), "k", "t", "a", "z")._jdf.queryExecution()
    assert "Generate" not in light.executedPlan().toString() and "Broadcast" not in light.executedPlan().toString()
