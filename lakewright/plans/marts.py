"""Curtailment fact, marts and keyed joins; events play the half-hourly plant records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marts as mt
from ..sources.tables import table
from .registry import query


def fact(spark, folder):
    """Users as plants; errors and clicks are restricted slots; the reference comes from ``props``."""
    e = table(spark, folder, "events")
    k = F.from_json("props", "k int")["k"]
    raw = e.select(
        "event_id", "ts", F.col("user_id").alias("plant"), F.col("value").alias("gen"), (k * 4.0).alias("ref"),
        F.when(F.col("event_type") == "error", "ENE").when(F.col("event_type") == "click", "CNF").alias("reason"),
        F.concat(F.lit("LT "), (k % 37).cast("string")).alias("element"),
    )
    return mt.curtailment(raw, "gen", "ref", "reason")


FACT_SQL = """
WITH k AS (SELECT *, (props->>'$.k')::INT AS k FROM events),
f0 AS (SELECT event_id, ts, user_id AS plant, value AS gen, k * 4.0::DOUBLE AS ref,
       CASE event_type WHEN 'error' THEN 'ENE' WHEN 'click' THEN 'CNF' END AS reason, 'LT ' || (k % 37) AS element FROM k),
f AS (SELECT *, reason IS NOT NULL AS restricted, CASE WHEN reason IS NOT NULL THEN greatest(ref - gen, 0) ELSE 0.0 END AS cut_mw,
      CASE WHEN reason IS NOT NULL THEN greatest(ref - gen, 0) ELSE 0.0 END * 0.5::DOUBLE AS cut_mwh FROM f0)
"""


@query("curtailment_fact", FACT_SQL + "SELECT event_id, reason, restricted, round(cut_mw, 6) AS cut_mw, round(cut_mwh, 6) AS cut_mwh FROM f")
def curtailment_fact(spark, folder):
    return fact(spark, folder).select(
        "event_id", "reason", "restricted", F.round("cut_mw", 6).alias("cut_mw"), F.round("cut_mwh", 6).alias("cut_mwh")
    )


@query("wind_reliable", """
SELECT event_id, event_type <> 'error' AND value / 10 > 0 AND value / 10 <= 40 AS reliable FROM events
""")
def wind_reliable(spark, folder):
    ok = mt.reliable_wind(F.col("event_type") != "error", F.col("value") / 10)
    return table(spark, folder, "events").select("event_id", ok.alias("reliable"))


@query("unit_columns", """
SELECT p_partkey, p_size + (p_partkey % 5) AS plugin, round((p_retailprice + p_size) / 1000, 6) AS price_kwh, round(p_retailprice / 1e3, 6) AS price_k,
       round(p_retailprice / 1e6, 9) AS price_m FROM part
""")
def unit_columns(spark, folder):
    price = F.col("p_retailprice")
    return table(spark, folder, "part").select(
        "p_partkey", (F.col("p_size") + F.col("p_partkey") % 5).alias("plugin"),
        F.round((price + F.col("p_size")) / 1000, 6).alias("price_kwh"), F.round(price / 1e3, 6).alias("price_k"), F.round(price / 1e6, 9).alias("price_m"),
    )


@query("mart_monthly", FACT_SQL + """
SELECT strftime(ts, '%Y-%m') AS month, reason, restricted, count(*) AS slots, count(DISTINCT plant) AS plants,
       round(sum(cut_mwh), 6) AS mwh_cut, round(sum(gen * 0.5), 6) AS mwh_generated FROM f GROUP BY 1, 2, 3
""")
def mart_monthly(spark, folder):
    return mt.monthly_mart(fact(spark, folder), "ts", ["reason", "restricted"], "plant", "gen")


@query("mart_element", FACT_SQL + """
SELECT element, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last,
       count(DISTINCT CAST(ts AS DATE)) AS active_days, count(DISTINCT plant) AS plants, round(sum(cut_mwh), 6) AS mwh_cut
FROM f WHERE restricted GROUP BY 1
""")
def mart_element(spark, folder):
    return mt.element_mart(fact(spark, folder), "element", "ts", "plant")


@query("noise_floor", FACT_SQL + """
, g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, gen, ref, round(abs(ref - gen) / nullif(gen, 0), 6) AS e FROM f WHERE NOT restricted)
SELECT day, count(*) AS free_slots, round(count(*) FILTER (WHERE ref - gen > 0) / count(*), 6) AS share_above,
       round(sum(greatest(ref - gen, 0)) * 0.5, 6) AS phantom_mwh, round(quantile_cont(e, 0.5), 6) AS error_p50, round(quantile_cont(e, 0.9), 6) AS error_p90
FROM g GROUP BY 1
""")
def noise_floor(spark, folder):
    f = fact(spark, folder).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return mt.noise_floor(f, ["day"], "gen", "ref")


@query("cells_summary", """
WITH p AS (SELECT round((c_acctbal / 1000) / 0.25) * 0.25::DOUBLE + 0.0::DOUBLE AS cell_lat, round((c_nationkey * 0.4::DOUBLE) / 0.25) * 0.25::DOUBLE + 0.0::DOUBLE AS cell_lon,
           'N' || c_nationkey AS st, c_mktsegment AS kind, c_custkey % 100 / 10 AS mw FROM customer)
SELECT cell_lat, cell_lon, min(st) AS state, count(*) FILTER (WHERE kind = 'BUILDING') AS wind, count(*) FILTER (WHERE kind <> 'BUILDING') AS other,
       round(sum(mw), 1) AS capacity FROM p GROUP BY 1, 2
""")
def cells_summary(spark, folder):
    c = table(spark, folder, "customer")
    plants = c.select(
        mt.cell_of(F.col("c_acctbal") / 1000).alias("cell_lat"), mt.cell_of(F.col("c_nationkey") * 0.4).alias("cell_lon"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("st"), F.col("c_mktsegment").alias("kind"),
        (F.col("c_custkey") % 100 / 10).alias("mw"),
    )
    return mt.cells_summary(plants, "cell_lat", "cell_lon", "st", "kind", "BUILDING", "mw")


@query("distinct_pairs", "SELECT count(*) AS pairs FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def distinct_pairs(spark, folder):
    return table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct().agg(F.count("*").alias("pairs"))


@query("plant_registry_join", """
SELECT n_name, r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, min(s_acctbal) AS low
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2
""")
def plant_registry_join(spark, folder):
    """Facts are summed per plant before the registry joins, so a plant with most facts moves as few rows."""
    start = F.lit("1996-01-01").cast("timestamp_ntz")
    lines = table(spark, folder, "lineitem").filter(F.col("l_shipdate") >= start).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")
    )
    registry = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return lines.join(registry, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name", "r_name").agg(
        F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("revenue"), F.min("s_acctbal").alias("low")
    )


@query("validity_join", """
WITH rel AS (SELECT o_custkey, o_orderpriority AS grp, o_orderdate AS a, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 45 DAY END AS z FROM orders),
fact AS (SELECT o_custkey, l_shipdate AS t, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT grp, count(*) AS n, round(sum(q), 2) AS quantity FROM fact JOIN rel USING (o_custkey) WHERE t >= a AND (z IS NULL OR t < z) GROUP BY 1
""")
def validity_join(spark, folder):
    o = table(spark, folder, "orders")
    relation = o.select(
        "o_custkey", F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").alias("a"),
        F.when(F.col("o_orderstatus") != "P", F.expr("o_orderdate + interval 45 days")).alias("z"),
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("t"), F.col("l_quantity").alias("q"))
    facts = lines.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "t").agg(
        F.count("*").alias("n"), F.sum("q").alias("q")
    )
    return mt.validity_join(facts, relation, "o_custkey", "t", "a", "z").groupBy("grp").agg(
        F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("quantity")
    )


@query("radius_join", """
WITH p AS (SELECT c_custkey, -10 + (c_custkey * 7919 % 100000) / 10000.0::DOUBLE AS lat, -40 + (c_custkey * 104729 % 100000) / 10000.0::DOUBLE AS lon FROM customer),
t AS (SELECT -10 + (s_suppkey * 15485863 % 100000) / 10000.0::DOUBLE AS lat, -40 + (s_suppkey * 32452843 % 100000) / 10000.0::DOUBLE AS lon FROM supplier)
SELECT c_custkey FROM p WHERE EXISTS (SELECT 1 FROM t WHERE 2 * 6371000.0 * asin(sqrt(least(1.0,
   pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2)))) <= 10000)
""")
def radius_join(spark, folder):
    def spot(key, a, b):
        return [(-10 + (F.col(key) * a % 100000) / 10000.0).alias("lat"), (-40 + (F.col(key) * b % 100000) / 10000.0).alias("lon")]

    points = table(spark, folder, "customer").select("c_custkey", *spot("c_custkey", 7919, 104729))
    targets = table(spark, folder, "supplier").select(*spot("s_suppkey", 15485863, 32452843))
    return mt.within_radius(points, targets, 10_000).select("c_custkey")


@query("issue_vs_obs", """
WITH d AS (SELECT event_type AS cell, CAST(ts AS DATE) AS day, round(sum(value), 2) AS v FROM events GROUP BY 1, 2),
i AS (SELECT cell, day AS issued, day + lead AS valid, lead, v AS forecast FROM d, (SELECT unnest([1, 2, 3])::INT AS lead))
SELECT lead::BIGINT AS lead, count(*) AS n, round(avg(abs(forecast - v)), 6) AS mae, round(avg(forecast - v), 6) AS bias
FROM i JOIN d ON d.cell = i.cell AND d.day = i.valid GROUP BY 1
""")
def issue_vs_obs(spark, folder):
    """Every day's total is issued as the forecast of the three days after it."""
    days = table(spark, folder, "events").groupBy(F.col("event_type").alias("cell"), F.to_date("ts").alias("valid")).agg(
        F.round(F.sum("value"), 2).alias("observed")
    )
    ahead = F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)]))
    issues = days.select("cell", F.col("valid").alias("issued"), F.col("observed").alias("forecast"), ahead.alias("h")).select(
        "cell", "issued", "forecast", F.expr("date_add(issued, h)").alias("valid")
    )
    return mt.forecast_errors(issues, days, ["cell"], "valid", "issued")


@query("hourly_json", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS time, value FROM events
UNION ALL SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M'), (props->>'$.k')::DOUBLE FROM events
""")
def hourly_json(spark, folder):
    """Responses with parallel arrays, as one object or as a list."""
    def at(expr):
        return F.date_format(F.expr(expr), "yyyy-MM-dd'T'HH:mm")

    body = F.concat(
        F.lit('{"hourly":{"time":["'), at("ts"), F.lit('","'), at("ts + interval 1 hour"), F.lit('"],"value":['),
        F.col("value").cast("string"), F.lit(","), F.get_json_object("props", "$.k"), F.lit("]}}"),
    )
    listed = F.when(F.col("event_type") == "view", F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return mt.hourly_rows(table(spark, folder, "events").select("event_id", listed.alias("json")), "json", ["event_id"])


@query("hourly_variables", """
WITH b AS (SELECT event_id, ts, value, (props->>'$.k')::DOUBLE AS k FROM events)
SELECT event_id, 'k' AS variable, strftime(ts, '%Y-%m-%dT%H:%M') AS time, k AS value FROM b
UNION ALL SELECT event_id, 'k', strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M'), k + 1 FROM b
UNION ALL SELECT event_id, 'wind 100m', strftime(ts, '%Y-%m-%dT%H:%M'), value FROM b
UNION ALL SELECT event_id, 'wind 100m', strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M'), NULL FROM b
""")
def hourly_variables(spark, folder):
    """Two variables of unequal length, found by what each response holds."""
    def at(expr):
        return F.date_format(F.expr(expr), "yyyy-MM-dd'T'HH:mm")

    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"hourly":{"time":["'), at("ts"), F.lit('","'), at("ts + interval 1 hour"), F.lit('"],"wind 100m":['), F.col("value").cast("string"),
        F.lit('],"k":['), k, F.lit(","), (k.cast("double") + 1).cast("string"), F.lit("]}}"),
    )
    listed = F.when(F.col("event_type") == "view", F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return mt.hourly_values(table(spark, folder, "events").select("event_id", listed.alias("json")), "json", ["event_id"])
