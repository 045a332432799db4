"""Locale parsers, probes and unification over text derived from ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..operators import unify as un
from ..sources import sinks
from ..sources.tables import table
from ..session import scratch_path
from .registry import query


def _orders(spark, folder):
    return table(spark, folder, "orders")


def number_text():
    """Price of an order written the way different files write it."""
    price, kind = F.col("o_totalprice"), F.col("o_orderpriority")
    comma = parse.format_comma(price, 2)
    plain = F.replace(comma, F.lit("."), F.lit(""))
    return (
        F.when(kind == "1-URGENT", comma)
        .when(kind == "2-HIGH", plain)
        .when(kind == "3-MEDIUM", F.concat(F.lit("  "), F.replace(plain, F.lit(","), F.lit(".")), F.lit(" ")))
        .when((kind == "5-LOW") & (F.col("o_orderstatus") == "F"), F.lit("   "))
        .when((kind == "5-LOW") & (F.col("o_orderstatus") == "O"), F.lit("n/d"))
        .otherwise(F.concat(F.replace(plain, F.lit(","), F.lit(".")), F.lit("f")))
    )


def number_texts(spark, folder):
    return _orders(spark, folder).select("o_orderkey", number_text().alias("txt"))


NUMBER_SQL = """
WITH f AS (
  SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS comma FROM orders),
t AS (
  SELECT o_orderkey, CASE
    WHEN p = '1-URGENT' THEN comma
    WHEN p = '2-HIGH' THEN replace(comma, '.', '')
    WHEN p = '3-MEDIUM' THEN '  ' || replace(replace(comma, '.', ''), ',', '.') || ' '
    WHEN p = '5-LOW' AND s = 'F' THEN '   '
    WHEN p = '5-LOW' AND s = 'O' THEN 'n/d'
    ELSE replace(replace(comma, '.', ''), ',', '.') || 'f' END AS txt FROM f)
"""


@query("num_parse_generic", NUMBER_SQL + """
SELECT o_orderkey, txt, TRY_CAST(CASE WHEN contains(txt, ',') THEN replace(replace(trim(txt), '.', ''), ',', '.') ELSE trim(txt) END AS DOUBLE) AS v FROM t
""")
def num_parse_generic(spark, folder):
    return number_texts(spark, folder).withColumn("v", parse.number_generic(F.col("txt")))


@query("num_parse_convention", NUMBER_SQL + """
SELECT o_orderkey, txt, TRY_CAST(replace(txt, ',', '.') AS DOUBLE) AS v FROM t
""")
def num_parse_convention(spark, folder):
    return number_texts(spark, folder).withColumn("v", parse.number_convention(F.col("txt")))


@query("num_parse_tariff", NUMBER_SQL + """
SELECT o_orderkey, txt AS label, TRY_CAST(replace(replace(txt, '.', ''), ',', '.') AS DOUBLE) AS vlrte FROM
  (SELECT o_orderkey, nullif(trim(txt), '') AS txt FROM t)
""")
def num_parse_tariff(spark, folder):
    raw = number_texts(spark, folder).select("o_orderkey", F.col("txt").alias("Label"), F.col("txt").alias("VlrTE"))
    out = un.declared(raw, numeric=["VlrTE"], dates=[])
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def time_texts(spark, folder):
    """Order dates in every accepted writing and in some that are not dates."""
    kind, state, d = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderdate")
    text = (
        F.when(kind == "1-URGENT", F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when((kind == "2-HIGH") & (state == "F"), F.date_format(d, "dd/MM/yyyy"))
        .when((kind == "2-HIGH") & (state == "O"), F.concat(F.date_format(d, "d/M/yyyy"), F.lit(" 08:15")))
        .when(kind == "2-HIGH", F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 23:59:01")))
        .when((kind == "3-MEDIUM") & (state == "F"), F.date_format(d, "yyyyMMdd"))
        .when((kind == "3-MEDIUM") & (state == "O"), F.date_format(d, "MM/yyyy"))
        .when(kind == "3-MEDIUM", F.date_format(d, "yyyy-MM"))
        .when((kind == "5-LOW") & (state == "F"), F.date_format(d, "yyyyMM"))
        .when((kind == "5-LOW") & (state == "O"), F.date_format(d, "yyyy"))
        .when(kind == "5-LOW", F.lit("12:30"))
        .when(state == "F", F.lit("31/02/2024"))
        .otherwise(F.lit(" "))
    )
    return _orders(spark, folder).select("o_orderkey", text.alias("txt"))


@query("ts_parse_multi", """
WITH t AS (
  SELECT o_orderkey, CASE
    WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN strftime(o_orderdate, '%-d/%-m/%Y') || ' 08:15'
    WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%d/%m/%Y') || ' 23:59:01'
    WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y%m%d')
    WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN strftime(o_orderdate, '%m/%Y')
    WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m')
    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y%m')
    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y')
    WHEN o_orderpriority = '5-LOW' THEN '12:30'
    WHEN o_orderstatus = 'F' THEN '31/02/2024' ELSE ' ' END AS txt FROM orders),
c AS (SELECT o_orderkey, txt, trim(txt) AS x FROM t)
SELECT o_orderkey, txt, strftime(coalesce(
    TRY_CAST(x AS TIMESTAMP), try_strptime(x, '%d/%m/%Y %H:%M:%S'), try_strptime(x, '%d/%m/%Y %H:%M'), try_strptime(x, '%d/%m/%Y'),
    try_strptime(x, '%Y%m%d'), try_strptime(x, '%m/%Y'), try_strptime(x, '%Y-%m'),
    CASE WHEN length(x) = 6 THEN try_strptime(x, '%Y%m') END), '%Y-%m-%d %H:%M:%S') AS t FROM c
""")
def ts_parse_multi(spark, folder):
    parsed = parse.timestamp_multi(F.col("txt"))
    return time_texts(spark, folder).withColumn("t", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"))


@query("sentinel_dates", """
WITH m AS (
  SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '1900-01-01 00:00:00'
                          WHEN o_orderpriority = '2-HIGH' THEN TIMESTAMP '1899-12-30 10:00:00' ELSE o_orderdate END AS t FROM orders)
SELECT o_orderkey, strftime(CASE WHEN CAST(t AS DATE) IN (DATE '1900-01-01', DATE '1899-12-30') THEN NULL ELSE t END, '%Y-%m-%d') AS t FROM m
""")
def sentinel_dates(spark, folder):
    marked = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1900-01-01 00:00:00").cast("timestamp_ntz"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("1899-12-30 10:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate"))
    )
    return _orders(spark, folder).select("o_orderkey", F.date_format(parse.drop_sentinel_dates(marked), "yyyy-MM-dd").alias("t"))


@query("blank_to_null", """
SELECT conv_id, turn, nullif(trim(CASE WHEN role = 'system' THEN '   ' ELSE '  ' || role || ' ' END), '') AS label FROM conversations
""")
def blank_to_null(spark, folder):
    padded = F.when(F.col("role") == "system", "   ").otherwise(F.concat(F.lit("  "), F.col("role"), F.lit(" ")))
    return table(spark, folder, "conversations").select("conv_id", "turn", parse.blank_to_null(padded).alias("label"))


@query("strip_strings", """
SELECT p_partkey, trim('    ' || p_name) AS p_name, trim(p_type || '  ') AS p_type, p_retailprice FROM part
""")
def strip_strings(spark, folder):
    indented = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("    "), "p_name").alias("p_name"),
        F.concat("p_type", F.lit("  ")).alias("p_type"), "p_retailprice",
    )
    return un.trim_strings(indented)


@query("drop_all_null", """
SELECT * FROM (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS k, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS v FROM orders)
WHERE k IS NOT NULL OR v IS NOT NULL
""")
def drop_all_null(spark, folder):
    holes = _orders(spark, folder).select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("k"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("v"),
        F.col("o_orderdate").alias("dataexcel"),
    )
    return un.drop_empty_rows(holes)


@query("packed_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS data, year(o_orderdate)::BIGINT AS ano FROM orders
""")
def packed_date(spark, folder):
    raw = _orders(spark, folder).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("data"), F.year("o_orderdate").cast("bigint").alias("anos"),
    )
    out = un.packed_or_year(un.packed_or_year(raw, "data"), "anos")
    return out.withColumn("data", F.date_format("data", "yyyy-MM-dd"))


@query("bool_to_int", """
SELECT o_orderkey AS num_minutos_k, (o_totalprice > 150000)::INT AS flg_caro, strftime(o_orderdate, '%Y-%m-%d') AS dat_programacao,
       TRY_CAST(replace(translate(format('{:,.2f}', o_totalprice), ',.', '.,'), ',', '.') AS DOUBLE) AS val_preco FROM orders
""")
def bool_to_int(spark, folder):
    raw = _orders(spark, folder).select(
        F.col("o_orderkey").alias("num_minutos_k"), (F.col("o_totalprice") > 150000).alias("flg_caro"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("dat_programacao"),
        parse.format_comma(F.col("o_totalprice"), 2).alias("val_preco"),
    )
    return un.by_convention([raw]).withColumn("dat_programacao", F.date_format("dat_programacao", "yyyy-MM-dd"))


@query("probe_columns", NUMBER_SQL + """,
w AS (
  SELECT t.txt AS mixed, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS price,
         strftime(o_orderdate, '%d/%m/%Y') AS dat_order, o_orderstatus AS status
  FROM t JOIN orders USING (o_orderkey)),
u AS (UNPIVOT w ON mixed, price, dat_order, status INTO NAME name VALUE x),
p AS (
  SELECT name, trim(x) AS x,
         TRY_CAST(CASE WHEN contains(x, ',') THEN replace(replace(trim(x), '.', ''), ',', '.') ELSE trim(x) END AS DOUBLE) AS num,
         coalesce(TRY_CAST(trim(x) AS TIMESTAMP), try_strptime(trim(x), '%d/%m/%Y')) AS tm FROM u WHERE trim(x) <> '')
SELECT name, count(*) AS filled, count(*) FILTER (WHERE tm IS NULL) AS bad_times, count(*) FILTER (WHERE num IS NULL) AS bad_numbers
FROM p GROUP BY name
""")
def probe_columns(spark, folder):
    wide = _orders(spark, folder).select(
        number_text().alias("mixed"), parse.format_comma(F.col("o_totalprice"), 2).alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("dat_order"), F.col("o_orderstatus").alias("status"),
    )
    names = wide.columns
    counts = wide.agg(*[a for n in names for a in un.probe_aggs(n, F.col(n), wide.schema[n].dataType, times=True, numbers=True)])
    rows = [
        F.struct(F.lit(n).alias("name"), F.col(f"{n}__filled").alias("filled"),
                 F.col(f"{n}__times").alias("bad_times"), F.col(f"{n}__numbers").alias("bad_numbers"))
        for n in names
    ]
    return counts.select(F.inline(F.array(*rows)))


def order_variants(spark, folder):
    """The same orders as three files of different years would hold them."""
    o = _orders(spark, folder)
    year = F.year("o_orderdate")
    plain = o.filter(year <= 1996)
    texts = o.filter((year > 1996) & (year <= 1998)).select(
        F.col("o_orderkey").alias("O_OrderKey"), "o_custkey", "o_orderstatus",
        parse.format_comma(F.col("o_totalprice"), 2).alias("o_totalprice"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate"), "o_orderpriority",
    )
    moved = o.filter(year > 1998).select(
        "o_totalprice", "o_orderdate", "o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus",
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("x ")).alias("Situação"),
    )
    return [plain, texts, moved]


@query("unify_orders_variants", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       CASE WHEN year(o_orderdate) <= 1998 THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN year(o_orderdate) > 1998 THEN ' ' || o_orderstatus || 'x ' END AS situacao FROM orders
""")
def unify_orders_variants(spark, folder):
    df = un.unify(order_variants(spark, folder)).df
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("split_rename", """
SELECT c_custkey, split_part(c_name, '#', 1) AS uf, split_part(c_name, '#', 2) AS polo, c_acctbal AS vento_100m_kmh,
       c_acctbal / 3.6 AS vento_100m_ms FROM customer
""")
def split_rename(spark, folder):
    c = table(spark, folder, "customer")
    return c.select(
        "c_custkey", F.split_part("c_name", F.lit("#"), F.lit(1)).alias("uf"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("polo"),
        F.col("c_acctbal").alias("vento_100m_kmh"), (F.col("c_acctbal") / 3.6).alias("vento_100m_ms"),
    )


# ---- profile and partition


def dated_lines(spark, folder):
    """Order lines with three time columns; one of them is a processing date."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").alias("din_embarque"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("mes_referencia"),
        F.expr("l_shipdate + make_interval(0, 0, 0, l_partkey % 977)").alias("dat_processamento"),
    )


@query("time_column_choice", """
SELECT 'din_embarque' AS time_column, count(DISTINCT l_shipdate) AS n_distinct, strftime(min(l_shipdate), '%Y-%m-%d') AS first,
       strftime(max(l_shipdate), '%Y-%m-%d') AS last, count(*) AS "rows" FROM lineitem
HAVING count(DISTINCT l_shipdate) >= count(DISTINCT date_trunc('month', l_shipdate))
""")
def time_column_choice(spark, folder):
    lines = dated_lines(spark, folder)
    found = un.unify([lines], exact=True)
    t = found.time_column
    return found.df.agg(
        F.count_distinct(t).alias("n_distinct"), F.date_format(F.min(t), "yyyy-MM-dd").alias("first"),
        F.date_format(F.max(t), "yyyy-MM-dd").alias("last"), F.count("*").alias("rows"),
    ).withColumn("time_column", F.lit(t))


@query("date_demotion", """
SELECT count(*) FILTER (WHERE ts <> date_trunc('day', ts)) AS ts_timed,
       CASE WHEN count(*) FILTER (WHERE ts <> date_trunc('day', ts)) = 0 THEN 'date' ELSE 'timestamp' END AS ts_type,
       (SELECT CASE WHEN count(*) FILTER (WHERE o_orderdate <> date_trunc('day', o_orderdate)) = 0 THEN 'date' ELSE 'timestamp' END FROM orders) AS order_type
FROM events
""")
def date_demotion(spark, folder):
    def kind(c):
        return F.when(F.count_if(~parse.day_only(F.col(c))) == 0, "date").otherwise("timestamp")

    orders = _orders(spark, folder).agg(kind("o_orderdate").alias("t"))
    return table(spark, folder, "events").agg(
        F.count_if(~parse.day_only(F.col("ts"))).alias("ts_timed"), kind("ts").alias("ts_type"),
    ).withColumn("order_type", orders.scalar())


@query("year_partition_counts", """
SELECT year(o_orderdate) AS ano, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE year(o_orderdate) >= 1997 GROUP BY 1
""")
def year_partition_counts(spark, folder):
    """Written by year, read back through partition pruning."""
    path = scratch_path(spark, "orders-by-year")
    sinks.write_by_year(_orders(spark, folder), path, "o_orderdate")
    back = spark.read.parquet(path).filter(F.col("ano") >= 1997)
    return back.groupBy(F.col("ano").cast("bigint").alias("ano")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("null_time_dropped", """
WITH m AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS t FROM orders)
SELECT count(*) FILTER (WHERE t IS NOT NULL) AS kept, count(*) FILTER (WHERE t IS NULL) AS quarantined FROM m
""")
def null_time_dropped(spark, folder):
    holes = _orders(spark, folder).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("dat_pedido")
    )
    table_ = un.unify([holes])
    return table_.kept.agg(F.count("*").alias("kept")).withColumn(
        "quarantined", table_.quarantine.agg(F.count("*")).scalar()
    )


@query("unified_write_complete", """
WITH m AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS t FROM orders)
SELECT layout, count(*) AS n, count(*) FILTER (WHERE t IS NULL) AS without_time, count(DISTINCT year(t)) AS years
FROM m, (SELECT unnest(['plain', 'year']) AS layout) GROUP BY 1
""")
def unified_write_complete(spark, folder):
    """Both layouts store every row, with or without a time."""
    t = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("dat_pedido")
    unified, parts = un.unify([_orders(spark, folder).select("o_orderkey", t)]), []
    for layout in ("plain", "year"):
        path = scratch_path(spark, f"unified-{layout}")
        sinks.write_unified(unified, path, layout)
        back = spark.read.parquet(path)
        parts.append(back.agg(
            F.lit(layout).alias("layout"), F.count("*").alias("n"), F.count_if(F.col("dat_pedido").isNull()).alias("without_time"),
            F.count_distinct(F.year("dat_pedido")).alias("years"),
        ))
    return parts[0].union(parts[1])


@query("write_roundtrip", """
SELECT year(o_orderdate) AS ano, count(*) AS n, round(sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice * 2 ELSE o_totalprice END), 2) AS total
FROM orders GROUP BY 1
""")
def write_roundtrip(spark, folder):
    """Partitions written once; then one year is replaced and the others stay."""
    path = scratch_path(spark, "orders-replace")
    by_year = _orders(spark, folder).withColumn("ano", F.year("o_orderdate").cast("bigint"))
    sinks.replace_partitions(by_year, path, ["ano"])
    fresh = by_year.filter("ano = 1996").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    sinks.replace_partitions(fresh, path, ["ano"])
    return spark.read.parquet(path).groupBy(F.col("ano").cast("bigint").alias("ano")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("approx_distinct")
def approx_distinct(spark, folder):
    """Sketches differ between engines, so rows only."""
    return table(spark, folder, "lineitem").agg(
        *[F.approx_count_distinct(c).alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")]
    )


@query("partition_layout", """
WITH p AS (
  SELECT source AS t, CASE lang WHEN 'en' THEN 'lake/' || source || '/ano=' || (2000 + n_chars % 20) || '/p.parquet'
         WHEN 'fr' THEN 'lake/' || source || '_f/data_emissao=2024-01-01/p.parquet' ELSE 'lake/' || source || '_g/p.parquet' END AS path FROM documents),
k AS (SELECT split_part(path, '/', 2) AS name, regexp_extract(path, '/([^/=]+)=', 1) AS key FROM p)
SELECT name, bool_or(key = 'ano') AS by_year, bool_or(key <> '') AS hive FROM k GROUP BY 1
""")
def partition_layout(spark, folder):
    from ..sources.files import layout_of_paths

    d = table(spark, folder, "documents")
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("lake/"), "source", F.lit("/ano="), (2000 + F.col("n_chars") % 20).cast("string"), F.lit("/p.parquet")))
        .when(F.col("lang") == "fr", F.concat(F.lit("lake/"), "source", F.lit("_f/data_emissao=2024-01-01/p.parquet")))
        .otherwise(F.concat(F.lit("lake/"), "source", F.lit("_g/p.parquet")))
    )
    return layout_of_paths(d.select(path.alias("path")))
