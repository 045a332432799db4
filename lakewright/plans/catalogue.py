"""Catalogue, descriptions and reconciliation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import lake
from ..operators import reconcile as rec
from ..session import scratch_path
from ..sources.files import dictionary_entries
from ..sources.footers import footers
from ..sources.tables import TABLES, register_views, table
from .registry import query

TIME = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
THEMES = {"o": "sales", "orders": "orders", "line": "sales", "part": "master", "customer": "master", "supplier": "master", "doc": "text"}
MANUAL = {"orders": "Orders of customers", "events": " "}
GENERATED = {"orders": "generated", "events": "User events", "pages": "Web pages"}
SOURCES = {"events": "Stream", "documents": "Corpus", "pages": "Corpus"}


def _entry_sql(name: str) -> str:
    t = TIME.get(name)
    span = f"strftime(min({t}), '%Y-%m-%d %H:%M:%S'), strftime(max({t}), '%Y-%m-%d %H:%M:%S')" if t else "NULL::VARCHAR, NULL::VARCHAR"
    col = f"'{t}'" if t else "NULL::VARCHAR"
    return f"SELECT '{name}' AS name, {col} AS time_column, count(*) AS row_count, {span} FROM {name}"


CATALOG_SQL = (
    "WITH e(name, time_column, row_count, first, last) AS (" + " UNION ALL ".join(_entry_sql(n) for n in TABLES) + """),
rules(prefix, theme) AS (VALUES ('o', 'sales'), ('orders', 'orders'), ('line', 'sales'), ('part', 'master'), ('customer', 'master'), ('supplier', 'master'), ('doc', 'text')),
m AS (SELECT e.name, theme, row_number() OVER (PARTITION BY e.name ORDER BY length(prefix) DESC) AS k FROM e JOIN rules ON starts_with(e.name, prefix))
SELECT e.name, time_column, row_count, first, last, coalesce(m.theme, 'outros') AS theme,
       CASE e.name WHEN 'events' THEN 'Stream' WHEN 'documents' THEN 'Corpus' WHEN 'pages' THEN 'Corpus' ELSE upper(e.name) END AS source,
       CASE e.name WHEN 'orders' THEN 'Orders of customers' WHEN 'events' THEN 'User events' WHEN 'pages' THEN 'Web pages' ELSE '' END AS description,
       (SELECT count(*) FROM duckdb_columns() c WHERE c.table_name = e.name)::BIGINT AS n_columns
FROM e LEFT JOIN m ON m.name = e.name AND k = 1
"""
)


@query("catalog_tables", CATALOG_SQL)
def catalog_tables(spark, folder):
    entries = [cat.entry(table(spark, folder, n), n, TIME.get(n)) for n in TABLES]
    out = cat.build(entries, THEMES, SOURCES, MANUAL, GENERATED)
    return out.withColumn("n_columns", F.size("columns").cast("bigint")).drop("columns")


@query("catalog_search", """
SELECT source, doc_id FROM documents
WHERE lang = 'fr' AND contains(regexp_replace(strip_accents(lower(source || ' ' || text || ' ' || lang)), '[^\\x00-\\x7F]', '', 'g'), 'etion')
  AND contains(regexp_replace(strip_accents(lower(source || ' ' || text || ' ' || lang)), '[^\\x00-\\x7F]', '', 'g'), 'eleau')
""")
def catalog_search(spark, folder):
    d = table(spark, folder, "documents")
    target = F.concat("source", F.lit(" "), "text", F.lit(" "), "lang")
    return cat.search(d, "Étion  ÊLEAU", target, F.col("lang"), "FR").select("source", "doc_id")


DESCRIPTIONS = {"o_orderkey": "Order key", "o_totalprice": "Order total, currency units", "o_orderdate": ""}


def _describe_sql() -> str:
    parts = []
    for c, kind in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")):
        shown = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind == "timestamp_ntz" else c
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS type, '{DESCRIPTIONS.get(c, '')}' AS description, count({c}) AS filled, "
                     f"min({shown})::VARCHAR AS lowest, max({shown})::VARCHAR AS highest FROM orders")
    return " UNION ALL ".join(parts)


@query("table_describe", _describe_sql())
def table_describe(spark, folder):
    return cat.describe(table(spark, folder, "orders"), DESCRIPTIONS)


@query("prefix_theme", """
WITH rules(prefix, theme) AS (VALUES ('SMALL', 'a'), ('SMALL BRUSHED', 'b'), ('LARGE', 'c'), ('S', 'd'), ('PROMO', 'e'), ('large', 'f'), ('small', 'g'), ('large brushed', 'h')),
t AS (SELECT p_partkey, p_type FROM part),
m AS (SELECT p_partkey, theme, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS k FROM t JOIN rules ON starts_with(p_type, prefix))
SELECT t.p_partkey, coalesce(theme, 'outros') AS theme FROM t LEFT JOIN m ON m.p_partkey = t.p_partkey AND k = 1
""")
def prefix_theme(spark, folder):
    rules = {"SMALL": "a", "SMALL BRUSHED": "b", "LARGE": "c", "S": "d", "PROMO": "e", "large": "f", "small": "g", "large brushed": "h"}
    return table(spark, folder, "part").select("p_partkey", cat.longest_prefix(F.col("p_type"), rules, cat.OTHER_THEME).alias("theme"))


def described_parts(spark, folder):
    """Part names as columns of tables, described by a dictionary that covers some of them."""
    p = table(spark, folder, "part")
    columns = p.select(F.col("p_brand").alias("tbl"), F.concat(F.lit("Válor "), "p_name").alias("column"))
    json = F.concat(
        F.lit('{"dicionario_simplificado":[{"codigo":" '), F.concat(F.lit("valor_"), F.replace("p_name", F.lit(" "), F.lit("_"))),
        F.lit('","descricao":" '), F.col("p_type"), F.lit(' "}]}'),
    )
    dictionary = dictionary_entries(p.filter("p_size <= 12").select(json.alias("value")))
    return cat.with_descriptions(columns, dictionary)


PARTS_SQL = """
WITH dic AS (SELECT p_name, min(p_type) AS description FROM part WHERE p_size <= 12 GROUP BY 1),
c AS (SELECT p_brand AS tbl, 'Válor ' || p.p_name AS "column", coalesce(dic.description, '') AS description FROM part p LEFT JOIN dic USING (p_name))
"""


@query("column_descriptions", PARTS_SQL + 'SELECT tbl, "column", description FROM c')
def column_descriptions(spark, folder):
    return described_parts(spark, folder)


@query("undescribed", PARTS_SQL + """
SELECT tbl, count(*) AS columns, count(*) FILTER (WHERE description = '') AS undescribed,
       min("column") FILTER (WHERE description = '') AS example FROM c GROUP BY 1
""")
def undescribed(spark, folder):
    return cat.undescribed(described_parts(spark, folder), ["tbl"])


@query("totals_by_source", """
SELECT coalesce(split_part(p_type, ' ', 1), 'TOTAL') AS source, count(*) AS tables, sum(p_size)::BIGINT AS "rows"
FROM part GROUP BY ROLLUP (split_part(p_type, ' ', 1))
""")
def totals_by_source(spark, folder):
    return cat.totals_by(table(spark, folder, "part"), F.split_part("p_type", F.lit(" "), F.lit(1)), "p_size")


def two_sides(spark, folder):
    """Labelled documents as the remote copy; toxic ones have another size there."""
    d = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("table"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".parquet")).alias("key"),
        F.col("n_chars").alias("size"),
    )
    labels = table(spark, folder, "labels")
    remote = d.join(labels, "doc_id").select("table", "key", (F.col("size") + F.col("toxic")).alias("size"))
    return d.select("table", "key", "size"), remote


SIDES_SQL = """
WITH loc AS (SELECT doc_id, source AS "table", source || '/' || doc_id || '.parquet' AS key, n_chars AS size FROM documents),
rem AS (SELECT "table", key, size + toxic AS size FROM loc JOIN labels USING (doc_id))
"""


@query("upload_diff", SIDES_SQL + """
SELECT key, size FROM loc WHERE NOT EXISTS (SELECT 1 FROM rem WHERE rem.key = loc.key AND rem.size = loc.size)
""")
def upload_diff(spark, folder):
    local, remote = two_sides(spark, folder)
    return rec.to_upload(local, remote).select("key", "size")


@query("orphans", SIDES_SQL + """
, small AS (SELECT * FROM loc WHERE size <= 100)
SELECT key FROM rem WHERE key NOT IN (SELECT key FROM small) AND "table" IN (SELECT "table" FROM small) AND ends_with(key, '.parquet')
""")
def orphans(spark, folder):
    local, remote = two_sides(spark, folder)
    return rec.orphans(local.filter("size <= 100"), remote).select("key")


@query("count_reconcile", SIDES_SQL + """
, a AS (SELECT "table", count(*) AS local FROM loc WHERE size > 2000 GROUP BY 1), b AS (SELECT "table", count(*) AS remote FROM rem WHERE size > 2000 GROUP BY 1)
SELECT "table", local, remote, local IS DISTINCT FROM remote AS differs FROM a FULL OUTER JOIN b USING ("table")
""")
def count_reconcile(spark, folder):
    local, remote = two_sides(spark, folder)
    return rec.compare_counts(local.filter("size > 2000"), remote.filter("size > 2000"), ["table"])


@query("sql_limit_flag", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 200 AS truncated
FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200
""")
def sql_limit_flag(spark, folder):
    register_views(spark, folder, ["orders"])
    found = cat.read_only(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey;")
    return cat.limited(found, 200)


def small_lake(spark, folder) -> str:
    """Given tables written as a lake: orders by year in three schemas, events by type, documents by language, nations."""
    root = scratch_path(spark, "lake")
    orders = table(spark, folder, "orders").withColumn("ano", F.year("o_orderdate"))
    variants = (
        orders.filter("ano < 1997").drop("o_orderpriority"), orders.filter("ano between 1997 and 1998"),
        orders.filter("ano > 1998").withColumn("O_TotalPrice", F.col("o_totalprice").cast("string")),
    )
    for df in variants:
        df.repartition("ano").write.mode("append").partitionBy("ano").parquet(f"{root}/curated/orders")
    table(spark, folder, "events").write.partitionBy("event_type").parquet(f"{root}/curated/events")
    table(spark, folder, "documents").select("doc_id", "source", "n_chars", "lang").write.partitionBy("lang").parquet(f"{root}/corpus/documents")
    table(spark, folder, "nation").write.parquet(f"{root}/analytics/nation")
    return root


@query("schema_signatures", """
WITH v AS (SELECT year(o_orderdate) AS ano, CASE
    WHEN year(o_orderdate) < 1997 THEN 'o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderkey:bigint,o_orderstatus:string,o_totalprice:double'
    WHEN year(o_orderdate) < 1999 THEN 'o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string,o_totalprice:double'
    ELSE 'o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string,o_totalprice:string' END AS signature FROM orders)
SELECT signature, count(DISTINCT ano) AS parts, count(*) AS "rows" FROM v GROUP BY 1
""")
def schema_signatures(spark, folder):
    """What the footers of the orders' files say: folders and rows per schema."""
    root = small_lake(spark, folder)
    files = lake.placed(footers(spark, f"{root}/curated/orders"), root)
    return lake.schema_variants(files, ["name"]).select("signature", "parts", "rows")


@query("partition_schema_check", """
WITH v AS (SELECT DISTINCT year(o_orderdate) AS ano, CASE WHEN year(o_orderdate) < 1997 THEN 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate'
    ELSE 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' END AS names FROM orders)
SELECT names, count(*) AS partitions, min(ano) AS first, max(ano) AS last, (SELECT count(DISTINCT names) FROM v) > 1 AS differs FROM v GROUP BY 1
""")
def partition_schema_check(spark, folder):
    """Years whose files hold other columns than those of other years."""
    root = small_lake(spark, folder)
    return lake.partition_variants(lake.placed(footers(spark, f"{root}/curated/orders"), root)).select("names", "partitions", "first", "last", "differs")


LAKE_SQL = """
WITH e(name, layer, by_year, hive, first_year, last_year, time_column, first, last, row_count, n_columns) AS (
  SELECT 'orders', 'curated', true, true, min(year(o_orderdate)), max(year(o_orderdate)), 'o_orderdate',
         strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), count(*), 6 FROM orders
  UNION ALL SELECT 'events', 'curated', false, true, NULL, NULL, 'ts', strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'), count(*), 6 FROM events
  UNION ALL SELECT 'documents', 'corpus', false, true, NULL, NULL, NULL, NULL, NULL, count(*), 4 FROM documents
  UNION ALL SELECT 'nation', 'analytics', false, false, NULL, NULL, NULL, NULL, NULL, count(*), 3 FROM nation)
"""


def lake_entries(spark, folder):
    root = small_lake(spark, folder)
    found = lake.entries(lake.placed(footers(spark, root), root), root, {"orders": "o_orderdate", "events": "ts"})
    return cat.build([found], THEMES, SOURCES, MANUAL, GENERATED)


@query("lake_catalog", LAKE_SQL + """
SELECT name, layer, by_year, hive, first_year, last_year, time_column, first, last, row_count, n_columns FROM e
""")
def lake_catalog(spark, folder):
    """Catalogue entries with layer, folders, years, period and rows, without reading any data."""
    names = ["name", "layer", "by_year", "hive", "first_year", "last_year", "time_column", "first", "last", "row_count"]
    return lake_entries(spark, folder).select(*names, F.size("columns").alias("n_columns"))


@query("lake_listing", LAKE_SQL + """
SELECT 'Stream' AS source, 1::BIGINT AS tables, '- events (' || format('{:,}', row_count) || ' linhas · ' || first[:10] || ' a ' || last[:10] || '): User events' AS lines FROM e WHERE name = 'events'
UNION ALL
SELECT 'ORDERS', 1, '- orders (' || format('{:,}', row_count) || ' linhas · ' || first[:10] || ' a ' || last[:10] || ' · particionada por ano): Orders of customers' FROM e WHERE name = 'orders'
""")
def lake_listing(spark, folder):
    """Tables whose name, description or theme hold the words, by source."""
    return lake.listing(lake_entries(spark, folder), "ÉR  s")
