"""Inventory, duplicates and resource choice over paths and names derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup, select as sel
from ..sources import files
from ..sources.tables import table
from .registry import query

HOME = {"en": "data/raw/en/", "fr": "dados/ons/", "de": "dados/rio_ev/x/"}


def doc_files(spark, folder, with_text=False):
    """Documents as files of a copied folder: path, size and, if asked for, content."""
    home = F.lit("outros/")
    for lang, p in reversed(HOME.items()):
        home = F.when(F.col("lang") == lang, p).otherwise(home)
    ending = F.when(F.col("n_chars") % 2 == 0, ".csv").otherwise(".parquet")
    d = table(spark, folder, "documents")
    return d.select(
        "doc_id", F.concat(home, "source", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"), *(["text"] if with_text else []),
    )


FILES_SQL = """
WITH fl AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'data/raw/en/' WHEN 'fr' THEN 'dados/ons/' WHEN 'de' THEN 'dados/rio_ev/x/' ELSE 'outros/' END
         || source || '_' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '.csv' ELSE '.parquet' END AS path,
         strlen(text)::BIGINT AS bytes, text FROM documents),
h AS (
  SELECT doc_id, path, bytes, CASE WHEN count(*) OVER (PARTITION BY bytes) > 1 THEN sha256(text) END AS sha256 FROM fl),
cn AS (
  SELECT *, CASE WHEN sha256 IS NULL THEN path ELSE first_value(path) OVER (PARTITION BY sha256 ORDER BY
    CASE WHEN starts_with(path, 'data/') THEN 0 WHEN starts_with(path, 'dados/ons/') THEN 1 WHEN starts_with(path, 'dados/rio_ev/') THEN 2
         WHEN starts_with(path, 'dados/data/') THEN 3 ELSE 4 END, length(path), path) END AS canonical FROM h)
"""


def hashed(spark, folder):
    return dedup.hash_repeated(doc_files(spark, folder, with_text=True), "bytes", F.col("text")).drop("text")


@query("file_inventory")
def file_inventory(spark, folder):
    """Files of the folder itself; paths and sizes only."""
    return files.inventory(spark, folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "extension", "bytes")


@query("doc_size_prefilter_dups", FILES_SQL + "SELECT doc_id, bytes, sha256 FROM h")
def doc_size_prefilter_dups(spark, folder):
    return hashed(spark, folder).select("doc_id", "bytes", "sha256")


@query("dup_canonical", FILES_SQL + "SELECT path, canonical, path <> canonical AS duplicate FROM cn")
def dup_canonical(spark, folder):
    return dedup.canonical_paths(hashed(spark, folder)).select("path", "canonical", "duplicate")


@query("dedup_summary", FILES_SQL + """
SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER (WHERE path <> canonical) AS duplicates,
       coalesce(sum(bytes) FILTER (WHERE path <> canonical), 0)::BIGINT AS duplicate_bytes,
       count(*) FILTER (WHERE path = canonical) AS unique_files, sum(bytes) FILTER (WHERE path = canonical)::BIGINT AS unique_bytes
FROM cn
""")
def dedup_summary(spark, folder):
    keyed = hashed(spark, folder).withColumn("key", F.coalesce("sha256", F.concat(F.lit("single:"), "path")))
    return dedup.summary(keyed, "key", "bytes")


@query("raw_selection", FILES_SQL + """
SELECT path, 'raw/' || substring(path, length('data/raw/') + 1) AS key FROM cn
WHERE path = canonical AND starts_with(path, 'data/raw/') AND NOT ends_with(path, '7.csv') AND NOT ends_with(path, '.tmp')
  AND NOT contains(substring(path, length('data/raw/en/') + 1), '/')
""")
def raw_selection(spark, folder):
    marked = dedup.canonical_paths(hashed(spark, folder))
    chosen = dedup.raw_selection(marked, "data/raw/", ["7.csv", ".tmp"], "raw/")
    return files.direct_children(chosen, "data/raw/en/").select("path", "key")


# ---- choice of resources


def resources(spark, folder):
    """Documents as resources of datasets: several formats of the same name."""
    fmt = F.element_at(F.array(*[F.lit(f) for f in ("parquet", "csv", "zip", "pdf", "CSV")]), (F.col("n_chars") % 5 + 1).cast("int"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("pos"), F.col("source").alias("dataset"), "lang",
        F.concat("source", F.lit("-"), "lang", F.lit("-"), (2000 + F.col("n_chars") % 30).cast("string"), F.lit("."), fmt).alias("name"),
        F.concat(F.lit("https://portal.example.org/"), "source", F.lit("/download/"), F.col("doc_id").cast("string")).alias("url"),
        F.lower(fmt).alias("format"), F.col("n_chars").alias("size"),
    )


RES_SQL = """
WITH r0 AS (
  SELECT doc_id AS pos, source AS dataset, lang, n_chars AS size, ['parquet', 'csv', 'zip', 'pdf', 'CSV'][n_chars % 5 + 1] AS fmt, * EXCLUDE (lang, source) FROM documents),
r AS (
  SELECT pos, dataset, lang, size, dataset || '-' || lang || '-' || (2000 + n_chars % 30) || '.' || fmt AS name,
         'https://portal.example.org/' || dataset || '/download/' || pos AS url, lower(fmt) AS format FROM r0)
"""


@query("best_format", RES_SQL + """
, k AS (SELECT *, lower(trim(regexp_replace(name, '\\.(csv|parquet|zip)|\\s+(CSV|PARQUET|ZIP)$', '', 'gi'))) AS key FROM r WHERE format IN ('parquet', 'zip', 'csv'))
SELECT key, name, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE format WHEN 'parquet' THEN 0 WHEN 'zip' THEN 1 ELSE 2 END, pos) AS n FROM k) WHERE n = 1
""")
def best_format(spark, folder):
    r = resources(spark, folder).filter(F.col("format").isin(*sel.FORMAT_PREFERENCE))
    keyed = r.withColumn("key", F.lower(sel.base_name(F.col("name"))))
    return sel.preferred(keyed, ["key"], sel.rank_in(F.col("format"), sel.FORMAT_PREFERENCE), "pos", ["name", "pos"])


@query("best_period", RES_SQL + """
, k AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM r WHERE format IN ('parquet', 'csv'))
SELECT stem, name FROM (
  SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE format WHEN 'parquet' THEN 0 ELSE 1 END, pos) AS n FROM k) WHERE n = 1
""")
def best_period(spark, folder):
    r = resources(spark, folder).filter(F.col("format").isin("parquet", "csv"))
    keyed = r.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    return sel.preferred(keyed, ["stem"], sel.rank_in(F.col("format"), ("parquet", "csv")), "pos", ["name"])


@query("format_detect", RES_SQL + """
, t AS (SELECT pos, format, CASE WHEN size % 3 = 0 THEN '' ELSE format END AS declared, url, name FROM r),
c AS (SELECT *, lower(declared || ' ' || url || ' ' || name) AS x FROM t)
SELECT pos, CASE WHEN regexp_matches(x, '\\bcsv\\b|\\.csv') THEN 'csv' WHEN regexp_matches(x, '\\bxlsx\\b|\\.xlsx') THEN 'xlsx'
  WHEN regexp_matches(x, '\\bpdf\\b|\\.pdf') THEN 'pdf' WHEN regexp_matches(x, '\\bjson\\b|\\.json') THEN 'json'
  WHEN regexp_matches(x, '\\bxml\\b|\\.xml') THEN 'xml' WHEN regexp_matches(x, '\\bzip\\b|\\.zip') THEN 'zip'
  WHEN declared <> '' THEN declared ELSE '?' END AS format FROM c
""")
def format_detect(spark, folder):
    declared = F.when(F.col("size") % 3 == 0, "").otherwise(F.col("format"))
    return resources(spark, folder).select("pos", sel.detect_format(declared, F.col("url"), F.col("name")).alias("format"))


@query("budget_cross", RES_SQL + """
, s AS (SELECT dataset, pos, size, coalesce(sum(size) OVER (PARTITION BY dataset ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r)
SELECT dataset, pos, size FROM s WHERE b <= 30000
""")
def budget_cross(spark, folder):
    r = resources(spark, folder).select("dataset", "pos", "size")
    newest = -F.floor(F.col("pos") / 4096)
    return sel.budget_crossing(r, ["dataset"], [F.col("pos").desc()], newest, "size", 30_000)


@query("budget_greedy", RES_SQL.replace("WITH r0", "WITH RECURSIVE r0") + """
, o AS (SELECT dataset, pos, size, row_number() OVER (PARTITION BY dataset ORDER BY pos DESC) AS i FROM r),
g AS (
  SELECT dataset, pos, size, i, size AS total, true AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.dataset, o.pos, o.size, o.i, CASE WHEN g.total + o.size > 30000 THEN g.total ELSE g.total + o.size END, g.total + o.size <= 30000
  FROM g JOIN o ON o.dataset = g.dataset AND o.i = g.i + 1)
SELECT dataset, pos, size FROM g WHERE kept
""")
def budget_greedy(spark, folder):
    r = resources(spark, folder).select("dataset", "pos", "size")
    return sel.budget_greedy(r, ["dataset"], -F.col("pos"), -F.floor(F.col("pos") / 4096), "size", 30_000)


@query("latest_year_sort", RES_SQL + """
SELECT pos, name, coalesce(regexp_extract_all(name || url, '20\\d\\d')[-1], '0') AS token FROM r ORDER BY token DESC, pos
""")
def latest_year_sort(spark, folder):
    token = sel.last_year_token(F.concat("name", "url"))
    return resources(spark, folder).select("pos", "name", token.alias("token")).orderBy(F.col("token").desc(), "pos")


@query("largest_group", RES_SQL + """
, s AS (SELECT dataset, lang, sum(size)::BIGINT AS bytes, count(*) AS files FROM r GROUP BY 1, 2)
SELECT dataset, lang, bytes, files FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY bytes DESC, lang) AS n FROM s) WHERE n = 1
""")
def largest_group(spark, folder):
    return sel.largest_option(resources(spark, folder), ["dataset"], "lang", "size")


@query("url_route", """
WITH u AS (SELECT page_id, split_part(url, '#', 1) AS url FROM pages),
c AS (SELECT *, lower(url) AS x FROM u)
SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  CASE WHEN regexp_matches(x, '/login|/busca|\\?print|/rss|\\.(jpg|jpeg|png|gif|zip|mp4|xlsx?|csv)$|/@@|sendto_form|folder_factories|facebook|twitter|linkedin|whatsapp|youtube|instagram|spam-farm') THEN 'skip'
       WHEN regexp_matches(x, '\\.html$') THEN 'pdf'
       WHEN regexp_matches(x, '/(en|fr)/') AND regexp_matches(x, '[?&](b_start|page|pagina|p_p_id)[:=]|/noticias/?$|/dataset/?(\\?.*)?$|/publicacoes/?$') THEN 'index'
       WHEN regexp_matches(x, '/(en|fr)/') THEN 'follow' ELSE 'none' END AS route
FROM c
""")
def url_route(spark, folder):
    url = tx.without_fragment(F.col("url"))
    way = sel.route(F.col("url"), allow=[r"/(en|fr)/"], pdfs=[r"\.html$"], deny=[*sel.DENY, "spam-farm"])
    return table(spark, folder, "pages").select("page_id", url.alias("url")).select(
        "page_id", "url", tx.url_host(F.col("url")).alias("host"), way.alias("route")
    )


@query("resource_filter", RES_SQL + """
SELECT pos, name FROM r WHERE regexp_matches(name || ' ' || split_part(url, '/', -1), 'SRC1\\d?-(en|fr)', 'i') AND NOT regexp_matches(name, '\\.pdf|dicion', 'i')
  AND NOT regexp_matches(name, 'dicion|metadad|layout|^DM -', 'i')
""")
def resource_filter(spark, folder):
    hits = sel.data_resources(resources(spark, folder), r"SRC1\d?-(en|fr)")
    return hits.filter(~F.col("name").rlike(r"(?i)\.pdf|dicion")).select("pos", "name")


@query("dictionary_choice", RES_SQL + """
, d AS (SELECT *, CASE WHEN lang = 'es' THEN 'Dicionário ' || name ELSE name END AS nm FROM r)
SELECT dataset, nm AS name, url FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos) AS n FROM d
  WHERE regexp_matches(nm, 'src\\d+-(es|fr)', 'i')
    AND (regexp_matches(nm || url, 'dicion|metadad|layout|DM -', 'i') OR (format = 'pdf' AND NOT regexp_matches(nm, 'csv|xlsx', 'i')))) WHERE n = 1
""")
def dictionary_choice(spark, folder):
    named = F.when(F.col("lang") == "es", F.concat(F.lit("Dicionário "), "name")).otherwise(F.col("name"))
    r = resources(spark, folder).withColumn("name", named)
    return sel.dictionary_choice(r, ["dataset"], r"src\d+-(es|fr)")


@query("derived_names", """
WITH n AS (
  SELECT p_partkey AS pos, 'siget_' || substring(trim(regexp_replace(regexp_replace(strip_accents(lower(
    trim(regexp_replace(p_type || ' ' || p_brand || 'ã.csv', '\\.(csv|parquet|zip)|\\s+(CSV|PARQUET|ZIP)$', '', 'gi')))), '[^\\x00-\\x7F]', '', 'g'),
    '[^a-z0-9]+', '_', 'g'), '_'), 1, 20) AS name, p_name FROM part)
SELECT name, p_name AS first_name, pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM n) WHERE k = 1
""")
def derived_names(spark, folder):
    raw = F.concat("p_type", F.lit(" "), "p_brand", F.lit("ã.csv"))
    named = table(spark, folder, "part").select(
        F.col("p_partkey").alias("pos"), sel.table_name("siget", raw, 20).alias("name"), F.col("p_name").alias("first_name")
    )
    return sel.first_per_key(named, ["name"], "pos", ["first_name", "pos"])


@query("seed_urls", """
SELECT p_partkey, 'https://docs.example.org/' || replace(url_encode(p_name || ' (' || p_type || ')/é~*+'), '%2F', '/') AS url FROM part
""")
def seed_urls(spark, folder):
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")/é~*+"))
    return table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("https://docs.example.org/"), tx.url_quote(name)).alias("url")
    )
