"""Corpus maintenance, chunks and retrieval over ``documents``, ``pages``, ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, html as hx, text as tx
from ..operators import corpus as co, index as ix, search as se
from ..session import materialize
from ..sources.feeds import feed_items
from ..sources.tables import table
from .registry import query

LIMIT = 5000


def docs(spark, folder):
    d = table(spark, folder, "documents")
    return d.withColumn("url", F.concat(F.lit("https://docs.example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")))


URLS = "SELECT *, 'https://docs.example.org/' || source || '/' || doc_id AS url FROM documents"
CUT = "CASE WHEN length(text) > 5000 THEN substring(text, 1, 5000) || chr(10) || chr(10) || '[... documento truncado em 5,000 caracteres ...]' ELSE text END"


@query("doc_quality_gate", """
SELECT source, count(*) FILTER (WHERE length(text) >= 300) AS kept, count(*) FILTER (WHERE length(text) < 300) AS dropped FROM documents GROUP BY 1
""")
def doc_quality_gate(spark, folder):
    n = F.char_length("text")
    return table(spark, folder, "documents").groupBy("source").agg(
        F.count_if(n >= co.MIN_CHARS).alias("kept"), F.count_if(n < co.MIN_CHARS).alias("dropped")
    )


@query("doc_truncate", f"""
SELECT doc_id, length(t) AS chars, sha256(t) AS sha256 FROM (SELECT doc_id, {CUT} AS t FROM documents)
""")
def doc_truncate(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", co.cut(F.col("text"), LIMIT).alias("t"))
    return d.select("doc_id", F.char_length("t").cast("bigint").alias("chars"), co.sha(F.col("t")).alias("sha256"))


@query("doc_title_rescue", """
WITH d AS (
  SELECT doc_id, CASE WHEN lang = 'en' THEN source || '  document  title' ELSE 'L' || doc_id END AS title,
         CASE WHEN lang IN ('fr', 'en') THEN 'LEI **Nº ' || doc_id || ', DE 7 DE JANEIRO DE 2022 ' || text ELSE text END AS text FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t,
  regexp_extract(regexp_replace(text, '[*_\\[\\]\\s]+', ' ', 'g'),
   '\\b((?:LEI|DECRETO|MEDIDA PROVIS[ÓO]RIA|RESOLU[ÇC][ÃA]O NORMATIVA|PORTARIA)(?: COMPLEMENTAR)?\\s+N[º°o.]\\s*[\\d.]+,?\\s+DE\\s+\\d{1,2}[º°]?\\s+DE\\s+\\w+\\s+DE\\s+\\d{4})', 1) AS act FROM d)
SELECT doc_id, CASE WHEN (length(t) < 12 OR regexp_full_match(t, '[A-Za-z]?\\d+\\w*')) AND act <> '' THEN act ELSE t END AS title FROM n
""")
def doc_title_rescue(spark, folder):
    d = table(spark, folder, "documents")
    key = F.col("doc_id").cast("string")
    title = F.when(F.col("lang") == "en", F.concat("source", F.lit("  document  title"))).otherwise(F.concat(F.lit("L"), key))
    text = F.when(
        F.col("lang").isin("fr", "en"), F.concat(F.lit("LEI **Nº "), key, F.lit(", DE 7 DE JANEIRO DE 2022 "), "text")
    ).otherwise(F.col("text"))
    return d.select("doc_id", co.rescued_title(title, text).alias("title"))


@query("dictionary_text_title", """
SELECT doc_id, CASE WHEN lang = 'de' THEN source ELSE 'Dicionario De Dados ' || upper(substring(source, 1, 1)) || substring(source, 2) END AS title,
       trim(regexp_replace(split_part(text, '.', 1), '\\s+', ' ', 'g')) AS description FROM documents
""")
def dictionary_text_title(spark, folder):
    head = F.when(F.col("lang") == "de", F.lit("sem titulo")).otherwise(F.concat(F.lit("DICIONARIO DE DADOS "), F.upper("source")))
    body = F.concat(
        F.lit("Página 1\n"), head, F.lit("\nDescrição do Dado: "), F.split_part("text", F.lit("."), F.lit(1)), F.lit("\n \nDescrição Código\nX"),
    )
    d = table(spark, folder, "documents").select("doc_id", "source", body.alias("t"))
    return d.select(
        "doc_id", co.dictionary_title(F.col("t"), F.col("source")).alias("title"), co.dictionary_description(F.col("t")).alias("description")
    )


def run(spark, folder):
    """A collection run: labelled documents are known, those of low quality in an older version."""
    d = docs(spark, folder)
    known = d.join(table(spark, folder, "labels"), "doc_id").select(
        "url", co.sha(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" old")))).alias("sha256")
    )
    return co.upsert(d, known, F.col("text")), known


RUN_SQL = f"""
WITH d AS (SELECT doc_id, source, url, t, CASE WHEN length(t) >= 300 THEN sha256(t) END AS sha, quality, text
           FROM (SELECT u.*, text AS t, quality FROM ({URLS}) u LEFT JOIN labels USING (doc_id))),
m AS (SELECT *, CASE WHEN quality = 1 THEN sha256(t) WHEN quality = 0 THEN sha256(text || ' old') END AS old FROM d),
s AS (SELECT *, CASE WHEN sha IS NULL THEN 'too_short' WHEN old IS NULL THEN 'new' WHEN old = sha THEN 'unchanged' ELSE 'changed' END AS status FROM m)
"""


@query("doc_changed_only", RUN_SQL + "SELECT url, sha AS sha256, status FROM s WHERE status IN ('new', 'changed')")
def doc_changed_only(spark, folder):
    outcome, _ = run(spark, folder)
    return outcome.changes.select("url", "sha256", "status")


@query("doc_state_latest", RUN_SQL + """
, st AS (SELECT url, CASE WHEN status IN ('new', 'changed') THEN sha ELSE old END AS sha256 FROM s WHERE old IS NOT NULL OR status IN ('new', 'changed'))
SELECT sha256, max(url) AS url, substring(sha256, 1, 16) AS doc_id FROM st GROUP BY 1
""")
def doc_state_latest(spark, folder):
    """State after the run; contents shared by several URLs are stored once, under the last URL."""
    outcome, known = run(spark, folder)
    after = co.next_state(known, outcome.changes.select("url", "sha256"))
    return co.content_keys(after.withColumn("seq", F.col("url")), "sha256", "seq", ["url"])


@query("ingest_counters", RUN_SQL + """
SELECT source, count(*) FILTER (WHERE status IN ('new', 'changed')) AS new_or_changed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged,
       count(*) FILTER (WHERE status = 'too_short') AS too_short FROM s GROUP BY 1
""")
def ingest_counters(spark, folder):
    outcome, _ = run(spark, folder)
    return outcome.counters()


ARRIVALS_SQL = """
WITH a AS (SELECT 'https://docs.example.org/' || source AS url, source, doc_id, text, CASE WHEN length(text) >= 300 THEN sha256(text) END AS sha FROM documents),
p AS (SELECT *, last_value(sha IGNORE NULLS) OVER (PARTITION BY url ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM a),
s AS (SELECT *, CASE WHEN sha IS NULL THEN 'too_short' WHEN old IS NULL THEN 'new' WHEN old = sha THEN 'unchanged' ELSE 'changed' END AS status FROM p)
"""


def arrivals(spark, folder):
    """A run in which a URL arrives many times: all documents of a source are versions of one page."""
    d = table(spark, folder, "documents").withColumn("url", F.concat(F.lit("https://docs.example.org/"), "source"))
    none = d.select("url", F.lit(None).cast("string").alias("sha256")).limit(0)
    return co.upsert(d, none, F.col("text"), order="doc_id"), none


@query("arrival_status", ARRIVALS_SQL + "SELECT doc_id, status FROM s")
def arrival_status(spark, folder):
    return arrivals(spark, folder)[0].marked.select("doc_id", "status")


@query("docs_current", ARRIVALS_SQL + """
, l AS (SELECT url, arg_max(sha, doc_id) AS sha FROM s WHERE status IN ('new', 'changed') GROUP BY 1)
SELECT doc_id, sha AS sha256 FROM s WHERE status IN ('new', 'changed') AND sha IN (SELECT sha FROM l)
""")
def docs_current(spark, folder):
    """Stored versions that are the current content of some URL."""
    outcome, none = arrivals(spark, folder)
    changes = outcome.changes.select("url", "sha256", "doc_id")
    return co.current_documents(changes, co.next_state(none, changes, order="doc_id")).select("doc_id", "sha256")


@query("page_links", """
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target, count(*) AS n FROM l GROUP BY ALL
""")
def page_links(spark, folder):
    p = table(spark, folder, "pages").select("page_id", "url", F.explode(hx.hrefs(F.col("html"))).alias("href"))
    return p.groupBy("page_id", "href", tx.resolve_url(F.col("url"), F.col("href")).alias("target")).agg(F.count("*").alias("n"))


@query("page_text")
def page_text(spark, folder):
    """Title and cleaned main text of every page. The HTML parser has no SQL twin."""
    parsed = hx.pages_to_text(table(spark, folder, "pages"), block="article")
    return parsed.select("page_id", "title", hx.clean_text(F.col("text")).alias("text"))


@query("frontier_bounded", """
WITH RECURSIVE l AS (SELECT regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS l FROM pages),
edges AS (SELECT DISTINCT l[1] AS src, unnest(l[2:]) AS dst FROM l WHERE len(l) > 1),
seeds AS (SELECT src AS url FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
b AS (SELECT url, 0 AS depth FROM seeds UNION SELECT dst, depth + 1 FROM b JOIN edges ON src = url WHERE depth < 30)
SELECT url, min(depth) AS depth FROM b GROUP BY 1 ORDER BY depth, url LIMIT 60
""")
def frontier_bounded(spark, folder):
    """Bounded crawl over the link words of ``pages``: the first link of a page leads to its others."""
    links = table(spark, folder, "pages").select(hx.hrefs(F.col("html")).alias("l")).filter(F.size("l") > 1)
    edges = materialize(links.select(F.col("l")[0].alias("src"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("dst")).distinct(), "edges")
    seeds = edges.groupBy("src").count().orderBy(F.col("count").desc(), "src").limit(3).select(F.col("src").alias("url"))
    return co.bounded_crawl(edges, seeds, max_pages=60)


@query("headline_filter", """
WITH f AS (SELECT doc_id, trim(split_part(text, '.', 1)) AS title, 'https://docs.example.org/' || doc_id AS link, source FROM documents)
SELECT link, title, 'Manchete: ' || title || chr(10) || 'Veículo: ' || source || chr(10) || 'Publicada em: Mon, 01 Jan 2024' || chr(10)
       || 'Link para a matéria original: ' || link AS text
FROM f WHERE title <> '' AND regexp_matches(title, 'éÇ|TION|gera[çc]', 'i')
""")
def headline_filter(spark, folder):
    """Each document as an RSS feed of one item; only items on topic become documents."""
    d = table(spark, folder, "documents")
    escaped = F.split_part("text", F.lit("."), F.lit(1))
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(coded))
    item = F.concat(
        F.lit("<rss><channel><title>"), "source", F.lit("</title><item><title>"), escaped, F.lit("</title><link>https://docs.example.org/"),
        F.col("doc_id").cast("string"), F.lit("</link><pubDate>Mon, 01 Jan 2024</pubDate></item></channel></rss>"),
    )
    feeds = d.select(F.concat(F.lit("https://"), "source", F.lit(".example.org/feed")).alias("feed"), item.alias("xml"))
    return co.headlines(feed_items(feeds), "éÇ|TION|gera[çc]").select("link", F.trim("title").alias("title"), "text")


@query("rows_to_documents", """
SELECT 'https://data.example.org/c#' || c_custkey AS url, substring('Cliente ' || c_name || ' (' || c_mktsegment || ')', 1, 30) AS title,
       'Cliente ' || c_name || ', saldo ' || CASE WHEN c_acctbal > 0 THEN regexp_replace(c_acctbal::VARCHAR, '\\.0$', '') ELSE '' END || '.' || chr(10) || 'Segmento: ' || c_mktsegment AS text,
       substring(sha256('Cliente ' || c_name || ', saldo ' || CASE WHEN c_acctbal > 0 THEN regexp_replace(c_acctbal::VARCHAR, '\\.0$', '') ELSE '' END || '.' || chr(10) || 'Segmento: ' || c_mktsegment), 1, 16) AS doc_id
FROM customer
""")
def rows_to_documents(spark, folder):
    c = table(spark, folder, "customer")
    text = co.template(["Cliente ", F.col("c_name"), ", saldo ", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), ".\nSegmento: ", F.col("c_mktsegment")])
    return c.select(
        co.template(["https://data.example.org/c#", F.col("c_custkey")]).alias("url"),
        F.substring(co.template(["Cliente ", F.col("c_name"), " (", F.col("c_mktsegment"), ")"]), 1, 30).alias("title"), text.alias("text"),
    ).withColumn("doc_id", co.doc_id(co.sha(F.col("text"))))


# ---- index and search


@query("doc_chunks")
def doc_chunks(spark, folder):
    """Chunks of every document with the text that is embedded."""
    d = docs(spark, folder).select("doc_id", F.col("source").alias("title"), "text")
    chunks = chunking.chunks_of(d)
    return chunks.withColumn("embed_text", ix.embed_input(F.col("title"), F.col("text")))


@query("embed_default")
def embed_default(spark, folder):
    """Default embedding of every chunk."""
    chunks = doc_chunks(spark, folder).select("doc_id", "chunk", "embed_text")
    return ix.hashing_embedder(256)(chunks, "embed_text", "vector").drop("embed_text")


QUESTION = "O que diz a Lei 14.300 sobre tionement, eaux e verein? leaux"


@query("query_terms", """
WITH f AS (SELECT conv_id, turn, regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g') AS x FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(x, '[a-z0-9][a-z0-9./-]*'), lambda w: (length(w) >= 5 OR regexp_matches(w, '[0-9]'))
        AND w NOT IN ('sobre', 'quais', 'qual', 'como', 'quando', 'onde', 'define', 'definicao', 'diz', 'para', 'pelo', 'pela', 'entre', 'segundo',
                      'ultimas', 'noticias', 'energia', 'eletrica', 'setor', 'lei')) AS w FROM f),
p AS (SELECT conv_id, turn, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t)
SELECT conv_id, turn, trim(w, '.') AS term FROM p GROUP BY ALL
""")
def query_terms(spark, folder):
    c = table(spark, folder, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.explode(tx.terms(F.col("text"))).alias("term"))


LEX_SQL = " + ".join(
    f"contains(regexp_replace(strip_accents(lower(source || ' ' || text)), '[^\\x00-\\x7F]', '', 'g'), '{t}')::INT"
    for t in ("14.300", "tionement", "verein", "leaux")
)


def question_terms(spark):
    """Terms of the constant question, a few words."""
    return spark.range(1).select(tx.terms(F.lit(QUESTION)).alias("t")).first().t


@query("lexical_score", f"SELECT doc_id, ({LEX_SQL}) / 4.0::DOUBLE AS share FROM documents")
def lexical_score(spark, folder):
    folded = tx.fold(F.concat_ws(" ", "source", "text"))
    return table(spark, folder, "documents").select("doc_id", tx.lexical_share(folded, question_terms(spark)).alias("share"))


def query_vector(spark, folder):
    """The vector with the lowest id plays the embedded question."""
    e = table(spark, folder, "embeddings")
    return e.agg(F.min_by("embedding", "vec_id")).first()[0]


COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 1e-9) / greatest(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 1e-9)"


@query("vector_topk", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round({COS}, 6) AS cosine FROM embeddings e, q ORDER BY cosine DESC, vec_id LIMIT 25
""")
def vector_topk(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    scored = se.cosine(e, "embedding", query_vector(spark, folder)).withColumn("cosine", F.round("cosine", 6))
    return se.top_k(scored, "cosine", 25, ["vec_id"])


@query("vector_cosine_all", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round({COS}, 6) AS cosine FROM embeddings e, q
""")
def vector_cosine_all(spark, folder):
    """Every vector's cosine as a plain expression."""
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.round(se.cosine_column(F.col("embedding"), query_vector(spark, folder)), 6).alias("cosine"))


@query("hybrid_topk_cap3", f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (
  SELECT d.doc_id, d.source, d.lang, e.vec_id, round({COS} + 0.15 * (({LEX_SQL}) / 4.0::DOUBLE), 6) AS score
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, q WHERE contains(lower(d.source), 'src1') AND d.lang IN ('fr', 'de', 'en', 'es')),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, vec_id) AS k FROM s),
t AS (SELECT * FROM r WHERE k <= 3 ORDER BY score DESC, vec_id LIMIT 8)
SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score,
  '[' || row_number() OVER (ORDER BY score DESC, vec_id) || '] ' || source || ' — ' || source || ' (' || lang || '), coletado em 2024-01-01, relevância '
  || format('{{:.2f}}', score) || chr(10) || 'URL: https://docs.example.org/' || source || '/' || doc_id || chr(10) || lang AS block FROM t
""")
def hybrid_topk_cap3(spark, folder):
    """Chunks are vectors of documents; a source stands for the document that may appear three times."""
    wanted = se.facets(docs(spark, folder), agency="SRC1", agency_column="source")
    folded = tx.fold(F.concat_ws(" ", "source", "text"))
    lexical = tx.lexical_share(folded, question_terms(spark))
    small = wanted.select("doc_id", "source", "lang", "url", lexical.alias("lexical"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id"), "embedding")
    cosines = se.cosine(vectors, "embedding", query_vector(spark, folder))
    scored = cosines.join(small, F.col("vec_id") == F.col("doc_id")).withColumn(
        "score", F.round(F.col("cosine") + se.LEXICAL_WEIGHT * F.col("lexical"), 6)
    )
    best = se.capped_top_k(scored, "score", 8, "source", ["vec_id"])
    c = F.col
    return se.rendered(best, "score", ["vec_id"], c("source"), c("source"), c("lang"), F.lit("2024-01-01"), c("url"), c("lang")).select(
        "rank", "vec_id", "score", "block"
    )


@query("index_integrity", """
WITH m AS (SELECT doc_id // 100 AS shard, count(*) AS texts FROM documents GROUP BY 1),
v AS (SELECT vec_id // 100 AS shard, count(*) AS vectors FROM embeddings WHERE label <> 3 OR vec_id >= 200 GROUP BY 1)
SELECT shard, texts, vectors FROM m JOIN v USING (shard) WHERE texts = vectors
""")
def index_integrity(spark, folder):
    meta = table(spark, folder, "documents").select(F.floor(F.col("doc_id") / 100).alias("shard"))
    vectors = table(spark, folder, "embeddings").filter("label <> 3 or vec_id >= 200").select(F.floor(F.col("vec_id") / 100).alias("shard"))
    return ix.whole_sources(meta, vectors, ["shard"])


@query("positional_pairs", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)
SELECT p_partkey, i::BIGINT AS pos, a[i + 1] AS "left", b[i + 1] AS "right" FROM w, (SELECT unnest(range(0, 8)) AS i) WHERE i < len(a) AND i < len(b)
""")
def positional_pairs(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))
    return ix.pair_by_position(p, p, ["p_partkey"], "a", "b").withColumn("pos", F.col("pos").cast("bigint"))


@query("signature_changed", """
WITH c AS (SELECT source, sha256(text) AS sha FROM documents GROUP BY ALL),
i AS (SELECT DISTINCT source, sha256(text) AS sha FROM documents LEFT JOIN labels USING (doc_id) WHERE source < 'src15' OR quality IS NOT NULL),
b AS (SELECT coalesce(c.source, i.source) AS source, c.sha AS cs, i.sha AS isha FROM c FULL OUTER JOIN i ON c.source = i.source AND c.sha = i.sha)
SELECT source, count(cs) AS current, count(isha) AS indexed, count(*) FILTER (WHERE cs IS NULL OR isha IS NULL) AS differing,
       count(*) FILTER (WHERE cs IS NULL OR isha IS NULL) > 0 AS changed FROM b GROUP BY 1
""")
def signature_changed(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", co.sha(F.col("text")).alias("sha"))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    indexed = d.join(labels, "doc_id", "left").filter("source < 'src15' or quality is not null")
    return ix.changed_sources(d.drop("doc_id"), indexed, doc="sha")


@query("corpus_totals", """
SELECT count(DISTINCT source) AS sources, count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS lines,
       (SELECT count(*) FROM embeddings) AS vectors FROM documents
""")
def corpus_totals(spark, folder):
    d = table(spark, folder, "documents").groupBy("source").agg(
        F.count("*").alias("d"), F.sum(F.size(F.split("text", "\n"))).alias("l")
    )
    vectors = table(spark, folder, "embeddings").agg(F.count("*"))
    return d.agg(F.count("*").alias("sources"), F.sum("d").alias("documents"), F.sum("l").alias("lines")).withColumn("vectors", vectors.scalar())
