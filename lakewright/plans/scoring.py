"""Answers, labels, routes and sessions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, text as tx
from ..operators import qa_eval as qa
from ..sources.tables import table
from .registry import query


@query("extract_numbers", """
WITH x AS (SELECT doc_id, regexp_extract_all(text, '\\d[\\d.,]*') AS f FROM documents),
u AS (SELECT doc_id, unnest(f) AS raw, generate_subscripts(f, 1) AS i FROM x),
t AS (SELECT doc_id, i, rtrim(raw, '.,') AS t FROM u),
v AS (SELECT doc_id, i, TRY_CAST(CASE WHEN contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.')
        WHEN length(t) - length(replace(t, '.', '')) > 1 OR regexp_full_match(t, '\\d{1,3}(\\.\\d{3})+') THEN replace(t, '.', '') ELSE t END AS DOUBLE) AS value FROM t)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, value FROM v WHERE value IS NOT NULL
""")
def extract_numbers(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.posexplode(tx.numbers(F.col("text"))).alias("pos", "value"))
    return d.withColumn("pos", F.col("pos").cast("bigint"))


def answers(spark, folder):
    """An answer per order: a number, a passage or the admission that there is none."""
    price = parse.format_comma(F.col("o_totalprice"), 1)
    kind = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "number")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "text").otherwise("gap")
    )
    said = (
        F.when(kind == "number", F.concat(F.lit("Em 2024 o total foi "), F.when(F.col("o_orderstatus") == "P", F.lit("12,5")).otherwise(price), F.lit(" reais.")))
        .when(kind == "text", F.concat(F.lit("O estado é "), F.when(F.col("o_orderstatus") == "F", F.lit("FECHADO")).otherwise(F.col("o_orderstatus"))))
        .otherwise(F.when(F.col("o_orderstatus") == "O", F.lit("NÃO HÁ dados para o período.")).otherwise(F.lit("Foram 3.")))
    )
    return table(spark, folder, "orders").select(
        "o_orderkey", kind.alias("kind"), said.alias("answer"), F.col("o_totalprice").alias("expected"),
        F.lit(0.001).alias("tolerance"), F.array(F.lit("fechado"), F.lit("estado é o")).alias("options"),
        F.round(F.col("o_custkey") % 97 / 7 + 0.3, 1).alias("seconds"),
    )


def _correct():
    c = F.col
    return qa.is_correct(c("answer"), c("kind"), c("expected"), c("tolerance"), c("options"))


ANSWER_SQL = """
WITH k AS (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'number' WHEN o_orderpriority = '3-MEDIUM' THEN 'text' ELSE 'gap' END AS kind FROM orders),
s AS (SELECT *, CASE kind WHEN 'number' THEN 'Em 2024 o total foi ' || CASE WHEN o_orderstatus = 'P' THEN '12,5' ELSE translate(format('{:,.1f}', o_totalprice), ',.', '.,') END || ' reais.'
    WHEN 'text' THEN 'O estado é ' || CASE WHEN o_orderstatus = 'F' THEN 'FECHADO' ELSE o_orderstatus END
    ELSE CASE WHEN o_orderstatus = 'O' THEN 'NÃO HÁ dados para o período.' ELSE 'Foram 3.' END END AS answer FROM k),
n AS (SELECT *, list_transform(regexp_extract_all(answer, '\\d[\\d.,]*'), lambda r: rtrim(r, '.,')) AS raw FROM s),
m AS (SELECT o_orderkey, o_custkey, kind, CASE kind
    WHEN 'number' THEN len(list_filter(raw, lambda t: abs(coalesce(TRY_CAST(CASE WHEN contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.') ELSE t END AS DOUBLE), -1e30) - o_totalprice) <= 0.001::DOUBLE * abs(o_totalprice))) > 0
    WHEN 'text' THEN contains(lower(answer), 'fechado') OR contains(lower(answer), 'estado é o')
    ELSE regexp_matches(answer, 'n[ãa]o (h[áa]|possu|disp[õo]|dispon|encontr|cobre|constam|existem|tenho|consegui|est[áa] dispon)|sem dados|indispon[íi]vel', 'i') END AS correct FROM n)
"""


@query("answer_match", ANSWER_SQL + "SELECT o_orderkey, kind, correct FROM m")
def answer_match(spark, folder):
    return answers(spark, folder).select("o_orderkey", "kind", _correct().alias("correct"))


@query("answer_accuracy", ANSWER_SQL + """
SELECT coalesce(kind, 'TOTAL') AS kind, sum(correct::INT)::BIGINT AS "right", count(*) AS total,
       round(sum(correct::INT)::BIGINT / count(*) * 100, 1) AS accuracy_pct FROM m GROUP BY ROLLUP (kind)
""")
def answer_accuracy(spark, folder):
    return qa.accuracy(answers(spark, folder), _correct(), "kind")


@query("latency_index_rule", ANSWER_SQL + """
, t AS (SELECT kind, round(o_custkey % 97 / 7 + 0.3, 1) AS sec FROM m),
l AS (SELECT kind, round(avg(sec), 2) AS mean, max(sec) AS max, list_sort(list(sec)) AS v, count(*) AS n FROM t GROUP BY 1)
SELECT kind, mean, max, v[n // 2 + 1] AS p50, v[greatest(floor(n * 0.9)::BIGINT - 1, 0) + 1] AS p90 FROM l
""")
def latency_index_rule(spark, folder):
    return qa.latency(answers(spark, folder), ["kind"], "seconds")


def labelled(spark, folder):
    """Documents with a guessed quality against the accepted labels."""
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    guess = F.when(F.col("n_chars") < 100, "none").when(F.col("n_chars") > 600, "1").otherwise("0")
    accepted = F.when(F.col("toxic") == 1, F.array(F.lit("none"), F.lit("0"))).otherwise(F.array(F.col("quality").cast("string")))
    return qa.label_accuracy(d.select("doc_id", "source", guess.alias("guess"), accepted.alias("accepted")), F.col("accepted"), F.col("guess"))


LABEL_SQL = """
WITH g AS (
  SELECT doc_id, source, CASE WHEN n_chars < 100 THEN 'none' WHEN n_chars > 600 THEN '1' ELSE '0' END AS guess,
         CASE WHEN toxic = 1 THEN '0/none' ELSE quality::VARCHAR END AS expected FROM documents JOIN labels USING (doc_id))
"""


@query("label_confusion", LABEL_SQL + """
SELECT expected, count(*) AS total, count(*) FILTER (WHERE list_contains(string_split(expected, '/'), guess)) AS hits,
       count(*) FILTER (WHERE guess = '0') AS got_0, count(*) FILTER (WHERE guess = '1') AS got_1, count(*) FILTER (WHERE guess = 'none') AS got_none
FROM g GROUP BY 1
""")
def label_confusion(spark, folder):
    return qa.label_confusion(labelled(spark, folder), "guess", ["0", "1", "none"])


@query("label_stability", """
WITH s AS (SELECT user_id, date_trunc('hour', ts) AS h, count(DISTINCT event_type) = 1 AS stable FROM events GROUP BY 1, 2)
SELECT count(*) AS groups, count(*) FILTER (WHERE stable) AS stable, round(count(*) FILTER (WHERE stable) / count(*) * 100, 1) AS stable_pct FROM s
""")
def label_stability(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.date_trunc("hour", "ts").alias("h"), "event_type")
    return qa.stability(e, ["user_id", "h"], "event_type")


def routed(spark, folder):
    """Messages with a label as a classifier might return it, some of it outside the allowed values."""
    c = table(spark, folder, "conversations")
    pick = F.element_at(F.array(*[F.lit(v) for v in (*qa.ROUTES, "???")]), (F.col("conv_id") % 6 + 1).cast("int"))
    level = F.element_at(F.array(*[F.lit(v) for v in (*qa.LEVELS, "")]), (F.col("turn") % 3 + 1).cast("int"))
    message = F.when(F.col("conv_id") % 4 == 0, F.lit("Olá, tudo bem?")).when(
        F.col("conv_id") % 4 == 1, F.concat(F.lit("OBRIGADO "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", qa.clean_route(pick).alias("route"), qa.clean_level(level).alias("level"), message.alias("message"))


ROUTE_SQL = """
WITH c AS (
  SELECT conv_id, turn, ['dados', 'documentos', 'misto', 'conversa', 'fora_escopo', 'misto'][conv_id % 6 + 1] AS route,
         ['simples', 'complexa', 'complexa'][turn % 3 + 1] AS level,
         CASE conv_id % 4 WHEN 0 THEN 'Olá, tudo bem?' WHEN 1 THEN 'OBRIGADO ' || text ELSE text END AS message FROM conversations),
p AS (SELECT *, CASE WHEN route = 'conversa' THEN CASE WHEN regexp_matches(message, '^\\W*(oi|ol[áa]|e a[íi]|bom dia|boa tarde|boa noite|obrigad|valeu|tchau|at[ée] mais|tudo bem|quem [ée] voc[êe]|qual [ée] o seu nome|qual o seu nome|qual seu nome|como voc[êe] se chama|o que voc[êe] (faz|sabe|consegue)|como voc[êe] funciona|me ajuda)', 'i')
                      AND len(list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> '')) <= 12 THEN 'rapido' ELSE 'dados' END
   WHEN route = 'fora_escopo' THEN 'dados' WHEN route = 'misto' OR level = 'complexa' THEN 'raciocinio' WHEN route = 'documentos' THEN 'documentos' ELSE 'dados' END AS profile FROM c)
"""


@query("route_profile", ROUTE_SQL + "SELECT conv_id, turn, route, level, profile, profile <> 'rapido' AS tools FROM p")
def route_profile(spark, folder):
    r = routed(spark, folder).withColumn("profile", qa.profile(F.col("route"), F.col("level"), F.col("message")))
    return r.withColumn("tools", qa.uses_tools(F.col("profile"))).drop("message")


@query("last_n_messages", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3
""")
def last_n_messages(spark, folder):
    return qa.last_messages(table(spark, folder, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("recent_sessions", """
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS messages FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 256
""")
def recent_sessions(spark, folder):
    out = qa.recent_sessions(table(spark, folder, "events").select("user_id", "ts"), "user_id", "ts")
    return out.withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("latest_decision", ROUTE_SQL + """
SELECT conv_id, turn, profile FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM p) WHERE k = 1
""")
def latest_decision(spark, folder):
    r = routed(spark, folder).withColumn("profile", qa.profile(F.col("route"), F.col("level"), F.col("message")))
    return qa.latest_decision(r, "conv_id", ["turn"], ["profile"])


@query("tool_calls", "SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'click') AS click_calls FROM events GROUP BY 1")
def tool_calls(spark, folder):
    return qa.tool_calls(table(spark, folder, "events"), "user_id", "event_type", "click")
