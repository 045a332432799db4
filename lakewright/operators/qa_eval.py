"""Scoring answers, labels and routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import admits_gap, near_any, numbers
from .ordered import join_keys, order_statistics

# Routes, levels of difficulty, and what marks small talk.
ROUTES = ("dados", "documentos", "misto", "conversa", "fora_escopo")
LEVELS = ("simples", "complexa")
DEFAULT_ROUTE, DEFAULT_LEVEL = "misto", "complexa"
SMALL_TALK = (
    r"^\W*(oi|ol[áa]|e a[íi]|bom dia|boa tarde|boa noite|obrigad|valeu|tchau|at[ée] mais|tudo bem|"
    r"quem [ée] voc[êe]|qual [ée] o seu nome|qual o seu nome|qual seu nome|como voc[êe] se chama|"
    r"o que voc[êe] (faz|sabe|consegue)|como voc[êe] funciona|me ajuda)"
)
SMALL_TALK_WORDS = 12


def is_correct(answer: Column, kind: Column, value: Column, tolerance: Column, options: Column) -> Column:
    """Numeric answers by tolerance, text answers by any expected passage, the rest by admitting the gap."""
    low = F.lower(answer)
    return (
        F.when(kind == "number", near_any(numbers(answer), value, tolerance))
        .when(kind == "text", F.exists(options, lambda o: F.contains(low, F.lower(o))))
        .otherwise(admits_gap(answer))
    )


def accuracy(df: DataFrame, correct: Column, by: str, total: str = "TOTAL", digits: int = 1) -> DataFrame:
    """Right answers, count and accuracy per group and overall."""
    out = df.withColumn("c__", correct.cast("int")).rollup(by).agg(
        F.sum("c__").alias("right"), F.count("*").alias("total"), F.grouping(by).alias("g__")
    )
    return out.select(
        F.when(F.col("g__") == 1, total).otherwise(F.col(by)).alias(by), "right", "total",
        F.round(F.col("right") / F.col("total") * 100, digits).alias("accuracy_pct"),
    )


def latency(df: DataFrame, keys: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """Mean, maximum and the order statistics at n div 2 and int(0.9 n) - 1."""
    ranks = {
        "p50": F.floor(F.col("n") / 2),
        "p90": F.greatest(F.floor(F.col("n") * F.lit(0.9)) - 1, F.lit(0)),
    }
    marks = order_statistics(df, keys, value, ranks).drop("n")
    means = df.groupBy(*keys).agg(F.round(F.avg(value), digits).alias("mean"), F.max(value).alias("max"))
    return join_keys(means, marks, keys, "left")


def label_accuracy(df: DataFrame, accepted: Column, obtained: Column) -> DataFrame:
    """Adds the expected label text (``a/b`` for several) and whether the obtained label is accepted."""
    return df.withColumn("expected", F.array_join(F.sort_array(accepted), "/")).withColumn("hit", F.array_contains(accepted, obtained))


def label_confusion(df: DataFrame, obtained: str, labels: Sequence[str]) -> DataFrame:
    """Expected against obtained labels, one row per expected label, empty cells as zero."""
    return df.groupBy("expected").agg(
        F.count("*").alias("total"), F.count_if("hit").alias("hits"),
        *[F.count_if(F.col(obtained) == v).alias(f"got_{v}") for v in labels],
    )


def stability(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Groups that got one and the same label every time, told from the smallest and largest label."""
    per = df.groupBy(*keys).agg((F.min(label) == F.max(label)).alias("stable"))
    return per.agg(
        F.count("*").alias("groups"), F.count_if("stable").alias("stable"),
        F.round(F.count_if("stable") / F.count("*") * 100, 1).alias("stable_pct"),
    )


def clean_route(route: Column) -> Column:
    return F.when(route.isin(*ROUTES), route).otherwise(DEFAULT_ROUTE)


def clean_level(level: Column) -> Column:
    return F.when(level.isin(*LEVELS), level).otherwise(DEFAULT_LEVEL)


def profile(route: Column, level: Column, message: Column) -> Column:
    """Answering profile; small talk is the only one without tools, and only when it looks like it."""
    words = F.size(F.filter(F.split(message, r"\s+"), lambda w: w != ""))
    chat = message.rlike(f"(?iu){SMALL_TALK}") & (words <= SMALL_TALK_WORDS)
    return (
        F.when(route == "conversa", F.when(chat, "rapido").otherwise("dados"))
        .when(route == "fora_escopo", "dados")
        .when((route == "misto") | (level == "complexa"), "raciocinio")
        .when(route == "documentos", "documentos")
        .otherwise("dados")
    )


def uses_tools(profile_: Column) -> Column:
    return profile_ != "rapido"


def last_messages(df: DataFrame, conversation: str, order: str, n: int) -> DataFrame:
    """The last n messages per conversation; the rank limit is applied in every task first."""
    from pyspark.sql import Window

    w = Window.partitionBy(conversation).orderBy(F.col(order).desc())
    return df.withColumn("r__", F.row_number().over(w)).filter(F.col("r__") <= n).drop("r__")


def recent_sessions(df: DataFrame, session: str, order: str, n: int = 256) -> DataFrame:
    """The n sessions with the latest activity."""
    return df.groupBy(session).agg(F.max(order).alias("last"), F.count("*").alias("messages")).orderBy(F.col("last").desc(), session).limit(n)


def latest_decision(df: DataFrame, session: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    last = F.max(F.struct(*[F.col(c) for c in (*order, *keep)]))
    return df.groupBy(session).agg(last.alias("l__")).select(session, *[F.col(f"l__.{c}").alias(c) for c in (*order, *keep)])


def tool_calls(df: DataFrame, answer: str, tool: str, name: str) -> DataFrame:
    """Calls in all and calls of one tool per answer."""
    return df.groupBy(answer).agg(F.count("*").alias("calls"), F.count_if(F.col(tool) == name).alias(f"{name}_calls"))
