"""Choosing among resources: formats, budgets, routes and names.

"Best per key" is always a minimum over a struct, which combines on the map side, never a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold_name
from ..session import materialize
from .ordered import join_keys, running_before

# Formats in the order in which they are looked for and preferred, and the URL rules.
KNOWN_FORMATS = ("csv", "xlsx", "pdf", "json", "xml", "zip")
FORMAT_PREFERENCE = ("parquet", "zip", "csv")
NAME_ENDING = r"(?i)\.(csv|parquet|zip)|\s+(CSV|PARQUET|ZIP)$"
NOT_DATA = r"dicion|metadad|layout|^DM -"
DICTIONARY_HINT = r"dicion|metadad|layout|DM -"
DENY = (r"/login", r"/busca", r"\?print", r"/rss", r"\.(jpg|jpeg|png|gif|zip|mp4|xlsx?|csv)$",
        r"/@@", r"sendto_form", r"folder_factories", r"facebook|twitter|linkedin|whatsapp|youtube|instagram")
LISTINGS = (r"[?&](b_start|page|pagina|p_p_id)[:=]", r"/noticias/?$", r"/noticias/area-\d+", r"/dataset/?(\?.*)?$",
            r"/publicacoes/?$", r"/procedimentos-regulatorios/?$")


def any_match(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def detect_format(declared: Column, url: Column, name: Column, known: Sequence[str] = KNOWN_FORMATS) -> Column:
    """First known format named in any of the three, else the declared one, else ``?``."""
    target = F.concat_ws(" ", F.coalesce(declared, F.lit("")), F.coalesce(url, F.lit("")), name)
    out = F.coalesce(F.nullif(declared, F.lit("")), F.lit("?"))
    for f in reversed(known):
        out = F.when(target.rlike(rf"(?i)\b{f}\b|\.{f}"), f).otherwise(out)
    return out


def base_name(name: Column) -> Column:
    """Name without its format ending: the key under which formats of one resource meet."""
    return F.trim(F.regexp_replace(name, NAME_ENDING, ""))


def data_resources(df: DataFrame, pattern: str, name: str = "name", url: str = "url") -> DataFrame:
    """Resources that match the data pattern and are no dictionary or layout."""
    target = F.concat(F.col(name), F.lit(" "), F.substring_index(url, "/", -1))
    return df.filter(target.rlike(f"(?i){pattern}") & ~F.col(name).rlike(f"(?i){NOT_DATA}"))


def preferred(df: DataFrame, keys: Sequence[str], rank: Column, pos: str, keep: Sequence[str]) -> DataFrame:
    """Row with the lowest rank per key; the first seen wins ties."""
    best = F.min(F.struct(rank.alias("r__"), F.col(pos).alias("p__"), *[F.col(c) for c in keep]))
    return df.groupBy(*keys).agg(best.alias("b__")).select(*keys, *[F.col(f"b__.{c}").alias(c) for c in keep])


def rank_in(c: Column, order: Sequence[str]) -> Column:
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def first_per_key(df: DataFrame, keys: Sequence[str], pos: str, keep: Sequence[str]) -> DataFrame:
    return preferred(df, keys, F.lit(0), pos, keep)


def last_year_token(text: Column) -> Column:
    """Last ``20dd`` in a text, ``0`` when there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(20\d\d)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("0"))


def largest_option(df: DataFrame, keys: Sequence[str], option: str, size: str) -> DataFrame:
    """Option with the most bytes per key; ties go to the smaller name."""
    sums = df.groupBy(*keys, option).agg(F.sum(size).alias("s__"), F.count("*").alias("n__"))
    best = F.min(F.struct((-F.col("s__")).alias("neg"), F.col(option).alias("o"), F.col("n__").alias("n")))
    return sums.groupBy(*keys).agg(best.alias("b__")).select(
        *keys, F.col("b__.o").alias(option), (-F.col("b__.neg")).alias("bytes"), F.col("b__.n").alias("files")
    )


def budget_crossing(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, size: str, budget: int) -> DataFrame:
    """Items in order until the budget is passed; the item that passes it is still taken."""
    return running_before(df, keys, order, bucket, F.col(size), "before__").filter(F.col("before__") <= budget).drop("before__")


FOLD_ROWS = 5_000


def budget_greedy(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    bucket: Column,
    size: str,
    budget: int,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Greedy fill: the first item is always taken, later ones when they still fit. Sizes are whole numbers from 0 up.

    Items of equal ``order`` go by their other columns, so the result does not depend on how a group is worked on. A group of
    at most ``fold_rows`` rows is folded in one array; others are never collected (``_by_size_classes``).
    """
    orderable = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    items = df.withColumn("o__", F.struct(order.alias("first"), *[c.alias(f"c{i}") for i, c in enumerate(orderable)])).withColumn("b__", bucket)
    groups = items.groupBy(*keys).agg(F.lit(int(budget)).cast("long").alias("left__"), F.count("*").alias("n__"))
    small = groups.filter(F.col("n__") <= fold_rows).select(*keys, "left__")
    folded = _fold(join_keys(items, small, keys), keys, size).select(*df.columns)
    large = groups.filter(F.col("n__") > fold_rows).select(*keys)
    if large.isEmpty():
        return folded
    taken = _by_size_classes(join_keys(items, large, keys), keys, size, int(budget))
    return folded.unionByName(taken.select(*df.columns))


def _by_size_classes(items: DataFrame, keys: Sequence[str], size: str, budget: int) -> DataFrame:
    """Rows of ``items`` (o__ the order, b__ its bucket) that a greedy fill of each group takes.

    With ``left`` in [2^k, 2^(k+1)), items under 2^k all fit until the first event: such an item brings ``left`` under 2^k, or an
    item of 2^k or more fits and is taken. Larger items before it never fit later. So each round takes a whole prefix by one
    running total, and k falls: there are at most log2(budget) + 2 rounds, whatever the sizes.
    """
    # rows that are equal in all columns are told apart by a number, stored so that it does not change
    items = materialize(items.withColumn("row__", F.monotonically_increasing_id()), "greedy-items")
    items = items.withColumn("o__", F.struct("o__", "row__")).withColumn("s__", F.col(size).cast("long")).drop("row__")
    first = items.groupBy(*keys).agg(F.min(F.struct("o__", "s__")).alias("f__"))
    started = join_keys(items, first, keys)
    taken = [started.filter(F.col("o__") == F.col("f__.o__")).select(*items.columns)]
    left = F.lit(budget) - F.col("f__.s__")
    rest = started.filter(F.col("o__") > F.col("f__.o__")).withColumn("left__", left).drop("f__")
    while True:
        rest = materialize(rest.filter(F.col("s__") <= F.col("left__")), "greedy-rest")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        half = F.when(F.col("left__") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("left__")) - 1)).otherwise(F.lit(0))
        lesser = F.col("s__") < F.greatest(half, F.lit(1))
        ranked = running_before(rest, keys, [F.col("o__")], F.col("b__"), F.when(lesser, F.col("s__")).otherwise(F.lit(0)), "before__")
        now = F.col("left__") - F.col("before__")
        event = (lesser & (now - F.col("s__") < half)) | (~lesser & (F.col("s__") <= now))
        stops = ranked.groupBy(*keys).agg(F.min(F.when(event, F.col("o__"))).alias("stop__"))
        before = F.col("stop__").isNull() | (F.col("o__") < F.col("stop__"))
        at = F.coalesce(F.col("o__") == F.col("stop__"), F.lit(False))
        marked = materialize(join_keys(ranked, stops, keys).withColumn("take__", (lesser & before) | at), "greedy-round")
        taken.append(marked.filter("take__").select(*items.columns))
        used = marked.groupBy(*keys).agg((F.max("left__") - F.coalesce(F.sum(F.when(F.col("take__"), F.col("s__"))), F.lit(0))).alias("left__"))
        later = marked.filter(F.col("o__") > F.col("stop__")).select(*items.columns)
        rest = join_keys(later, used, keys)


def _fold(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Greedy fill of small groups inside one expression."""
    columns = [c for c in df.columns if c not in (*keys, "left__")]
    row = F.struct(F.col("o__").alias("k__"), *[F.col(c) for c in columns])
    groups = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows__"), F.first("left__").alias("left__"))
    empty = F.filter("rows__", lambda r: F.lit(False))
    start = F.struct(F.col("left__").alias("left"), F.lit(False).alias("any"), empty.alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        take = (r[size] <= acc["left"]) | ~acc["any"]
        return F.struct(
            F.when(take, acc["left"] - r[size]).otherwise(acc["left"]).alias("left"),
            F.lit(True).alias("any"),
            F.when(take, F.concat(acc["kept"], F.array(r))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = F.aggregate("rows__", start, step)["kept"]
    return groups.select(*keys, F.explode(kept).alias("r__")).select(*keys, *[F.col(f"r__.{c}").alias(c) for c in columns])


def route(url: Column, allow: Sequence[str], pdfs: Sequence[str] = (), deny: Sequence[str] = DENY, listings: Sequence[str] = LISTINGS) -> Column:
    """``skip``, ``pdf``, ``index`` (links only), ``follow`` or ``none`` for a URL."""
    return (
        F.when(any_match(url, deny), "skip")
        .when(any_match(url, pdfs), "pdf")
        .when(any_match(url, allow) & any_match(url, listings), "index")
        .when(any_match(url, allow), "follow")
        .otherwise("none")
    )


def dictionary_choice(df: DataFrame, keys: Sequence[str], table_pattern: str, pos: str = "pos") -> DataFrame:
    """First resource that is the dictionary of a table: named like one, or a PDF of the table's name."""
    named = F.concat("name", "url").rlike(f"(?i){DICTIONARY_HINT}")
    of_table = F.col("name").rlike(f"(?i){table_pattern}")
    fmt = detect_format(F.col("format"), F.col("url"), F.col("name"))
    hits = df.filter((named | (fmt == "pdf")) & of_table & F.col("url").isNotNull())
    return first_per_key(hits, keys, pos, ["name", "url"])


def table_name(prefix: str, name: Column, length: int = 40) -> Column:
    """Table name from a resource name: folded, words joined by underscores, cut to a length."""
    words = F.trim(F.regexp_replace(fold_name(base_name(name)), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.concat(F.lit(f"{prefix}_"), F.substring(words, 1, length))
