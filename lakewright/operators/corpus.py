"""Keeping a document corpus: gate, hash, compare with the state, count, crawl."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..session import materialize
from .ordered import carried_forward, join_keys

# Limits, the note on cut documents and the headings that identify a legal act.
MIN_CHARS = 300
MAX_CHARS = 80_000
CUT_NOTE = "\n\n[... documento truncado em {:,} caracteres ...]"
POOR_TITLE = r"^[A-Za-z]?\d+\w*$"
POOR_TITLE_CHARS = 12
LEGAL_ACT = (r"\b((?:LEI|DECRETO|MEDIDA PROVIS[ÓO]RIA|RESOLU[ÇC][ÃA]O NORMATIVA|PORTARIA)"
             r"(?: COMPLEMENTAR)?\s+N[º°o.]\s*[\d.]+,?\s+DE\s+\d{1,2}[º°]?\s+DE\s+\w+\s+DE\s+\d{4})")
ID_CHARS = 16


def cut(text: Column, limit: int = MAX_CHARS) -> Column:
    """Long texts end in a note; this comes before the hash and the length gate."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(CUT_NOTE.format(limit)))).otherwise(text)


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def doc_id(hash_: Column) -> Column:
    return F.substring(hash_, 1, ID_CHARS)


def rescued_title(title: Column, text: Column) -> Column:
    """A poor title gives way to the legal act named in the text."""
    clean = squeeze(F.coalesce(title, F.lit("")))
    flat = F.regexp_replace(text, r"[*_\[\]\s]+", " ")
    act = F.nullif(F.regexp_extract(flat, "(?U)" + LEGAL_ACT, 1), F.lit(""))
    poor = (F.char_length(clean) < POOR_TITLE_CHARS) | clean.rlike(POOR_TITLE)
    return F.when(poor, F.coalesce(act, clean)).otherwise(clean)


def latest_state(versions: DataFrame, keys: Sequence[str] = ("url",), order: str = "seq", keep: Sequence[str] = ("sha256",)) -> DataFrame:
    """Last version per key as an aggregate, so a URL with many versions is reduced before it moves."""
    last = F.max(F.struct(F.col(order), *[F.col(c) for c in keep]))
    return versions.groupBy(*keys).agg(last.alias("l__")).select(*keys, *[F.col(f"l__.{c}").alias(c) for c in keep])


@dataclass
class Upsert:
    """Outcome of one collection run; all frames are lazy views of the same marked rows."""

    marked: DataFrame

    @property
    def changes(self) -> DataFrame:
        return self.marked.filter(F.col("status").isin("new", "changed"))

    def counters(self, by: Sequence[str] = ("source",)) -> DataFrame:
        """New or changed, unchanged and too short documents per source."""
        s = F.col("status")
        return self.marked.groupBy(*by).agg(
            F.count_if(s.isin("new", "changed")).alias("new_or_changed"),
            F.count_if(s == "unchanged").alias("unchanged"),
            F.count_if(s == "too_short").alias("too_short"),
        )


def upsert(
    incoming: DataFrame,
    state: DataFrame,
    text: Column,
    min_chars: Column | int = MIN_CHARS,
    key: str = "url",
    order: str | None = None,
) -> Upsert:
    """Marks each document as new, changed, unchanged or too short, by its whole text.

    ``state`` holds one row (key, sha256). ``order`` names the sequence of arrivals, if a key may come more than once:
    an arrival is held against the last one of its key that was long enough, the first such against the state. ``order`` is
    unique within a key; hashes are then written once, and one key's arrivals are spread over tasks (``carried_forward``).
    The text stays in place: only keys and hashes are joined when the caller selects no text afterwards. ``cut`` may come
    before. ``incoming``'s own columns chars and sha256 are replaced.
    """
    final = incoming.withColumn("text", text).drop("chars", "sha256")
    chars = F.char_length("text").cast("bigint")
    hashed = F.when(chars >= min_chars, sha(F.col("text")))
    if order:
        told = materialize(final.select(key, order, chars.alias("chars"), hashed.alias("sha256")), "arrivals")
        final = join_keys(final, carried_forward(told, [key], order, "sha256", "last__"), [key, order])
    else:
        final = final.withColumn("chars", chars).withColumn("sha256", hashed).withColumn("last__", F.lit(None).cast("string"))
    old = state.select(F.col(key).alias("key__"), F.col("sha256").alias("old__"))
    joined = final.join(old, F.col(key).eqNullSafe(F.col("key__")), "left").drop("key__")
    joined = joined.withColumn("old__", F.coalesce("last__", "old__")).drop("last__")
    status = (
        F.when(F.col("sha256").isNull(), "too_short")
        .when(F.col("old__").isNull(), "new")
        .when(F.col("old__") == F.col("sha256"), "unchanged")
        .otherwise("changed")
    )
    return Upsert(joined.withColumn("status", status).drop("old__"))


def next_state(state: DataFrame, changes: DataFrame, key: str = "url", order: str | None = None) -> DataFrame:
    """State after a run: changed keys replaced by their last arrival, new keys added, the rest kept."""
    at = F.struct(F.lit(1).alias("run"), (F.col(order) if order else F.lit(0)).cast("long").alias("at"))
    none = F.struct(F.lit(0).alias("run"), F.lit(None).cast("long").alias("at"))
    both = state.select(key, "sha256", none.alias("seq")).unionByName(changes.select(key, "sha256", at.alias("seq")))
    return latest_state(both, [key])


def current_documents(stored: DataFrame, state: DataFrame, hash_: str = "sha256") -> DataFrame:
    """Stored documents whose content some key of the state still has."""
    return stored.join(state.select(hash_).distinct(), hash_, "left_semi")


def content_keys(docs: DataFrame, hash_: str = "sha256", order: str = "seq", keep: Sequence[str] = ("url",)) -> DataFrame:
    """One stored document per content; the last writer's metadata wins."""
    return latest_state(docs, [hash_], order, keep).withColumn("doc_id", doc_id(F.col(hash_)))


def template(parts: Sequence[str | Column]) -> Column:
    """Text from literals and columns; nulls become empty, whole doubles lose their ``.0``."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(F.lit(p))
        else:
            s = p.cast("string")
            out.append(F.coalesce(F.regexp_replace(s, r"^(-?\d+)\.0$", "$1"), F.lit("")))
    return F.concat(*out)


def front_matter(fields: dict[str, Column], text: Column) -> Column:
    """Document as stored: a head of ``key: value`` lines, then the text."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), text, F.lit("\n"))


def headlines(items: DataFrame, topics: str | None = None) -> DataFrame:
    """Feed items with title and link, on topic if a pattern is given, as headline-only documents."""
    out = items.filter((F.trim("title") != "") & (F.trim("link") != ""))
    if topics:
        out = out.filter(F.col("title").rlike(f"(?iu){topics}"))
    return out.withColumn("text", template([
        "Manchete: ", F.trim("title"), "\nVeículo: ", F.trim("outlet"), "\nPublicada em: ", F.trim("date"),
        "\nLink para a matéria original: ", F.trim("link"),
    ]))


def dictionary_title(text: Column, fallback: Column, min_chars: int = 12) -> Column:
    """First long upper-case line of a dictionary document, in title case."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    heads = F.filter(
        lines,
        lambda s: (s == F.upper(s)) & (s != F.lower(s)) & (F.char_length(s) > min_chars) & ~F.contains(F.substring(F.upper(s), 1, 6), F.lit("PÁGINA")),
    )
    return F.coalesce(F.initcap(F.try_element_at(heads, F.lit(1))), fallback)


def dictionary_description(text: Column) -> Column:
    """Text between the description label and the next section, on one line."""
    found = F.regexp_extract(text, r"(?s)Descrição do Dado:\s*(.+?)(?:\n\s*\n|Descrição\s*Código)", 1)
    return squeeze(found)


def bounded_crawl(
    edges: DataFrame,
    seeds: DataFrame,
    max_pages: int,
    queue_factor: int = 3,
    max_rounds: int = 50,
) -> DataFrame:
    """Breadth-first visit order over an edge table ``(src, dst)`` with a page budget.

    Each round joins the frontier with the edges and drops what was queued before. At most
    ``queue_factor * max_pages`` URLs are ever queued, so frontier and visited set stay small and
    bounded by the budget, never by the graph. Returns (url, depth) of visited pages.
    """
    queued = materialize(
        seeds.select("url").distinct().orderBy("url").limit(max_pages).withColumn("depth", F.lit(0)), "crawl"
    )
    frontier, depth = queued, 0
    while depth < max_rounds:
        depth += 1
        room = queue_factor * max_pages - queued.count()
        if room <= 0:
            break
        found = (
            edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("url")).distinct()
            .join(queued.select("url"), "url", "left_anti")
            .orderBy("url").limit(room)
        )
        frontier = materialize(found.withColumn("depth", F.lit(depth)), "crawl")
        if frontier.isEmpty():
            break
        queued = materialize(queued.unionByName(frontier), "crawl")
    return queued.orderBy("depth", "url").limit(max_pages)
