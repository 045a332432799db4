"""Repair of conversations as a lightest derivation over weighted deductions.

Rows of a conversation are read in order; a repaired one has role initials ``(s?(ua)+)?``. An item ``[i, q]`` says that the
first ``i`` rows are dealt with and the output so far ends in state ``q``. Rows are axioms of value ``(0, "")``; a
deduction takes an item and the next row (Keep, Rerole, Delete) or an item alone (Insert) and adds its cost and its
initial. Every deduction is superior (the value grows: a longer audit follows its own beginning) and monotone: of two
audits for one item at one cost neither begins the other, because rows are read by one letter each and inserts cost.
So Knuth's agenda, which takes the item with the least (cost, audit) first, finalises each item once and right.

Long conversations are cut into blocks of ``BLOCK`` rows. The agenda runs over each block from every state it may be
entered in; tables of neighbours are then put together, ``FAN`` at a time, until a conversation has one. Values of the
second part would not be superior (``KR`` comes before ``R``), so this step takes the least over the state in between.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import join_keys, running_before
from .common import crc32, store

BLOCK = 64  #: rows over which one agenda runs
FAN = 64  #: tables put together in one step
SPACE = "\\x20\\x09-\\x0D"

# Prices of edits, and what the repaired role is called.
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}

START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
GOALS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
MUST_GO = (BLANK, DUPLICATE)

Code = tuple[str, int, int]  #: a row's role initial and fault, and how many equal rows in turn
Table = dict[tuple[int, int], tuple[int, str]]  #: (state before, state after): least (cost, audit)


def deductions(rows: tuple[Code, ...], i: int, q: int):
    """(cost, initials, next i, next state) of every edit that item ``[i, q]`` allows."""
    for letter, state in MOVES[q].items():
        if letter in ROLES:
            yield INSERT, "I", i, state
    if i == len(rows):
        return
    initial, fault, times = rows[i]
    yield DELETE * times, "D" * times, i + 1, q
    if fault in MUST_GO:
        return
    extra = CUT if fault == TRUNCATED else 0
    for letter, state in MOVES[q].items():
        if letter == initial:
            yield extra, "K", i + 1, state
        if letter in ROLES:
            yield extra + RENAME, "R", i + 1, state


def agenda(rows: tuple[Code, ...], entry: int) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of every state after all ``rows``, from state ``entry`` before them."""
    waiting, final, out = [(0, "", 0, entry)], set(), {}
    while waiting and len(out) < len(MOVES):
        cost, audit, i, q = heappop(waiting)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == len(rows):
            out[q] = (cost, audit)
        for more, initials, j, r in deductions(rows, i, q):
            if (j, r) not in final:
                heappush(waiting, (cost + more, audit + initials, j, r))
    return out


@lru_cache(1 << 15)
def block_table(rows: tuple[Code, ...], first: bool) -> Table:
    """``agenda`` from every state; a conversation's first block is only entered at the start."""
    return {(p, q): value for p in ((START,) if first else MOVES) for q, value in agenda(rows, p).items()}


def chained(one: Table, two: Table) -> Table:
    out: Table = {}
    for (p, q), (cost, audit) in one.items():
        for (r, s), (more, rest) in two.items():
            if q == r and ((p, s) not in out or (cost + more, audit + rest) < out[p, s]):
                out[p, s] = (cost + more, audit + rest)
    return out


def goal(table: Table) -> tuple[int, str]:
    return min(table[START, q] for q in GOALS if (START, q) in table)


_TABLE = "array<struct<p:tinyint,q:tinyint,cost:bigint,audit:string>>"
_PART = f"conv_id long, block long, head string, tail string, illegal long, paths {_TABLE}"


def _packed(table: Table) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in sorted(table.items())]


def _from_rows(conv_id, block, rows):
    codes = tuple((r["initial"], r["fault"], r["times"]) for r in rows)
    illegal = sum((t - 1) for _, _, t in codes)  # the same initial twice is never legal
    illegal += sum(x[0] + y[0] not in LEGAL for x, y in zip(codes, codes[1:]))
    return conv_id, block, codes[0][0], codes[-1][0], illegal, _packed(block_table(codes, block == 0))


def _from_parts(conv_id, block, parts):
    tables = [{(e["p"], e["q"]): (e["cost"], e["audit"]) for e in part["paths"]} for part in parts]
    while len(tables) > 1:  # pairs of neighbours, so that an audit is copied once for each level
        tables = [reduce(chained, tables[i : i + 2]) for i in range(0, len(tables), 2)]
    illegal = sum(part["illegal"] for part in parts)
    illegal += sum(x["tail"] + y["head"] not in LEGAL for x, y in zip(parts, parts[1:]))
    return conv_id, block, parts[0]["head"], parts[-1]["tail"], illegal, _packed(tables[0])


def _mapped(grouped: DataFrame, make) -> DataFrame:
    """``make(conv_id, block, list)`` for every row of ``grouped``."""
    names = [part.split(" ")[0] for part in _PART.split(", ")]
    kinds = pa.schema([
        ("conv_id", pa.int64()), ("block", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()),
        ("paths", pa.list_(pa.struct([("p", pa.int8()), ("q", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                made = [make(*row.values()) for row in batch.slice(lo, 500).to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in made], kinds)

    return grouped.mapInArrow(run, _PART)


def checked(rows: DataFrame) -> DataFrame:
    """Numbers of ``rows`` (conv_id, turn, role, text; no nulls in the last two) without their texts.

    One line for rows equal in all four, which stand side by side: turn, role, print (of the text), times, and the fault of
    the first (``fault``) and of the others (``again``). Order is by turn (nulls first), role and print.
    """
    filled = F.regexp_replace("text", f"[{SPACE}]+$", "")
    fault = F.when(filled == "", BLANK).when(~F.substring(filled, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    narrow = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.unhex(F.md5(F.encode("text", "utf-8"))).alias("print"), fault.alias("own"),
    )
    runs = narrow.groupBy("conv_id", "turn", "role", "print", "own").agg(F.count("*").alias("times"))
    runs = store(runs, "runs")
    content = ["conv_id", "role", "print"]
    first = runs.groupBy(*content).agg(F.min(F.struct("turn")).alias("first"))
    runs = join_keys(runs, first, content)
    again = F.when(F.col("own") == BLANK, BLANK).otherwise(DUPLICATE)
    seen = F.when(F.struct("turn").eqNullSafe(F.col("first")), F.col("own")).otherwise(again)
    return runs.select("conv_id", "turn", "role", "print", "times", seen.alias("fault"), again.alias("again"))


def reports(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.

    A conversation may be of any length: places come from totals of buckets of 64 turns, each agenda sees ``BLOCK`` rows, and
    each later step ``FAN`` tables. A null conv_id is a conversation of its own; null turns come first.
    """
    runs = checked(rows)
    # the place of a run among its conversation's; buckets follow the order: turns, and without a turn, role and print
    bare = F.col("turn").isNull()
    bucket = F.struct(F.floor(F.col("turn") / 64), F.when(bare, F.col("role")), F.when(bare, F.substring(F.hex("print"), 1, 2)))
    parts = F.when((F.col("times") > 1) & (F.col("fault") != F.col("again")), 2).otherwise(1)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]
    runs = store(running_before(runs, ["conv_id"], order, bucket, parts.cast("long"), "at"), "placed-runs")

    head = F.substring("role", 1, 1)
    initial = F.when(head.isin("s", "u", "a"), head).otherwise("-")

    def code(at, fault, times):
        return F.struct(at.alias("at"), initial.alias("initial"), fault.alias("fault"), times.alias("times"))

    whole = F.array(code(F.col("at"), F.col("fault"), F.col("times")))
    split = F.array(code(F.col("at"), F.col("fault"), F.lit(1).cast("long")), code(F.col("at") + 1, F.col("again"), F.col("times") - 1))
    codes = runs.select("conv_id", F.explode(F.when(parts == 2, split).otherwise(whole)).alias("c")).select("conv_id", "c.*")
    numbers = codes.groupBy("conv_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("fault") == kind, F.col("times"))), F.lit(0)).alias(name)
        for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))
    ])
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    numbers = join_keys(numbers, runs.groupBy("conv_id").agg(F.coalesce(spread, F.lit(0)).alias("gaps")), ["conv_id"])

    def grouped(df, at, per, *fields):
        inside = F.array_sort(F.collect_list(F.struct(at, *fields)))
        return df.groupBy("conv_id", F.floor(F.col(at) / per).alias("_block")).agg(inside.alias("rows"))

    tables = store(_mapped(grouped(codes, "at", BLOCK, "initial", "fault", "times"), _from_rows), "blocks")
    left = tables.agg(F.max("block")).first()[0] or 0
    while left:
        tables = store(_mapped(grouped(tables, "block", FAN, "head", "tail", "illegal", "paths"), _from_parts), "blocks")
        left //= FAN
    ends = F.filter("paths", lambda e: (e.p == START) & e.q.isin(*GOALS))
    best = F.array_min(F.transform(ends, lambda e: F.struct(e.cost.alias("cost"), e.audit.alias("audit"))))
    done = tables.select("conv_id", "illegal", best.alias("best")).select("conv_id", "illegal", "best.cost", "best.audit")
    return join_keys(done, numbers, ["conv_id"]).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edited(batches):
    """Repaired turns (conv_id, edit, turn, role, text) in order, and (conv_id, None, ...) behind each conversation.

    ``batches`` are sorted: a conversation's audit, then its rows.
    """
    now, audit, at, last, began = None, "", 0, "", False

    def next_role():
        return ROLES["a" if last == "u" else "u"]

    def inserts():
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            role = next_role()
            at, last = at + 1, role[0]
            yield now, "I", None, role, ""

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "kind", "turn", "role", "text")]
        for conv_id, kind, turn, role, text in zip(*columns):
            if kind == 0:
                if began:
                    yield from inserts()
                    yield now, None, None, None, None
                now, audit, at, last, began = conv_id, text, 0, "", True
                continue
            yield from inserts()
            edit = audit[at]
            if edit == "D":
                at += 1
                continue
            role = next_role() if edit == "R" else role
            at, last = at + 1, role[:1]
            yield now, edit, turn, role, text
    if began:
        yield from inserts()
        yield now, None, None, None, None


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows, dealt by conversation and sorted within; texts are moved once."""
    text = F.col("text")
    narrow = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role",
        F.unhex(F.md5(F.encode("text", "utf-8"))).alias("print"), text,
    )
    audits = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("print"), F.col("audit").alias("text"))
    both = audits.unionByName(narrow).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "print")
    return both.select("conv_id", "kind", "turn", "role", "text")


def repaired(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns of every repaired conversation, places from 0.

    ``edit`` is K (kept), R (its role was changed) or I (inserted; no turn, empty text).
    """
    def run(batches):
        place, held = 0, []
        for conv_id, edit, turn, role, text in _edited(batches):
            if edit is None:
                place = 0
                continue
            held.append({"conv_id": conv_id, "place": place, "edit": edit, "turn": turn, "role": role, "text": text})
            place += 1
            if len(held) == 500:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    found = reports(rows) if found is None else found
    return _streamed(rows, found).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of ``role:text`` of the repaired turns, joined by newlines.

    SHA-256 must see a conversation's bytes in order, so one task reads each conversation once, as a stream; it holds the
    audit and one batch.
    """
    def run(batches):
        ids, prints, state, any_turn = [], [], hashlib.sha256(), False
        for conv_id, edit, _, role, text in _edited(batches):
            if edit is None:
                ids.append(conv_id)
                prints.append(state.hexdigest())
                state, any_turn = hashlib.sha256(), False
            else:
                state.update((("\n" if any_turn else "") + role + ":" + text).encode())
                any_turn = True
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.string())], ["conv_id", "repaired_sha256"])

    return _streamed(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by the crc32 of ``conv_id:turn`` modulo 20.

    0: the row goes; 1: its text is emptied; 2: it loses its ``[.!?]``; 3: it comes twice; 4: its role is user. Null role and
    text are one space, and so are a null conv_id and turn in the text that is hashed.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    rows = conversations.withColumn("_kind", kind).where("_kind != 0").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_kind") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def damage_report(conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations`` (null too): what ``damaged`` left, and its cheapest repair.

    Rows of one turn go by role, then by the md5 of the text; rows equal in all are repeats. Blank texts are those of space
    and control characters 9 to 13; an empty or unknown role has no legal place. A conversation without rows has zeros, an
    empty audit and the hash of nothing. An empty table gives an empty result. Long texts are hashed and streamed whole;
    further columns are ignored.
    """
    rows = damaged(conversations)
    found = store(reports(rows), "reports")
    out = join_keys(found, digests(rows, found), ["conv_id"])
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = join_keys(every, out, ["conv_id"], "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
