"""Conversation repair and the prefix trie against brute force, with nulls, ties, repeats, empty and long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lakewright.llm import repair, trie

SHAPE = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _damage(rows):
    shown = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _repair(rows):
    """Best of all edit sequences, state by state but without an agenda: (cost, audit, turns) for every output's initials."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))

    def legal(state, letter):
        return letter == {"": "u", "s": "u", "u": "a", "a": "u"}[state] or (state == "" and letter == "s")

    best = {"": (0, "", ())}

    def put(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserts(table):
        for _ in range(4):  # more in a row never pays
            for state, (cost, audit, out) in list(table.items()):
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if legal(state, letter):
                        put(table, letter, (cost + 3, audit + "I", out + ((name, ""),)))

    for (_, _, role, text), fault in zip(rows, faults):
        inserts(best)
        after = {}
        for state, (cost, audit, out) in best.items():
            put(after, state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a") and legal(state, role[:1]):
                put(after, role[:1], (cost + extra, audit + "K", out + ((role, text),)))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if legal(state, letter):
                    put(after, letter, (cost + extra + 3, audit + "R", out + ((name, text),)))
        best = after
    inserts(best)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    assert SHAPE.fullmatch("".join(r[:1] for r, _ in out))
    count = lambda kind: faults.count(kind)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit), out


def _wanted(rows):
    damaged = _damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        numbers, turns = _repair([r for r in damaged if r[0] == conv])
        out.append((conv, *numbers, sha("\n".join(f"{r}:{t}" for r, t in turns))))
    return sorted(out, key=str)


def _conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.choice([0, 1, 2, 4, 7])):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "ux"])
            text = r.choice(["A.", "B!", "c", "", None, " \t\n", "same?", "same?", "d . ", "é"])
            rows.append((conv if r.random() < 0.97 else None, r.choice([turn, turn, turn, None, turn + 3, -turn]), role, text))
    for turn in range(150):
        rows.append((10_000, turn // 2, r.choice(["user", "assistant"]), f"{turn // 3}" + r.choice(["", "."])))
        rows.append((10_001, None, r.choice(["user", "assistant", "system"]), r.choice("abc") + "."))
        rows.append((10_002, 5, "user", "hot."))
    return rows + rows[:9]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_agenda_against_all_edit_strings():
    """Small inputs: every string of edits, of which the cheapest and then the ASCII-least wins."""
    r = random.Random(4)
    for _ in range(60):
        rows = tuple((r.choice("sua-"), r.choice([0, 1, 2, 3, 0]), 1) for _ in range(r.randint(0, 3)))
        found = []
        for length in range(0, len(rows) * 2 + 3):
            for audit in itertools.product("DIKR", repeat=length):
                if sum(e != "I" for e in audit) != len(rows) or audit.count("I") > len(rows) + 2:
                    continue
                for last in itertools.product("ua", repeat=sum(e in "IR" for e in audit)):
                    made, names, cost, i = "", iter(last), 0, 0
                    for e in audit:
                        if e == "I":
                            made, cost = made + next(names), cost + 3
                            continue
                        initial, fault, _ = rows[i]
                        i += 1
                        if e == "D":
                            cost += 4
                            continue
                        if fault in (2, 3):
                            break
                        cost += (3 if fault == 1 else 0) + (3 if e == "R" else 0)
                        made += initial if e == "K" else next(names)
                    else:
                        if SHAPE.fullmatch(made):
                            found.append((cost, "".join(audit)))
        assert repair.goal(repair.block_table(rows, True)) == min(found)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_equal_one_agenda(seed):
    r = random.Random(seed)
    rows = tuple((r.choice("sua-uaua"), r.choice([0, 0, 0, 1, 2, 3]), 1) for _ in range(120))
    parts = [repair.block_table(rows[i : i + 17], i == 0) for i in range(0, 120, 17)]
    table = parts[0]
    for part in parts[1:]:
        table = repair.chained(table, part)
    assert table == repair.block_table(rows, True)


def test_repair_equals_brute_force(spark):
    rows = _conversations(1, 120)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cost string").repartition(3)
    assert sorted(map(tuple, repair.damage_report(df).collect()), key=str) == _wanted(rows)


def test_repaired_turns_hash_to_the_report(spark):
    rows = _conversations(2, 40)
    df = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    found = repair.reports(df)
    turns = {}
    for t in repair.repaired(df).collect():
        turns.setdefault(t.conv_id, []).append(t)
    for got in repair.digests(df, found).collect():
        mine = sorted(turns.get(got.conv_id, []), key=lambda t: t.place)
        assert [t.place for t in mine] == list(range(len(mine)))
        assert got.repaired_sha256 == sha("\n".join(f"{t.role}:{t.text}" for t in mine))


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.damage_report(empty).collect() == [] and repair.repaired(empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    row = repair.damage_report(spark.createDataFrame([(gone, 1, "user", "x" * 100_000)], SCHEMA)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", sha(""))


def _trie(rows):
    """Every node of the rebuilt conversations, subtree by subtree."""
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            held.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in held.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes) for k in below)
        saved = sum((len(nodes[k]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) for k in below if k)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
                    sum(len(k) == len(key) + 1 for k in below), leaves, saved, sha(",".join(str(c) for c in sorted(members) if len(made[c]) == len(key)))))
    return sorted(out, key=str)


def _branching(seed, n):
    r = random.Random(seed)
    rows = [(r.choice([c, c, c, -c, None]), r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(["a b", "c", "", None, "d  e f"]))
            for c in range(n) for t in range(r.choice([1, 1, 3, 6]))]
    chain = [(c, t, "user", f"w {t if t < 25 else t * c}") for c in (5000, 5021) for t in range(40)]
    copies = [(c, t, "user", f"hot {t}") for c in range(6000, 6060) for t in range(4)]
    return rows + chain + copies + rows[:5]


@pytest.mark.parametrize("whole", [1, 7, trie.WHOLE])
def test_trie_equals_brute_force(spark, whole):
    rows = _branching(3, 90)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int").repartition(3)
    assert sorted(map(tuple, trie.rebuilt_trie(df, whole).collect()), key=str) == _trie(rows)


def test_trie_of_nothing(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    one = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    row = trie.rebuilt_trie(spark.createDataFrame([(one, 1, "user", "x" * 100_000)], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(one, 0, None, 1, 0, 1, 0, sha(str(one)))]


def test_centroids_split_a_chain_evenly():
    chain = list(range(-1, 999))
    leaves, saved = trie._decompose(chain, [0] * 999 + [1], [1] * 1000)
    assert leaves == [1] * 1000 and saved == list(range(1000, 0, -1))
