"""Conversation repair against the search through all edit sequences, and whole tables against plain Python."""

import hashlib
import itertools
import re
import zlib

import pytest

from etlvault.llm import turn_repair as T

PATTERN = re.compile(r"(s?(ua)+)?")


def all_repairs(initials, faults):
    """Every (cost, audit, roles) that the rules allow, with up to two inserts at each place, one of longer conversations."""
    inserts = [x for k in range(3 if len(initials) < 3 else 2) for x in itertools.product("ua", repeat=k)]
    per_turn = []
    for initial, fault in zip(initials, faults, strict=True):
        more = 5 if fault == T.TRUNCATED else 0
        options = [(2, "D", "")]
        if fault not in (T.BLANK, T.DUPLICATE):
            options += [(more, "K", initial), (1 + more, "R", "u"), (1 + more, "R", "a")]
        per_turn.append([(c + 5 * len(i), "I" * len(i) + x, "".join(i) + r) for i in inserts for c, x, r in options])
    per_turn.append([(5 * len(i), "I" * len(i), "".join(i)) for i in inserts])
    for steps in itertools.product(*per_turn):
        roles = "".join(s[2] for s in steps)
        if PATTERN.fullmatch(roles):
            yield sum(s[0] for s in steps), "".join(s[1] for s in steps), roles


def test_edits_are_the_cheapest_and_ascii_least():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product(range(4), repeat=n) if n < 3 else [(0, 0, 0), (3, 0, 3), (0, 3, 0), (0, 1, 0), (3, 3, 3)]:
                want = min(all_repairs(initials, faults))
                assert T.edits("".join(initials), faults) == want[:2], (initials, faults)
                roles, before, after = T.apply(want[1], "".join(initials))
                got = "".join((b.replace("user:", "u").replace("assistant:", "a").replace("\n", "")) + ("" if r is None else r[0] if r else i)
                              for r, b, i in zip(roles, before, initials, strict=True)) + "".join(x[0] for x in after)
                assert got == want[2]


def test_long_conversations_read_their_digits_alike():
    cost, audit = T.edits("ua" * 1000, [0] * 2000)
    assert (cost, audit) == (0, "K" * 2000)
    cost, audit = T.edits("u" * 1501, [0] * 1501)
    assert cost == 752 and len(audit) == 1501 and audit.count("D") == 1


def plain(rows):
    """The contract row by row: rows are (conv_id, turn, role, text)."""
    def shown(x):
        return " " if x is None else str(x)

    groups = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(T.BLANK if not body else T.DUPLICATE if (role, text) in seen else T.TRUNCATED if body[-1] not in ".!?" else T.CLEAN)
            seen.add((role, text))
        initials = "".join(role[:1] or " " for _, role, _ in turns)
        cost, audit = T.edits(initials, faults)
        roles, before, after = T.apply(audit, initials)
        lines = []
        for (_, role, text), new, lead in zip(turns, roles, before, strict=True):
            lines += ([lead] if lead else []) + ([] if new is None else [f"{new or role}:{text}"])
        lines += [f"{x}:" for x in after]
        known = {t for t, _, _ in turns if t is not None}
        yield (conv, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(k) for k in (T.BLANK, T.DUPLICATE, T.TRUNCATED)),
               sum(p not in ("su", "ua", "au") for p in map("".join, itertools.pairwise(initials))), cost, audit,
               hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["conv_id", *T.STATS, "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def check(df, data, rows):
    assert rows(T.repaired_conversations(df), *COLUMNS) == sorted(plain(data), key=str)


def test_query_equals_plain_python(spark, rows):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    data = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = T.op12_turn_repair(spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("conv_id", "bigint"), *((c, "bigint") for c in T.STATS), ("audit", "string"), ("repaired_sha256", "string")]
    assert rows(got, *COLUMNS) == sorted(plain(data), key=str)


def test_nulls_ties_repeats_and_long_texts(spark, rows):
    data = [(1, None, None, None), (1, None, "user", "Why?"), (1, 0, "assistant", "So."), (1, 0, "assistant", "So."), (1, 0, "assistant", "No"),
            (2, 5, "tool", "x" * 300_000 + "."), (2, 6, "", "\t\n"), (2, 9, "user", " end! \x0b"), (None, 1, "user", "Ok."), (None, None, "assistant", "Ok."),
            (3, None, "user", "a."), (4, 2, "system", "Be kind."), (4, 3, "système", "é"), (5, 1, "user", " ")]
    data += [(9, i, "user" if i % 2 else "assistant", f"turn {i}.") for i in range(700)]
    check(spark.createDataFrame(data, SCHEMA), data, rows)


def test_hot_conversation_and_clashing_columns(spark, rows, monkeypatch):
    monkeypatch.setattr("etlvault.llm.ordered_digest.CHUNK", 200)
    data = [(i % 3 * (i % 2), i, "user" if i % 4 < 2 else "assistant", f"words {i}.") for i in range(900)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in data], SCHEMA + ", conv_key string, number long, place long, key string, audit string")
    check(df, data, rows)


def test_empty_table_and_all_rows_dropped(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.repaired_conversations(empty).collect() == []
    turn = next(t for t in range(500) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert rows(T.repaired_conversations(spark.createDataFrame([(7, turn, "user", "Hi.")], SCHEMA)), *COLUMNS) == [
        (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("initials, want", [("ua", (0, "KK")), ("s", (2, "D")), ("aua", (2, "DKK")), ("uua", (2, "DKK")), ("suaa", (2, "KKDK")), ("", (0, ""))])
def test_some_repairs(initials, want):
    assert T.edits(initials, [0] * len(initials)) == want
