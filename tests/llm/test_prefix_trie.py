"""The trie of rebuilt conversations against plain Python and SQL, at container limits that never, often and always burst."""

import hashlib
import random
import zlib

import pytest
from oracle import compare, duck

from etlvault.llm import ordered_digest as D
from etlvault.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", tie(role or "", text or ""), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        whole = tuple(turns.get(base, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((c, d == len(whole)))
    below = {p: [] for p in nodes}
    for p in nodes:
        if p:
            below[p[:-1]].append(p)
    size = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in nodes.items()}
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
        saved[p] = size[p] + sum(saved[q] for q in below[p])
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        yield (min(m)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())


def check(spark, data, rows, limit, extra=()):
    schema = SCHEMA + "".join(f", {c} string" for c in extra)
    df = spark.createDataFrame([(*r, *extra) for r in data], schema)
    assert rows(P.prefix_trie(df, limit), *COLUMNS) == sorted(plain(data), key=str)


@pytest.mark.parametrize("limit", [30, 10_000])
def test_shared_prefixes_copies_and_ends_inside(spark, rows, limit):
    draw = random.Random(limit)
    data = []
    for c in range(90):
        n = draw.choice([1, 2, 5, 10])
        data += [(c, t, draw.choice(["user", "assistant"]) if draw.random() < 0.1 else "user", draw.choice("ab") if draw.random() < 0.2 else f"é{t}") for t in range(n)]
    check(spark, data, rows, limit)


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, rows):
    data = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, "user", "x"), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 2, "user", "a"),
            (6, 1, "user", "y" * 500_000), (7, None, "", ""), (-3, 0, "user", "m"), (-5, 1, "user", "n"), (-6, 1, "user", "n"), (0, 3, "user", "z")]
    data += [(11 + i, t, "user", "same") for i in range(30) for t in range(20)]
    check(spark, data, rows, 25, extra=("conv", "depth", "head", "number", "bytes", "place", "key"))


def test_one_long_conversation(spark, rows):
    data = [(1, t, "user", f"t{t}") for t in range(600)] + [(2, t, "user", f"t{t}") for t in range(590)] + [(3, 0, "user", "t0")]
    check(spark, data, rows, 100)


def test_empty_table(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("limit", [100, P.CONTAINER_ROWS])
def test_query_equals_sql(spark, limit):
    path = "/root/testdata/sf0.01"
    df = P.prefix_trie(spark.read.parquet(f"{path}/conversations.parquet"), limit)
    assert compare(df, duck(path), P.ORACLE["op11_prefix_trie"]) == ""


def test_digests_of_groups_over_many_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 64)
    groups = {"a": 2000, "b": 1, "c": 0, "d": 37, "e": 900}
    data = [(k, i, str(i * i).encode()) for k, n in groups.items() for i in range(n)] + [("long", 1, b"z" * 300), ("none", 1, b""), ("none", 2, b"")]
    df = spark.createDataFrame(data, "key string, place long, piece binary").repartition(7)
    want = {}
    for k, _, piece in data:
        want.setdefault(k, []).append(piece)
    assert rows(D.ordered_digest(df, b", "), "key", "sha256") == sorted((k, hashlib.sha256(b", ".join(x)).hexdigest()) for k, x in want.items())
