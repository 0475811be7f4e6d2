import re

import numpy as np
import pytest

from etlvault.llm import decontaminate
from etlvault.llm.common import read
from etlvault.llm.decontaminate import align, drop_leaked, find_leaks

SF_DIR = "/root/testdata/sf0.001"


def brute_align(a, b):
    best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_against_the_full_matrix():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 20))
        score, x, y = align(a, b)
        assert score == brute_align(a, b)
        assert score == 0 or brute_align(a, b[x:y]) == score


def words(text):
    return re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """Align every item with every whole document that shares an n-gram with it."""
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            n = min(5, len(v))
            grams = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
            if any(tuple(w[k:k + n]) in grams for k in range(len(w) - n + 1)) and brute_align(v, w) >= 0.5 * 2 * len(v):
                out.add((d, i))
    return out


def got(docs, items):
    return {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}


def test_real_documents(spark):
    docs, items = read(spark, SF_DIR, "documents"), read(spark, SF_DIR, "benchmark")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 4000]
    have = {p for p in got(docs, items) if p[0] in dict(short)}
    assert have == brute(short, [(r.item_id, r.text) for r in items.collect()]) and have


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_edited_copies(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", ("item_id", "text", block_words))
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(k, "which of the following is true about " + " ".join(rng.choice(vocabulary, 30))) for k in range(8)] + [(50, "tiny one item"), (51, None), (52, ""), (53, "Tiny, one item!")]
    docs, leaked = [], set()
    for d in range(120):
        text = list(rng.choice(vocabulary, 200))
        if d % 4 == 0:
            copy = words(items[d % 8][1])
            for _ in range(d % 7):
                copy[rng.integers(len(copy))] = "edited"
            text[100:100] = copy
            leaked.add(d)
        if d % 4 == 1:
            text[10:10] = "which of the following is true about".split()
        docs.append((d, " ".join(text), "x", None))
    docs += [(900, None, "", 0), (901, "", "", 0), (902, "so tiny one item", "", 0), (902, "so tiny one item", "", 0), (None, "a tiny one item " + "long " * 50_000, "", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    have = got(frame, benchmark)
    assert {d for d, _ in have} == leaked | {902, None} and {i for d, i in have if d == 902} == {50, 53}
    left = drop_leaked(frame, benchmark)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {d for d, *_ in docs} - leaked - {902, None}


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).count() == 0 and drop_leaked(docs, items).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_leaks(docs.limit(0), some).count() == 0 and got(docs, some) == {(1, 1)}


def test_a_passage_edited_alike_in_many_documents(spark):
    """More than a quarter of the item's seeds never occur, the others in every document."""
    rng = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(500)]
    item = list(rng.choice(vocabulary, 38, replace=False))
    edited = [*item[:14], "changed", *item[15:22], "words", *item[23:]]
    docs = [(d, " ".join([*rng.choice(vocabulary, 30), *edited, *rng.choice(vocabulary, 30)])) for d in range(300)]
    items = [(1, " ".join(item)), (2, " ".join(rng.choice(vocabulary, 38)))]
    have = got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert have == brute(docs, items) == {(d, 1) for d in range(300)}


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_items_that_share_a_context(spark, monkeypatch, block_words):
    """Documents quote what several items share, without or with an edit of where they differ."""
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", ("item_id", "text", block_words))
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(500)]
    context = list(rng.choice(vocabulary, 32, replace=False))
    items = [(k, " ".join([*context, *(f"q{k}x{i}" for i in range(6))])) for k in range(7)]
    docs = [(1, " ".join([*rng.choice(vocabulary, 40), *context, *rng.choice(vocabulary, 40)])), (2, " ".join([*context, "another", "question"])),
            (3, " ".join([*context[:7], *rng.choice(vocabulary, 60)])), (4, " ".join([*context[:12], *("put", "in") * 8, *context[12:]]))]
    have = got(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert have == brute(docs, items) == {(d, k) for d in (1, 2, 4) for k in range(7)}
    left = drop_leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {3}
