import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from etlvault.llm import jaccard_join
from etlvault.llm.common import read, shingle_sets
from etlvault.llm.components import connected
from etlvault.llm.jaccard_join import drop_similar, similar_classes

SF_DIR = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", (text or "").lower())
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(doc_id, class_id, n_links) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return sorted(((i, least[find(a)], links[a]) for a, (i, _) in enumerate(sets)), key=str)


def got(docs):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in similar_classes(docs).collect()), key=str)


def near_group(n, seed, length=120):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.integers(0, 6)):
            words[rng.integers(length)] = f"e{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


def test_shingle_sets_by_hand():
    texts = ["A b, c d e f", "a B c d e f!", None, "", "?!", "one two", "Two one", "x y z x y z x y z x"]
    tokens, bounds = shingle_sets(pa.array(texts))
    sets = [set(tokens[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[0] == sets[1] and sets[5] != sets[6] and all(tokens[a:b].tolist() == sorted(sets[i]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)))


def test_against_all_pairs(spark):
    rows = list(enumerate(near_group(40, 1) + near_group(3, 2, 9) + [f"alone {i} " + " ".join(f"q{i}x{k}" for k in range(30)) for i in range(30)] + near_group(40, 1)[:10]))
    docs = spark.createDataFrame([(i, t, "x", b"k", 5) for i, t in rows], "doc_id long, text string, id string, rid binary, n int").repartition(4)
    assert got(docs) == brute(rows)


def test_full_nodes_are_split_and_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    rows = list(enumerate(near_group(60, 3) + near_group(20, 4)))
    want, have = brute(rows), got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(w[2] for w in want) * 0.98 <= sum(h[2] for h in have) <= sum(w[2] for w in want)
    assert [h[:2] for h in have] == [w[:2] for w in want]


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "?!"), (4, "a b"), (5, "A  b."), (5, "A  b."), (None, "a b"), (7, long), (8, long + " end"), (9, "b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)
    left = drop_similar(docs)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 7, 9] and left.columns == docs.columns
    assert similar_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    have = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert have == {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [0])
def test_real_documents(spark, seed):
    docs = read(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)
