import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from etlvault.llm.exact_dedup import drop_copies, exact_groups, repeated_fingerprints
from etlvault.llm.quotient_filter import CountingQuotientFilter as Filter

values = st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), max_size=60)


@settings(max_examples=60, deadline=None)
@given(values, values)
def test_filters_merge_without_loss(a, b):
    merged = Filter.of(np.array(a, np.uint64)).merge(Filter.of(np.array(b, np.uint64)))
    got, counts = Filter.from_bytes(merged.to_bytes()).entries()
    want, n = np.unique(np.array(a + b, np.uint64), return_counts=True)
    assert got.tolist() == want.tolist() and counts.tolist() == n.tolist()
    assert all(merged.count(v) == (a + b).count(v) for v in a + b)


def test_repeated_fingerprints(spark):
    fps = [7, -7, 7, 2**62, -2**63, -2**63, 5]
    got = repeated_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(-2**63, 2), (7, 2)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, norm string, keep_id int")


def test_groups(spark, rows):
    long = "word " * 50_000
    d = docs(spark, [(5, "a  b", "x", None, 1), (3, "a\tb", "y", None, 1), (9, "a b", None, None, 1), (4, None, None, None, 1), (2, "", "", "", 1),
                     (1, "a b ", "", "", 1), (7, long, "", "", 1), (8, long, "", "", 1), (6, "once", "", "", 1), (6, "once", "", "", 1), (None, "nil", "", "", 1)])
    got = rows(exact_groups(d), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(5, 3, 3, False), (3, 3, 3, True), (9, 3, 3, False), (4, 2, 2, False), (2, 2, 2, True), (1, 1, 1, True), (7, 7, 2, True),
                          (8, 7, 2, False), (6, 6, 2, True), (6, 6, 2, False), (None, None, 1, True)], key=str)
    left = drop_copies(d)
    assert left.columns == d.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in left.collect()) == [-1, 1, 2, 3, 6, 7]


def test_one_id_with_two_texts(spark):
    d = docs(spark, [(1, "a", "", "", 1), (1, "a", "", "", 1), (1, "b", "", "", 1)])
    assert sorted(r.text for r in drop_copies(d).collect()) == ["a", "b"]


def test_empty(spark):
    d = docs(spark, [])
    assert exact_groups(d).count() == 0 and drop_copies(d).count() == 0
