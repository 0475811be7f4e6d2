import re
from itertools import combinations

import numpy as np

from etlvault.llm.common import read
from etlvault.llm.url_rules import RULES, judge, mine

CASES = [
    ("http://a.b.org/x?q=1", "a.b.org", "/x", "org/", "allow"), ("HTTP://Www.EXAMPLE.org/es/9#t", "www.example.org", "/es/9", "example.org/es/", "block"),
    ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"), ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://badexample.org/es/2", "badexample.org", "/es/2", "org/", "allow"), ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://x.com/DE/1", "x.com", "/DE/1", None, "allow"), ("http://org?x", "org", "", None, "allow"),
    ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://ÄB.com/de/", "Äb.com", "/de/", "com/de/", "block"),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_given_rules(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = judge(pages(spark, [c[0] for c in CASES] * 2), none).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [c[1:] for c in CASES] * 2
    assert judge(pages(spark, []), none).count() == 0


def test_mined_rules_against_all_combinations(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        items = [t for t, p in (("a", .5), ("b", .5), ("c", .4), ("d", .3)) if rng.random() < p]
        bad = rng.random() < (0.95 if {"a", "b"} <= set(items) else 0.9 if "d" in items else 0.1)
        rows.append((items, "block" if bad else "allow"))
    got = {(tuple(r["items"]), r.verdict): r.confidence for r in mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02).collect()}
    found = {}
    for n in range(1, 5):
        for items in combinations("abcd", n):
            with_items = [v for t, v in rows if set(items) <= set(t)]
            for verdict in ("allow", "block"):
                both = with_items.count(verdict)
                share = sum(v == verdict for _, v in rows) / len(rows)
                if both >= max(0.02 * len(rows), 10) and both / len(with_items) >= 0.8 and both / len(with_items) / share >= 1.05:
                    found[items, verdict] = both / len(with_items)
    want = {k: c for k, c in found.items() if not any(found.get((tuple(x for x in k[0] if x != drop), k[1]), 0) >= c for drop in k[0] if len(k[0]) > 1)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and ("a", "b") in {k[0] for k in got}


def test_mined_rules_decide(spark):
    urls = [f"https://{'spam' if i % 2 else 'good'}.shop.net/{'buy' if i % 4 == 1 else 'read'}/{i}?ref={i}" for i in range(200)] + [None]
    labels = spark.createDataFrame([(i, None if i % 10 == 5 else int(i % 4 != 1), None if i % 5 == 0 else 0) for i in range(150)] + [(None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in judge(pages(spark, urls), labels).collect()}
    assert all(got[i].verdict == ("block" if i % 4 == 1 else "allow") for i in range(200)) and got[200].verdict == "allow"
    assert got[1].mined and got[1].rule is None


def test_real_pages(spark):
    source, labels = read(spark, "/root/testdata/sf0.01", "pages"), read(spark, "/root/testdata/sf0.01", "labels")
    got = {r.page_id: r for r in judge(source, labels).collect()}
    for r in source.select("page_id", "url").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        have = got.pop(r.page_id)
        assert (have.host, have.path, have.rule) == (host, path, rule) and (verdict is None or verdict == have.verdict)
    assert not got
