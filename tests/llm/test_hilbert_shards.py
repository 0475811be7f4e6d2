"""The curve by its defining properties, the shards against plain Python, and what pruning saves."""

import bisect
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from etlvault.llm import hilbert_shards as H

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot"]


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_by_steps_of_one(spark, dims, bits):
    cells = [F.col(f"c{i}") for i in range(dims)]
    df = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"c{i}" for i in range(dims)])
    found = df.select("*", H.curve_index(cells, bits).alias("k"), H.curve_index([F.shiftright(c, 1) for c in cells], bits - 1).alias("coarse")).orderBy("k").collect()
    assert [r["k"] for r in found] == list(range(1 << bits * dims))
    assert {sum(abs(a[i] - b[i]) for i in range(dims)) for a, b in itertools.pairwise(found)} == {1}
    blocks = [r["coarse"] for r in found]
    assert sum(a != b for a, b in itertools.pairwise(blocks)) == (1 << (bits - 1) * dims) - 1  # a block is left once


def plain(spark, docs, dimensions, shards, law):
    """Shards by walking through all rows in the order of the curve; cells and hashes as the operator takes them."""
    images = {n: H.image(docs, n) for n in dimensions}
    bounds = H.cell_bounds(docs.select(*[c.alias(n) for n, c in images.items()]), {n: F.col(f"`{n}`") for n in images})
    data = docs.select("doc_id", "text", *[c.alias(f"i_{n}") for n, c in images.items()]).collect()
    cells = [[0 if r[f"i_{n}"] is None else 1 + bisect.bisect_left(bounds[n], r[f"i_{n}"]) for n in dimensions] for r in data]
    assert all(0 <= x < 1 << H.CELL_BITS for row in cells for x in row)
    places, states = H.turns(len(dimensions))
    found = []
    for r, row in zip(data, cells, strict=True):
        index = state = 0
        for level in reversed(range(H.CELL_BITS)):
            at = state * 2 ** len(row) + sum((c >> level & 1) << d for d, c in enumerate(row))
            index, state = index << len(row) | places[at], states[at]
        text = (r["text"] or "").encode()
        found.append((index, zlib.crc32(text), len(text) + 16, (r["doc_id"] is not None, r["doc_id"] or 0), r["doc_id"]))
    found.sort(key=lambda x: x[:4])
    total, upto, slots, out = sum(x[2] for x in found), 0, {}, []
    for number, (_, crc, size, _, doc_id) in enumerate(found):
        upto += size
        shard = number * shards // len(found) if law == "rows" else (2 * upto - size) * shards // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((doc_id, size, crc, law, shard, slots[shard]))
    return sorted(out, key=str)


@pytest.mark.parametrize("law, dimensions", [("rows", H.DIMENSIONS), ("bytes", ("lang", "n_chars"))])
def test_whole_table_equals_plain_python(spark, rows, law, dimensions):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = H.hilbert_shards(docs, dimensions, law=law)
    assert rows(found, *COLUMNS) == plain(spark, docs, dimensions, H.SHARDS, law)


def test_query_keeps_its_law(spark):
    found = H.op13_hilbert_shards(spark, SF)
    assert found.columns == [*COLUMNS, "grown_shard"]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == set(docs)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len((docs[r["doc_id"]] or "").encode()) + 16, zlib.crc32((docs[r["doc_id"]] or "").encode()))
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, rows, law):
    data = [(None, None, None, None), (None, None, None, None), (1, "é" * 100_000, "de", "s"), (2, "", "de", "s"), (2, "", "de", "s"), (3, "a", None, "t")]
    data += [(10 + i, "copy", "en", "hot") for i in range(60)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in data], "doc_id long, text string, lang string, source string, curve long, shard long, number long, size long")
    assert rows(H.hilbert_shards(df, shards=7, law=law), *COLUMNS) == plain(spark, df, H.DIMENSIONS, 7, law)


def test_empty_table_and_fewer_rows_than_shards(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for law in ("rows", "bytes"):
        assert H.hilbert_shards(empty, law=law).collect() == []
    few = spark.createDataFrame([(i, "x" * i, "de", "s") for i in range(3)], empty.schema)
    assert sorted(r["slot"] for r in H.hilbert_shards(few).collect()) == [0, 0, 0]


def test_bytes_are_off_by_no_more_than_the_rows_at_the_ends(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = H.hilbert_shards(docs, ("lang", "source", "n_chars"), law="bytes").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    largest = docs.agg(F.max(F.octet_length("text"))).head()[0] + 16
    mean = sum(r["b"] for r in found) / 40
    assert all(abs(r["b"] - mean) <= largest for r in found)


def test_written_shards_are_pruned_by_every_dimension(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spans = H.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    top = docs.groupBy("source").count().orderBy("count").first()["source"]
    for wanted, most in (({"lang": "fr"}, 24), ({"source": top}, 16), ({"doc_id": (10, 60)}, 16), ({"lang": "fr", "doc_id": (10, 60)}, 8)):
        kept = H.matching_shards(spans, wanted)
        match = F.lit(True)
        for name, value in wanted.items():
            match = match & (F.col(name).between(*value) if isinstance(value, tuple) else F.col(name) == value)
        assert len(kept) <= most, (wanted, kept)
        assert docs.where(match).count() == back.where(match & F.col("shard").isin(kept)).count()
