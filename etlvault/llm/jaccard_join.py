"""Jaccard self-join of word-shingle sets by the chosen path method.

A set walks down a random tree: at each node a seeded hash samples a few of its tokens, and
the set goes on along each of them. Similar sets sample the same shared tokens, so they meet.
Nodes that hold few sets are compared by brute force; fuller nodes are split again on further
tokens; nodes that stay full after the last split are dense with similar sets and are compared
in blocks, each pair of blocks a task of its own. Independent runs repeat until the chance to
miss a pair at the threshold is below ``1 - recall``.

Equal sets are joined first and stand for one another, so copies never meet again. A pair that
meets in several leaves is counted only in the least of them, so pairs need not be made
distinct, or be written at all: leaves give each set its number of partners and one edge.
Before whole sets travel to leaves, small bottom-k sketches rule out leaves without a likely
pair; only sets with one are built again from their text and compared exactly.

Defined cases: NULL, empty and wordless texts are similar to nothing and form classes of their
own; a text of fewer words than a shingle has one shingle of all of them; repeated rows and
rows of one id count as copies; NULL ids take part and order last; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import cut, keep_rows, mix, read, shingle_sets, slices, whole_groups
from etlvault.llm.components import connected

THRESHOLD = 0.8
RECALL = 0.995   # of pairs exactly at the threshold; more similar pairs meet more often
BRANCH = 1.25    # tokens a set samples at the root of a run, on average
SUB_BRANCH = 2.0  # and at each further node
DEPTH = 2        # levels of splits
LEAF = 1_000     # sets of a node that is not split further, and of a block of a dense node
SKETCH = 64      # least tokens kept as a sketch
_TOP = np.uint64(2**64 - 1)
_GOLD = 0x9E3779B97F4A7C15


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met in a leaf with the given probability.

    Two sets at Jaccard similarity t share at least t of the larger one's tokens, so the number
    of tokens both sample is about Poisson with mean branch x t; deeper nodes keep a meeting
    with probability 1 - exp(-sub_branch x t) each.
    """
    kept = (1 - math.exp(-SUB_BRANCH * threshold)) ** (DEPTH - 1)
    return math.ceil(-math.log(1 - recall) / (BRANCH * threshold * kept))


def _limits(n: np.ndarray, branch: float) -> np.ndarray:
    """Hash value below which a token of a set of ``n`` tokens is sampled."""
    share = np.minimum(branch / np.maximum(n, 1), 1.0)
    return np.where(share >= 1.0, _TOP, (share * 2.0**63).astype(np.uint64) * np.uint64(2))


def _set_key(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def _describe(runs: int):
    seeds = [mix(np.array([r + 1], np.uint64) * np.uint64(_GOLD))[0] for r in range(runs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                tokens, bounds = shingle_sets(part.column("text"))
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                limit = _limits(n, BRANCH)[owner]
                paths, owners = [], []
                for seed in seeds:
                    taken = mix(tokens ^ seed) < limit
                    paths.append(mix(tokens[taken] + seed))
                    owners.append(owner[taken])
                owners = np.concatenate(owners)
                order = np.argsort(owners, kind="stable")
                paths = np.concatenate(paths)[order].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(n)))]).astype(np.int32)
                keys = [_set_key(tokens[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sketches = [tokens[a:min(b, a + SKETCH)].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(keys, pa.binary()), pa.array(n.astype(np.int32)), pa.array(sketches, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(paths))], ["doc_id", "rid", "n", "sketch", "paths"])

    return run


def _sketch_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    out = np.full((len(column), SKETCH), _TOP)
    for i, s in enumerate(column.to_pylist()):
        values = np.frombuffer(s, np.uint64)
        out[i, :len(values)] = values
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Further paths of the sets of full nodes, sampled from their sketches."""
    for batch in batches:
        sketch = _sketch_matrix(batch.column("sketch"))
        n = (sketch != _TOP).sum(1)
        path = batch.column("path").to_numpy().view(np.uint64)
        taken = (mix(sketch ^ mix(path + np.uint64(_GOLD))[:, None]) < _limits(n, SUB_BRANCH)[:, None]) & (sketch != _TOP)
        rows, places = np.nonzero(taken)
        onward = mix(sketch[rows, places] ^ mix(path[rows])).view(np.int64)
        parent, full = (batch.column(c).take(pa.array(rows)) for c in ("path", "size"))
        yield pa.RecordBatch.from_arrays([parent, full, pa.array(onward), batch.column("rid").take(pa.array(rows))], ["parent", "full", "path", "rid"])


def _leaf_lists(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The leaves of every row, one row of a matrix each, filled up with the largest number."""
    lists = [np.asarray(x, np.int64) for x in column.to_pylist()]
    out = np.full((len(lists), max(map(len, lists), default=0)), np.iinfo(np.int64).max)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def _owned(leaves: np.ndarray, path: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether each pair's leaf is the least that both rows share; blocks of a leaf split its pairs among them."""
    own = np.ones(len(i), bool)
    step = max(1, int(2e7) // max(1, leaves.shape[1] ** 2))
    for at in range(0, len(i), step):
        a, b = leaves[i[at:at + step]], leaves[j[at:at + step]]
        less = a < path[i[at:at + step], None]
        own[at:at + step] = ~((a[:, :, None] == b[:, None, :]) & less[:, :, None]).any((1, 2))
    return own


def _likely(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sketches leave room for the threshold: four deviations, none if they are whole sets."""
    top = np.where(n > SKETCH, sketch[:, -1], _TOP - np.uint64(1))
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        x, y = i[at:at + 20_000], j[at:at + 20_000]
        reach = np.minimum(top[x], top[y])[:, None]
        both = np.sort(np.concatenate([sketch[x], sketch[y]], 1), 1)
        common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] <= reach)).sum(1)
        union = (both <= reach).sum(1) - common
        whole = (n[x] <= SKETCH) & (n[y] <= SKETCH)
        slack = np.where(whole, 1e-9, 4 * np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1)))
        out[at:at + 20_000] = common >= (threshold - slack) * union
    return out


def _pairs(bounds: np.ndarray, sketch: np.ndarray, n: np.ndarray, threshold: float, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs of rows of one group, in chunks: small groups pair by pair, large ones row by row."""
    held_i, held_j, count = [], [], 0
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 64:
            for x, y in _likely_rows(sketch[a:b], n[a:b], threshold):
                yield x + a, y + a
            continue
        for x in range(a, b - 1):
            held_i.append(np.full(b - x - 1, x))
            held_j.append(np.arange(x + 1, b))
            count += b - x - 1
        if count >= most:
            i, j = np.concatenate(held_i), np.concatenate(held_j)
            fits = _likely(sketch, n, i, j, threshold)
            yield i[fits], j[fits]
            held_i, held_j, count = [], [], 0
    if count:
        i, j = np.concatenate(held_i), np.concatenate(held_j)
        fits = _likely(sketch, n, i, j, threshold)
        yield i[fits], j[fits]


def _likely_rows(sketch: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_likely`` for all pairs of a group: one row's tokens are marked and counted in all later rows."""
    top = np.where(n > SKETCH, sketch[:, -1], _TOP - np.uint64(1))
    known, flat = np.unique(sketch, return_inverse=True)
    flat = flat.reshape(sketch.shape)
    mark = np.zeros(len(known), np.int8)
    found_i, found_j = [], []
    for x in range(len(n) - 1):
        mine = flat[x][sketch[x] != _TOP]
        mark[mine] = 1
        common = mark[flat[x + 1:]].sum(1, dtype=np.int64)
        mark[mine] = 0
        reach = np.minimum(top[x], top[x + 1:])
        union = (sketch[x] <= reach[:, None]).sum(1) + (sketch[x + 1:] <= reach[:, None]).sum(1) - common
        whole = (n[x] <= SKETCH) & (n[x + 1:] <= SKETCH)
        slack = np.where(whole, 1e-9, 4 * np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1)))
        y = np.flatnonzero(common >= (threshold - slack) * union) + x + 1
        found_i.append(np.full(len(y), x))
        found_j.append(y)
    yield np.concatenate(found_i), np.concatenate(found_j)


def _bounds(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])


def _plausible(threshold: float):
    """Rows of leaves in which they own a likely pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            bucket, path = table.column("bucket").to_numpy(), table.column("path").to_numpy()
            n, blk = table.column("n").to_numpy(), table.column("blk").to_numpy()
            same = table.column("same").to_numpy(zero_copy_only=False)
            sketch, leaves = _sketch_matrix(table.column("sketch")), _leaf_lists(table.column("leaves"))
            taken = np.zeros(len(bucket), bool)
            for i, j in _pairs(_bounds(bucket), sketch, n, threshold):
                fits = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & (same[i] | (blk[i] != blk[j]))
                i, j = i[fits], j[fits]
                fits = _owned(leaves, path, i, j)
                taken[i[fits]] = taken[j[fits]] = True
            out = table.filter(pa.array(taken)).drop_columns(["n", "sketch"])
            yield from out.combine_chunks().to_batches()
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuild the sets from their texts: a row for each leaf that asked for the set."""
    names = ["bucket", "path", "rid", "copies", "blk", "same", "leaves", "tokens"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.binary()]
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            tokens, bounds = shingle_sets(part.column("text"))
            rows = []
            for k, (rid, copies, entries) in enumerate(zip(*(part.column(c).to_pylist() for c in ("rid", "copies", "entries")), strict=True)):
                own = tokens[bounds[k]:bounds[k + 1]]
                if _set_key(own) == rid:  # other texts of a repeated id are not meant
                    rows += [(e["bucket"], e["path"], rid, copies, e["blk"], e["same"], e["leaves"], own.tobytes()) for e in entries]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _verify(threshold: float):
    """Exact comparison inside the leaves: partners of each set and one edge to its local root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            bounds = _bounds(table.column("bucket").to_numpy())
            out: list[tuple[bytes, int, int, bytes]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    out += _verify_group(table.slice(a, b - a), threshold)
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             ["rid", "partners", "texts", "root"])
    return run


def _verify_group(group: pa.Table, threshold: float) -> list[tuple[bytes, int, int, bytes]]:
    first = {r: i for i, r in reversed(list(enumerate(group.column("rid").to_pylist())))}
    order = sorted(first)
    group = group.take(pa.array([first[r] for r in order]))
    if len(order) < 2:
        return []
    sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
    n = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    copies, blk = group.column("copies").to_numpy(), group.column("blk").to_numpy()
    same, path = group.column("same").to_numpy(zero_copy_only=False), group.column("path").to_numpy()
    leaves = _leaf_lists(group.column("leaves"))
    partners, texts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    root = list(range(len(order)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    mark = np.zeros(len(known), np.int32)
    for x in range(len(order) - 1):
        mine = flat[starts[x]:starts[x] + n[x]]
        mark[mine] = 1
        common = np.add.reduceat(mark[flat[starts[x + 1]:]], starts[x + 1:] - starts[x + 1])
        mark[mine] = 0
        union = n[x] + n[x + 1:] - common
        y = np.flatnonzero((common >= threshold * union - 1e-9) & (same[x] | (blk[x] != blk[x + 1:]))) + x + 1
        if len(y):
            y = y[_owned(leaves, path, np.full(len(y), x), y)]
            partners[x] += copies[y].sum()
            texts[x] += len(y)
            partners[y] += copies[x]
            texts[y] += 1
            for other in y.tolist():
                p, q = find(x), find(other)
                root[max(p, q)] = min(p, q)
    return [(order[x], int(partners[x]), int(texts[x]), order[find(x)]) for x in range(len(order)) if texts[x]]


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), n_links, n_copies, kept.

    ``n_links`` counts the other documents at least ``threshold`` similar, copies included;
    ``n_copies`` the documents with the same shingle set. ``kept`` marks the class's own id.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    records = cut(source.mapInArrow(_describe(runs_needed(threshold, recall)), "doc_id long, rid binary, n int, sketch binary, paths array<long>"))
    with_set = records.where("rid IS NOT NULL")
    copies = with_set.groupBy("rid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sketches = with_set.select("rid", "n", "sketch").dropDuplicates(["rid"])

    def met(members: DataFrame) -> DataFrame:
        """``members`` with the size of their node, where more than one set reaches it."""
        sizes = members.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return cut(members.join(sizes, "path"))

    nodes = met(with_set.select(F.explode("paths").alias("path"), "rid").distinct())
    ready, full = nodes.where(F.col("size") <= LEAF), nodes.where(F.col("size") > LEAF)
    for _ in range(DEPTH - 1):
        if full.isEmpty():
            break
        onward = full.join(sketches, "rid").select("path", "size", "rid", "sketch")
        nodes = met(onward.mapInArrow(_split, "parent long, full long, path long, rid binary").distinct())
        dense = nodes.groupBy("parent", "full").agg(F.max("size").alias("most")).where("2 * most >= full").select("parent")
        ready = ready.unionByName(full.join(dense, full["path"] == dense["parent"], "left_semi"))
        nodes = nodes.join(dense, "parent", "left_anti").select("path", "rid", "size")
        ready, full = ready.unionByName(nodes.where(F.col("size") <= LEAF)), nodes.where(F.col("size") > LEAF)

    blocks = F.ceil(F.col("size") / LEAF).cast("int")
    placed = (ready.unionByName(full).withColumn("blk", F.pmod(F.xxhash64("rid"), blocks).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select("rid", F.struct(F.xxhash64("path", F.least("blk", "other"), F.greatest("blk", "other")).alias("bucket"), "path", "blk",
                                      (F.col("blk") == F.col("other")).alias("same")).alias("leaf")))
    leaves = (placed.groupBy("rid").agg(F.collect_list("leaf").alias("own")).join(sketches, "rid")
              .select("rid", "n", "sketch", F.array_distinct("own.path").alias("leaves"), F.explode("own").alias("leaf"))
              .select("leaf.bucket", "leaf.path", "rid", "n", "sketch", "leaf.blk", "leaf.same", "leaves"))
    likely = cut(leaves.repartition("bucket").sortWithinPartitions("bucket")
                 .mapInArrow(_plausible(threshold), "bucket long, path long, rid binary, blk int, same boolean, leaves array<long>"))
    wanted = (likely.groupBy("rid").agg(F.collect_list(F.struct("bucket", "path", "blk", "same", "leaves")).alias("entries"))
              .join(copies, "rid").select("rid", "copies", "rep", "entries"))
    sets = (source.join(wanted, source["id"].eqNullSafe(wanted["rep"])).select("rid", "copies", "entries", "text")
            .mapInArrow(_sets, "bucket long, path long, rid binary, copies long, blk int, same boolean, leaves array<long>, tokens binary"))
    linked = cut(sets.repartition("bucket").sortWithinPartitions("bucket")
                 .mapInArrow(_verify(threshold), "rid binary, partners long, texts long, root binary"))
    degree = linked.groupBy("rid").agg(F.sum("partners").alias("partners"))
    part_of = connected(linked, "rid", "root").select(F.col("node").alias("rid"), "root")
    least = part_of.join(copies, "rid").groupBy("root").agg(F.min("rep").alias("class_id"))
    about = (copies.join(degree, "rid", "left").join(part_of.join(least, "root"), "rid", "left")
             .select("rid", F.coalesce("class_id", "rep").alias("class_id"), "copies",
                     (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")))
    out = records.select("doc_id", "rid").join(about, "rid", "left")
    class_id = F.when(F.col("rid").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.coalesce("copies", F.lit(1)).alias("n_copies"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, the one with the least id; rows without an id stay."""
    kept = (similar_classes(docs, id_col, text_col).where("kept AND doc_id IS NOT NULL")
            .groupBy(F.col("doc_id").alias(id_col)).agg(F.count(F.lit(1)).alias("__copies")))
    rows = keep_rows(docs.where(F.col(id_col).isNotNull()), kept, id_col, "__copies", F.col(text_col))
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(read(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE: dict[str, str] = {}
