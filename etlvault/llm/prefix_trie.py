"""Prefix trie of conversations by burst tries.

A container holds the suffixes of all conversations that share the turns down to one node. One
container starts at the root. A container of more than ``CONTAINER_ROWS`` turns bursts: the turns
all its members share become trie heads in one step, and its members are parted by their next
turn into new containers, one below each head. What is left after the last burst are containers
of bounded size. Those of one conversation are nodes as they stand; the others are sorted by
suffix and swept into nodes, with a stack as deep as the longest suffix.

A node is named by its least member and its depth. A conversation is rows (conversation,
depth, turn id, bytes) all the way, a turn id being 128 bits of a SHA-256 of role and text, so
neither a long conversation nor a common prefix is gathered: heads are found by aggregates with
map-side partials, subtree sums reach the heads above by one aggregate over each container's list
of heads, and the ids that end at a node are hashed as a stream.

Defined cases: rows without a conversation id belong to no conversation; NULL role or text is
empty; turns sort NULL first, equal turns by role and then turn id, repeated rows stay; NULL and
very long texts count by their UTF-8 bytes; an empty table gives no rows, not even a root.
Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from etlvault.llm.common import cut, read
from etlvault.llm.ordered_digest import ordered_digest
from etlvault.operators.ordered import with_running_number

CONTAINER_ROWS = 8192  # turns in a container from which it bursts
FAMILY = 5             # conversations that share the first turns of one of them
HEAD_MODULUS = 9       # shared turns are fewer than this
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def turn_rows(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth from 1, turn, bytes) in turn order, and (conv, n) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), role.alias("role"), F.substring(digest, 1, 16).alias("turn"),
        F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("bytes"))
    numbered = cut(with_running_number(rows, ["conv", "at", "role", "turn"], "number"))
    firsts = numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = numbered.join(firsts, "conv").select("conv", (F.col("number") - F.col("first") + 1).alias("depth"), "turn", "bytes")
    return placed, firsts.select("conv", "n")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, turn, bytes) and (conv, length) of the rebuilt conversations; depth 0 is a row of its own.

    The first ``h`` turns come from the first conversation of a family of five, the rest from the
    conversation's own turns after its first ``h``.
    """
    turns, sizes = turn_rows(conversations)
    turns = cut(turns)
    base = F.col("conv") - F.col("conv") % FAMILY
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_MODULUS
    convs = sizes.select("conv", base.alias("base"), shared.alias("h"), F.col("n").alias("own"))
    base_sizes = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut(convs.join(base_sizes, "base", "left").select("conv", "base", "h", given.alias("given"), "own"))
    own = turns.join(convs, "conv").where("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("given")).alias("depth"), "turn", "bytes")
    heads = turns.where((F.col("depth") < HEAD_MODULUS) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    lent = heads.join(convs.select("conv", "base", "given"), "base").where("depth <= given").select("conv", "depth", "turn", "bytes")
    tops = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("turn"), F.lit(0).cast("long").alias("bytes"))
    lengths = convs.select("conv", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return own.unionByName(lent).unionByName(tops), lengths


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted containers; a row is one conversation's suffix, the head's own turn first.

    An open node is [least member, turn, members, children, leaves, saved, ends]; a
    conversation's rows close all open nodes that its suffix does not share.
    """
    names = [x.split()[0] for x in NODE.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()]
    container, parent, depth, stack, out = None, None, 0, [], []

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            conv, _, size, n, children, leaves, saved, ends = stack.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * size
            if stack:
                above = stack[-1]
                above[0] = min(above[0], conv)
                above[4] += 1
                above[5] += leaves
                above[6] += saved
            at = len(out)
            out.append([conv, depth + len(stack), parent, n, children, leaves, saved,
                        hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest() if ends else NOTHING])
            for child in waiting.pop(len(stack) + 1, ()):
                out[child][2] = conv
            waiting.setdefault(len(stack), []).append(at)

    waiting: dict[int, list[int]] = {}  # rows of ``out``, by level, that wait for the name of the node above
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "head_depth", "parent", "conv", "turns", "sizes")]
        for head, head_depth, above, conv, turns, sizes in zip(*columns, strict=True):
            if (head, head_depth) != container:
                close(0)
                waiting.clear()
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out.clear()
                container, parent, depth = (head, head_depth), above, head_depth
            same = 0
            while same < len(stack) and same < len(turns) and stack[same][1] == turns[same]:
                same += 1
            close(same)
            for node in stack:
                node[0] = min(node[0], conv)
                node[3] += 1
            for turn, size in zip(turns[same:], sizes[same:], strict=True):
                stack.append([conv, turn, size, 1, 0, 0, 0, []])
            stack[-1][7].append(conv)
    close(0)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def burst(rows: DataFrame, members: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Burst containers until none is above ``limit`` turns.

    Returns the members (conv, length, head, head_depth, parent, above) of the containers that are
    left, their sizes (head, head_depth, n), and of each round the heads (head, top, bottom,
    parent, above, n, n_children), the nodes on their way (head, top, depth, bytes) and the
    conversations (head, top, conv) that end at the bottom. ``above`` lists the heads, by (head, top), that a container lies below.
    """
    above = F.array().cast("array<struct<head:long,top:long>>")
    least = members.agg(F.min("conv")).scalar()
    live = members.select("conv", "length", least.alias("head"), F.lit(0).cast("long").alias("head_depth"),
                          F.lit(None).cast("long").alias("parent"), above.alias("above"))
    key = ["head", "head_depth"]
    done, sizes, heads, ways, ended = [], [], [], [], []
    while True:
        live = cut(live)
        size = cut(live.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("length") - F.col("head_depth") + 1).alias("n_rows"),
                                          F.first("parent").alias("parent"), F.first("above").alias("above")))
        large = size.where((F.col("n_rows") > limit) & (F.col("n") > 1))
        if large.isEmpty():
            done.append(live)
            sizes.append(size.select(*key, "n"))
            break
        done.append(live.join(large.select(*key), key, "left_anti"))
        sizes.append(size.join(large.select(*key), key, "left_anti").select(*key, "n"))
        hot = live.join(large.select(*key), key, "left_semi").select("conv", "length", *key)
        inside = hot.join(rows, "conv").where("depth >= head_depth")
        profile = cut(inside.groupBy(*key, "depth").agg(F.count(F.lit(1)).alias("have"), F.min("turn").alias("low"), F.max("turn").alias("high"),
                                                         F.max("bytes").alias("bytes")).join(large.select(*key, "n"), key))
        shared = (F.col("have") == F.col("n")) & (F.col("low") == F.col("high"))
        # the first depth at which members differ or one has ended; the shared way ends above it
        bottoms = profile.groupBy(*key).agg((F.coalesce(F.min(F.when(~shared, F.col("depth"))), F.max("depth") + 1) - 1).alias("bottom"))
        ways.append(profile.join(bottoms, key).where("depth <= bottom").select("head", F.col("head_depth").alias("top"), "depth", "bytes"))
        ended.append(hot.join(bottoms, key).where("length = bottom").select("head", F.col("head_depth").alias("top"), "conv"))
        parted = hot.join(bottoms, key).where("length > bottom").join(
            rows.select("conv", F.col("depth").alias("next"), "turn"), "conv").where("next = bottom + 1")
        parted = cut(parted.select("conv", "length", *key, "bottom", "turn"))
        children = parted.groupBy(*key, "turn").agg(F.min("conv").alias("child"))
        counts = children.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
        fresh = large.join(bottoms, key).join(counts, key, "left")
        heads.append(fresh.select("head", F.col("head_depth").alias("top"), "bottom", "parent", "above", "n", F.coalesce("n_children", F.lit(0)).alias("n_children")))
        below = F.concat("above", F.array(F.struct(F.col("head"), F.col("head_depth").alias("top"))))
        lists = large.select(*key, below.alias("above"))
        named = children.join(lists, key)
        live = parted.join(named, [*key, "turn"]).select(
            "conv", "length", F.col("child").alias("head"), (F.col("bottom") + 1).alias("head_depth"), F.col("head").alias("parent"), "above")
    return _union(done), _union(sizes), heads, ways, ended


def prefix_trie(conversations: DataFrame, limit: int = CONTAINER_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with the measures of its subtree."""
    rows, lengths = rebuilt(conversations)
    rows, lengths = cut(rows), cut(lengths)
    return trie_nodes(rows, lengths, limit)


def trie_nodes(rows: DataFrame, lengths: DataFrame, limit: int = CONTAINER_ROWS) -> DataFrame:
    """Nodes of the conversations given as (conv, depth, turn, bytes), depth from 0, and (conv, length)."""
    left, sizes, heads, ways, ended = burst(rows, lengths, limit)
    key = ["head", "head_depth"]
    left = cut(left.join(sizes, key))
    inside = left.join(rows, "conv").where("depth >= head_depth")
    # a container of one conversation: each turn is a node
    last = F.col("depth") == F.col("length")
    alone = inside.where("n = 1").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("head_depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    suffix = F.sort_array(F.collect_list(F.struct("depth", "turn", "bytes")))
    several = inside.where("n > 1").groupBy(*key, "parent", "conv").agg(suffix.alias("suffix")).select(
        *key, "parent", "conv", F.transform("suffix", lambda x: x["turn"]).alias("turns"), F.transform("suffix", lambda x: x["bytes"]).alias("sizes"))
    swept = several.repartition(*key).sortWithinPartitions(*key, "turns", "conv").mapInArrow(_sweep, NODE)
    nodes = alone.unionByName(swept)
    if not heads:
        return nodes
    nodes = cut(nodes)
    return nodes.unionByName(_head_nodes(nodes, left, cut(_union(heads)), cut(_union(ways)), _union(ended)))


def _head_nodes(nodes: DataFrame, left: DataFrame, head: DataFrame, way: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes of the burst containers: their own counts, and the sums of all containers below."""
    saving = way.join(head.select("head", "top", "n"), ["head", "top"]).select("head", "top", "depth", ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    own = head.join(saving.groupBy("head", "top").agg(F.sum("saved").alias("saved")), ["head", "top"]).select(
        "above", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("leaves"), "saved")
    tops = left.groupBy("head", "head_depth").agg(F.first("above").alias("above")).join(
        nodes.select(F.col("conv_id").alias("head"), F.col("depth").alias("head_depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")),
        ["head", "head_depth"]).select("above", "leaves", "saved")
    below = (own.unionByName(tops).select(F.explode("above").alias("up"), "leaves", "saved").groupBy("up.head", "up.top")
             .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_below")))
    ids = ended.select(F.concat_ws(":", "head", "top").alias("key"), F.col("conv").alias("place"), F.col("conv").cast("string").cast("binary").alias("piece"))
    at = F.split("key", ":")
    ends = ordered_digest(ids, b",").select(at[0].cast("long").alias("head"), at[1].cast("long").alias("top"), F.col("sha256").alias("ends"))
    upward = Window.partitionBy("head", "top").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the way of one head is no longer than the shortest of its conversations
    path = saving.withColumn("saved_way", F.sum("saved").over(upward)).join(head, ["head", "top"]).join(below, ["head", "top"], "left").join(ends, ["head", "top"], "left")
    bottom = F.col("depth") == F.col("bottom")
    return path.select(
        F.col("head").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("head")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("saved_below", F.lit(0)) + F.col("saved_way")).cast("long").alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE = {"op11_prefix_trie": f"""
with crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, j: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as t),
t as (
  select conv_id as conv, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), d) as k, d, b
  from (select *, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d, strlen(coalesce(text, '')) as b
        from conversations where conv_id is not null) x),
c as (
  select conv, n, conv - conv % {FAMILY} as base,
    xor(list_reduce(list_transform(range(1, length(s) + 1), lambda k: ord(s[k])), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]), 4294967295),
        4294967295) % {HEAD_MODULUS} as h
  from (select conv, count(*) as n, conv::varchar as s from t group by conv) y, crc),
r as (
  select c.conv, t.k, t.d, t.b from c join t on t.conv = c.base and t.k <= c.h
  union all select c.conv, t.k + 1000000, t.d, t.b from c join t on t.conv = c.conv and t.k > c.h
  union all select conv, 0, '', 0 from c),
m as (
  select conv, row_number() over w - 1 as depth, b, sha256(string_agg(d, ',') over w) as node, count(*) over (partition by conv) - 1 as len
  from r window w as (partition by conv order by k)),
n as (
  select node, min(conv) as conv_id, any_value(depth) as depth, count(*) as n_convs, (count(*) - 1) * any_value(b) as saved,
    string_agg(conv::varchar, ',' order by conv) filter (where len = depth) as ends
  from m group by node),
e as (select n.*, m.node as up from n left join m on m.conv = n.conv_id and m.depth = n.depth - 1),
k as (select up, count(*) as n_children from e where up is not null group by up),
l as (select n.*, coalesce(k.n_children, 0) as n_children from n left join k on k.up = n.node),
s as (
  select m.node, sum(l.saved) as saved_tokens, count(*) filter (where l.n_children = 0) as n_leaves
  from l join m on m.conv = l.conv_id and m.depth <= l.depth group by m.node)
select e.conv_id, e.depth, up.conv_id as parent_conv_id, e.n_convs, l.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens,
  sha256(coalesce(e.ends, '')) as ends_sha256
from e join l using (node) join s using (node) left join n as up on up.node = e.up"""}
