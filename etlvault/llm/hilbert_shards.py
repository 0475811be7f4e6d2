"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is quantised into cells of about equal row counts, the cells of a row give its
place on the curve, rows are ordered by it and cut into runs. Rows that are close in all
dimensions share a shard, so a filter on any of them reads few files: ``manifest`` lists the
values each shard spans and ``matching_shards`` prunes by them.

A run is cut by one of two laws: ``rows`` (counts at most one apart) or ``bytes`` (a row belongs
to the shard its middle byte falls into, so a shard is off the mean by no more than half of the
two rows at its ends).

Defined cases: NULL in a dimension is cell 0, before all values; NULL text has no bytes; rows
equal in all that the order looks at (curve place, text checksum, size, id) are interchangeable
and get neighbouring slots; with fewer rows than shards some shards stay empty; an empty table
gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import read
from etlvault.operators.ordered import with_running_number, with_running_sum

SHARDS = 40
CELL_BITS = 4         # a dimension has at most 2 ** CELL_BITS cells
ROW_BYTES = 16        # counted for each row beside its text
RANK_ERROR = 1 / 4096  # of the cell bounds
DIMENSIONS = ("lang", "source", "doc_id")


def turns(dims: int) -> tuple[list[int], list[int]]:
    """The curve as an automaton: of each state and octant, the octant's place in it and the state inside.

    Octants follow the reflected Gray code. A state is the corner where a cube is entered and the
    axis along which it is left; ``state * 2 ** dims + octant`` indexes both lists.
    """
    size = 1 << dims

    def rotate(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1)

    def ones(x: int) -> int:
        return (x ^ (x + 1)).bit_length() - 1  # trailing set bits

    place_of = {w ^ (w >> 1): w for w in range(size)}
    places, states = [], []
    for corner in range(size):
        for axis in range(dims):
            for octant in range(size):
                w = place_of[rotate(octant ^ corner, -(axis + 1))]
                even = 2 * ((w - 1) // 2)
                enter = 0 if w == 0 else even ^ (even >> 1)
                leave = 0 if w == 0 else ones(w if w % 2 else w - 1)
                places.append(w)
                states.append((corner ^ rotate(enter, axis + 1)) * dims + (axis + leave + 1) % dims)
    return places, states


def curve_index(cells: Sequence[Column], bits: int = CELL_BITS) -> Column:
    """Place of a cell on the Hilbert curve; ``cells`` are whole numbers of ``bits`` bits."""
    dims = len(cells)
    if dims * bits > 62:
        raise ValueError("the curve index must fit 62 bits")
    places, states = turns(dims)
    octants = []
    for level in reversed(range(bits)):
        bit = [F.shiftleft(F.shiftright(c.cast("long"), level).bitwiseAND(F.lit(1)), d) for d, c in enumerate(cells)]
        total = bit[0]
        for b in bit[1:]:
            total = total + b
        octants.append(total)
    # the lists hold dims * 4 ** dims numbers, a constant of the plan
    place, state = F.array(*map(F.lit, places)), F.array(*map(F.lit, states))
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))

    def step(acc: Column, octant: Column) -> Column:
        at = (acc["state"] * F.lit(1 << dims) + octant + F.lit(1)).cast("int")
        return F.struct((F.shiftleft(acc["index"], dims) + F.element_at(place, at)).alias("index"), F.element_at(state, at).alias("state"))

    return F.aggregate(F.array(*octants), start, step, lambda acc: acc["index"])


def cell_bounds(rows: DataFrame, dimensions: Mapping[str, Column], bits: int = CELL_BITS, error: float = RANK_ERROR) -> dict[str, list[int]]:
    """Upper bounds of the cells of every dimension, from the quantiles of all rows.

    Partial summaries of a size set by ``error`` are merged; at most 2 ** bits numbers come back.
    A value that fills several quantiles gives one bound.
    """
    cells = (1 << bits) - 1  # cell 0 is kept for NULL
    shares = [i / cells for i in range(1, cells)]
    aggregates = [F.percentile_approx(image, shares, round(1 / error)).alias(name) for name, image in dimensions.items()]
    found = rows.agg(*aggregates).head()
    return {name: sorted(set(found[name] or ())) for name in dimensions}


def cell_of(image: Column, bounds: Sequence[int]) -> Column:
    """Number of the cell: 0 for NULL, else 1 and the number of bounds below the value."""
    number = F.lit(1)
    for bound in bounds:
        number = number + (image > F.lit(bound)).cast("int")
    return F.when(image.isNull(), F.lit(0)).otherwise(number)


def image(df: DataFrame, name: str) -> Column:
    """A whole number that stands for a value: itself, or 56 leading bits of a text's hash."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(f"`{name}`").cast("long")
    return F.when(F.col(f"`{name}`").isNotNull(), F.shiftright(F.xxhash64(F.col(f"`{name}`").cast("string")), 8))


def hilbert_shards(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, shards: int = SHARDS, law: str = "rows",
                   id_col: str = "doc_id", text_col: str = "text", bits: int = CELL_BITS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot): the run of every row, and its place in it from 0.

    The texts are read once for their size and checksum and never shuffled. Equal texts with equal
    cells follow each other. A hot value of one dimension is parted by the others and by the id:
    the order is a range partitioning over all of them, so no value is bound to one task.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    images = {f"__d{i}": image(docs, name) for i, name in enumerate(dimensions)}
    bounds = cell_bounds(docs.select(*[c.alias(n) for n, c in images.items()]), {n: F.col(n) for n in images}, bits)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(text).alias("text_crc32"), curve_index([cell_of(c, bounds[n]) for n, c in images.items()], bits).alias("curve"))
    order = ["curve", "text_crc32", "size", "doc_id"]
    placed = with_running_number(rows, order, "number").withColumn("number", F.col("number") - 1)
    if law == "rows":
        total = placed.agg(F.count(F.lit(1))).scalar()
        # the shard of number k of n is floor(k * shards / n), which starts at ceil(shard * n / shards)
        cut = placed.withColumn("total", total).withColumn("shard", F.expr(f"(number * {shards}) div total"))
        cut = cut.withColumn("slot", F.col("number") - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
    else:
        placed = with_running_sum(placed, ["number"], F.col("size"), "upto")
        total = placed.agg(F.max("upto")).scalar()
        middle = f"(2 * upto - size) * CAST({shards} AS DECIMAL(20, 0))"
        cut = placed.withColumn("total", total).withColumn("shard", F.expr(f"CAST(floor({middle} / (2 * total)) AS BIGINT)"))
        first = cut.groupBy("shard").agg(F.min("number").alias("first"))  # one row per shard
        cut = cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("number") - F.col("first"))
    return cut.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, dimensions: Sequence[str] = DIMENSIONS, shards: int = SHARDS, law: str = "rows",
                 id_col: str = "doc_id", **options) -> DataFrame:
    """Write all columns of ``docs`` as one folder ``shard=k`` per shard, in slot order; returns its manifest.

    ``id_col`` must be unique and not NULL, since whole rows meet their shard by it.
    """
    placed = hilbert_shards(docs, dimensions, shards, law, id_col, **options).select(F.col("doc_id").alias(id_col), "shard", "slot")
    whole = docs.join(placed, id_col).repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    whole.drop("slot").write.partitionBy("shard").parquet(path)
    return manifest(docs.sparkSession.read.parquet(path), dimensions)


def manifest(sharded: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(shard, n_rows, and of each dimension its least and greatest value, whether NULLs occur, and up to 64 values).

    ``<name>_values`` is NULL where a shard holds more than 64 different values.
    """
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for name in dimensions:
        c = F.col(f"`{name}`")
        aggregates += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.max(c.isNull()).alias(f"{name}_null")]
    spans = sharded.groupBy("shard").agg(*aggregates)
    for name in dimensions:
        distinct = sharded.select("shard", F.col(f"`{name}`").alias("v")).where("v IS NOT NULL").distinct()
        few = distinct.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n <= 64").select("shard")
        listed = distinct.join(few, "shard", "left_semi").groupBy("shard").agg(F.sort_array(F.collect_list("v")).alias(f"{name}_values"))
        spans = spans.join(listed, "shard", "left")
    return spans


def matching_shards(spans: DataFrame, wanted: Mapping[str, object]) -> list[int]:
    """Shards that may hold a row with ``wanted``: a value, or a (low, high) pair, for each of some dimensions."""
    keep = F.lit(True)
    for name, value in wanted.items():
        low, high = value if isinstance(value, tuple) else (value, value)
        keep = keep & (F.col(f"{name}_max") >= F.lit(low)) & (F.col(f"{name}_min") <= F.lit(high))
        keep = keep & F.coalesce(F.exists(F.col(f"{name}_values"), lambda v: (v >= F.lit(low)) & (v <= F.lit(high))), F.lit(True))
    return sorted(r["shard"] for r in spans.where(keep).select("shard").collect())  # one row per shard


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(read(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


QUERIES = {"op13_hilbert_shards": op13_hilbert_shards}
ORACLE: dict[str, str] = {}
