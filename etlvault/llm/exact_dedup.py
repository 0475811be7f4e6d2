"""Exact de-duplication: counting quotient filters find repeated fingerprints, bytes decide.

Each task builds a filter of its fingerprints and cuts it by leading bits into shards; a
shard's filters merge by sorted remainders. Only texts whose fingerprint counts above one
are compared, as whole byte strings, with one row per task and text before the shuffle.

Defined cases: NULL text counts as empty; white space runs (space, tab to carriage return)
count as one space; NULL ids order last; several rows with one id and equal text are one
document of which one row stays; an empty table gives no rows; columns other than id and
text are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import cut, keep_rows, read
from etlvault.llm.quotient_filter import CountingQuotientFilter

FLUSH = 1 << 20  # fingerprints per filter: bounds a task's memory, a longer task emits several filters


def normalised(text: str | Column) -> Column:
    """The text with every run of white space replaced by one space; NULL as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _build(shard_bits: int):
    def emit(fingerprints: np.ndarray):
        values, counts = CountingQuotientFilter.of(fingerprints).entries()
        shard = (values >> np.uint64(64 - shard_bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        rows = [(int(shard[a]), CountingQuotientFilter(values[a:b] << np.uint64(shard_bits), counts[a:b], max(3, int(b - a).bit_length())).to_bytes())
                for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "filter"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= FLUSH:
                yield emit(np.concatenate(held))
                held, n = [], 0
        if n:
            yield emit(np.concatenate(held))

    return build


def _merge(shard_bits: int):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")]
        while len(filters) > 1:  # pairwise, so that each entry moves log(n) times
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) & ~1:]
        values, counts = filters[0].entries()
        values = (values >> np.uint64(shard_bits)) | (np.uint64(key[0].as_py()) << np.uint64(64 - shard_bits))
        again = counts > 1
        return pa.table({"fp": values[again].view(np.int64), "n": counts[again]})

    return merge


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp") -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, by merging the tasks' filters.

    A shard's filter loses the bits that number the shard, which are put back at the end.
    Shards grow in number with the shuffle partitions, so a shard's share stays small.
    """
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard_bits = max(1, (4 * parts - 1).bit_length())
    filters = fingerprints.select(column).mapInArrow(_build(shard_bits), "shard long, filter binary")
    return filters.groupBy("shard").applyInArrow(_merge(shard_bits), "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    norm = normalised(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    narrow = cut(
        base.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"))
        .groupBy("doc_id", "fp", "sha").agg(F.count(F.lit(1)).alias("copies")))
    # a document's own repeats count as well: its fingerprint enters once for each row, twice being enough
    listed = narrow.select(F.explode(F.expr("array_repeat(fp, int(least(copies, 2)))")).alias("fp"))
    repeated = repeated_fingerprints(listed).select("fp")
    suspects = base.withColumn("fp", F.xxhash64("norm")).join(repeated.hint("shuffle_hash"), "fp", "left_semi")
    # byte verification: rows of one group have one text, not just one fingerprint
    classes = (
        suspects.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))
    found = narrow.join(classes, ["fp", "sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.expr("sequence(1L, copies)")).alias("at"), F.lower(F.hex("sha")).alias("text_sha256"), "copies",
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == 1)).alias("kept"),
             "text_sha256", "copies")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies; of each group the row with the smallest id stays.

    Ids identify documents. Rows that share an id but differ in text stay when any of them
    stays; rows without an id stay.
    """
    kept = (exact_groups(docs, id_col, text_col).where("kept AND doc_id IS NOT NULL")
            .groupBy(F.col("doc_id").alias(id_col)).agg(F.max("copies").alias("__copies")))
    rows = keep_rows(docs.where(F.col(id_col).isNotNull()), kept, id_col, "__copies", normalised(text_col))
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("copies")


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE = {"op5_exact_dedup": """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g using (norm)"""}
