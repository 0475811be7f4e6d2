"""Incremental vault loads: the batch loaders on micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from etlvault.operators import vault

LOG = "load_log"
BUCKET = "key_bucket"  # leading digits of the hash key, the partition column of every stored table


def only_changes(events: DataFrame, column: str, kinds: Sequence[str]) -> DataFrame:
    """Change events of the given kinds; a stateless filter."""
    return events.filter(F.col(column).isin(*kinds))


@dataclass(frozen=True)
class HubLoad:
    table: str
    key: str
    business_keys: tuple[str, ...]

    def rows(self, staged: DataFrame, stored: DataFrame | None) -> DataFrame:
        return vault.load_hub(staged, self.key, self.business_keys, stored)


@dataclass(frozen=True)
class LinkLoad:
    table: str
    key: str
    hub_keys: tuple[str, ...]

    def rows(self, staged: DataFrame, stored: DataFrame | None) -> DataFrame:
        return vault.load_link(staged, self.key, self.hub_keys, stored)


@dataclass(frozen=True)
class SatelliteLoad:
    table: str
    key: str
    diff: str
    payload: tuple[str, ...]

    def rows(self, staged: DataFrame, stored: DataFrame | None) -> DataFrame:
        return vault.load_satellite(staged, self.key, self.diff, self.payload, stored)


@dataclass
class VaultFolder:
    """Vault tables as parquet folders under one path every executor reaches.

    A table is partitioned by the first ``key_digits`` hexadecimal digits of its hash key, 16 to
    the power of them in all. A batch reads only the partitions its keys fall into, so what it
    costs follows the batch, as far as its keys are fewer than the partitions, and not the table.
    """

    spark: SparkSession
    path: str
    loads: Sequence[HubLoad | LinkLoad | SatelliteLoad]
    key_digits: int = 1
    _started: set[str] = field(default_factory=set)

    def _schema_path(self, table: str) -> str:
        return f"{self.path}/schema_of_{table}"

    def _partition(self, key: str):
        return F.lower(F.substring(F.col(key), 1, self.key_digits))

    def read(self, table: str) -> DataFrame:
        """A stored table without its partition column, or the log."""
        if table == LOG:
            return self.spark.read.parquet(f"{self.path}/{LOG}")
        columns = self.spark.read.parquet(self._schema_path(table)).schema
        return self.spark.read.schema(columns.add(BUCKET, "string")).parquet(f"{self.path}/{table}").drop(BUCKET)

    def stored(self, table: str, like: DataFrame, partitions: Sequence[str]) -> DataFrame:
        """The rows of a stored table in some of its partitions; a first use creates the folders."""
        if table not in self._started:
            # empty first writes give the folder and its schema; what exists is left alone
            like.limit(0).write.mode("ignore").parquet(self._schema_path(table))
            like.limit(0).withColumn(BUCKET, F.lit("")).write.mode("ignore").partitionBy(BUCKET).parquet(f"{self.path}/{table}")
            self._started.add(table)
        whole = self.spark.read.schema(like.schema.add(BUCKET, "string")).parquet(f"{self.path}/{table}")
        return whole.filter(F.col(BUCKET).isin(list(partitions))).drop(BUCKET)

    def touched(self, staged: DataFrame, keys: Sequence[str]) -> dict[str, list[str]]:
        """Of each hash key, the partitions that the batch has rows for; 16 ** key_digits at most."""
        found = staged.agg(*[F.collect_set(self._partition(k)).alias(f"k{i}") for i, k in enumerate(keys)]).head()
        return {k: sorted(found[i]) for i, k in enumerate(keys)}

    def load(self, staged: DataFrame, batch_id: int) -> None:
        """Load one staged batch into every table and log the rows added.

        The loaders skip what is stored, so a batch repeated after a failure adds only
        what its first run did not get to.
        """
        counted = []
        touched = self.touched(staged, list(dict.fromkeys(step.key for step in self.loads)))
        for step in self.loads:
            rows = step.rows(staged, self.stored(step.table, step.rows(staged, None), touched[step.key]))
            seen = Observation()
            # few files per partition, and a partition with many rows is still split; counted behind
            # the shuffle, since an empty one takes what lies before it out of the plan
            parted = rows.withColumn(BUCKET, self._partition(step.key)).hint("rebalance", F.col(BUCKET))
            parted.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(BUCKET).parquet(f"{self.path}/{step.table}")
            counted.append((batch_id, step.table, int(seen.get["n"])))
        self.spark.createDataFrame(counted, "batch_id bigint, table_name string, rows bigint").coalesce(1).write.mode(
            "append").parquet(f"{self.path}/{LOG}")


def stream_load(changes: DataFrame, stage: Callable[[DataFrame], DataFrame], folder: VaultFolder, checkpoint: str,
                every: str | None = None) -> StreamingQuery:
    """Run the loads on every micro-batch of a stream.

    ``every`` names the interval of a continuous load, such as ``"5 minutes"``; without it
    the load takes all that is there and stops.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        staged = stage(batch).persist()  # read by every table's load
        try:
            folder.load(staged, batch_id)
        finally:
            staged.unpersist()

    writer = changes.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_changes(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the parquet files arriving under a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
