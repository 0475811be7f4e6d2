"""Session settings, lineage cutting and shared-folder handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs rely on; all of them can be set at session level.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; partition counts stay as the cluster sets them."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a private temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="etlvault-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder, not yet created."""
    root = shared_folder(spark).rstrip("/")
    return f"{root}/{name}-{os.urandom(6).hex()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, computing it once, now.

    All later reads come from the written files, so partition ids and anything else that
    depends on how the rows were split is fixed, also after a lost executor. A lazy
    checkpoint would compute the rows for the first action and again for the files.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def task_parts(scan: DataFrame, task_rows: int) -> int:
    """Parts of about ``task_rows`` rows of a plain scan at most, and at least one for each core."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // task_rows))


def spread(scan: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Spread a plain scan over the cores when it has fewer splits than cores.

    For work that costs more per row than moving the row once: hashing, text scans,
    sorts. A scan that is already wide, as any large table is, stays as it is. With
    ``task_rows`` a part has at most about so many rows, for rows that grow once read,
    whose parts are kept in memory.
    """
    parts = task_parts(scan, task_rows) if task_rows else scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= parts else scan.repartition(parts)
