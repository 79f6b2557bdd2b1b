"""Shared scratch space and Hadoop file-system access.

Lineage cuts, round trips and claims all need storage every executor can see.
The cluster names it in ``spark.checkpoint.dir``; only a local master may fall
back to a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_local_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to the driver and all executors."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"set {_CONF} to a folder every executor can reach (master is {master})")
    app = spark.sparkContext.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = "file://" + tempfile.mkdtemp(prefix="tabforge-")
    return _local_fallback[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor.

    The result also has a fixed partition layout, so per-partition counts and
    positions taken in separate jobs agree.
    """
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Let checkpoints, also those Spark ML takes between rounds, go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def spread(df: DataFrame, min_rows: int = 2) -> DataFrame:
    """Give work that costs far more than a shuffle at least one partition per core.

    Few or unsplittable files leave most cores idle.  A table with as many
    files as cores is returned as it is; otherwise one pass without columns
    counts rows per partition, and only too few partitions are reshuffled.
    Tables under ``min_rows`` rows stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores:
        return df
    busy = df.groupBy(F.spark_partition_id().alias("p")).count().agg(
        F.count("p").alias("partitions"), F.sum("count").alias("rows")).first()
    enough = busy.partitions >= cores or (busy.rows or 0) < min_rows
    return df if enough else df.repartition(cores)


#: Rows of a partition of training rows, and the fewest partitions.
LAYOUT_ROWS, LAYOUT_LEAST = 250_000, 8


def steady_layout(df: DataFrame) -> DataFrame:
    """Rows dealt and sorted by their values, over a number of partitions that follows from their number alone.

    Training that draws rows by partition then gives the same model on any number of cores and for any
    order, split or source of the same rows.  Equal rows share a partition; they are interchangeable.  The count reads
    only what decides which rows there are.
    """
    return laid_out(df, df.count())


def laid_out(df: DataFrame, rows: int, least: int = LAYOUT_LEAST) -> DataFrame:
    """The layout for a given number of rows."""
    parts = max(least, -(-rows // LAYOUT_ROWS))
    key = F.xxhash64(*df.columns)
    return df.withColumn("__key", key).repartition(parts, "__key").sortWithinPartitions("__key").drop("__key")


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def glob_has_match(spark: SparkSession, pattern: str) -> bool:
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def delete_tree(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty marker; False when somebody else already holds it."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        return fs.createNewFile(p)
    except Py4JJavaError:
        # Another writer created it between the check and the create.
        if fs.exists(p):
            return False
        raise


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none when it does not exist."""
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and root that listings show."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()
