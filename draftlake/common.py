"""Shared helpers: table access, lineage cuts, hashing and partition sizing."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    It is read from the session. Only where it is unset (tests, local runs) a
    temporary one is chosen, which must not happen on a cluster.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"draftlake-checkpoints-{os.getuid()}")
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stable_hash(*cols: Column | str, seed: int = 0) -> Column:
    """Non-negative BIGINT that depends on the values and the seed only, never on partitioning."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def numbered_in_order(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Number of each row (from 1) in the order of the whole table, which must be total.

    The table is cut into ranges of the order, rows are numbered within their range
    and offset by the counts of the ranges before, so no task sorts more than a range.
    """
    n = shuffle_partitions(df.sparkSession)
    # written, as the ranges are sampled and must not be drawn anew for the counts
    ranged = checkpoint(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ranged.withColumn("_rn", inside).join(F.broadcast(offsets), "_part")  # one row per shuffle partition
    return placed.withColumn(name, F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt out to all of them.

    For Python stages whose work per row outweighs moving the row. Large tables have
    more splits than cores and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def plan_id(col: Column | str) -> Column:
    """Plan identity without the ``.svg`` or ``_contract`` endings that older exports left on it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\.svg$", ""), r"_contract$", "")
