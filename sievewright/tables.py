"""Reading the input tables and spreading CPU-heavy work over the cluster."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Rows spread over all cores when the scan has fewer splits than that.

    Only for Python-side text work, where a task's CPU time outweighs the one
    shuffle. Large inputs have more splits than cores and pass unchanged.
    """
    sc = df.sparkSession.sparkContext
    cores = max(sc.defaultParallelism, 2)
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(per_core * cores)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset and
    everything runs on one machine (tests) a local folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and read back from the shared folder.

    Cuts lineage without depending on any executor's memory or disk. The table
    stays until clear() or until the shared folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row.

    The optimizer would copy a long expression into each of its uses, and a
    lambda would compute it again for each element; a generator of one value
    keeps it apart.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def positions(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with each row's position in its group, from 1, however large a group is.

    Rows are range-partitioned by group and order, so a hot group spans many
    partitions; rows are numbered within a partition and shifted by the counts
    of the partitions before, at most one row for each partition and group.
    The columns of order must tell the rows of a group apart.
    """
    ranged = df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    held = written(ranged, "positions")  # the partition numbers must stay as they are
    counts = held.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = held.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    joined = local.join(shift, local[group].eqNullSafe(shift["_group"]) & (local["_part"] == shift["_p"]))
    return joined.select(*df.columns, (F.col("_before") + F.col("_k")).cast("long").alias(name))
