"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, with its scheme. Only where all runs in one JVM, as in tests, may it be unset: a local folder is set then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lacquer-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return ("file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full).rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder in scratch_dir() of all that this application stages."""
    return f"{scratch_dir(spark)}/lacquer-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str | None = None) -> None:
    """Delete what was staged at path, or all that this application staged; tables read from there can't be used any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path or session_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget_staged(df: DataFrame) -> None:
    """Delete the files of a table that stage() gave and that nothing reads any more."""
    files = df.inputFiles()
    if files:
        forget(df.sparkSession, files[0].rpartition("/")[0])


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder, by Spark's codec or this one, and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def with_positions(df: DataFrame, column: str = "_pos", by: tuple[str, ...] = ()) -> DataFrame:
    """df with the dense position of each row in its present order, from 0; its columns `by`, which are dropped, come before that order.

    Spark numbers rows within partitions; the staged rows then get the sum of the sizes of the
    partitions before theirs. Only one row a partition is summed up in order. Rows equal in `by` and in
    their partition have to follow each other, as those of a piece of a file do.
    """
    numbered = stage(df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "positions")
    order = [*by, "_part"]
    sizes = numbered.groupBy(*order).agg(F.count("*").alias("count"), F.min("_at").alias("_least"))
    before = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_least", *by, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), order).withColumn(column, F.col("_start") + F.col("_at") - F.col("_least")).drop(*order, "_at", "_least", "_start")
