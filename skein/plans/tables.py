"""Where intermediate tables of iterative operators go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where that is unset on a single machine (tests) a temporary one is made and set as the checkpoint folder;
    on a cluster a folder of one machine would lose data, so the setting has to be there.
    """
    if root := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='skein-')}")
    return context.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark deletes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written once and read back, so that a loop's plan does not grow and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete the folders of settled tables that nothing reads any more, through Spark's file system layer."""
    for df in tables:
        if path := getattr(df, "_folder", None):
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with the place of each row (from 0) in an order of all rows that no two share.

    Rows are dealt in ranges of the order, and a range's first place is the number of rows in the ranges before it, so
    no task sees more than its range; the ranges' sizes are as many rows as there are partitions.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_range_size"))
    before = F.coalesce(F.sum("_range_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_range", before.alias("_range_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_row_in_range", place).join(F.broadcast(firsts), "_range").withColumn(name, F.col("_range_first") + F.col("_row_in_range")).drop("_range", "_row_in_range", "_range_first")
