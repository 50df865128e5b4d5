"""Tables between the steps of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, a cluster one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        local = spark.sparkContext.master.partition("[")[0] == "local"
        path = f"file://{tempfile.mkdtemp(prefix='chronoplate-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete_at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place.getParent()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage, and survives the loss of executors. Removed by dropped(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoplate/{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    files, place = _delete_at(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables made by written() that nothing will read any more."""
    for df in tables:
        files, place = _delete_at(df.sparkSession, df._written_at)
        files.delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as a shuffle has: a file of narrow rows is few tasks, whatever is computed for each row. To be called while rows are narrow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def few(df: DataFrame, most: int) -> DataFrame:
    """A written table, broadcast if it has `most` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def before_by_ranges(rows: DataFrame, order: str, name: str, by: str | None = None) -> DataFrame:
    """Distinct values of a column (of each `by`, a column without nulls) with the value before each, by ranges that are sorted apart; each range takes over the last value of the one before."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [by] if by else []
    cut = written(rows.select(*keys, order).distinct().repartitionByRange(parts, *keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    # A row for each range, and for each group in it.
    ends = cut.groupBy(*keys, "_range").agg(F.max(order).alias("_end")).withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_range"))).select(*keys, "_range", "_carried")
    inside = F.lag(order).over(Window.partitionBy(*keys, "_range").orderBy(order))
    ends = ends if by else F.broadcast(ends)
    return cut.withColumn("_inside", inside).join(ends, [*keys, "_range"]).select(*keys, order, F.coalesce("_inside", "_carried").alias(name))
