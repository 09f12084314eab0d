"""Reading tables, and writing screened rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core above which the partitions that a shuffle leaves are enough.
SPREAD = 64 << 20


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out over all cores if it has fewer partitions than there are cores.

    A small table is often one file, which one task would read and screen; a large one stays as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """The result of a shuffle, dealt out over all cores if Spark estimates it as so small that it would be merged into a few tasks.

    What follows is work on each row that its bytes don't show.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size >= cores * SPREAD else df.repartition(cores)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def write_split(screened: DataFrame, path: str) -> None:
    """Allowed and quarantined rows as partitions of one Parquet table."""
    screened.withColumn("verdict", F.when(F.col("blocked"), "quarantine").otherwise("allow")).write.mode("overwrite").partitionBy("verdict").parquet(path)
