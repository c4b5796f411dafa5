"""Document sinks: JSON summaries and Markdown reports of many runs in a fixed number of buckets.

A run's document lies in the bucket of its run id, and files are sorted by run, so one run is read by
pruning a partition and then, by the files' own statistics, row groups. The number of files follows
the buckets and the size of the documents, not the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ORDER = ["run_id", "section", "part", "k1", "k2", "k3", "k4"]
DOCUMENT_BUCKETS = 64


def bucket_of(run_id: Column, buckets: int = DOCUMENT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def write_summary(documents: DataFrame, path: str) -> None:
    """The JSON documents of all runs, one row a run."""
    rows = documents.select("run_id", F.lit(0).cast("bigint").alias("position"), F.col("document").alias("value"))
    _write(rows, ["run_id"], path, None)


def write_report(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """The report lines of all runs, numbered in order.

    Lines are range-partitioned and sorted by bucket, run and place; a very long report simply
    has several files.
    """
    _write(lines.withColumnRenamed("line", "value"), REPORT_ORDER, path, partitions)


def _write(rows: DataFrame, order: list[str], path: str, partitions: int | None) -> None:
    dealt = rows.withColumn("bucket", bucket_of(F.col("run_id")))
    keys = ["bucket", *order]
    ranged = dealt.repartitionByRange(partitions, *keys) if partitions else dealt.repartitionByRange(*keys)
    placed = ranged.sortWithinPartitions(*keys).withColumn("position", F.monotonically_increasing_id())
    placed.select("bucket", "run_id", "position", "value").write.mode("error").partitionBy("bucket").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines or documents of all runs as (run_id, position, value)."""
    return spark.read.parquet(path).drop("bucket")


def read_document(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The lines of one run's document in order, as (value); only the run's bucket is opened."""
    mine = spark.read.parquet(path).filter((F.col("bucket") == bucket_of(F.lit(run_id))) & (F.col("run_id") == run_id))
    return mine.orderBy("position").select("value")


def export_document(spark: SparkSession, path: str, run_id: str, target: str) -> None:
    """One run's document as text files whose name order is line order."""
    mine = spark.read.parquet(path).filter((F.col("bucket") == bucket_of(F.lit(run_id))) & (F.col("run_id") == run_id))
    mine.repartitionByRange("position").sortWithinPartitions("position").select("value").write.mode("error").text(target)
