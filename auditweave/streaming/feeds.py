"""Structured Streaming jobs over the log and the evidence feed.

Every job runs with ``availableNow``: it works off what is there, stops, and
resumes from its checkpoint folder. Results are written as tables; nothing is
gathered in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.sources.tables import upsert_runs


def read_feed(spark: SparkSession, folder: str, schema: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def window_counts(transitions: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Transitions per tumbling window, node and state; late rows are dropped by the watermark."""
    return (
        transitions.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "node_id", "to_state")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "node_id", "to_state", "n")
    )


def run_window_counts(counts: DataFrame, table: str, checkpoint: str) -> None:
    """Write every change of a window as (…, n, batch); the newest batch holds.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()


def final_counts(spark: SparkSession, table: str) -> DataFrame:
    """The last count of every window."""
    keys = ["window_start", "window_end", "node_id", "to_state"]
    return spark.read.parquet(table).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


EVIDENCE_KEY = ["run_id", "file", "line_start", "source", "summary"]


def dedup_feed(evidence: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival per evidence key; keys are forgotten once the watermark passes them."""
    return evidence.withWatermark("ts", delay).dropDuplicatesWithinWatermark(EVIDENCE_KEY)


def run_append(rows: DataFrame, table: str, checkpoint: str) -> None:
    """Append a stream to a Parquet table, exactly once."""
    query = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


MERGE_BUCKETS = 64


def run_incremental_merge(spark: SparkSession, updates: DataFrame, root: str, checkpoint: str, buckets: int = MERGE_BUCKETS) -> None:
    """Merge new run rows into a table of hash buckets, batch by batch.

    A batch reads and rewrites the buckets of its own runs only; Spark writes them beside the old ones
    and puts them in place when the batch is done. Merging rows twice changes nothing, so a repeated batch
    does no harm. The table belongs to one stream: a root that another checkpoint filled is refused, as
    its rows would be merged with a history that this stream does not know. ``buckets`` must stay the
    same for a root; rows of a bucket are bounded by choosing it in proportion to the number of runs.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        _own(session, root, session.sparkContext.getLocalProperty("sql.streaming.queryId"))
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]
        if not touched:
            return
        existing = session.read.schema(dealt.schema).parquet(root).filter(F.col("bucket").isin(touched))
        merged = upsert_runs(existing.select(*batch.columns), batch).select(*batch.columns)
        placed = merged.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
        clustered = placed.repartition("bucket").sortWithinPartitions("bucket", "run_id")
        clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)

    query = (
        updates.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )
    query.awaitTermination()


def _own(spark: SparkSession, root: str, query_id: str) -> None:
    """Mark an empty root as this query's; raise if it is another's."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = path(root, f"_stream-{query_id}")
    if system.exists(mark):
        return
    if system.exists(folder) and len(system.listStatus(folder)):
        raise ValueError(f"{root} holds rows of another stream: give this one a root of its own, or its old checkpoint")
    system.create(mark).close()


def merged_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of a merged table."""
    return spark.read.parquet(root).drop("bucket")
