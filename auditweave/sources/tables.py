"""Keyed tables: merge on a key, append, look up.

Stored as Parquet. A merge reads the old table and writes a new version beside
it, so readers never see half a table and a lost executor only repeats a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.text import redacted

LOG_BUCKETS = 32


def upsert_runs(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge run rows on run_id: the first ``started_at`` stays, the rest is overwritten.

    ``seq`` orders the updates; an existing row comes before all of them, so merging the same
    updates again changes nothing. Both rules are combining aggregates, so a run with very many
    updates is reduced before the shuffle.
    """
    rest = [c for c in existing.columns if c not in ("run_id", "started_at", "seq")]
    both = existing.withColumn("_new", F.lit(False)).unionByName(updates.withColumn("_new", F.lit(True)))
    merged = both.groupBy("run_id").agg(
        F.min_by("started_at", F.struct("_new", "seq")).alias("started_at"),
        F.max_by(F.struct(*rest), "seq").alias("_last"),
        F.max("seq").alias("seq"),
    )
    return merged.select("run_id", "started_at", *[F.col(f"_last.{c}").alias(c) for c in rest], "seq")


def upsert_latest(existing: DataFrame, updates: DataFrame, key: str = "run_id", seq: str = "seq") -> DataFrame:
    """Merge on a key; the last row wins as a whole."""
    both = existing.unionByName(updates)
    rest = [c for c in both.columns if c not in (key, seq)]
    merged = both.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_last"), F.max(seq).alias(seq))
    return merged.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest], seq)


upsert_scan_outputs = upsert_latest


def log_bucket(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(LOG_BUCKETS)).cast("int")


def append_transitions(transitions: DataFrame, path: str, time: str = "ts") -> None:
    """Append to the log, one folder per bucket of run ids.

    Rows are clustered the same way first, so a write makes about one file a bucket, and sorted by run,
    so a file's own statistics tell its runs apart. A ``reason`` is redacted; ``date`` is the day of ``time``.
    """
    if "reason" in transitions.columns:
        transitions = transitions.withColumn("reason", redacted(F.col("reason")))
    dated = transitions.withColumns({"bucket": log_bucket(F.col("run_id")), "date": F.to_date(time)})
    clustered = dated.repartition("bucket").sortWithinPartitions("bucket", "run_id", "seq")
    clustered.write.mode("append").partitionBy("bucket").parquet(path)


def list_transitions(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The log, or one run of it in insertion order, for which only the run's bucket is opened."""
    log = spark.read.parquet(path)
    if run_id is not None:
        log = log.filter((F.col("bucket") == log_bucket(F.lit(run_id))) & (F.col("run_id") == run_id)).orderBy("seq")
    return log.drop("bucket")


def manifest_rows(manifests: DataFrame, seq: str = "seq") -> DataFrame:
    """Typed manifests as (run_id, payload_json, seq)."""
    body = [c for c in manifests.columns if c != seq]
    return manifests.select("run_id", F.to_json(F.struct(*body)).alias("payload_json"), seq)


def get_manifest(store: DataFrame, run_id: str, schema: str) -> DataFrame:
    """The typed manifest of one run, or no row."""
    return typed_manifests(store.filter(F.col("run_id") == run_id), schema)


def typed_manifests(store: DataFrame, schema: str) -> DataFrame:
    return store.select(F.from_json("payload_json", schema).alias("m")).select("m.*")
