"""Session helpers. Operators never create a session; jobs and tests do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Adaptive execution coalesces small shuffle partitions and splits skewed join
# partitions at run time; UTC makes timestamps comparable across engines.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "auditweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that the driver and all executors share: below ``spark.checkpoint.dir``.

    A local session without that setting uses its warehouse folder; on a cluster
    the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/auditweave"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
