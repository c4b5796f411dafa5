"""Connected components of an edge table, as alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import staged


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step: neighbours move to the smallest vertex seen from ``u``.

    ``larger``: the neighbours above ``u`` move; else those below it, and ``u`` itself, do.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    ends = edges.unionByName(turned) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "at")
    # ``at`` is not null; written so that the join gets exchanges of its own, which adaptive execution can split.
    moved = ends.join(least, (ends["u"] == least["at"]) & (F.lit(True)), "inner")
    if larger:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select("v", "m").unionByName(moved.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return out if larger else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``vertex``, ``component``): the smallest vertex that each vertex of ``edges`` (u, v) reaches.

    Large-star and small-star steps alternate until the edges stay the same, which takes few
    rounds also for long chains. Every round ends in a stage table. Vertices without an edge to
    another vertex are absent; an empty table gives an empty result.
    """
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if sums == before or not sums[0]:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            )
        before, now = sums, staged(_star(_star(now, larger=True), larger=False))
