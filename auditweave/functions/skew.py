"""Keyed joins and neighbour look-ups that survive one very hot key.

A run, repository or source may hold a third of all rows. The helpers below
never send such a group to one task: facts are salted and the small side is
copied per salt, and neighbour look-ups work inside slices of a group that hold a
bounded number of rows, and then patch the slice borders from a small border table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 16
#: Rows of a slice of a group, and slices of a group at most.
SLICE_ROWS = 8_000_000
MOST_SLICES = 1024


def salt_of(*parts: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(salts)).cast("int")


def attach(
    facts: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Join ``facts`` with a table of one row per key.

    ``spread`` names fact columns whose hash spreads one key over ``salts``
    tasks. The small side is copied ``salts`` times, so it should hold only a
    few narrow columns; when it is small enough Spark broadcasts it instead.
    """
    salted = facts.withColumn("_salt", salt_of(*[F.col(c) for c in spread], salts=salts))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def first_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str], salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group with their position, in two steps.

    Step one keeps n rows per (group, salt), step two n rows per group, so the
    last task of a group sorts at most ``n * salts`` rows whatever its size.
    """
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt_of(*[F.col(c) for c in spread], salts=salts))
        .withColumn("_n", F.row_number().over(part))
        .filter(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(whole))
        .filter(F.col("_n") <= n)
        .withColumn("position", F.col("_n").cast("bigint"))
        .drop("_salt", "_n")
    )


def slice_bounds(df: DataFrame, keys: list[str], seq: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For each group of more than ``slice_rows`` rows, the ``seq`` values that end its slices but the last.

    Bounds are quantiles, so slices hold about equally many rows however the values of ``seq`` lie. Only
    large groups have a row, so all bounds together number at most two for every ``slice_rows`` rows of the table.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slice_rows)
    shares = [(i + 1) / MOST_SLICES for i in range(MOST_SLICES - 1)]
    quantiles = df.join(F.broadcast(large), keys).groupBy(*keys).agg(
        F.percentile_approx(seq, shares, 8 * MOST_SLICES).alias("_q"), F.first("_n").alias("_n")
    )
    slices = F.least(F.ceil(F.col("_n") / F.lit(slice_rows)), F.lit(MOST_SLICES)).cast("int")
    picked = F.transform(
        F.sequence(F.lit(1), slices - 1), lambda i: F.element_at("_q", F.greatest(F.lit(1), F.floor(i * F.lit(MOST_SLICES) / slices).cast("int")))
    )
    return quantiles.select(*keys, F.array_distinct(picked).alias("_bounds"))


def slice_borders(sliced: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The values beside each slice of the large groups: one row a slice."""
    packed = F.struct(F.col("_value").alias("v"))
    ends = sliced.groupBy(*keys, "_slice").agg(F.min_by(packed, seq).alias("_first"), F.max_by(packed, seq).alias("_last"))
    over_slices = Window.partitionBy(*keys).orderBy("_slice")
    return ends.select(
        *keys,
        "_slice",
        F.lag("_last").over(over_slices).alias("_from_left"),
        F.lead("_first").over(over_slices).alias("_from_right"),
    )


def neighbours(
    df: DataFrame,
    keys: list[str],
    seq: str,
    value: Column,
    before: str | None = None,
    after: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``value`` of the row before and/or after in ``seq`` order of each group.

    A group is windowed in slices of about ``slice_rows`` rows. Only the first and last row of a slice
    need another slice; these come from a border table of one row per slice of a large group. Bounds
    and borders have a proven size (a row for every ``slice_rows`` rows at most) and are broadcast, so
    the rows are shuffled once.
    """
    valued = df.withColumn("_value", value)
    bounds = F.broadcast(slice_bounds(df.select(*keys, seq), keys, seq, slice_rows))
    number = F.size(F.filter("_bounds", lambda bound: bound < F.col(seq)))
    rows = valued.join(bounds, keys, "left").withColumn("_slice", F.when(F.col("_bounds").isNull(), 0).otherwise(number)).drop("_bounds")
    large = valued.select(*keys, seq, "_value").join(bounds, keys).withColumn("_slice", number).drop("_bounds")
    inside = Window.partitionBy(*keys, "_slice").orderBy(seq)
    packed = F.struct(F.col("_value").alias("v"))
    rows = rows.withColumn("_lag", F.lag(packed).over(inside)).withColumn("_lead", F.lead(packed).over(inside))
    joined = rows.join(F.broadcast(slice_borders(large, keys, seq)), [*keys, "_slice"], "left")
    if before:
        joined = joined.withColumn(before, F.coalesce("_lag", "_from_left")["v"])
    if after:
        joined = joined.withColumn(after, F.coalesce("_lead", "_from_right")["v"])
    return joined.drop("_slice", "_value", "_lag", "_lead", "_from_left", "_from_right")
