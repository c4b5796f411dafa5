"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.common import WORD, staged

#: Rows of one source and size that one window group holds on average; larger groups are split by ranges of doc_id.
GROUP_ROWS = 16_384
#: Ids that are drawn for each of those ranges; its bounds are taken from them at even distances.
SAMPLED = 16
#: Halvings that find a range among all of a group's: more than any list of bounds needs.
HALVINGS = 32
#: Random offsets drawn for each source; the one whose mix comes nearest to the target is used.
DRAWS = 16


def _offset(source: Column, draw: int, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the source, the draw and the seed alone."""
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}|{draw}"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / float(1 << 24)


def _range_of(doc_id: Column, bounds: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``doc_id``; a null id stands before all."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def halved(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        above = F.get(bounds, middle) <= doc_id
        half = F.struct(F.when(above, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(above, at["hi"]).otherwise(middle).alias("hi"))
        return F.when(at["lo"] < at["hi"], half).otherwise(at)

    return F.when(doc_id.isNull() | bounds.isNull(), F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halved)["lo"])


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """Targets of ``sources`` (source, source_size, ...): water filling under the cap of each.

    Every source gets its weight's share of all words, at most ``cap`` times its size; what a capped
    source leaves goes to the others by weight. With sources ordered by cap per weight, the level is
    the largest of (words left) / (weights left), so one pass of running sums replaces the rounds.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - (F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    weights_left = F.sum("weight").over(whole) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")
    level = F.max("level").over(whole)
    return limited.withColumn("level", left / weights_left).withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("level", "most")


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken and the columns ``keep``), a row per row of ``docs``.

    ``size`` counts words (a null text has none). Documents of a source stand in order of size and
    id; each adds its expected copies, target / source_size, to a running sum. With one random
    offset added, a document gets a copy for each whole number that the sum passes at it. The order
    by size keeps the words taken close to the target, and is the same however many rows a source
    and size have: crowded ones are cut into ranges of ids. Rows of equal source, size and id are
    interchangeable; a null doc_id comes first, the null source is a source of its own. A source
    without words has target 0 and gives nothing, an empty text gets copies like any other. An
    empty table gives no rows. The columns doc_id, source and text are read, and those in ``keep``.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = staged(docs.select("doc_id", "source", size.alias("size")))

    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    by_size = narrow.groupBy("source", "size").agg(F.count("*").alias("rows"))
    large = by_size.filter(F.col("rows") > GROUP_ROWS).select(F.col("source").alias("c_source"), F.col("size").alias("c_size"))
    # The ids whose hashes are multiples of ``one_of``, which every run draws alike; each ``every``-th of them bounds a range.
    one_of = max(1, GROUP_ROWS // SAMPLED)
    every = max(1, GROUP_ROWS // one_of)
    drawn = narrow.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(one_of)) == 0)).join(large, same)
    ids = drawn.groupBy("c_source", "c_size").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    crowded = staged(ids.select("c_source", "c_size", F.array_distinct(F.filter("ids", lambda _, i: i % every == every - 1)).alias("bounds")))

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(crowded, same, "left").withColumn("part", _range_of(F.col("doc_id"), F.col("bounds"))).drop("c_source", "c_size", "bounds")

    groups = staged(grouped(narrow).groupBy("source", "size", "part").agg(F.count("*").alias("rows")))
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = source_targets(sources, weights, cap).withColumn("share", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0))
    earlier = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))

    # All copies of a group up to its n-th row are floor(offset + share * (before + n)) - floor(offset + share * before).
    def crossed(draw: int, last: Column, before: Column) -> Column:
        offset = _offset(F.col("source"), draw, seed)
        return F.floor(offset + F.col("share") * last) - F.floor(offset + F.col("share") * before)

    same_source = F.col("t_source").eqNullSafe(F.col("source"))
    known = targets.withColumnRenamed("source", "t_source")
    totals = starts.join(known, same_source).groupBy("t_source").agg(
        F.any_value("target").alias("target"), F.any_value("source_size").alias("source_size"), F.any_value("share").alias("share"),
        *(F.sum(F.col("size") * crossed(d, F.col("before") + F.col("rows"), F.col("before"))).alias(f"d{d}") for d in range(DRAWS)),
    )
    offset = F.least(*(F.struct(F.abs(F.col(f"d{d}") - F.col("target")), F.lit(d), _offset(F.col("t_source"), d, seed)) for d in range(DRAWS)))["col3"]
    plan = staged(totals.select("t_source", "source_size", "target", "share", offset.alias("offset")))
    placed = starts.join(plan, same_source).select(
        F.col("source").alias("g_source"), F.col("size").alias("g_size"), F.col("part").alias("g_part"), "before", "source_size", "target", "share", "offset"
    )
    placed = staged(placed)

    rows = grouped(docs.select("doc_id", "source", size.alias("size"), *(F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep))) if keep else narrow)
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id"))
    ranked = rows.withColumn("rank", rank)
    found = ranked.join(placed, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")) & (F.col("part") == F.col("g_part")))
    last = F.col("before") + F.col("rank")
    copies = F.floor(F.col("offset") + F.col("share") * last) - F.floor(F.col("offset") + F.col("share") * (last - 1))
    return found.withColumn("copies", F.least(copies, F.lit(int(cap))).cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"keep_{i}").alias(f"kept_{k}") for i, k in enumerate(keep))
    )


#: The same mixture in DuckDB's SQL.
MIXTURE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - (sum(most) OVER o - most)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM w
      WINDOW o AS (ORDER BY most / weight, weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS share FROM t),
r AS (SELECT d.doc_id, d.size, e.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
u AS (SELECT source, k, ('0x' || md5('11|' || k || '|' || coalesce(source, ''))[1:6])::BIGINT / {float(1 << 24)}::DOUBLE AS off FROM e, range({DRAWS}) AS x(k)),
m AS (SELECT u.source, u.k, u.off, abs(sum(r.size * (floor(u.off + r.share * r.n) - floor(u.off + r.share * (r.n - 1)))) - any_value(r.target)) AS gap
      FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.source GROUP BY u.source, u.k, u.off),
b AS (SELECT source, arg_min(off, gap * 1000 + k / 1000.0) AS off FROM m GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * least(floor(b.off + r.share * r.n) - floor(b.off + r.share * (r.n - 1)), 3))::BIGINT AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
