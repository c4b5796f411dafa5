"""Redaction jobs over text columns and whole nested tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions.nested import has_strings, map_strings
from auditweave.functions.text import redacted


def redact_text(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: redacted(F.col(c)) for c in columns})


def redact_nested(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Redact every string of every column, at any depth; map keys and ``keep`` stay."""
    return rows.select(
        *[
            map_strings(F.col(f"`{f.name}`"), f.dataType, redacted).alias(f.name)
            if f.name not in keep and has_strings(f.dataType)
            else F.col(f"`{f.name}`")
            for f in rows.schema.fields
        ]
    )


def redaction_report(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Hits per source table and pattern.

    One pass per table: each pattern is counted on the text the patterns before
    it left, in steps that share that text, and all counts are summed at once.
    """
    result = None
    for name, (rows, column) in tables.items():
        counted = rows.select(F.col(column).alias("_text"))
        for pattern, regex, keeps_label in V.REDACTION_PATTERNS:
            replacement = ("$1" if keeps_label else "") + V.REDACTED
            counted = counted.select(
                *[c for c in counted.columns if c != "_text"],
                F.regexp_count("_text", F.lit(regex)).alias(pattern),
                F.regexp_replace("_text", regex, replacement).alias("_text"),
            )
        patterns = [p for p, _, _ in V.REDACTION_PATTERNS]
        totals = counted.agg(*[F.coalesce(F.sum(p), F.lit(0)).cast("bigint").alias(p) for p in patterns])
        items = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(p).alias("hits")) for p in patterns])
        report = totals.select(F.lit(name).alias("source_table"), F.inline(items))
        result = report if result is None else result.unionByName(report)
    return result
