"""Standardising labels and checking contracts.

Rules are expressions over one record, so the same rule set serves flat
columns and the elements of nested arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave import fixed_values as V
from auditweave.functions.ranks import lookup
from auditweave.functions.text import strip

Getter = Callable[[str], Column]


# ------------------------------------------------------------- standardising
def std_severity(raw: Column) -> Column:
    return F.coalesce(lookup(F.lower(strip(raw)), V.SEVERITY_SPELLINGS), raw)


def std_status(raw: Column) -> Column:
    return F.coalesce(lookup(F.replace(F.lower(strip(raw)), F.lit(" "), F.lit("_")), V.STATUS_SPELLINGS), raw)


def std_file(raw: Column) -> Column:
    """Blank becomes N/A; null stays null (it is not text)."""
    return F.when(raw.isNull(), raw).otherwise(F.coalesce(F.nullif(strip(raw), F.lit("")), F.lit("N/A")))


def std_line(raw: Column) -> Column:
    """Whole numbers of at least 1; anything but digits becomes 1."""
    text = strip(raw.cast("string"))
    digits = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))
    return F.greatest(F.coalesce(digits, F.lit(1)), F.lit(1)).cast("bigint")


def std_confidence(raw: Column) -> Column:
    """Numbers clamped to [0, 1]; NaN becomes 0, text that is no number 0.5."""
    text = strip(raw.cast("string"))
    # A Java number may end in a type letter; that is text here.
    number = F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))
    return (
        F.when(number.isNull(), F.lit(0.5))
        .when(F.isnan(number), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    )


STANDARD_FIELDS: dict[str, Callable[[Column], Column]] = {
    "severity": std_severity,
    "status": std_status,
    "file": std_file,
    "line_start": std_line,
    "line_end": std_line,
    "confidence": std_confidence,
}


def std_lines_files(findings: DataFrame, file: str, line: str) -> DataFrame:
    return findings.withColumn("std_file", std_file(F.col(file))).withColumn("std_line", std_line(F.col(line)))


def standardised(value: Column, data_type: T.DataType, category: Column) -> Column:
    """Standardise every known field at any depth; ``category`` replaces every category.

    Types stay as they were: a line or confidence kept as text stays text.
    """
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: standardised(item, data_type.elementType, category))
    if not isinstance(data_type, T.StructType):
        return value
    for field in data_type.fields:
        name, inner = field.name, field.dataType
        if name == "category" and isinstance(inner, T.StringType):
            changed = F.when(value[name].isNotNull(), category)
        elif name in STANDARD_FIELDS and not isinstance(inner, (T.StructType, T.ArrayType)):
            changed = STANDARD_FIELDS[name](value[name]).try_cast(inner)
        elif isinstance(inner, (T.StructType, T.ArrayType)):
            changed = standardised(value[name], inner, category)
        else:
            continue
        value = value.withField(f"`{name}`", changed)
    return value


def std_findings(payloads: DataFrame, column: str = "findings", category: str = "branch") -> DataFrame:
    """Standardise the findings array of whole payloads, forcing the branch's category."""
    data_type = payloads.schema[column].dataType
    return payloads.withColumn(column, standardised(F.col(column), data_type, F.col(category)))


# ------------------------------------------------------------------ contracts
def _blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def _outside(value: Column, allowed: list[str]) -> Column:
    return value.isNull() | ~value.isin(*allowed)


def _not_number_in(value: Column, low: float, high: float | None) -> Column:
    number = value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | (number < low)
    return bad | (number > high) if high is not None else bad


def finding_rules(get: Getter, branch: Column | None = None) -> list[tuple[str, Column]]:
    """Rules every finding has to keep; with ``branch`` also that it belongs there."""
    rules = [(f"{name}_empty", _blank(get(name))) for name in ("id", "title", "description", "recommendation")]
    rules += [
        ("category_unknown", _outside(get("category"), V.CATEGORIES)),
        ("severity_unknown", _outside(get("severity"), V.SEVERITIES)),
        ("status_unknown", _outside(get("status"), V.STATUSES)),
        ("confidence_range", _not_number_in(get("confidence"), 0.0, 1.0)),
        (
            "confirmed_without_evidence",
            (get("status") == "confirmed") & (F.coalesce(F.size(get("evidence")), F.lit(0)) <= 0),
        ),
        (
            "evidence_file_empty",
            F.exists(_refs(get), lambda e: _blank(e["file"])),
        ),
        (
            "evidence_source_empty",
            F.exists(_refs(get), lambda e: _blank(e["source"])),
        ),
        (
            "evidence_line_range",
            F.exists(
                _refs(get),
                lambda e: _not_number_in(e["line_start"], 1, None) | _not_number_in(e["line_end"], 1, None),
            ),
        ),
    ]
    if branch is not None:
        rules.append(("category_of_other_branch", get("category").isNotNull() & (get("category") != branch)))
    return rules


def _refs(get: Getter) -> Column:
    return get("evidence")


def roadmap_rules(get: Getter) -> list[tuple[str, Column]]:
    """Rules every roadmap item has to keep."""
    rules = [
        (f"{name}_empty", _blank(get(name)))
        for name in ("task", "impact", "effort", "risk", "justification")
    ]
    return rules + [
        ("priority_unknown", _outside(get("priority"), V.PRIORITIES)),
        ("timeline_unknown", _outside(get("timeline_bucket"), list(V.TIMELINE_BY_PRIORITY.values()))),
    ]


def risk_rules(get: Getter) -> list[tuple[str, Column]]:
    return [
        ("issue_empty", _blank(get("issue"))),
        ("file_empty", _blank(get("file"))),
        ("severity_unknown", _outside(get("severity"), V.SEVERITIES)),
    ]


def broken(rules: list[tuple[str, Column]]) -> Column:
    """Names of the broken rules."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def contract_violations(findings: DataFrame, keys: list[str], branch: str | None = None) -> DataFrame:
    """One row per record and broken rule."""
    rules = finding_rules(F.col, F.col(branch) if branch else None)
    return findings.select(*keys, F.explode(broken(rules)).alias("rule"))


def _violation_count(findings: Column, branch: Column) -> Column:
    per_finding = F.transform(findings, lambda f: F.size(broken(finding_rules(lambda n: f[n], branch))))
    return F.aggregate(per_finding, F.lit(0), lambda total, n: total + n)


def repair_or_reject(payloads: DataFrame, column: str = "findings", branch: str = "branch") -> DataFrame:
    """Label payloads valid, repaired or rejected.

    A payload that breaks a rule is standardised and checked again; one that
    standardising does not change is rejected at once. ``repaired`` holds the
    findings to go on with.
    """
    fixed = standardised(F.col(column), payloads.schema[column].dataType, F.col(branch))
    checked = (
        payloads.withColumn("_fixed", fixed)
        .withColumn("broken_before", _violation_count(F.col(column), F.col(branch)))
        .withColumn("broken_after", _violation_count(F.col("_fixed"), F.col(branch)))
    )
    outcome = (
        F.when(F.col("broken_before") == 0, "valid")
        .when(F.col("_fixed").eqNullSafe(F.col(column)), "rejected")
        .when(F.col("broken_after") == 0, "repaired")
        .otherwise("rejected")
    )
    return (
        checked.withColumn("outcome", outcome)
        .withColumn("repaired", F.when(F.col("outcome") == "repaired", F.col("_fixed")).otherwise(F.col(column)))
        .drop("_fixed")
    )


FINDING_FIELDS = [
    "id", "category", "title", "description", "severity", "status", "confidence", "symptoms", "recommendation", "evidence",
]


def unknown_fields(payloads: DataFrame, payload: str, keys: list[str], allowed: list[str] | None = None) -> DataFrame:
    """One row per field of a JSON payload that the contract does not know."""
    names = F.array(*[F.lit(n) for n in (allowed or FINDING_FIELDS)])
    return payloads.select(*keys, F.explode(F.array_except(F.json_object_keys(payload), names)).alias("field"))


def request_violations(requests: DataFrame) -> DataFrame:
    """One row per request and broken rule."""
    url, path = F.col("github_url"), F.col("local_path")
    kind = F.col("source_type")
    rules = [
        ("source_type_unknown", _outside(kind, V.SOURCE_TYPES)),
        ("github_url_missing", (kind == "github_url") & _blank(url)),
        ("local_path_missing", (kind == "local_path") & _blank(path)),
        ("exactly_one_source", _blank(url) == _blank(path)),
        ("max_tokens_not_positive", F.col("max_tokens") <= 0),
        ("max_tokens_above_window", F.col("max_tokens") > F.col("context_window")),
    ]
    return requests.select("run_id", F.explode(broken(rules)).alias("rule"))


def canonical_labels(rows: DataFrame, column: str = "provider") -> DataFrame:
    """Add ``canonical`` and ``accepted`` for labels with older spellings."""
    canonical = lookup(F.lower(strip(F.col(column))), V.PROVIDER_SPELLINGS)
    return rows.withColumn("canonical", canonical).withColumn("accepted", F.col("canonical").isNotNull())
