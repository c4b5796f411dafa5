"""Scanner reports and profiles to one evidence table.

List order matters downstream (the first match wins), so every row carries
``ord``: a struct of producer, report part, position and path that sorts in
list order without ranking a whole run in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions import paths, text
from auditweave.functions.ranks import lookup
from auditweave.sources.reports import recovered_json

ENTRY, MANIFEST, SEMGREP, BANDIT, OSV = range(5)
COLUMNS = [
    "run_id", "repo", "ord", "id", "file", "line_start", "line_end",
    "snippet_hash", "source", "signal_type", "summary", "confidence",
]


def order_key(producer: int, part: Column, position: Column, path: Column) -> Column:
    return F.struct(
        F.lit(producer).alias("producer"),
        part.cast("bigint").alias("part"),
        position.cast("bigint").alias("position"),
        path.alias("path"),
    )


def evidence_id(rows: DataFrame) -> DataFrame:
    """Content-addressed id and full digest of each evidence row."""
    parts = [F.col(c) for c in ("file", "line_start", "line_end", "source", "signal_type", "summary")]
    return rows.withColumn("snippet_hash", text.full_digest(*parts)).withColumn(
        "id", F.substring("snippet_hash", 1, 16)
    )


def _finish(rows: DataFrame) -> DataFrame:
    return evidence_id(rows).select(*COLUMNS)


def evidence_heuristic(entry_points: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per entry point and one per manifest path."""

    def rows(found: DataFrame, producer: int, signal: str, prefix: str, confidence: float) -> DataFrame:
        path = F.col("path")
        return found.select(
            "run_id",
            "repo",
            order_key(producer, F.lit(0), F.lit(0), path).alias("ord"),
            path.alias("file"),
            F.lit(1).alias("line_start"),
            F.lit(1).alias("line_end"),
            F.lit("scanner_heuristic").alias("source"),
            F.lit(signal).alias("signal_type"),
            F.concat(F.lit(prefix), path).alias("summary"),
            F.lit(confidence).alias("confidence"),
        )

    entries = rows(entry_points, ENTRY, "entrypoint", V.ENTRY_SUMMARY_PREFIX, V.ENTRY_CONFIDENCE)
    found = rows(manifests, MANIFEST, "dependency", V.MANIFEST_SUMMARY_PREFIX, V.MANIFEST_CONFIDENCE)
    return _finish(entries.unionByName(found))


def _line(value: Column, default: Column) -> Column:
    return F.coalesce(value.try_cast("int"), default)


def evidence_semgrep(loaded: DataFrame) -> DataFrame:
    """Flatten pattern-scanner results; rows without a path are skipped."""
    hits = loaded.select("run_id", "repo", "part", F.posexplode("document.results").alias("pos", "hit"))
    start = _line(F.col("hit.start.line"), F.lit(1))
    return _finish(
        hits.filter(F.col("hit.path") != "").select(
            "run_id",
            "repo",
            order_key(SEMGREP, F.col("part"), F.col("pos"), F.lit("")).alias("ord"),
            F.col("hit.path").alias("file"),
            start.alias("line_start"),
            _line(F.col("hit.end.line"), start).alias("line_end"),
            F.lit("semgrep").alias("source"),
            F.lit("vuln").alias("signal_type"),
            F.coalesce(
                text.text_or_none(F.col("hit.extra.message")),
                text.text_or_none(F.col("hit.check_id")),
                F.lit(V.SEMGREP_DEFAULT_SUMMARY),
            ).alias("summary"),
            F.lit(V.SEMGREP_CONFIDENCE).alias("confidence"),
        )
    )


def evidence_bandit(loaded: DataFrame) -> DataFrame:
    """Flatten Python-scanner results; paths are tidied."""
    hits = loaded.select("run_id", "repo", "part", F.posexplode("document.results").alias("pos", "hit"))
    line = _line(F.col("hit.line_number"), F.lit(1))
    return _finish(
        hits.filter(F.col("hit.filename") != "").select(
            "run_id",
            "repo",
            order_key(BANDIT, F.col("part"), F.col("pos"), F.lit("")).alias("ord"),
            paths.tidy_path(F.col("hit.filename")).alias("file"),
            line.alias("line_start"),
            line.alias("line_end"),
            F.lit("bandit").alias("source"),
            F.lit("vuln").alias("signal_type"),
            F.coalesce(
                text.text_or_none(F.col("hit.issue_text")),
                text.text_or_none(F.col("hit.test_name")),
                F.lit(V.BANDIT_DEFAULT_SUMMARY),
            ).alias("summary"),
            F.lit(V.BANDIT_CONFIDENCE).alias("confidence"),
        )
    )


def dependency_severity(raw: Column) -> Column:
    known = lookup(F.lower(text.strip(raw)), V.DEPENDENCY_SEVERITY_SPELLINGS)
    return F.coalesce(known, F.lit("Unknown"))


def fixed_version(affected: Column) -> Column:
    """First fixed version of the first range of the first affected entry."""
    events = F.get(F.get(affected, F.lit(0))["ranges"], F.lit(0))["events"]
    return F.get(F.filter(events, lambda e: e["fixed"].isNotNull()), F.lit(0))["fixed"]


def dep_findings(loaded: DataFrame) -> DataFrame:
    """Flatten results, packages and vulnerabilities; unnamed packages are skipped."""
    unknown = F.lit(V.UNKNOWN)
    results = loaded.select("run_id", "repo", "part", F.posexplode("document.results").alias("r", "result"))
    packages = results.select(
        "run_id", "repo", "part", "r",
        F.coalesce("result.source.path", unknown).alias("source_file"),
        F.posexplode("result.packages").alias("p", "entry"),
    ).filter(F.col("entry.package.name") != "")
    flat = packages.select("*", F.posexplode("entry.vulnerabilities").alias("v", "vuln"))
    # Positions nest. Ten digits hold every array index, so the text sorts as the lists do.
    inner = F.concat_ws(".", F.lpad(F.col("p").cast("string"), 10, "0"), F.lpad(F.col("v").cast("string"), 10, "0"))
    return flat.select(
        "run_id",
        "repo",
        order_key(OSV, F.col("part"), F.col("r"), inner).alias("ord"),
        F.col("entry.package.name").alias("package"),
        F.coalesce("entry.package.ecosystem", unknown).alias("ecosystem"),
        F.coalesce("entry.package.version", unknown).alias("version"),
        F.coalesce("vuln.id", unknown).alias("vulnerability_id"),
        F.coalesce("vuln.aliases", F.array().cast("array<string>")).alias("aliases"),
        dependency_severity(F.col("vuln.database_specific.severity")).alias("severity"),
        fixed_version(F.col("vuln.affected")).alias("fixed_version"),
        "source_file",
    )


def evidence_osv(dependencies: DataFrame) -> DataFrame:
    """One evidence row per dependency finding."""
    return _finish(
        dependencies.select(
            "run_id",
            "repo",
            "ord",
            F.col("source_file").alias("file"),
            F.lit(1).alias("line_start"),
            F.lit(1).alias("line_end"),
            F.lit("osv").alias("source"),
            F.lit("dependency").alias("signal_type"),
            F.concat("package", F.lit(V.VULNERABLE_INFIX), "vulnerability_id").alias("summary"),
            F.lit(V.OSV_CONFIDENCE).alias("confidence"),
        )
    )


def evidence_index(*producers: DataFrame) -> DataFrame:
    """All evidence; ``ord`` already sorts across producers."""
    index = producers[0]
    for rows in producers[1:]:
        index = index.unionByName(rows)
    return index


def tool_status(attempts: DataFrame) -> DataFrame:
    """Label each tool attempt completed, failed or unavailable, with its error text.

    ``attempts`` has tool, tool_found, timed_out, exit_code, stdout, stderr.
    """
    tool, code = F.col("tool"), F.col("exit_code")
    out = text.text_or_none(text.strip(F.coalesce("stdout", F.lit(""))))
    err = text.text_or_none(text.strip(F.coalesce("stderr", F.lit(""))))
    no_context = F.lit(False)
    for name, codes in V.UNAVAILABLE_EXIT_CODES.items():
        no_context = no_context | ((tool == name) & code.isin(*codes))
    case = (
        F.when(~F.col("tool_found"), "missing")
        .when(F.col("timed_out"), "timeout")
        .when(no_context, "no_context")
        .when(code.isNull() | ~code.isin(*V.SUCCESS_EXIT_CODES), "bad_exit")
        .when(out.isNotNull() & recovered_json(out).isNull(), "not_json")
        .otherwise("fine")
    )
    rows = attempts.withColumn("_case", case).withColumn("_out", out).withColumn("_err", err)
    kind = F.col("_case")
    error = (
        F.when(kind == "missing", F.concat(tool, F.lit(V.TOOL_NOT_FOUND)))
        .when(kind == "timeout", F.concat(tool, F.lit(V.TOOL_TIMED_OUT)))
        .when(
            kind == "no_context",
            F.coalesce("_err", "_out", F.concat(tool, F.lit(V.TOOL_NO_CONTEXT))),
        )
        .when(kind == "bad_exit", F.coalesce("_err", F.concat(tool, F.lit(V.TOOL_FAILED))))
        .when(kind == "not_json", F.concat(tool, F.lit(V.TOOL_NOT_JSON)))
    )
    ran = ~kind.isin("missing", "timeout")
    return (
        rows.withColumn(
            "status",
            F.when(kind == "fine", "completed").when(kind.isin("missing", "no_context"), "unavailable").otherwise("failed"),
        )
        .withColumn("error", error)
        .withColumn("exit_code", F.when(ran, code))
        .withColumn("stderr", F.when(ran, F.col("_err")))
        .withColumn("details", F.coalesce("error", "stderr"))
        .drop("_case", "_out", "_err")
    )


def attempt_fallback(statuses: DataFrame, fallback: bool = True) -> DataFrame:
    """Result per run from a targeted (1) and a recursive (2) attempt.

    Both attempts meet in one aggregate per run, so no self join is needed.
    """
    result = F.struct("status", "error", "exit_code", "stderr")
    paired = statuses.groupBy("run_id").agg(
        F.any_value(F.when(F.col("attempt") == 1, result), True).alias("a"),
        F.any_value(F.when(F.col("attempt") == 2, result), True).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    targeted_stands = a.isNotNull() & ((a["status"] == "completed") | b.isNull() | F.lit(not fallback))
    recursive_stands = a.isNull() | (b["status"] == "completed")
    both_errors = a["error"].isNotNull() & b["error"].isNotNull()
    # An exit code of zero counts as no code, as an empty text would.
    merged = F.struct(
        F.when((a["status"] == "failed") | (b["status"] == "failed"), "failed").otherwise("unavailable").alias("status"),
        F.concat(a["error"], F.lit("; fallback: "), b["error"]).alias("error"),
        F.coalesce(F.nullif(b["exit_code"], F.lit(0)), a["exit_code"]).alias("exit_code"),
        F.coalesce(b["stderr"], a["stderr"]).alias("stderr"),
    )
    chosen = F.when(targeted_stands, a).when(recursive_stands, b).when(both_errors, merged).otherwise(a)
    return paired.select("run_id", chosen.alias("_c")).select(
        "run_id", "_c.status", "_c.error", "_c.exit_code", "_c.stderr"
    )


def dependency_status(tool_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Roll the statuses of a run's dependency tools up; a run of ``runs`` with none is unavailable."""
    rows = tool_runs.select("run_id", "status").unionByName(runs.select("run_id", F.lit(None).cast("string").alias("status")))
    status = F.col("status")
    seen = rows.groupBy("run_id").agg(
        F.bool_or(status == "completed").alias("_any"),
        F.bool_or(status == "failed").alias("_failed"),
    )
    return seen.select(
        "run_id",
        F.when(F.col("_any"), "completed").when(F.col("_failed"), "failed").otherwise("unavailable").alias("status"),
    )
