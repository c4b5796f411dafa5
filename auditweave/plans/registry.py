"""Every operator as a query over the driver tables.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``. Results use plain
types so that another engine can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave import fixed_values as V
from auditweave import fixtures
from auditweave.functions.text import token_count, token_counter
from auditweave.operators import checks, compaction, evidence, inventory, profiling, quality, redaction, reporting, runlog
from auditweave.plans import inputs
from auditweave.session import shared_folder
from auditweave.sources import documents, reports, tables
from auditweave.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SCHEMA_VERSION = "1.0.0"
EVIDENCE_TOTAL, EVIDENCE_PER_SOURCE, DEPENDENCY_TOP, MINIMAL_TOP = 10, {"semgrep": 3, "bandit": 2, "osv": 4, "scanner_heuristic": 2}, 3, 2
TIER_BUDGETS = {"scanner": 2500, "security": 1400, "roadmap": 760}
MANIFEST_SETTINGS = {
    "schema_version": SCHEMA_VERSION,
    "workspace_root": "/workspace",
    "prompt_versions": {"architecture": "v1", "roadmap": "v2", "scanner": "v1"},
    "tool_versions": {"python": "3.12", "semgrep": "1.0"},
    "retries": {"max_attempts": 3, "backoff_seconds": 1.0, "jitter_seconds": 0.2},
    "timeouts": {"scanner_seconds": 900, "agent_seconds": 600},
}


def _plain_column(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.IntegerType, T.ShortType, T.ByteType)):
        return column.cast("bigint")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.round(column.cast("double"), 6)
    if isinstance(data_type, T.ArrayType):
        return F.array_join(column.cast("array<string>"), "|")
    if isinstance(data_type, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, TIME_TEXT)
    return column


def plain(rows: DataFrame) -> DataFrame:
    """Integers as bigint, doubles rounded, lists and times as text; structs are spread."""
    out = []
    for field in rows.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            out += [_plain_column(column[f.name], f.dataType).alias(f"{field.name}_{f.name}") for f in field.dataType.fields]
        else:
            out.append(_plain_column(column, field.dataType).alias(field.name))
    return rows.select(*out)


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        return build

    return register


# ------------------------------------------------------------ sources, sinks
@query("load_reports")
def _(spark, sf_dir):
    made = {"semgrep": inputs.semgrep_reports, "bandit": inputs.bandit_reports, "osv-scanner": inputs.osv_reports}
    loaded = [reports.load_reports(build(spark, sf_dir), tool) for tool, build in made.items()]
    rows = [r.select("run_id", "tool", "part", "readable", F.size("document.results").alias("results")) for r in loaded]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("recover_json")
def _(spark, sf_dir):
    item = F.to_json(F.struct("ord", "file", "summary"))
    logs = fixtures.evidence(spark, sf_dir).select(
        "ord",
        F.when(F.col("ord") % 10 == 0, F.lit("nothing {here"))
        .when(F.col("ord") % 10 == 1, item)
        .otherwise(F.concat(F.lit("warn {x} {"), item, F.lit(" tail {}")))
        .alias("stdout"),
    )
    found = F.from_json("payload", "ord BIGINT, file STRING, summary STRING")
    return reports.recover_json(logs).select("ord", found.alias("found"))


def _run_rows(spark, sf_dir):
    """Registered runs and the updates their log brings."""
    registered = fixtures.requests(spark, sf_dir).select(
        "run_id",
        F.lit("registered").alias("status"),
        F.lit("2023-12-31T00:00:00").alias("started_at"),
        F.lit(None).cast("string").alias("finished_at"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    updates = fixtures.transitions(spark, sf_dir).select(
        "run_id",
        F.concat_ws("_", "node_id", "to_state").alias("status"),
        moment.alias("started_at"),
        moment.alias("finished_at"),
        "seq",
    )
    return registered, updates


@query("upsert_runs")
def _(spark, sf_dir):
    return tables.upsert_runs(*_run_rows(spark, sf_dir))


@query("upsert_scan_outputs")
def _(spark, sf_dir):
    def payload(rows):
        return rows.select("run_id", F.to_json(F.struct("status", "seq")).alias("payload_json"), "seq")

    registered, updates = _run_rows(spark, sf_dir)
    return tables.upsert_scan_outputs(payload(registered), payload(updates))


@query("append_transitions")
def _(spark, sf_dir):
    reason = F.when(F.col("to_state") == "failed", F.concat("node_id", F.lit(" stopped, token="), F.lpad(F.col("seq").cast("string"), 12, "0")))
    log = runlog.transition_chain(fixtures.transitions(spark, sf_dir)).withColumn("reason", reason)
    folder = shared_folder(spark, "transitions")
    tables.append_transitions(log, folder)
    return tables.list_transitions(spark, folder).select("run_id", "node_id", "from_state", "to_state", "seq", "ts", "reason")


def _manifests(spark, sf_dir):
    return runlog.run_manifest(
        fixtures.requests(spark, sf_dir),
        runlog.stage_statuses(fixtures.transitions(spark, sf_dir)),
        runlog.branch_failures(inputs.failure_texts(spark, sf_dir)),
        MANIFEST_SETTINGS,
    )


@query("manifest_store")
def _(spark, sf_dir):
    built = _manifests(spark, sf_dir)
    schema = built.schema.simpleString()
    first = tables.manifest_rows(built.withColumn("analysis_status", F.create_map().cast("map<string,string>")).withColumn("seq", F.lit(0)))
    second = tables.manifest_rows(built.filter(F.size("analysis_status") > 0).withColumn("seq", F.lit(1)))
    store = tables.upsert_latest(first, second)
    return tables.typed_manifests(store, schema).select("run_id", "repo.repo_name", "analysis_status")


def _summary_documents(spark, sf_dir):
    profile = checks.architecture_type(_profile_of_runs(spark, sf_dir))
    runs = profile.select(
        "run_id",
        F.col("repo").alias("repo_name"),
        F.col("languages_detected").alias("language_detected"),
        F.col("frameworks_detected").alias("frameworks"),
        "architecture_type",
    )
    found = inputs.findings(spark, sf_dir)
    risks = checks.top_security_risks(found).unionByName(checks.top_performance_risks(found))
    return reporting.summary_json(
        runs,
        risks,
        checks.roadmap(found),
        reporting.tooling_status(inputs.tool_runs(spark, sf_dir)),
        reporting.stage_status(inputs.stage_states(spark, sf_dir)),
        SCHEMA_VERSION,
    )


def _profile_of_runs(spark, sf_dir):
    return profiling.repo_profile(inventory.scanned_files(inputs.files_by_run(spark, sf_dir), inputs.DEFAULT_POLICY))


@query("write_summary")
def _(spark, sf_dir):
    folder = shared_folder(spark, "summary")
    documents.write_summary(_summary_documents(spark, sf_dir), folder)
    return documents.read_documents(spark, folder).select("run_id", F.col("value").alias("document"))


@query("write_report")
def _(spark, sf_dir):
    folder = shared_folder(spark, "report")
    documents.write_report(_report_lines(spark, sf_dir), folder)
    return documents.read_documents(spark, folder).select("run_id", F.col("value").alias("line"))


# ----------------------------------------------------------------- inventory
@query("hard_exclude")
def _(spark, sf_dir):
    return inventory.hard_exclude(fixtures.files(spark, sf_dir)).select("doc_id", "repo", "rel_path")


@query("glob_policy")
def _(spark, sf_dir):
    policy = inventory.ScanPolicy(
        include=["src/**", "*.py", "/docs/", "**/uv.lock"], exclude=["tests/fixtures/**", "*.toml", "!src/**/pyproject.toml"]
    )
    return inventory.glob_policy(fixtures.files(spark, sf_dir), policy).select("doc_id", "repo", "rel_path")


@query("nested_ignore")
def _(spark, sf_dir):
    listed = fixtures.files(spark, sf_dir).select("repo", "run_id", "rel_path")
    ignoring = fixtures.ignore_files(spark, sf_dir)
    rules = inventory.ignore_rules(ignoring.withColumn("content", F.concat_ws("\n", "first_line", "second_line", F.lit(""))))
    return inventory.nested_ignore(listed, rules).select("repo", "rel_path")


def _labelled(spark, sf_dir):
    return inventory.skip_reason(fixtures.files(spark, sf_dir), inputs.SMALL_POLICY)


@query("skip_reason")
def _(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "repo", "rel_path", "size_bytes", "reason")


@query("scan_stats")
def _(spark, sf_dir):
    return inventory.scan_stats(_labelled(spark, sf_dir))


@query("max_files_cap")
def _(spark, sf_dir):
    seen = inventory.max_files_cap(_labelled(spark, sf_dir), inputs.SMALL_POLICY.max_files, "doc_id")
    return inventory.scan_stats(seen)


@query("language_map")
def _(spark, sf_dir):
    return inventory.language_map(fixtures.files(spark, sf_dir)).select("doc_id", "rel_path", "language")


@query("lockfiles")
def _(spark, sf_dir):
    return inventory.lockfiles(fixtures.files(spark, sf_dir), inputs.SMALL_POLICY)


@query("lockfile_resolve")
def _(spark, sf_dir):
    found = fixtures.files(spark, sf_dir)
    path, root = F.col("rel_path"), F.concat(F.lit("/data/"), "repo")
    spellings = F.array(
        path,
        F.concat(root, F.lit("/"), path),
        F.concat(F.lit("./x/../"), path),
        F.concat(F.lit("/elsewhere/"), path),
        F.concat(F.lit("../"), path),
        F.concat(path, F.lit(".missing")),
    )
    names = path.rlike(r"(uv\.lock|go\.sum|requirements\.txt)$")
    candidates = found.filter(names).select("repo", root.alias("root"), F.explode(spellings).alias("path"))
    return inventory.lockfile_resolve(candidates, found)


@query("report_exclude")
def _(spark, sf_dir):
    rows = fixtures.files(spark, sf_dir).withColumnRenamed("rel_path", "file")
    return inventory.report_exclude(rows).select("doc_id", "file")


@query("scan_plan")
def _(spark, sf_dir):
    requests = fixtures.requests(spark, sf_dir).select(
        "run_id",
        (F.col("max_tokens") % 3 != 0).alias("enable_semgrep"),
        (F.col("max_tokens") % 4 != 0).alias("enable_bandit"),
        (F.col("max_tokens") % 5 != 0).alias("enable_osv"),
    )
    known = profiling.languages(
        inventory.scanned_files(inputs.files_by_run(spark, sf_dir), inputs.DEFAULT_POLICY)
    ).select("run_id", "languages_detected")
    wanted = requests.join(known, "run_id", "left").withColumn(
        "languages", F.coalesce("languages_detected", F.array().cast("array<string>"))
    )
    return inventory.scan_plan(wanted, {"enable_semgrep": True, "enable_bandit": True, "enable_osv": True})


@query("repo_from_url")
def _(spark, sf_dir):
    return inventory.repo_from_url(fixtures.requests(spark, sf_dir)).select(
        "run_id", "github_url", "repo_name", F.col("repo_name").isNull().alias("rejected")
    )


# ----------------------------------------------------------------- profiling
for _name, _build in {
    "languages": profiling.languages,
    "entry_points": profiling.entry_points,
    "frameworks_npm": profiling.frameworks_npm,
    "frameworks_py": profiling.frameworks_py,
    "frameworks": profiling.frameworks,
    "architecture_hints": profiling.architecture_hints,
    "folder_summary": profiling.folder_summary,
    "manifest_counts": profiling.manifest_counts,
    "repo_profile": profiling.repo_profile,
    "profile_paths": profiling.profile_paths,
}.items():
    query(_name)(lambda spark, sf_dir, build=_build: build(inputs.scanned(spark, sf_dir)))


# ------------------------------------------------------------------ evidence
def _heuristic(spark, sf_dir):
    scanned = inputs.scanned(spark, sf_dir)
    manifests = profiling.manifest_counts(scanned).select("repo", "run_id", "path").distinct()
    return evidence.evidence_heuristic(profiling.entry_points(scanned), manifests)


def _semgrep(spark, sf_dir):
    return evidence.evidence_semgrep(reports.load_reports(inputs.semgrep_reports(spark, sf_dir), "semgrep"))


def _bandit(spark, sf_dir):
    return evidence.evidence_bandit(reports.load_reports(inputs.bandit_reports(spark, sf_dir), "bandit"))


def _osv(spark, sf_dir):
    return evidence.dep_findings(reports.load_reports(inputs.osv_reports(spark, sf_dir), "osv-scanner"))


query("evidence_heuristic")(_heuristic)
query("evidence_semgrep")(_semgrep)
query("evidence_bandit")(_bandit)
query("dep_findings")(_osv)
query("evidence_osv")(lambda spark, sf_dir: evidence.evidence_osv(_osv(spark, sf_dir)))


@query("dep_severity")
def _(spark, sf_dir):
    rows = fixtures.dependencies(spark, sf_dir)
    return rows.groupBy("raw_severity", evidence.dependency_severity(F.col("raw_severity")).alias("severity")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("fixed_version")
def _(spark, sf_dir):
    return _osv(spark, sf_dir).groupBy("fixed_version").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_id")
def _(spark, sf_dir):
    return evidence.evidence_id(fixtures.evidence(spark, sf_dir)).select("ord", "id", "snippet_hash")


@query("evidence_index")
def _(spark, sf_dir):
    return evidence.evidence_index(
        _heuristic(spark, sf_dir), _semgrep(spark, sf_dir), _bandit(spark, sf_dir), evidence.evidence_osv(_osv(spark, sf_dir))
    )


@query("tool_status")
def _(spark, sf_dir):
    return inputs.tool_statuses(spark, sf_dir).select("run_id", "attempt", "status", "error", "exit_code", "stderr", "details")


@query("attempt_fallback")
def _(spark, sf_dir):
    return evidence.attempt_fallback(inputs.tool_statuses(spark, sf_dir))


@query("dependency_status")
def _(spark, sf_dir):
    return evidence.dependency_status(inputs.tool_statuses(spark, sf_dir), fixtures.requests(spark, sf_dir))


# -------------------------------------------------------------------- checks
FINDING_OUTPUT = [
    "run_id", "repo", "category", "ord", "check_id", "id", "severity", "status", "confidence",
]


def _shown(found: DataFrame) -> DataFrame:
    refs = F.transform("evidence", lambda e: F.concat_ws(":", e["file"], e["line_start"], e["line_end"], e["source"]))
    return found.select(*FINDING_OUTPUT, refs.alias("evidence"))


@query("security_evidence")
def _(spark, sf_dir):
    return checks.security_evidence(fixtures.evidence(spark, sf_dir)).select("ord", "run_id", "source", "signal_type")


@query("performance_evidence")
def _(spark, sf_dir):
    return checks.performance_evidence(fixtures.evidence(spark, sf_dir)).select("ord", "run_id", "signal_type", "summary")


@query("first_match")
def _(spark, sf_dir):
    rules = checks.SECURITY_RULES + checks.PERFORMANCE_RULES
    found = checks.first_match(fixtures.evidence(spark, sf_dir), rules)
    return found.select("run_id", "check_id", "item.file", "item.summary", "item.confidence")


def _security(spark, sf_dir):
    return checks.security_findings(fixtures.evidence(spark, sf_dir))


def _performance(spark, sf_dir):
    return checks.performance_findings(fixtures.evidence(spark, sf_dir))


def _osv_finding(spark, sf_dir):
    found = fixtures.evidence(spark, sf_dir)
    status = checks.runs_of(found).withColumn(
        "status", F.when(F.col("run_id").endswith("-3"), "failed").otherwise("completed")
    )
    return checks.osv_finding(found, inputs.dependencies(spark, sf_dir), status)


query("security_findings")(lambda spark, sf_dir: _shown(_security(spark, sf_dir)))
query("performance_findings")(lambda spark, sf_dir: _shown(_performance(spark, sf_dir)))
query("osv_finding")(lambda spark, sf_dir: _shown(_osv_finding(spark, sf_dir)))
query("architecture_finding")(
    lambda spark, sf_dir: _shown(checks.architecture_finding(fixtures.evidence(spark, sf_dir)))
)


@query("architecture_type")
def _(spark, sf_dir):
    profile = profiling.repo_profile(inputs.scanned(spark, sf_dir))
    return checks.architecture_type(profile).select("repo", "architecture_hints", "architecture_type")


@query("runtime_summary")
def _(spark, sf_dir):
    profile = profiling.repo_profile(inputs.scanned(spark, sf_dir))
    return checks.runtime_summary(profile).select("repo", "runtime_flow_summary")


@query("module_boundaries")
def _(spark, sf_dir):
    return checks.module_boundaries(profiling.folder_summary(inputs.scanned(spark, sf_dir)), limit=3)


def top_security_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the five worst security risks of every run, from raw evidence."""
    found = _security(spark, sf_dir).unionByName(_osv_finding(spark, sf_dir))
    return checks.top_security_risks(found)


query("top_security_risks")(top_security_risks)


@query("top_performance_risks")
def _(spark, sf_dir):
    return checks.top_performance_risks(_performance(spark, sf_dir))


@query("failed_branch_fill")
def _(spark, sf_dir):
    states = runlog.latest_state(fixtures.transitions(spark, sf_dir))
    texts = inputs.failure_texts(spark, sf_dir).groupBy("run_id", "branch").agg(F.max_by("reason", "seq").alias("reason"))
    finished = states.filter(F.col("state").isin(*V.TERMINAL_STATES)).select(
        "run_id", F.col("node_id").alias("branch"), F.col("state").alias("status")
    )
    known = finished.join(texts, ["run_id", "branch"], "left")
    return checks.failed_branch_fill(inputs.log_runs(spark, sf_dir), known).drop("evidence", "symptoms", "title", "recommendation")


@query("roadmap")
def _(spark, sf_dir):
    return checks.roadmap(inputs.findings(spark, sf_dir)).drop("impact")


@query("finding_id")
def _(spark, sf_dir):
    return checks.finding_id(fixtures.findings(spark, sf_dir), "run_id", "title").select("ord", "finding_id")


@query("evidence_severity")
def _(spark, sf_dir):
    return checks.severity_counts(fixtures.evidence(spark, sf_dir))


@query("restamp")
def _(spark, sf_dir):
    scans = fixtures.requests(spark, sf_dir).select(
        F.col("run_id").alias("scan_id"),
        F.concat(F.lit("scan-"), "run_id").alias("run_id"),
        F.concat(F.lit("1."), F.col("max_tokens").cast("string")).alias("schema_version"),
    )
    rows = fixtures.findings(spark, sf_dir).withColumn("scan_id", F.col("run_id"))
    return checks.restamp(rows, scans, ["ord"]).select("ord", "run_id", "schema_version")


@query("rule_catalog")
def _(spark, sf_dir):
    # A catalogue is configuration: here the region names, looked for in every document.
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    catalogue = regions.select(
        F.lit("documents").alias("category"),
        F.col("r_regionkey").alias("position"),
        F.concat(F.lit("mentions-"), F.lower("r_name")).alias("check_id"),
        F.lit("Low").alias("severity"),
        F.split(F.lower(F.trim("r_name")), " +").alias("keywords"),
        F.lit("Mention").alias("title"),
        F.lit("-").alias("concern"),
        F.lit("-").alias("advice"),
    )
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("run_id"),
        F.col("source").alias("repo"),
        F.lit("").alias("file"),
        F.lit(1).alias("line_start"),
        F.lit(1).alias("line_end"),
        F.col("lang").alias("source"),
        F.col("text").alias("summary"),
        F.lit(0.8).alias("confidence"),
    )
    found = checks.check_findings(pages, checks.rules_from_table(catalogue))
    return found.select("run_id", "check_id", "status", "id", F.length("description").alias("length"))


# ------------------------------------------------------------------- quality
@query("std_severity")
def _(spark, sf_dir):
    rows = fixtures.findings(spark, sf_dir)
    return rows.select("ord", quality.std_severity(F.col("raw_severity")).alias("severity"))


@query("std_status")
def _(spark, sf_dir):
    finding = F.explode("findings").alias("f")
    rows = inputs.branch_payloads(spark, sf_dir).select(finding)
    return rows.select("f.id", quality.std_status(F.col("f.status")).alias("status"))


@query("std_lines_files")
def _(spark, sf_dir):
    rows = quality.std_lines_files(
        fixtures.findings(spark, sf_dir).withColumn("path", F.when(F.col("ord") % 5 == 0, "  ").otherwise(F.col("evidence_file"))),
        "path",
        "raw_line",
    )
    return rows.select("ord", "std_file", "std_line")


@query("std_confidence")
def _(spark, sf_dir):
    rows = fixtures.findings(spark, sf_dir)
    return rows.select("ord", quality.std_confidence(F.col("raw_confidence")).alias("confidence"))


@query("std_findings")
def _(spark, sf_dir):
    fixed = quality.std_findings(inputs.branch_payloads(spark, sf_dir)).select("run_id", "branch", F.explode("findings").alias("f"))
    first = F.get("f.evidence", F.lit(0))
    return fixed.select(
        "run_id", "branch", "f.id", "f.category", "f.severity", "f.status",
        F.col("f.confidence").cast("double").alias("confidence"),
        first["file"].alias("file"), first["line_start"].alias("line_start"), first["line_end"].alias("line_end"),
    )


@query("contract_violations")
def _(spark, sf_dir):
    rows = inputs.branch_payloads(spark, sf_dir).select("branch", F.inline("findings"))
    return quality.contract_violations(rows, ["id"], branch="branch")


@query("repair_or_reject")
def _(spark, sf_dir):
    return quality.repair_or_reject(inputs.branch_payloads(spark, sf_dir)).select(
        "run_id", "branch", "part", "broken_before", "broken_after", "outcome"
    )


@query("unknown_fields")
def _(spark, sf_dir):
    payloads = fixtures.findings(spark, sf_dir).select("ord", F.to_json(F.struct("*")).alias("payload"))
    return quality.unknown_fields(payloads, "payload", ["ord"])


@query("request_violations")
def _(spark, sf_dir):
    return quality.request_violations(fixtures.requests(spark, sf_dir))


@query("canonical_labels")
def _(spark, sf_dir):
    return quality.canonical_labels(fixtures.requests(spark, sf_dir)).select("run_id", "provider", "canonical", "accepted")


# ---------------------------------------------------------------- compaction
def _identified(spark, sf_dir):
    return evidence.evidence_id(fixtures.evidence(spark, sf_dir))


@query("evidence_dedup")
def _(spark, sf_dir):
    return compaction.evidence_dedup(fixtures.evidence(spark, sf_dir)).select("ord", "run_id", "file", "line_start", "source", "summary")


@query("evidence_cap")
def _(spark, sf_dir):
    kept = compaction.evidence_cap(_identified(spark, sf_dir), EVIDENCE_TOTAL, EVIDENCE_PER_SOURCE)
    return kept.select("run_id", "position", "ord", "source", "id")


@query("dep_top_n")
def _(spark, sf_dir):
    top = compaction.dep_top_n(inputs.dependencies(spark, sf_dir), DEPENDENCY_TOP)
    return top.select("run_id", "position", "severity", "vulnerability_id", "package", "version")


def _context_runs(spark, sf_dir):
    """Runs of the evidence with what every payload repeats: profile, file counts, state of the dependency scan."""
    stats = inventory.scan_stats(inventory.skip_reason(inputs.files_by_run(spark, sf_dir), inputs.SMALL_POLICY))
    counts = ["total_files_seen", "files_scanned", "files_skipped"]
    runs = checks.runs_of(fixtures.evidence(spark, sf_dir)).join(stats.select("repo", *counts), "repo", "left")
    scan = F.when(F.col("run_id").endswith("-3"), "failed").otherwise("completed")
    return runs.select(
        "run_id", "repo", F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(F.col("repo").alias("repo_name")).alias("repo_profile"),
        F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).alias("scan_stats"), scan.alias("vulnerability_scan_status"),
    )


def _context_tables(spark, sf_dir):
    """Folders, manifests and tool runs of the runs, from their evidence and reports."""
    found = fixtures.evidence(spark, sf_dir)
    keys = found.select("run_id", "signal_type", "file").distinct()
    folders = keys.select("run_id", F.concat_ws("/", F.split_part("file", F.lit("/"), F.lit(1)), "signal_type").alias("path")).distinct()
    folders = folders.withColumn("purpose_guess", F.lit("Source folder")).withColumn("confidence", F.lit(0.5))
    manifests = keys.filter("signal_type = 'dependency'").select(
        "run_id", F.col("file").alias("path"), F.lit("npm").alias("ecosystem"), F.length("file").cast("bigint").alias("direct_dependency_count")
    )
    tools = found.groupBy("run_id", F.col("source").alias("tool")).agg(F.count(F.lit(1)).alias("n")).select(
        "run_id", "tool", F.when(F.col("n") % 3 == 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("n") % 3 > 0, F.lit(0)).alias("exit_code"), F.repeat(F.concat(F.lit("line "), F.col("n").cast("string"), F.lit(" ")), 100).alias("details"),
    )
    return {"folders": folders, "manifests": manifests, "tool_runs": tools}


@query("minimal_context")
def _(spark, sf_dir):
    tables_of = _context_tables(spark, sf_dir)
    context = compaction.minimal_context(
        _context_runs(spark, sf_dir), inputs.dependencies(spark, sf_dir), MINIMAL_TOP, tables_of["manifests"], tables_of["tool_runs"]
    )
    return context.join(compaction.payload_json(context), "run_id").select(
        "run_id", "repo", "mode", "dependency_findings", "manifest_count", F.transform("vulnerability_findings", lambda d: d["vulnerability_id"]).alias("top"),
        F.transform("scanner_tool_runs", lambda t: F.concat_ws(":", t["tool"], t["status"], F.length(t["details"]).cast("string"))).alias("tools"),
        F.get_json_object("payload", "$.scan_stats.files_scanned").cast("bigint").alias("files_scanned"), token_count(F.col("payload")).alias("payload_tokens"),
    )


@query("truncate_details")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("details"))
    return compaction.truncate_details(rows)


@query("compacted_context")
def _(spark, sf_dir):
    context = compaction.compacted_context(
        _context_runs(spark, sf_dir), _identified(spark, sf_dir), inputs.dependencies(spark, sf_dir), EVIDENCE_TOTAL, EVIDENCE_PER_SOURCE, DEPENDENCY_TOP,
        **_context_tables(spark, sf_dir),
    )
    shown = context.withColumn("evidence_ids", F.transform("evidence_index", lambda e: e["id"])).withColumn(
        "vulnerability_ids", F.transform("vulnerability_findings", lambda d: d["vulnerability_id"])
    )
    shown = shown.withColumns({"folders": F.transform("folders", lambda x: x["path"]), "manifests": F.transform("manifests", lambda x: x["path"])})
    counted = compaction.payload_json(context).select("run_id", token_count(F.col("payload")).alias("payload_tokens"))
    return shown.join(counted, "run_id").select(
        "run_id", "repo", "evidence_ids", "vulnerability_ids", "folders", "manifests", "payload_tokens", *compaction.COMPACTION_COUNTS
    )


@query("token_counts")
def _(spark, sf_dir):
    return compaction.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["source", "lang"])


@query("token_udf")
def _(spark, sf_dir):
    def load():
        import re

        words = re.compile(V.TOKEN_PATTERN, re.ASCII)
        return lambda text: len(words.findall(text))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compaction.token_counts(docs, "text", ["source", "lang"], count=token_counter(load))


def _sizes(spark, sf_dir):
    """Tokens of the full, compact and minimal payload per run."""
    return compaction.context_sizes(
        _context_runs(spark, sf_dir), _identified(spark, sf_dir), inputs.dependencies(spark, sf_dir), EVIDENCE_TOTAL, EVIDENCE_PER_SOURCE, DEPENDENCY_TOP,
        MINIMAL_TOP, **_context_tables(spark, sf_dir),
    )


@query("context_tier")
def _(spark, sf_dir):
    return compaction.context_tier(_sizes(spark, sf_dir), TIER_BUDGETS)


# ----------------------------------------------------------------- redaction
@query("redact_text")
def _(spark, sf_dir):
    return redaction.redact_text(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")


@query("redact_nested")
def _(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    secret = F.concat(F.lit("api_key="), F.lpad(F.col("conv_id").cast("string"), 10, "k"))
    nested = turns.select(
        "conv_id",
        "turn",
        F.struct(
            "role",
            F.array("text", secret).alias("values"),
            F.create_map(F.lit("token=abcdefghij"), secret).alias("named"),
        ).alias("body"),
    )
    out = redaction.redact_nested(nested)
    return out.select(
        "conv_id", "turn", F.col("body.role").alias("role"), F.get("body.values", F.lit(0)).alias("text"),
        F.get("body.values", F.lit(1)).alias("secret"),
        F.array_join(F.map_keys("body.named"), ",").alias("keys"), F.array_join(F.map_values("body.named"), ",").alias("named"),
    )


@query("redaction_report")
def _(spark, sf_dir):
    return redaction.redaction_report(
        {
            "documents": (spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"), "text"),
            "conversations": (spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text"), "text"),
            "failures": (inputs.failure_texts(spark, sf_dir), "reason"),
        }
    )


# ----------------------------------------------------------------- reporting
@query("summary_risks")
def _(spark, sf_dir):
    found = inputs.findings(spark, sf_dir)
    return reporting.summary_risks(checks.top_security_risks(found).unionByName(checks.top_performance_risks(found)))


@query("summary_roadmap")
def _(spark, sf_dir):
    return reporting.summary_roadmap(checks.roadmap(inputs.findings(spark, sf_dir)))


@query("tooling_status")
def _(spark, sf_dir):
    return reporting.tooling_status(inputs.tool_runs(spark, sf_dir))


@query("stage_status")
def _(spark, sf_dir):
    return reporting.stage_status(inputs.stage_states(spark, sf_dir))


query("summary_json")(_summary_documents)


@query("top_findings")
def _(spark, sf_dir):
    return reporting.top_findings(inputs.findings(spark, sf_dir), inputs.log_runs(spark, sf_dir))


@query("finding_lines")
def _(spark, sf_dir):
    return reporting.finding_lines(inputs.findings(spark, sf_dir), inputs.log_runs(spark, sf_dir))


@query("roadmap_lines")
def _(spark, sf_dir):
    return reporting.roadmap_lines(checks.roadmap(inputs.findings(spark, sf_dir)), inputs.log_runs(spark, sf_dir))


@query("tooling_lines")
def _(spark, sf_dir):
    return reporting.tooling_lines(inputs.tool_runs(spark, sf_dir), inputs.finding_runs(spark, sf_dir))


def _report_lines(spark, sf_dir):
    files_of_runs = inputs.files_by_run(spark, sf_dir)
    scanned = inventory.scanned_files(files_of_runs, inputs.DEFAULT_POLICY)
    runs = files_of_runs.select("run_id", "repo").distinct()
    stats = inventory.scan_stats(inventory.skip_reason(files_of_runs, inputs.DEFAULT_POLICY))
    profile = checks.runtime_summary(checks.architecture_type(profiling.repo_profile(scanned)))
    info = (
        runs.join(stats.select("run_id", "files_scanned", "files_skipped"), "run_id")
        .join(profile.drop("repo"), "run_id", "left")
        .withColumn("repo_name", F.col("repo"))
    )
    only_runs = runs.select("run_id")
    found = inputs.findings(spark, sf_dir).join(only_runs, "run_id", "left_semi")
    return reporting.report_markdown(
        only_runs,
        info,
        profiling.profile_paths(scanned),
        reporting.stage_status(inputs.stage_states(spark, sf_dir)),
        inputs.tool_runs(spark, sf_dir).join(only_runs, "run_id", "left_semi"),
        checks.module_boundaries(profiling.folder_summary(scanned)),
        found,
        checks.roadmap(found),
    )


query("report_markdown")(_report_lines)


@query("hard_failures")
def _(spark, sf_dir):
    return reporting.hard_failures(reporting.stage_status(inputs.stage_states(spark, sf_dir))).select("run_id", "scanner", "roadmap")


# ------------------------------------------------------------------- run log
for _name, _build in {
    "latest_state": runlog.latest_state,
    "latest_run_state": runlog.latest_run_state,
    "completed_nodes": runlog.completed_nodes,
    "resume_plan": runlog.resume_plan,
    "fan_in_ready": runlog.fan_in_ready,
    "stage_spans": runlog.stage_spans,
    "trace_ids": runlog.trace_ids,
}.items():
    query(_name)(lambda spark, sf_dir, build=_build: build(fixtures.transitions(spark, sf_dir)))


@query("roadmap_state")
def _(spark, sf_dir):
    log = fixtures.transitions(spark, sf_dir)
    planner_errors = log.filter((F.col("node_id") == "roadmap") & (F.col("to_state") == "pending"))
    return runlog.roadmap_state(log, planner_errors)


@query("transition_chain")
def _(spark, sf_dir):
    return runlog.transition_chain(fixtures.transitions(spark, sf_dir)).select("run_id", "seq", "from_state", "to_state")


@query("chain_breaks")
def _(spark, sf_dir):
    recorded = fixtures.transitions(spark, sf_dir).withColumn("from_state", F.lit("pending"))
    return runlog.chain_breaks(recorded).select("run_id", "seq", "recorded", "from_state")


@query("branch_failures")
def _(spark, sf_dir):
    return runlog.branch_failures(inputs.failure_texts(spark, sf_dir))


query("run_manifest")(_manifests)


# ----------------------------------------------------------------- streaming
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _event_feed(spark, sf_dir):
    """The events table as a stream, read as the transition log."""
    feed = feeds.read_feed(spark, sf_dir, EVENT_SCHEMA, pattern="events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    node = (
        F.when(kind == "signup", "scanner").when(kind == "view", "architecture").when(kind == "click", "security")
        .when(kind == "purchase", "performance").otherwise("roadmap")
    )
    state = F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "completed", "failed")]), (k % 4 + 1).cast("int"))
    return feed.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        node.alias("node_id"),
        state.alias("to_state"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query("stream_state")
def _(spark, sf_dir):
    table = shared_folder(spark, "windows")
    feeds.run_window_counts(feeds.window_counts(_event_feed(spark, sf_dir)), table, shared_folder(spark, "windows-log"))
    return feeds.final_counts(spark, table)


@query("stream_dedup")
def _(spark, sf_dir):
    feed = _event_feed(spark, sf_dir).select(
        "run_id", "ts", F.concat_ws("/", "node_id", F.to_date("ts").cast("string")).alias("file"), F.lit(1).alias("line_start"), F.col("to_state").alias("source"),
        F.lit("seen").alias("summary"),
    )
    # The key holds the day, so rows of one key are less than a day apart and a delay of one day finds all of them.
    table = shared_folder(spark, "evidence")
    feeds.run_append(feeds.dedup_feed(feed, "1 day"), table, shared_folder(spark, "evidence-log"))
    return spark.read.parquet(table).select(*feeds.EVIDENCE_KEY)


@query("incremental_scan")
def _(spark, sf_dir):
    moment = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    updates = _event_feed(spark, sf_dir).select(
        "run_id", F.concat_ws("_", "node_id", "to_state").alias("status"),
        moment.alias("started_at"), moment.alias("finished_at"), "seq",
    )
    root = shared_folder(spark, "runs")
    feeds.run_incremental_merge(spark, updates, root, shared_folder(spark, "runs-log"))
    return feeds.merged_rows(spark, root)
