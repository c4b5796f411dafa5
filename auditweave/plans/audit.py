"""The whole audit as one batch job over many repositories.

    spark-submit auditweave/plans/audit.py --repos /trees --reports /reports --out /results/1 --log /results/log

Requests (run_id, repo, root) say what to audit. Runs whose roadmap the log shows
as finished are dropped before their folders are listed; a repository that changed
is audited again under a new run id. Stage tables are written once and read by
everything after them: the files, and the parsed reports of completed tools.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark import __version__ as spark_version
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions.skew import attach
from auditweave.functions.text import redacted
from auditweave.operators import checks, compaction, evidence, inventory, profiling, redaction, reporting, runlog
from auditweave.operators.inventory import ScanPolicy
from auditweave.session import build_session
from auditweave.sources import documents, files, reports, tables

SCHEMA_VERSION = "1.0.0"
MANIFEST_SETTINGS = {
    "schema_version": SCHEMA_VERSION,
    "workspace_root": "",
    "tool_versions": {"spark": spark_version},
    "prompt_versions": {},
    "retries": {"max_attempts": 1, "backoff_seconds": 0.0, "jitter_seconds": 0.0},
    "timeouts": {"scanner_seconds": 0, "agent_seconds": 0},
}
REPORTS = "run_id string, repo string, tool string, part bigint, payload string"


def _stage(rows: DataFrame, out: str, name: str) -> DataFrame:
    rows.write.mode("error").parquet(f"{out}/{name}")
    return rows.sparkSession.read.parquet(f"{out}/{name}")


def finished_runs(spark: SparkSession, log: str | None) -> DataFrame | None:
    """Runs the log shows as done; none when there is no log yet."""
    if log is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    history = tables.list_transitions(spark, log)
    ended = F.col("to_state").isin(*V.TERMINAL_STATES)
    return history.filter((F.col("node_id") == "roadmap") & ended).select("run_id").distinct()


def _profile_of_all(runs: DataFrame, profile: DataFrame) -> DataFrame:
    """A profile row for every run; one without scanned files has empty lists."""
    rows = runs.select("run_id", "repo").join(profile.drop("repo"), "run_id", "left")
    blank = checks.runtime_summary(checks.architecture_type(profiling.empty_profile(runs))).drop("repo")
    names = [c for c in profile.columns if c not in ("run_id", "repo")]
    filled = rows.join(blank.select("run_id", *[F.col(c).alias(f"_{c}") for c in names]), "run_id")
    return filled.select("run_id", "repo", *[F.coalesce(c, f"_{c}").alias(c) for c in names])


def tool_runs_of(plan: DataFrame, loaded: DataFrame) -> DataFrame:
    """Status per planned tool: its report was read, could not be read, or is missing."""
    seen = loaded.groupBy("run_id", "tool").agg(F.bool_and("readable").alias("readable"))
    status = (
        F.when(F.col("readable").isNull(), "unavailable").when(F.col("readable"), "completed").otherwise("failed")
    )
    details = (
        F.when(F.col("readable").isNull(), F.concat("tool", F.lit(V.TOOL_NOT_FOUND)))
        .when(~F.col("readable"), F.concat("tool", F.lit(V.TOOL_NOT_JSON)))
    )
    return plan.join(seen, ["run_id", "tool"], "left").select(
        "run_id", "tool", status.alias("status"), F.lit(None).cast("int").alias("exit_code"), details.alias("details")
    )


def branch_states_of(runs: DataFrame, failures: DataFrame | None) -> DataFrame:
    """State of each branch of each run: failed where ``failures`` (run_id, branch, reason) says so, else completed."""
    branches = F.explode(F.array(*[F.lit(c) for c in V.CATEGORIES]))
    every = runs.select("run_id", branches.alias("branch"))
    if failures is None:
        return every.withColumn("status", F.lit("completed")).withColumn("reason", F.lit(None).cast("string"))
    known = failures.groupBy("run_id", "branch").agg(F.max("reason").alias("reason")).withColumn("status", F.lit("failed"))
    joined = every.join(known, ["run_id", "branch"], "left")
    return joined.select("run_id", "branch", F.coalesce("status", F.lit("completed")).alias("status"), redacted(F.col("reason")).alias("reason"))


def run_audit(
    spark: SparkSession,
    requests: DataFrame | str,
    out: str,
    report_texts: DataFrame | None = None,
    log: str | None = None,
    policy: ScanPolicy | None = None,
    enabled: dict[str, bool] | None = None,
    failures: DataFrame | None = None,
    settings: dict | None = None,
) -> dict[str, DataFrame]:
    """Audit every request, or every folder below a path; returns the stage tables by name.

    ``failures`` (run_id, branch, reason) names branches that did not finish: their findings
    are replaced by a failed one, and their runs end degraded. ``settings`` are the job's constants
    in the manifests.
    """
    policy = policy or ScanPolicy()
    report_texts = report_texts if report_texts is not None else spark.createDataFrame([], REPORTS)
    stages: dict[str, DataFrame] = {}

    def stage(name: str, rows: DataFrame) -> DataFrame:
        stages[name] = _stage(rows, out, name)
        return stages[name]

    # Requests first: what is finished is not even listed.
    requests = files.requests_below(spark, requests) if isinstance(requests, str) else requests
    done = finished_runs(spark, log)
    wanted_runs = requests if done is None else requests.join(done, "run_id", "left_anti")
    runs = stage("runs", wanted_runs.select("run_id", "repo", "root"))

    # Scan: bytes are needed for the tests and, later, only of manifests.
    found = files.readable_files(runs, policy)
    wanted = profiling.is_manifest(F.col("rel_path")) | inventory.is_ignore_file(F.col("rel_path"))
    keep = F.when(wanted & F.col("reason").isNull(), F.col("content"))
    labelled = stage(
        "files", inventory.language_map(inventory.skip_reason(found, policy)).withColumn("content", keep)
    )
    labelled = stage("listed", inventory.nested_ignore(labelled))
    seen = stage("seen", inventory.max_files_cap(labelled, policy.max_files))
    scanned = seen.filter(F.col("reason").isNull())
    beyond = (
        labelled.groupBy("run_id").agg(F.count("*").alias("n_files"))
        .join(seen.groupBy("run_id").agg(F.count("*").alias("n_seen")), "run_id", "left")
        .select("run_id", (F.col("n_files") - F.coalesce("n_seen", F.lit(0))).alias("files_beyond_cap"))
    )
    stats = stage("scan_stats", inventory.scan_stats(seen).join(beyond, "run_id", "left"))
    profile = stage("repo_profile", _profile_of_all(runs, checks.runtime_summary(checks.architecture_type(profiling.repo_profile(scanned)))))
    paths = stage("profile_paths", profiling.profile_paths(scanned))
    folders = stage("folders", profiling.folder_summary(scanned))
    manifests = stage("manifests", profiling.manifest_counts(scanned))
    stage("lockfiles", inventory.lockfiles(seen, policy))

    # Reports: read and parsed once, then the results of completed tools only.
    flags = {t.flag: F.lit(True) for t in inventory.TOOLS}
    planned = profile.select("run_id", F.col("languages_detected").alias("languages")).withColumns(flags)
    plan = stage("plan", inventory.scan_plan(planned, enabled or {}))
    mine = attach(report_texts, plan, ["run_id", "tool"], ["part"], how="left_semi")
    parsed = {t.name: stage(f"reports_{t.name}", reports.load_reports(mine, t.name).drop("payload")) for t in inventory.TOOLS}
    marks = [rows.select("run_id", "tool", "readable") for rows in parsed.values()]
    tool_runs = stage("tool_runs", tool_runs_of(plan, reduce(DataFrame.unionByName, marks)))
    completed = tool_runs.filter(F.col("status") == "completed").select("run_id", "tool")
    loaded = {name: attach(rows, completed, ["run_id", "tool"], ["part"], how="left_semi") for name, rows in parsed.items()}
    dependencies = stage("dependency_findings", evidence.dep_findings(loaded["osv-scanner"]))
    index = stage(
        "evidence",
        evidence.evidence_index(
            evidence.evidence_heuristic(
                profiling.entry_points(scanned), manifests.select("run_id", "repo", "path").distinct()
            ),
            evidence.evidence_semgrep(loaded["semgrep"]),
            inventory.report_exclude(evidence.evidence_bandit(loaded["bandit"])),
            evidence.evidence_osv(dependencies),
        ),
    )
    dependency_state = stage("dependency_status", evidence.dependency_status(tool_runs.filter(F.col("tool") == "osv-scanner"), runs))

    # What an agent would get: the largest payload that fits, and the two that have bounds.
    heads = (
        profile.select("run_id", F.struct(F.col("repo").alias("repo_name"), "languages_detected", "frameworks_detected").alias("repo_profile"))
        .join(stats.select("run_id", F.struct("total_files_seen", "files_scanned", "files_skipped").alias("scan_stats")), "run_id", "left")
        .join(dependency_state.select("run_id", F.col("status").alias("vulnerability_scan_status")), "run_id", "left")
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
    )
    cleaned = redaction.redact_text(tool_runs, "details")
    parts = {"manifests": manifests, "tool_runs": cleaned}
    stage("context_tiers", compaction.context_tier(compaction.context_sizes(heads, index, dependencies, folders=folders, **parts)))
    compact = compaction.compacted_context(heads, index, dependencies, folders=folders, **parts)
    minimal = compaction.minimal_context(heads, dependencies, **parts)
    stage("payloads", compaction.payload_json(compact).withColumn("tier", F.lit("compact")).unionByName(compaction.payload_json(minimal).withColumn("tier", F.lit("minimal"))))

    # Evidence to findings and roadmap.
    scan_status = (
        tool_runs.filter(F.col("tool") == "osv-scanner").select("run_id", "status").join(runs, "run_id")
    )
    states_of_branches = stage("branch_states", branch_states_of(runs, failures))
    failed = states_of_branches.filter("status = 'failed'").select("run_id", F.col("branch").alias("category"))
    keys = runs.select("run_id", "repo")
    made = (
        checks.architecture_finding(index, keys)
        .unionByName(checks.check_findings(index, checks.SECURITY_RULES + checks.PERFORMANCE_RULES, keys))
        .unionByName(checks.osv_finding(index, dependencies, scan_status))
        .join(failed, ["run_id", "category"], "left_anti")
    )
    filled = (
        checks.failed_branch_fill(runs, states_of_branches)
        .join(keys, "run_id")
        .withColumn("ord", F.lit(0).cast("bigint"))
        .withColumn("check_id", F.lit("branch-failed"))
    )
    findings = stage("findings", made.unionByName(filled.select(*made.columns)))
    roadmap = stage("roadmap", checks.roadmap(findings))
    risks = stage("risks", checks.top_security_risks(findings).unionByName(checks.top_performance_risks(findings)))

    # Documents.
    nodes = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(s).alias("node_id")) for i, s in enumerate(V.FLOW_NODES)]))
    named = states_of_branches.select("run_id", F.col("branch").alias("node_id"), "status", "reason")
    steps = runs.select("run_id", nodes.alias("x")).select("run_id", "x.n", "x.node_id").join(named, ["run_id", "node_id"], "left")
    transitions = stage("transitions", steps.select(
        "run_id", "node_id", F.coalesce("status", F.lit("completed")).alias("to_state"), F.col("n").cast("bigint").alias("seq"),
        F.current_timestamp().alias("ts"), "reason",
    ))
    roadmaps = stage("roadmap_state", runlog.roadmap_state(transitions)).select("run_id", F.lit("roadmap").alias("stage"), F.col("roadmap_status").alias("ended"))
    current = transitions.select("run_id", F.col("node_id").alias("stage"), "to_state").join(roadmaps, ["run_id", "stage"], "left")
    states = reporting.stage_status(current.select("run_id", "stage", F.coalesce("ended", "to_state").alias("state")))
    info = (
        runs.join(stats.select("run_id", "files_scanned", "files_skipped"), "run_id", "left")
        .join(profile.drop("repo"), "run_id", "left")
        .withColumn("repo_name", F.col("repo"))
        .na.fill(0, ["files_scanned", "files_skipped"])
    )
    heads = profile.select(
        "run_id", F.col("repo").alias("repo_name"), F.col("languages_detected").alias("language_detected"),
        F.col("frameworks_detected").alias("frameworks"), "architecture_type",
    )
    summary = reporting.summary_json(heads, risks, roadmap, reporting.tooling_status(tool_runs), states, SCHEMA_VERSION)
    documents.write_summary(summary, f"{out}/summary")
    lines = stage("report_lines", reporting.report_markdown(
        runs.select("run_id"), info, paths, states, redaction.redact_text(tool_runs, "details"),
        checks.module_boundaries(folders), findings, roadmap,
    ))
    documents.write_report(lines, f"{out}/report")

    # Tables of runs, and last the log: a run counts as finished only when its documents exist.
    stage("scan_outputs", profile.select("run_id", F.to_json(F.struct("languages_detected", "frameworks_detected", "architecture_type")).alias("payload_json"), F.lit(0).cast("bigint").alias("seq")))
    failed_branches = stage("branch_failures", runlog.branch_failures(transitions.filter("to_state = 'failed'").select("run_id", F.col("node_id").alias("branch"), "seq", "reason")))
    nothing = F.lit(None).cast("string")
    asked = runs.select(
        "run_id", F.lit("local_path").alias("source_type"), F.col("root").alias("local_path"), nothing.alias("github_url"), nothing.alias("provider"),
        F.lit(None).cast("int").alias("max_tokens"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    made_of = runlog.run_manifest(asked, runlog.stage_statuses(transitions), failed_branches, settings or MANIFEST_SETTINGS)
    stage("run_manifests", tables.manifest_rows(made_of.withColumn("seq", F.lit(0).cast("bigint"))))
    moment = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stage("run_rows", roadmaps.select("run_id", F.col("ended").alias("status"), moment.alias("started_at"), moment.alias("finished_at"), F.lit(0).cast("bigint").alias("seq")))
    if log is not None:
        tables.append_transitions(runlog.transition_chain(transitions), log)
    return stages


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--repos", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--reports")
    parser.add_argument("--log")
    arguments = parser.parse_args()
    spark = build_session("audit")
    texts = reports.read_report_texts(spark, arguments.reports) if arguments.reports else None
    run_audit(spark, arguments.repos, arguments.out, texts, arguments.log)


if __name__ == "__main__":
    main()
