"""Operator inputs bound to the driver tables.

Each function shapes one fixture view into the table an operator expects, over
all of its rows. Report documents are built from small fixed slices of a run,
so no document grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import fixtures
from auditweave.operators import checks, evidence, inventory, runlog
from auditweave.operators.inventory import ScanPolicy

SMALL_POLICY = ScanPolicy(max_file_bytes=300, max_files=8)
DEFAULT_POLICY = ScanPolicy()
ROWS_PER_REPORT = 64
ORDERS_PER_PAYLOAD = 1024


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.scanned_files(fixtures.files(spark, sf_dir), DEFAULT_POLICY)


def files_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files dealt to the hundred runs that the findings belong to."""
    number = (F.col("doc_id") % 100).cast("string")
    return (
        fixtures.files(spark, sf_dir)
        .withColumn("run_id", F.concat(F.lit("run-"), number))
        .withColumn("repo", F.concat(F.lit("repo-"), number))
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with description and evidence."""
    ref = F.struct(
        F.col("evidence_file").alias("file"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
        F.lit("semgrep").alias("source"), F.lit(None).cast("string").alias("rule_id"),
    )
    return (
        fixtures.findings(spark, sf_dir)
        .withColumn("description", F.concat(F.lit("about "), "title"))
        .withColumn("evidence", F.when(F.col("evidence_file").isNull(), checks.no_refs()).otherwise(F.array(ref)))
    )


def finding_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.findings(spark, sf_dir).select("run_id").distinct()


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat dependency findings with their normal severity and an order."""
    return (
        fixtures.dependencies(spark, sf_dir)
        .filter(F.col("package").isNotNull())
        .withColumn("severity", evidence.dependency_severity(F.col("raw_severity")))
        .withColumn("ord", F.struct("l_orderkey", "l_linenumber"))
    )


def _documents(rows: DataFrame, keys: list[str], order: str, item: Column, tool: str, noise: bool) -> DataFrame:
    """One report document per key; keys are chosen so that a document stays small."""
    results = F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("item")))), lambda x: x["item"])
    body = F.to_json(F.struct(results.alias("results")))
    if noise:
        body = F.concat(F.lit("scan started {pass 1}\n"), body, F.lit("\ndone }"))
    return rows.groupBy(*keys).agg(body.alias("payload")).withColumn("tool", F.lit(tool))


def semgrep_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.evidence(spark, sf_dir).filter(F.col("source") == "semgrep")
    n = F.col("ord")
    item = F.struct(
        F.when(n % 17 != 0, F.col("file")).alias("path"),
        F.when(n % 7 != 0, F.concat(F.lit("rule."), "signal_type")).alias("check_id"),
        F.when(n % 9 != 0, F.struct(F.col("line_start").alias("line"))).alias("start"),
        F.when(n % 4 != 0, F.struct(F.col("line_end").alias("line"))).alias("end"),
        F.struct(F.when(n % 5 == 0, F.lit("")).otherwise(F.col("summary")).alias("message")).alias("extra"),
    )
    part = F.floor(n / ROWS_PER_REPORT).alias("part")
    return _documents(rows.select("*", part), ["run_id", "repo", "part"], "ord", item, "semgrep", noise=True)


def bandit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.evidence(spark, sf_dir).filter(F.col("source") == "bandit")
    n = F.col("ord")
    messy = F.concat(F.lit("./"), F.replace("file", F.lit("/"), F.lit("//./")))
    item = F.struct(
        F.when(n % 13 == 0, F.lit("")).otherwise(messy).alias("filename"),
        F.when(n % 6 != 0, F.col("line_start")).alias("line_number"),
        F.when(n % 5 == 0, F.lit("")).otherwise(F.col("summary")).alias("issue_text"),
        F.when(n % 10 != 0, F.col("signal_type")).alias("test_name"),
    )
    part = F.floor(n / ROWS_PER_REPORT).alias("part")
    return _documents(rows.select("*", part), ["run_id", "repo", "part"], "ord", item, "bandit", noise=False)


def osv_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per lockfile line: a named package, one without a name, and an empty result."""
    repo = F.concat(F.lit("repo-"), F.split_part("run_id", F.lit("-"), F.lit(2)))
    no_text = F.lit(None).cast("string")
    events = F.array(
        F.struct(F.lit("0").alias("introduced"), no_text.alias("fixed")),
        F.struct(no_text.alias("introduced"), F.col("fixed_version").alias("fixed")),
    )

    def vulnerability(identifier: Column) -> Column:
        return F.struct(
            identifier.alias("id"),
            F.array(F.concat(F.lit("CVE-"), F.col("l_linenumber").cast("string"))).alias("aliases"),
            F.struct(F.col("raw_severity").alias("severity")).alias("database_specific"),
            F.array(F.struct(F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected"),
        )

    def package(name: Column, *vulnerabilities: Column) -> Column:
        return F.struct(
            F.struct(name.alias("name"), "ecosystem", "version").alias("package"),
            F.array(*vulnerabilities).alias("vulnerabilities"),
        )

    known = vulnerability(F.col("vulnerability_id"))
    packages = F.array(package(no_text, known), package(F.col("package"), known, vulnerability(no_text)))
    results = F.array(
        F.struct(F.struct(no_text.alias("path")).alias("source"), F.slice(packages, 1, 0).alias("packages")),
        F.struct(F.struct(F.col("source_file").alias("path")).alias("source"), packages.alias("packages")),
    )
    return fixtures.dealt_dependencies(spark, sf_dir).select(
        "run_id",
        repo.alias("repo"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("part"),
        F.to_json(F.struct(results.alias("results"))).alias("payload"),
        F.lit("osv-scanner").alias("tool"),
    )


def tool_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.tool_status(fixtures.attempts(spark, sf_dir).withColumn("tool", F.lit("osv-scanner")))


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dependency tool run per run."""
    return (
        evidence.attempt_fallback(tool_statuses(spark, sf_dir))
        .withColumn("tool", F.lit("osv-scanner"))
        .withColumn("details", F.coalesce("error", "stderr"))
        .select("run_id", "tool", "status", "exit_code", "details")
    )


def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.latest_state(fixtures.transitions(spark, sf_dir)).select(
        "run_id", F.col("node_id").alias("stage"), "state"
    )


def log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transitions(spark, sf_dir).select("run_id").distinct()


def failure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failure text with a secret for every failed transition."""
    reason = F.concat(F.col("node_id"), F.lit(" stopped, token="), F.lpad(F.col("seq").cast("string"), 12, "0"))
    return (
        fixtures.transitions(spark, sf_dir)
        .filter(F.col("to_state") == "failed")
        .select("run_id", F.col("node_id").alias("branch"), "seq", reason.alias("reason"))
    )


def branch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch outputs with dirty labels; a payload holds a fixed slice of the order numbers."""
    n = F.col("ord")
    status = (
        F.when(n % 9 == 0, "unknown").when(n % 9 == 1, " N/A ").when(n % 9 == 2, "Insufficient").otherwise(F.col("status"))
    )
    ref = F.struct(
        F.when(n % 5 == 0, F.lit("  ")).otherwise(F.col("evidence_file")).alias("file"),
        F.col("raw_line").alias("line_start"),
        F.col("raw_line").alias("line_end"),
        F.lit("model").alias("source"),
    )
    finding = F.struct(
        "id",
        F.when(n % 11 == 0, F.lit("security")).otherwise(F.col("category")).alias("category"),
        "title",
        F.concat(F.lit("about "), "title").alias("description"),
        F.col("raw_severity").alias("severity"),
        status.alias("status"),
        F.col("raw_confidence").alias("confidence"),
        F.array("title").alias("symptoms"),
        "recommendation",
        F.when(F.col("evidence_file").isNull(), F.array().cast("array<struct<file:string,line_start:string,line_end:string,source:string>>"))
        .otherwise(F.array(ref)).alias("evidence"),
    )
    return (
        fixtures.findings(spark, sf_dir)
        .select("run_id", F.col("category").alias("branch"), F.floor(n / ORDERS_PER_PAYLOAD).alias("part"), "ord", finding.alias("finding"))
        .groupBy("run_id", "branch", "part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "finding"))), lambda x: x["finding"]).alias("findings"))
    )
