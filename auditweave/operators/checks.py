"""Checklists over evidence: findings, risks, roadmaps.

All checks of all branches run in one pass, however long the catalogue: a prefix
tree of all keywords finds those that an evidence text holds, a join with the
keyword table gives their rules, and a combining aggregate keeps, per run and
check, the first matching evidence row.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions.ranks import any_word_in, rank_of
from auditweave.functions.skew import attach
from auditweave.functions.text import longest_word_at_each_place, short_digest

EVIDENCE_REF = "STRUCT<file: STRING, line_start: INT, line_end: INT, source: STRING, rule_id: STRING>"
FINDING_COLUMNS = [
    "run_id", "repo", "category", "ord", "check_id", "id", "title", "description", "severity", "status",
    "confidence", "symptoms", "recommendation", "evidence",
]


@dataclass(frozen=True)
class Rule:
    """One check of a branch: keywords are substrings of summary and file."""

    category: str
    check_id: str
    severity: str
    keywords: tuple[str, ...]
    title: str
    concern: str
    advice: str


def _rules(category: str, checks: list, words: dict[str, tuple[str, str, str]]) -> list[Rule]:
    return [Rule(category, cid, sev, tuple(kw), *words[cid]) for cid, sev, kw in checks]


SECURITY_RULES = _rules("security", V.SECURITY_CHECKS, {
    "hardcoded-secrets": ("Secrets kept in source", "Anyone who can read the code can use the secret.",
                          "Load secrets from a vault and replace every exposed one."),
    "unsafe-config-practices": ("Risky configuration", "Lax defaults widen what an attacker can reach.",
                                "Ship strict production settings and review each relaxed one."),
    "missing-input-validation": ("Unchecked input", "Raw input can reach code that trusts it.",
                                 "Check the shape of every request where it enters."),
    "sql-injection-patterns": ("Queries built from text", "A crafted value can change the query.",
                               "Bind values as parameters in all queries."),
    "insecure-jwt-usage": ("Weak token checks", "A forged token may be accepted.",
                           "Pin strong algorithms and verify issuer, audience and expiry."),
    "weak-password-storage": ("Weak password hashes", "Stolen hashes can be reversed quickly.",
                              "Store passwords with a slow salted hash."),
    "exposed-admin-endpoints": ("Open administration routes", "Sensitive actions may need no login.",
                                "Require login and roles on every administration route."),
    "dependency-vulnerabilities": ("Vulnerable packages", "Known holes in packages are easy to exploit.",
                                   "Move to patched versions and keep lockfiles current."),
})
PERFORMANCE_RULES = _rules("performance", V.PERFORMANCE_CHECKS, {
    "heavy-sync-operations": ("Blocking work", "Requests wait while a thread is held.",
                              "Move blocking work off the request path."),
    "n-plus-one-query-patterns": ("Queries per row", "Query count grows with the rows shown.",
                                  "Fetch related rows together."),
    "missing-caching-opportunities": ("Repeated reads", "The same answer is computed again and again.",
                                      "Cache stable answers and say when they expire."),
    "large-payload-risks": ("Large responses", "Big bodies cost bandwidth and memory.",
                            "Return fewer fields and bound the body size."),
    "db-indexing-hints": ("Missing indexes", "Look-ups read whole tables.",
                          "Add indexes for the usual filters and sorts."),
    "loop-and-io-hotspots": ("Busy loops and file access", "Tight loops and file access stall requests.",
                             "Measure hot loops, then batch or stream their work."),
    "missing-pagination-in-apis": ("Unbounded lists", "One call can return every record.",
                                   "Demand a page size and cap it."),
})


def rules_from_table(rules: DataFrame) -> list[Rule]:
    """A user's rule table as rules.

    A catalogue is configuration: it is read to plan the job.
    """
    rows = rules.orderBy("category", "position").collect()
    return [
        Rule(r.category, r.check_id, r.severity, tuple(k.lower() for k in r.keywords), r.title, r.concern, r.advice)
        for r in rows
    ]


def is_security_evidence() -> Column:
    return F.col("source").isin(*V.SECURITY_SOURCES) | F.col("signal_type").isin(*V.SECURITY_SIGNALS)


def is_performance_evidence() -> Column:
    return (F.col("signal_type") == V.PERFORMANCE_SIGNAL) | any_word_in(F.lower("summary"), V.PERFORMANCE_WORDS)


BRANCH_FILTER = {"security": is_security_evidence, "performance": is_performance_evidence}


def security_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.filter(is_security_evidence())


def performance_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.filter(is_performance_evidence())


def runs_of(evidence: DataFrame) -> DataFrame:
    return evidence.select("run_id", "repo").distinct()


def keyword_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(keyword, category, rule): the rules that a found keyword stands for.

    A found keyword is the longest at its place, so it also stands for the rules of all keywords that it
    begins with. The empty keyword, found in every text, has the rules that list it, and rule -1.
    """
    of: dict[str, set[int]] = {}
    for number, rule in enumerate(rules):
        for word in rule.keywords:
            of.setdefault(word, set()).add(number)
    rows = [("", None, -1)]
    for word in of.keys() | {""}:
        numbers = set().union(*(of.get(word[:n], ()) for n in range(1 if word else 0, len(word) + 1)))
        rows += [(word, rules[n].category, n) for n in sorted(numbers)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True)]
    return spark.createDataFrame(pa.table(columns, ["keyword", "category", "rule"]))


def first_match(evidence: DataFrame, rules: list[Rule], runs: DataFrame | None = None) -> DataFrame:
    """For each run and check the first evidence (by ``ord``, unique in a run) with any keyword, or nulls.

    ``runs`` lists runs that need a row even without evidence; by default the
    runs seen in the evidence. The evidence is read once, whatever the number of
    rules; Spark broadcasts the keyword table only if it is small. An evidence row
    is repeated for its matches alone, before a combining aggregate.
    """
    keys = ["run_id", "repo"]
    branches = sorted({r.category for r in rules})
    item = F.struct("file", "line_start", "line_end", "source", "summary", "confidence")
    pattern = longest_word_at_each_place({k for r in rules for k in r.keywords})
    held = F.regexp_extract_all(F.lower(F.concat("summary", F.lit(" "), "file")), F.lit(pattern), F.lit(1))
    fits = [F.when(BRANCH_FILTER.get(b, lambda: F.lit(True))(), F.lit(b)) for b in branches]
    prepared = evidence.select(*keys, "ord", item.alias("item"), held.alias("held"), F.array_compact(F.array(*fits)).alias("branches"))
    if runs is not None:
        blank = [F.lit(None).cast(prepared.schema[c].dataType).alias(c) for c in prepared.columns if c not in keys]
        prepared = prepared.unionByName(runs.select(*keys, *blank))
    nothing = F.array(F.lit(""))
    words = F.explode(F.coalesce(F.array_distinct(F.concat(nothing, "held")), nothing))
    found = prepared.withColumn("keyword", words).drop("held").join(keyword_table(evidence.sparkSession, rules), "keyword")
    found = found.filter(F.col("category").isNull() | F.array_contains("branches", F.col("category")))
    firsts = found.groupBy(*keys, "rule").agg(F.min_by(F.when(F.col("rule") >= 0, F.col("item")), "ord").alias("item"))
    # Rule -1 is seen in every run; it stands for a row without evidence of each rule.
    every = F.sequence(F.lit(0), F.lit(len(rules) - 1))
    spread = firsts.withColumn("rule", F.explode(F.when(F.col("rule") >= 0, F.array("rule")).otherwise(every)))
    whole = spread.groupBy(*keys, "rule").agg(F.first("item", ignorenulls=True).alias("item"))
    names = F.array(*[F.lit(r.check_id) for r in rules])
    return whole.withColumn("check_id", F.element_at(names, F.col("rule") + 1)).select(*keys, "rule", "item", "check_id")


def _rule_column(rules: list[Rule], attribute: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, attribute)) for r in rules]), F.col("rule") + 1)


def evidence_ref(item: Column) -> Column:
    return F.struct(
        item["file"].alias("file"),
        item["line_start"].cast("int").alias("line_start"),
        item["line_end"].cast("int").alias("line_end"),
        item["source"].alias("source"),
        F.lit(None).cast("string").alias("rule_id"),
    )


def no_refs() -> Column:
    return F.array().cast(f"ARRAY<{EVIDENCE_REF}>")


def check_findings(evidence: DataFrame, rules: list[Rule], runs: DataFrame | None = None) -> DataFrame:
    """Exactly one finding per run and check."""
    item = F.col("item")
    hit = item.isNotNull()
    return (
        first_match(evidence, rules, runs)
        .withColumn("category", _rule_column(rules, "category"))
        .withColumn("title", _rule_column(rules, "title"))
        .withColumn("severity", _rule_column(rules, "severity"))
        .withColumn("ord", F.col("rule").cast("bigint"))
        .withColumn("id", short_digest(F.col("category"), F.coalesce(item["file"], "repo"), F.col("check_id")))
        .withColumn(
            "description",
            F.coalesce(item["summary"], F.concat(F.lit("Nothing in the evidence points to: "), F.lower("title"))),
        )
        .withColumn(
            "status",
            F.when(~hit, "insufficient_evidence").when(item["confidence"] >= 0.7, "confirmed").otherwise("suspected"),
        )
        .withColumn(
            "confidence",
            F.when(hit, F.least(F.lit(0.95), F.greatest(F.lit(0.45), item["confidence"]))).otherwise(F.lit(0.35)),
        )
        .withColumn("symptoms", F.array(_rule_column(rules, "concern")))
        .withColumn("recommendation", _rule_column(rules, "advice"))
        .withColumn("evidence", F.when(hit, F.array(evidence_ref(item))).otherwise(no_refs()))
        .select(*FINDING_COLUMNS)
    )


def security_findings(evidence: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    return check_findings(evidence, SECURITY_RULES, runs)


def performance_findings(evidence: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    return check_findings(evidence, PERFORMANCE_RULES, runs)


def osv_finding(evidence: DataFrame, dependencies: DataFrame, scan_status: DataFrame) -> DataFrame:
    """One more High finding for runs whose dependency scan completed with findings.

    Counts, status and the first three evidence rows meet in one aggregate.
    """
    ref = F.struct("ord", "file", "line_start", "line_end", "source")
    first_three = (
        evidence.filter(F.col("source") == "osv")
        .withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "repo").orderBy("ord")))
        .filter(F.col("_n") <= 3)
        .select("run_id", "repo", ref.alias("ref"))
    )
    counts = dependencies.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    grouped = first_three.groupBy("run_id").agg(F.any_value("repo").alias("repo"), F.array_sort(F.collect_list("ref")).alias("refs"))
    completed = scan_status.filter(F.col("status") == "completed").select("run_id", "repo")
    refs = F.transform(F.coalesce("refs", F.array()), evidence_ref)
    joined = completed.join(counts, "run_id").join(grouped.drop("repo"), "run_id", "left")
    return joined.select(
        "run_id",
        "repo",
        F.lit("security").alias("category"),
        F.lit(len(SECURITY_RULES)).cast("bigint").alias("ord"),
        F.lit("dependency-findings-present").alias("check_id"),
        short_digest(F.lit("security"), F.col("repo"), F.lit("dependency-findings-present")).alias("id"),
        F.lit("Dependency scan found vulnerable packages").alias("title"),
        F.concat(F.lit("Vulnerabilities reported for dependencies: "), F.col("n").cast("string")).alias("description"),
        F.lit("High").alias("severity"),
        F.when(F.col("refs").isNotNull(), "confirmed").otherwise("suspected").alias("status"),
        F.lit(0.9).alias("confidence"),
        F.array(F.lit("Packages in the lockfiles have known holes.")).alias("symptoms"),
        F.lit("Patch direct packages first, then the ones they pull in.").alias("recommendation"),
        refs.alias("evidence"),
    )


def architecture_finding(evidence: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One finding per run from its first structural evidence."""
    structural = F.col("signal_type").isin(*V.ARCHITECTURE_SIGNALS)
    item = F.struct("file", "line_start", "line_end", "source", "summary")
    first = evidence.filter(structural).select("run_id", "repo", "ord", item.alias("item"))
    blank = (runs if runs is not None else runs_of(evidence)).select(
        "run_id",
        "repo",
        F.lit(None).cast(evidence.schema["ord"].dataType).alias("ord"),
        F.lit(None).cast(first.schema["item"].dataType).alias("item"),
    )
    found = first.unionByName(blank).groupBy("run_id", "repo").agg(F.min_by("item", "ord").alias("item"))
    item, hit = F.col("item"), F.col("item").isNotNull()
    return found.select(
        "run_id",
        "repo",
        F.lit("architecture").alias("category"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit("runtime-structure").alias("check_id"),
        short_digest(
            F.lit("architecture"), F.coalesce(item["file"], "repo"), F.coalesce(item["summary"], F.lit(V.UNKNOWN))
        ).alias("id"),
        F.when(hit, "Entry point and modules found").otherwise("Too little structural evidence").alias("title"),
        F.when(hit, "Folders and entry points show how the program starts and is divided.")
        .otherwise("The scan saw too few structural signs to name a pattern.").alias("description"),
        F.when(hit, "Low").otherwise("Medium").alias("severity"),
        F.when(hit, "confirmed").otherwise("insufficient_evidence").alias("status"),
        F.when(hit, F.lit(0.75)).otherwise(F.lit(0.35)).alias("confidence"),
        F.array(
            F.when(hit, "Folders suggest the module borders.").otherwise("The architecture type may be wrong.")
        ).alias("symptoms"),
        F.when(hit, "Write the start-up path and the module borders down.")
        .otherwise("Scan deeper for routes and service borders.").alias("recommendation"),
        F.when(hit, F.array(evidence_ref(item))).otherwise(no_refs()).alias("evidence"),
    )


def architecture_type(profile: DataFrame) -> DataFrame:
    def hinted(word: str) -> Column:
        return F.exists("architecture_hints", lambda h: F.lower(h).contains(word))

    kind = (
        F.when(hinted("microservice"), "microservices")
        .when(hinted("modular"), "modular_monolith")
        .when(F.col("has_entry_point"), "monolith")
        .otherwise(V.UNKNOWN)
    )
    return profile.withColumn("architecture_type", kind)


def runtime_summary(profile: DataFrame) -> DataFrame:
    """A sentence about the first three entry points."""
    sentence = F.when(
        F.col("has_entry_point"),
        F.concat(
            F.lit("Starts from "),
            F.array_join("first_entry_points", ", "),
            F.lit(" and continues into the top-level folders."),
        ),
    ).otherwise(F.lit("No entry point was found, so the start-up path is unknown."))
    return profile.withColumn("runtime_flow_summary", sentence)


def module_boundaries(folders: DataFrame, limit: int = 10) -> DataFrame:
    """The first folders of each repository as modules."""
    order = Window.partitionBy("repo", "run_id").orderBy("path")
    return (
        folders.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .select(
            "repo",
            "run_id",
            F.col("_n").cast("bigint").alias("position"),
            F.col("path").alias("name"),
            F.array("path").alias("paths"),
            F.col("purpose_guess").alias("responsibility"),
        )
    )


def severity_rank(column: str = "severity") -> Column:
    return rank_of(F.col(column), V.SEVERITIES, len(V.SEVERITIES))


def by_severity_and_confidence(*tie_break: str) -> list[Column]:
    return [severity_rank(), F.lit(1) - F.col("confidence"), *[F.col(c) for c in tie_break]]


def is_actionable() -> Column:
    return F.col("status").isin(*V.ACTIONABLE_STATUSES)


def top_risks(findings: DataFrame, category: str, limit: int = 5) -> DataFrame:
    """Most severe actionable findings of a branch per run.

    The rank limit is pushed below the shuffle, so each task forwards at most
    ``limit`` rows per run.
    """
    order = Window.partitionBy("run_id").orderBy(*by_severity_and_confidence("ord"))
    return (
        findings.filter((F.col("category") == category) & is_actionable())
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .select(
            "run_id",
            F.lit(category).alias("category"),
            F.col("_n").cast("bigint").alias("position"),
            F.col("title").alias("issue"),
            "severity",
            F.coalesce(F.get("evidence", F.lit(0))["file"], F.lit(V.UNKNOWN)).alias("file"),
        )
    )


def top_security_risks(findings: DataFrame) -> DataFrame:
    return top_risks(findings, "security")


def top_performance_risks(findings: DataFrame) -> DataFrame:
    return top_risks(findings, "performance")


FAILED_BRANCH_SEVERITY = {"architecture": "Medium", "security": "High", "performance": "Medium"}


def _branch_entry(branch: str) -> Column:
    mine = F.col("entry.branch") == branch
    failed = F.bool_or(mine & (F.col("entry.state.status") == "failed"))
    status = F.when(failed, F.lit("failed")).otherwise(F.max(F.when(mine, F.col("entry.state.status"))))
    reason = F.when(failed, F.min(F.when(mine & (F.col("entry.state.status") == "failed"), F.col("entry.state.reason")))).otherwise(
        F.min(F.when(mine, F.col("entry.state.reason")))
    )
    return F.when(F.bool_or(mine), F.struct(F.lit(branch).alias("branch"), F.struct(status.alias("status"), reason.alias("reason")).alias("state")))


def failed_branch_fill(runs: DataFrame, branch_states: DataFrame) -> DataFrame:
    """A failed finding for each branch of a run that failed or has no output.

    ``branch_states(run_id, branch, status, reason)`` holds one row per finished
    branch. States become a map per run, at most three entries long, and the
    missing branches are read off it.
    """
    entry = F.struct("branch", F.struct("status", "reason").alias("state"))
    known = branch_states.filter(F.col("branch").isin(*V.CATEGORIES)).select("run_id", entry.alias("entry"))
    blank = runs.select("run_id", F.lit(None).cast(known.schema["entry"].dataType).alias("entry"))
    # Rows of one branch are folded: a failure counts before other states, then the first reason by name.
    states = known.unionByName(blank).groupBy("run_id").agg(
        F.map_from_entries(
            F.array_compact(F.array(*[_branch_entry(c) for c in V.CATEGORIES]))
        ).alias("states")
    )
    branch = F.col("category")
    state = F.try_element_at(F.col("states"), branch)
    missing = states.select("run_id", "states", F.explode(F.array(*[F.lit(c) for c in V.CATEGORIES])).alias("category"))
    reason = F.coalesce(
        F.when(state["status"] == "failed", state["reason"]), F.concat(branch, F.lit(" branch output missing"))
    )
    severity = F.lit(None).cast("string")
    for name, value in FAILED_BRANCH_SEVERITY.items():
        severity = F.when(branch == name, value).otherwise(severity)
    return missing.filter(state.isNull() | (state["status"] != "completed")).select(
        "run_id",
        "category",
        short_digest(branch, F.col("run_id"), F.lit("failed")).alias("id"),
        F.concat(F.initcap(branch), F.lit(" analysis did not finish")).alias("title"),
        reason.alias("description"),
        severity.alias("severity"),
        F.lit("failed").alias("status"),
        F.lit(0.0).alias("confidence"),
        F.array(F.concat(F.lit("No result for "), branch)).alias("symptoms"),
        F.lit("Read the run log of this branch and run it again.").alias("recommendation"),
        no_refs().alias("evidence"),
    )


def roadmap(findings: DataFrame, limit: int = 10) -> DataFrame:
    """Work items per run from the most severe actionable findings of all branches."""
    branch = rank_of(F.col("category"), V.CATEGORIES, len(V.CATEGORIES))
    order = Window.partitionBy("run_id").orderBy(
        severity_rank(), F.lit(1) - F.col("confidence"), branch, F.col("ord")
    )
    priority = (
        F.when(F.col("severity").isin("Critical", "High"), "P0").when(F.col("severity") == "Medium", "P1").otherwise("P2")
    )
    timeline = F.lit(None).cast("string")
    for name, bucket in V.TIMELINE_BY_PRIORITY.items():
        timeline = F.when(F.col("priority") == name, bucket).otherwise(timeline)
    return (
        findings.filter(is_actionable())
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .withColumn("priority", priority)
        .select(
            "run_id",
            F.col("_n").cast("bigint").alias("position"),
            "priority",
            F.col("recommendation").alias("task"),
            F.concat(F.lit("Lowers the "), "category", F.lit(" risk: "), "title").alias("impact"),
            F.lit(V.ROADMAP_EFFORT).alias("effort"),
            F.col("severity").alias("risk"),
            F.col("description").alias("justification"),
            timeline.alias("timeline_bucket"),
            F.array("id").alias("depends_on"),
        )
    )


def finding_id(rows: DataFrame, reference: str, seed: str) -> DataFrame:
    return rows.withColumn("finding_id", short_digest(F.col("category"), F.col(reference), F.col(seed)))


def evidence_severity(evidence: DataFrame) -> DataFrame:
    """Severity and kind of advice that the signal of an evidence row calls for."""
    signal = F.col("signal_type")
    return evidence.withColumn(
        "severity",
        F.when(signal.isin("secret", "vuln"), "High").when(signal == "dependency", "Medium").otherwise("Low"),
    ).withColumn(
        "advice",
        F.when(signal == "secret", "rotate").when(signal == "dependency", "upgrade").otherwise("review"),
    )


def severity_counts(evidence: DataFrame) -> DataFrame:
    return evidence_severity(evidence).groupBy("severity", "advice").agg(F.count(F.lit(1)).alias("n"))


def restamp(rows: DataFrame, scans: DataFrame, spread: list[str]) -> DataFrame:
    """Give branch rows the run id and schema version of the scan they belong to.

    ``rows`` carry the id of the scan in ``scan_id``; ``scans`` is one row per scan.
    """
    bare = rows.drop("run_id", "schema_version")
    return attach(bare, scans.select("scan_id", "run_id", "schema_version"), ["scan_id"], spread, how="inner")
