"""Summaries and reports per run.

Bounded lists (top risks, roadmap, tools) become arrays of a summary document.
Everything else stays in rows: a report is a table of lines with sort keys, so
a run with any number of findings is written without gathering it in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions.ranks import lookup, rank_of
from auditweave.functions.text import cut, squeeze
from auditweave.operators.checks import severity_rank


def _numbered(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Positions inside groups whose size is bounded by an earlier cap."""
    return rows.withColumn(
        "position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    )


def summary_risks(risks: DataFrame) -> DataFrame:
    """The selected top risks of a branch, sorted by severity, issue and file."""
    chosen = risks.withColumnRenamed("position", "_selected")
    return _numbered(chosen, ["run_id", "category"], severity_rank(), "issue", "file", "_selected").drop("_selected")


def priority_rank() -> Column:
    return rank_of(F.col("priority"), V.PRIORITIES, len(V.PRIORITIES))


def summary_roadmap(roadmap: DataFrame) -> DataFrame:
    """Roadmap items sorted by priority and task."""
    chosen = roadmap.withColumnRenamed("position", "_selected")
    return _numbered(chosen, ["run_id"], priority_rank(), "task", "_selected").select(
        "run_id", "position", "priority", "task", "effort", "impact", "risk", "justification"
    )


def renamed_tool_status(status: Column) -> Column:
    return F.coalesce(lookup(status, V.TOOLING_STATUS), F.lit(V.TOOLING_STATUS_DEFAULT))


def tooling_status(tool_runs: DataFrame) -> DataFrame:
    """Tool runs with their report status; one row per run and tool."""
    return tool_runs.select("run_id", "tool", renamed_tool_status(F.col("status")).alias("status"), "exit_code", "details")


def stage_status(states: DataFrame) -> DataFrame:
    """One column per stage from ``states(run_id, stage, state)``; a stage without a good state failed."""

    def state_of(stage: str) -> Column:
        good = ["completed"] if stage == "scanner" else ["completed", "degraded"]
        state = F.max(F.when((F.col("stage") == stage) & F.col("state").isin(*good), F.col("state")))
        return F.coalesce(state, F.lit("failed")).alias(stage)

    return states.groupBy("run_id").agg(*[state_of(s) for s in V.STAGES])


def hard_failures(stages: DataFrame) -> DataFrame:
    return stages.filter((F.col("scanner") == "failed") | (F.col("roadmap") == "failed"))


RISK_FIELDS = ["issue", "severity", "file"]
ROADMAP_FIELDS = ["priority", "task", "effort", "impact", "risk", "justification"]
TOOL_FIELDS = ["tool", "status", "exit_code", "details"]
SUMMARY_FIELDS = [
    "schema_version", "run_id", "repo_name", "language_detected", "frameworks", "architecture_type",
    "top_security_risks", "top_performance_risks", "roadmap", "scanner_tooling", "analysis_status",
]


def summary_json(
    runs: DataFrame, risks: DataFrame, roadmap: DataFrame, tooling: DataFrame, stages: DataFrame, schema_version: str
) -> DataFrame:
    """One JSON document per run with a fixed set of keys.

    ``runs(run_id, repo_name, language_detected, frameworks, architecture_type)``. The rows of all
    inputs, each in a column of its own, meet in one aggregate per run; the lists are bounded by the
    caps of their inputs and sorted there.
    """

    def entry(order: list[str | Column], fields: list[str], name: str) -> Column:
        return F.struct(F.struct(*order).alias("order"), F.struct(*fields).alias("item")).alias(name)

    head = ["repo_name", "language_detected", "frameworks", "architecture_type"]
    rows = [
        runs.select("run_id", F.struct(*head).alias("head")),
        risks.select("run_id", "category", entry([severity_rank().alias("rank"), "issue", "file", "position"], RISK_FIELDS, "risk_row")),
        roadmap.select("run_id", entry([priority_rank().alias("rank"), "task", "position"], ROADMAP_FIELDS, "roadmap_row")),
        tooling.select("run_id", entry(["tool"], TOOL_FIELDS, "tool_row")),
        stages.select("run_id", F.struct(*V.STAGES).alias("stages")),
    ]
    together = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), rows)

    def listed(name: str, only: Column | None = None) -> Column:
        found = F.col(name) if only is None else F.when(only, F.col(name))
        return F.transform(F.array_sort(F.collect_list(found)), lambda x: x["item"])

    whole = together.groupBy("run_id").agg(
        F.first("head", ignorenulls=True).alias("head"),
        listed("risk_row", F.col("category") == "security").alias("top_security_risks"),
        listed("risk_row", F.col("category") == "performance").alias("top_performance_risks"),
        listed("roadmap_row").alias("roadmap"),
        listed("tool_row").alias("scanner_tooling"),
        F.first("stages", ignorenulls=True).alias("stages"),
    ).filter(F.col("head").isNotNull())
    status = F.struct(*[F.coalesce(F.col("stages")[s], F.lit("failed")).alias(s) for s in V.STAGES])
    whole = whole.select("*", "head.*", F.lit(schema_version).alias("schema_version"), status.alias("analysis_status"))
    document = F.to_json(F.struct(*SUMMARY_FIELDS), {"ignoreNullFields": "false"})
    return whole.select("run_id", document.alias("document"))


def shown_status(status: Column) -> Column:
    return F.when(status == "failed", V.FAILED_FINDING_LABEL).otherwise(status)


def is_shown() -> Column:
    return ~F.col("status").isin(*V.HIDDEN_STATUSES)


def branch_rank() -> Column:
    return rank_of(F.col("category"), V.CATEGORIES, len(V.CATEGORIES))


def top_findings(findings: DataFrame, runs: DataFrame, limit: int = 10) -> DataFrame:
    """Numbered most severe findings of all branches per run; one placeholder when there is none."""
    order = Window.partitionBy("run_id").orderBy(
        severity_rank(), F.lit(1) - F.col("confidence"), "title", branch_rank(), "ord"
    )
    ranked = (
        findings.filter(is_shown())
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .select(
            "run_id", F.col("_n").cast("bigint").alias("position"), "category", "severity", "title",
            shown_status(F.col("status")).alias("status"),
        )
    )
    # Ranked rows are few per run, so one outer join also finds the runs without any.
    defaults = {
        "position": F.lit(1).cast("bigint"),
        "category": F.lit("architecture"),
        "severity": F.lit("Low"),
        "title": F.lit("No actionable findings"),
        "status": F.lit("insufficient_evidence"),
    }
    return ranked.join(runs.select("run_id"), "run_id", "full").select(
        "run_id", *[F.coalesce(c, default).alias(c) for c, default in defaults.items()]
    )


def table_row(rows: DataFrame) -> DataFrame:
    """Markdown table rows of ``top_findings``."""
    cells = F.concat_ws(" | ", F.col("position").cast("string"), "category", "severity", "title", "status")
    return rows.withColumn("line", F.concat(F.lit("| "), cells, F.lit(" |")))


LINE_KEYS = ["k1", "k2", "k3", "k4"]


def finding_lines(findings: DataFrame, runs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Report lines per run and branch with their sort keys.

    A branch without any finding gets a line saying so; one whose findings are
    all hidden gets none.
    """
    categories = categories or V.CATEGORIES
    status = shown_status(F.col("status"))
    mine = findings.filter(F.col("category").isin(*categories))
    lines = mine.filter(is_shown()).select(
        "run_id",
        "category",
        severity_rank().cast("bigint").alias("k1"),
        (F.lit(1) - F.col("confidence")).alias("k2"),
        F.col("title").alias("k3"),
        F.col("ord").cast("bigint").alias("k4"),
        F.concat(
            F.lit("- **"), "severity", F.lit("** `"), status, F.lit("` - "), "title", F.lit(": "), "recommendation"
        ).alias("line"),
    )
    # Which branches of a run have findings: fixed flags in one combining aggregate.
    seen = (
        runs.select("run_id", F.lit(None).cast("string").alias("category"))
        .unionByName(mine.select("run_id", "category"))
        .groupBy("run_id")
        .agg(*[F.coalesce(F.bool_or(F.col("category") == c), F.lit(False)).alias(f"has:{c}") for c in categories])
    )
    absent = F.array_compact(F.array(*[F.when(~F.col(f"has:{c}"), F.lit(c)) for c in categories]))
    empty = seen.select(
        "run_id",
        F.explode(absent).alias("category"),
        F.lit(0).cast("bigint").alias("k1"),
        F.lit(0.0).alias("k2"),
        F.lit("").alias("k3"),
        F.lit(0).cast("bigint").alias("k4"),
        F.lit(V.NO_FINDINGS_LINE).alias("line"),
    )
    return lines.unionByName(empty)


def _or_line(lines: DataFrame, runs: DataFrame, text: str) -> DataFrame:
    """Lines, plus ``text`` for runs without any; a run has few lines here."""
    return lines.join(runs.select("run_id"), "run_id", "full").select(
        "run_id", F.coalesce("position", F.lit(1).cast("bigint")).alias("position"), F.coalesce("line", F.lit(text)).alias("line")
    )


def roadmap_lines(roadmap: DataFrame, runs: DataFrame) -> DataFrame:
    """Ordered roadmap lines per run."""
    chosen = roadmap.withColumnRenamed("position", "_selected")
    detail = F.concat(
        F.lit(" [impact: "), "impact", F.lit("; effort: "), "effort", F.lit("; risk: "), "risk",
        F.lit("; justification: "), "justification", F.lit("]"),
    )
    lines = _numbered(chosen, ["run_id"], priority_rank(), "task", "_selected").select(
        "run_id",
        "position",
        F.concat(F.lit("- **"), "priority", F.lit("** ("), "timeline_bucket", F.lit(") - "), "task", detail).alias("line"),
    )
    return _or_line(lines, runs, V.NO_ROADMAP_LINE)


def tooling_lines(tool_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Ordered tool lines per run; a run has one row per tool."""
    details = F.nullif(F.col("details"), F.lit(""))
    metadata = F.concat_ws(
        "; ",
        F.concat(F.lit("exit_code="), F.col("exit_code").cast("string")),
        F.concat(F.lit("details="), cut(squeeze(details), 140)),
    )
    suffix = F.when(metadata != "", F.concat(F.lit(" ("), metadata, F.lit(")"))).otherwise(F.lit(""))
    lines = _numbered(tool_runs, ["run_id"], "tool").select(
        "run_id",
        "position",
        F.concat(F.lit("- `"), "tool", F.lit("`: `"), renamed_tool_status(F.col("status")), F.lit("`"), suffix).alias("line"),
    )
    return _or_line(lines, runs, V.NO_TOOLING_LINE)


def _placed(rows: DataFrame, section: int | Column, part: int, line: Column | str = "line", keys: dict[str, Column] | None = None) -> DataFrame:
    """Put lines at their place in the report."""
    keys = keys or {}
    return rows.select(
        "run_id",
        (F.lit(section) if isinstance(section, int) else section).alias("section"),
        F.lit(part).alias("part"),
        keys.get("k1", F.lit(0)).cast("bigint").alias("k1"),
        keys.get("k2", F.lit(0.0)).cast("double").alias("k2"),
        keys.get("k3", F.lit("")).alias("k3"),
        keys.get("k4", F.lit(0)).cast("bigint").alias("k4"),
        F.col(line).alias("line") if isinstance(line, str) else line.alias("line"),
    )


def _joined_or(names: str, otherwise: str) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit(otherwise))


def overview_lines(info: DataFrame) -> DataFrame:
    """Overview and architecture lines from one row per run; ``path_lines`` adds the paths."""

    def line(section: int, number: int, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(number).alias("number"), text.alias("line"))

    lines = [
        line(3, 1, F.concat(F.lit("- Repository: `"), "repo_name", F.lit("`"))),
        line(3, 2, F.concat(F.lit("- Languages detected: "), _joined_or("languages_detected", "Unknown"))),
        line(3, 3, F.concat(F.lit("- Frameworks detected: "), _joined_or("frameworks_detected", "Unknown"))),
        line(3, 6, F.concat(F.lit("- Files scanned: "), F.col("files_scanned").cast("string"))),
        line(3, 7, F.concat(F.lit("- Files skipped: "), F.col("files_skipped").cast("string"))),
        line(4, 1, F.concat(F.lit("- Architecture type: `"), "architecture_type", F.lit("`"))),
        line(4, 2, F.concat(F.lit("- Runtime flow: "), "runtime_flow_summary")),
    ]
    return info.select("run_id", F.explode(F.array(*lines)).alias("x")).select("run_id", "x.section", "x.number", "x.line")


#: Kind of path, its line number in the overview, and its label.
PATH_LINES = [("entry_point", 4, "Entry points"), ("manifest", 5, "Dependency manifests")]
PATHS_PER_LINE = 200


def path_lines(paths: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, number, row, line): the paths of each kind in order, in lines of ``PATHS_PER_LINE``; one line without any."""
    order = Window.partitionBy("run_id", "kind").orderBy("path")
    placed = paths.select("run_id", "kind", "path").distinct().withColumn("row", F.floor((F.row_number().over(order) - 1) / PATHS_PER_LINE))
    texts = placed.groupBy("run_id", "kind", "row").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("text"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("number"), F.lit(label).alias("label")) for k, n, label in PATH_LINES])
    wanted = runs.select("run_id", F.explode(kinds).alias("x")).select("run_id", "x.*")
    more = F.when(F.col("row") > 0, F.lit(" (more)")).otherwise("")
    return wanted.join(texts, ["run_id", "kind"], "left").select(
        "run_id", "number", F.coalesce("row", F.lit(0)).alias("row"),
        F.concat(F.lit("- "), "label", more, F.lit(": "), F.coalesce("text", F.lit("Not detected"))).alias("line"),
    )


def module_lines(modules: DataFrame, runs: DataFrame) -> DataFrame:
    lines = modules.select(
        "run_id",
        "position",
        F.concat(F.lit("- **"), "name", F.lit("**: "), "responsibility", F.lit(" (`"), F.array_join("paths", ", "), F.lit("`)")).alias("line"),
    )
    return _or_line(lines, runs, V.NO_MODULES_LINE)


def report_markdown(
    runs: DataFrame,
    info: DataFrame,
    paths: DataFrame,
    stages: DataFrame,
    tool_runs: DataFrame,
    modules: DataFrame,
    findings: DataFrame,
    roadmap: DataFrame,
) -> DataFrame:
    """All report lines of all runs, with the keys that sort them.

    Sorted by (run_id, section, part, k1..k4) the lines of a run are its
    Markdown report.
    """
    frame = []
    for section, heading in enumerate(V.REPORT_HEADINGS):
        before = [] if section in (0, 1) else [(-2, "")]
        after = [(99, "")] if section == 0 else []
        if section == len(V.REPORT_HEADINGS) - 1:
            after = [(0, V.SUMMARY_TABLE_HEADER), (1, V.SUMMARY_TABLE_RULE), (99, "")]
        frame += [(section, part, text) for part, text in [*before, (-1, heading), *after]]
    fixed = F.array(
        *[F.struct(F.lit(s).alias("section"), F.lit(p).alias("part"), F.lit(t).alias("line")) for s, p, t in frame]
    )
    headings = runs.select("run_id", F.explode(fixed).alias("x")).select("run_id", "x.section", "x.part", "x.line")
    headings = headings.select(
        "run_id", "section", "part",
        F.lit(0).cast("bigint").alias("k1"), F.lit(0.0).alias("k2"), F.lit("").alias("k3"), F.lit(0).cast("bigint").alias("k4"),
        "line",
    )
    known = runs.select("run_id").join(stages, "run_id", "left")
    stage_items = F.array(
        *[
            F.struct(F.lit(i).alias("n"), F.concat(F.lit(f"- `{s}`: `"), F.coalesce(s, F.lit("failed")), F.lit("`")).alias("line"))
            for i, s in enumerate(V.STAGES)
        ]
    )
    stage_rows = known.select("run_id", F.explode(stage_items).alias("x")).select("run_id", "x.n", "x.line")
    overview = overview_lines(info)
    position = {"k1": F.col("position")}
    sorted_keys = {k: F.col(k) for k in LINE_KEYS}
    lines = finding_lines(findings.filter(F.col("category") != "architecture"), runs, ["security", "performance"])
    pieces = [
        headings,
        _placed(stage_rows, 1, 2, keys={"k1": F.col("n")}),
        _placed(tooling_lines(tool_runs, runs), 2, 2, keys=position),
        _placed(overview, F.col("section"), 2, keys={"k1": F.col("number")}),
        _placed(path_lines(paths, runs), 3, 2, keys={"k1": F.col("number"), "k4": F.col("row")}),
        _placed(module_lines(modules, runs), 5, 2, keys=position),
        _placed(lines, F.when(F.col("category") == "security", 6).otherwise(7), 2, keys=sorted_keys),
        _placed(roadmap_lines(roadmap, runs), 8, 2, keys=position),
        _placed(table_row(top_findings(findings, runs)), 9, 2, keys=position),
    ]
    return reduce(DataFrame.unionByName, pieces)
