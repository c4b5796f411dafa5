"""Dedup, caps and token budgets for the context of a run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions.ranks import lookup, rank_of
from auditweave.functions.skew import DEFAULT_SALTS, first_n, salt_of
from auditweave.functions.text import cut, token_count, token_count_of_many

EVIDENCE_ORDER = ["source", "file", "line_start", "line_end", "summary", "id"]
DEPENDENCY_ORDER = ["vulnerability_id", "package", "version"]
#: The smallest payload leaves versions in list order.
MINIMAL_ORDER = ["vulnerability_id", "package"]


def evidence_dedup(evidence: DataFrame) -> DataFrame:
    """First row (by ``ord``) per file, start line, source and summary of a run.

    The rank limit of one is applied before the shuffle too, so a large group of
    copies shrinks to one row per task.
    """
    same = Window.partitionBy("run_id", "file", "line_start", "source", "summary").orderBy("ord")
    return evidence.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") == 1).drop("_n")


def evidence_cap(evidence: DataFrame, total: int | None = None, per_source: dict[str, int] | None = None) -> DataFrame:
    """Deduplicated evidence of a run, capped per source and then in total.

    ``position`` is the place in the sorted result. Rows above a source's cap do
    not use up the total.
    """
    total = V.DEFAULT_EVIDENCE_TOTAL if total is None else total
    caps = V.DEFAULT_EVIDENCE_PER_SOURCE if per_source is None else per_source
    limit = F.coalesce(lookup(F.col("source"), caps), F.lit(total)) if caps else F.lit(total)
    highest = max([total, *caps.values()])
    order = [F.col(c) for c in EVIDENCE_ORDER] + [F.col("ord")]
    by_source = Window.partitionBy("run_id", "source").orderBy(*order)
    by_run = Window.partitionBy("run_id").orderBy(*order)
    return (
        evidence_dedup(evidence)
        .withColumn("_n", F.row_number().over(by_source))
        .filter(F.col("_n") <= highest)
        .filter(F.col("_n") <= limit)
        .withColumn("_n", F.row_number().over(by_run))
        .filter(F.col("_n") <= total)
        .withColumn("position", F.col("_n").cast("bigint"))
        .drop("_n")
    )


def dep_top_n(dependencies: DataFrame, limit: int | None = None, order_by: list[str] = DEPENDENCY_ORDER) -> DataFrame:
    """Most severe dependency findings per run; ties of ``order_by`` stay in list order (``ord``)."""
    limit = V.DEFAULT_DEPENDENCY_FINDINGS if limit is None else limit
    rank = rank_of(F.col("severity"), V.DEPENDENCY_SEVERITIES, 99)
    order = Window.partitionBy("run_id").orderBy(rank, *order_by, "ord")
    return (
        dependencies.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .withColumn("position", F.col("_n").cast("bigint"))
        .drop("_n")
    )


def truncate_details(tool_runs: DataFrame, limit: int = 500) -> DataFrame:
    return tool_runs.withColumn("details", cut(F.col("details"), limit))


def _list_per_run(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """Ordered array per run of rows that are capped before."""
    return rows.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"]).alias(name)
    )


EVIDENCE_ITEM = [
    "id", "file", "line_start", "line_end", "snippet_hash", "source", "signal_type", "summary", "confidence",
]
DEPENDENCY_ITEM = [
    "package", "ecosystem", "version", "vulnerability_id", "aliases", "severity", "fixed_version", "source_file",
]


def _dependency_item(rows: DataFrame) -> Column:
    """The fields of a dependency in a payload; a source without aliases has none."""
    none = F.array().cast("array<string>").alias("aliases")
    return F.struct(*[none if name == "aliases" and name not in rows.columns else F.col(name) for name in DEPENDENCY_ITEM])


FOLDER_ITEM = ["path", "purpose_guess", "confidence"]
MANIFEST_ITEM = ["path", "ecosystem", "direct_dependency_count"]
TOOL_RUN_ITEM = ["tool", "status", "exit_code", "details"]
#: Columns of ``runs`` that every payload repeats as they are, if a run has them.
HEAD = ["schema_version", "run_id", "repo_profile", "scan_stats", "vulnerability_scan_status"]
#: A list of folders or manifests stops here; one so long is beyond every token budget.
MOST_ITEMS = 20_000


def _numbered(rows: DataFrame, name: str, items: list[str], order: list[str], most: int = MOST_ITEMS) -> DataFrame:
    """(run_id, list): the first ``most`` rows of each run in order."""
    first = first_n(rows, ["run_id"], [F.col(c) for c in order], most, order)
    return _list_per_run(first, F.struct(*items), name)


def _with_lists(runs: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """``runs`` with each list by its name; empty where a run has no row."""
    for name, rows in lists.items():
        empty = F.array().cast(rows.schema[name].dataType)
        runs = runs.join(rows, "run_id", "left").withColumn(name, F.coalesce(name, empty))
    return runs


def _count_per_run(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))


def minimal_context(
    runs: DataFrame,
    dependencies: DataFrame,
    limit: int = V.MINIMAL_DEPENDENCY_FINDINGS,
    manifests: DataFrame | None = None,
    tool_runs: DataFrame | None = None,
) -> DataFrame:
    """Parts of the smallest payload per run: what ``runs`` carries, the worst dependency findings, counts and tool runs.

    ``tool_runs`` has one row per run and tool; their details are cut short.
    """
    top = dep_top_n(dependencies, limit, MINIMAL_ORDER)
    lists = {"vulnerability_findings": _list_per_run(top, _dependency_item(top), "vulnerability_findings")}
    if tool_runs is not None:
        lists["scanner_tool_runs"] = _numbered(truncate_details(tool_runs, V.TOOL_DETAILS_LIMIT), "scanner_tool_runs", TOOL_RUN_ITEM, ["tool"])
    counts = {"dependency_findings": dependencies} | ({} if manifests is None else {"manifest_count": manifests})
    made = _with_lists(runs, lists)
    for name, rows in counts.items():
        made = made.join(_count_per_run(rows, name), "run_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return made.withColumn("mode", F.lit(V.MINIMAL_MODE))


def compacted_context(
    runs: DataFrame,
    evidence: DataFrame,
    dependencies: DataFrame,
    total: int | None = None,
    per_source: dict[str, int] | None = None,
    dependency_limit: int | None = None,
    folders: DataFrame | None = None,
    manifests: DataFrame | None = None,
    tool_runs: DataFrame | None = None,
) -> DataFrame:
    """Parts of the compacted payload per run: capped lists, and counts before and after.

    Lists are built only from capped rows, so their length has a bound.
    """
    kept = evidence_cap(evidence, total, per_source)
    top = dep_top_n(dependencies, dependency_limit)
    lists = {
        "evidence_index": _list_per_run(kept, F.struct(*EVIDENCE_ITEM), "evidence_index"),
        "vulnerability_findings": _list_per_run(top, _dependency_item(top), "vulnerability_findings"),
    }
    if folders is not None:
        lists["folders"] = _numbered(folders, "folders", FOLDER_ITEM, ["path"])
    if manifests is not None:
        lists["manifests"] = _numbered(manifests, "manifests", MANIFEST_ITEM, ["path"])
    if tool_runs is not None:
        lists["scanner_tool_runs"] = _numbered(truncate_details(tool_runs, V.TOOL_DETAILS_LIMIT), "scanner_tool_runs", TOOL_RUN_ITEM, ["tool"])
    joined = _with_lists(runs, lists)
    joined = joined.join(_count_per_run(evidence, "original_evidence_count"), "run_id", "left")
    joined = joined.join(_count_per_run(dependencies, "original_dependency_findings"), "run_id", "left")

    def number(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)

    return joined.select(
        *runs.columns,
        *lists,
        number("original_evidence_count"),
        F.size("evidence_index").cast("bigint").alias("compacted_evidence_count"),
        number("original_dependency_findings"),
        F.size("vulnerability_findings").cast("bigint").alias("compacted_dependency_findings"),
    )


COMPACTION_COUNTS = ["original_evidence_count", "compacted_evidence_count", "original_dependency_findings", "compacted_dependency_findings"]


def payload_json(context: DataFrame) -> DataFrame:
    """(run_id, payload): the JSON that an agent gets, from the parts of ``minimal_context`` or ``compacted_context``.

    Parts that the context was made without are left out; null values are written.
    """
    has = set(context.columns)

    def picked(*names: str) -> list[str]:
        return [name for name in names if name in has]

    no_evidence = F.array().cast("array<string>").alias("evidence_index")
    enabled = F.lit(True).alias("enabled")
    if "mode" in has:
        block = F.struct(enabled, "mode", F.lit(V.MINIMAL_NOTE).alias("note"))
        parts = [F.struct(*picked("vulnerability_scan_status", "vulnerability_findings", "manifest_count")).alias("dependency_summary"), no_evidence]
    else:
        block = F.struct(enabled, *COMPACTION_COUNTS)
        parts = [*picked("folders"), F.struct(*picked("manifests", "vulnerability_scan_status", "vulnerability_findings")).alias("dependency_summary"), "evidence_index"]
    head = picked("schema_version", "run_id", "repo_profile", "scan_stats")
    whole = F.struct(*head, *parts, *picked("scanner_tool_runs"), block.alias("context_compaction"))
    return context.select("run_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("payload"))


def _json(*items: str | Column) -> Column:
    return F.to_json(F.struct(*items), {"ignoreNullFields": "false"})


def _top_tokens(items: Column, limit: int) -> Column:
    """Tokens of the first ``limit`` of a list of (order, tokens)."""
    return F.aggregate(F.slice(F.sort_array(items), 1, limit), F.lit(0).cast("bigint"), lambda total, x: total + x["tokens"])


def _dependency_sizes(dependencies: DataFrame, limit: int, minimal: int, count: Callable[[Column], Column]) -> DataFrame:
    """Tokens of all, of the ``limit`` and of the ``minimal`` worst dependency findings per run, from one pass.

    Each salt of a run keeps its own first rows, so a run's last step sorts a bounded list.
    """
    severity = rank_of(F.col("severity"), V.DEPENDENCY_SEVERITIES, 99)
    rows = dependencies.select("run_id", salt_of(F.col("ord"), salts=DEFAULT_SALTS).alias("salt"), severity.alias("_rank"), "ord", *_dependency_fields(dependencies))
    part = Window.partitionBy("run_id", "salt")
    orders = [["_rank", *DEPENDENCY_ORDER, "ord"], ["_rank", *MINIMAL_ORDER, "ord"]]
    ranked = rows.withColumn("n1", F.row_number().over(part.orderBy(*orders[0]))).withColumn("n2", F.row_number().over(part.orderBy(*orders[1])))
    # Counted where the rows have been dealt out, as the texts are longer than the rows.
    ranked = ranked.withColumn("tokens", count(_json(*DEPENDENCY_ITEM)))
    listed = ranked.groupBy("run_id").agg(
        F.sum("tokens").alias("full"),
        *[F.collect_list(F.when(F.col(f"n{i}") <= most, F.struct(*orders[i - 1], "tokens"))).alias(f"l{i}") for i, most in ((1, limit), (2, minimal))],
    )
    return listed.select("run_id", "full", _top_tokens(F.col("l1"), limit).alias("compact"), _top_tokens(F.col("l2"), minimal).alias("minimal"))


def _evidence_sizes(evidence: DataFrame, total: int, caps: dict[str, int], count: Callable[[Column], Column]) -> DataFrame:
    """Tokens of all evidence and of the capped evidence per run, from one pass."""
    order = [c for c in EVIDENCE_ORDER if c not in ("line_end", "id")]
    same = ["run_id", "file", "line_start", "source", "summary"]
    rows = evidence.select(*same, "line_end", "id", "ord", count(_json(*EVIDENCE_ITEM)).alias("tokens"))
    first = rows.groupBy(*same).agg(F.sum("tokens").alias("full"), F.min_by(F.struct("line_end", "id", "ord", "tokens"), "ord").alias("x"))
    limit = F.coalesce(lookup(F.col("source"), caps), F.lit(total)) if caps else F.lit(total)
    keyed = first.select("run_id", "full", limit.alias("limit"), salt_of(*[F.col(c) for c in order], salts=DEFAULT_SALTS).alias("salt"), *order, "x.*")
    placed = [*EVIDENCE_ORDER, "ord"]
    ranked = keyed.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "source", "salt").orderBy(*placed)))
    item = F.struct(F.struct(*placed).alias("o"), "tokens", "limit")
    listed = ranked.groupBy("run_id").agg(F.sum("full").alias("full"), F.collect_list(F.when(F.col("n") <= F.least("limit", F.lit(total)), item)).alias("items"))
    # In order, a row is taken while its source and the whole list are below their caps.
    start = F.struct(F.lit(None).cast("string").alias("source"), F.lit(0).alias("used"), F.lit(0).alias("taken"), F.lit(0).cast("bigint").alias("tokens"))

    def step(state: Column, x: Column) -> Column:
        used = F.when(x["o"]["source"].eqNullSafe(state["source"]), state["used"]).otherwise(0)
        fits = (used < x["limit"]) & (state["taken"] < total)
        return F.struct(
            x["o"]["source"].alias("source"), F.when(fits, used + 1).otherwise(used).alias("used"),
            F.when(fits, state["taken"] + 1).otherwise(state["taken"]).alias("taken"), F.when(fits, state["tokens"] + x["tokens"]).otherwise(state["tokens"]).alias("tokens"),
        )

    return listed.select("run_id", "full", F.aggregate(F.sort_array("items"), start, step, lambda state: state["tokens"]).alias("compact"), F.lit(0).cast("bigint").alias("minimal"))


def _dependency_fields(rows: DataFrame) -> list[str | Column]:
    return [F.array().cast("array<string>").alias("aliases") if name == "aliases" and name not in rows.columns else name for name in DEPENDENCY_ITEM]


def context_sizes(
    runs: DataFrame,
    evidence: DataFrame,
    dependencies: DataFrame,
    total: int | None = None,
    per_source: dict[str, int] | None = None,
    dependency_limit: int | None = None,
    minimal_limit: int = V.MINIMAL_DEPENDENCY_FINDINGS,
    folders: DataFrame | None = None,
    manifests: DataFrame | None = None,
    tool_runs: DataFrame | None = None,
    count: Callable[[Column], Column] = token_count_of_many,
) -> DataFrame:
    """(run_id, full_tokens, compact_tokens, minimal_tokens): tokens of the three payloads as JSON, for every run.

    The payloads are never built: each table is read once and gives the tokens of its JSON items, with those
    that the caps keep summed apart, and field names count once a run. With a tokenizer that joins characters
    across JSON marks the sums are upper bounds.
    """
    total = V.DEFAULT_EVIDENCE_TOTAL if total is None else total
    caps = V.DEFAULT_EVIDENCE_PER_SOURCE if per_source is None else per_source
    limit = V.DEFAULT_DEPENDENCY_FINDINGS if dependency_limit is None else dependency_limit
    sizes = [_evidence_sizes(evidence, total, caps, count), _dependency_sizes(dependencies, limit, minimal_limit, count)]

    for rows, names in ((folders, FOLDER_ITEM), (manifests, MANIFEST_ITEM)):
        if rows is not None:
            tokens = F.sum(count(_json(*names))).alias("full")
            sizes.append(rows.groupBy("run_id").agg(tokens).select("run_id", "full", F.col("full").alias("compact"), F.lit(0).cast("bigint").alias("minimal")))
    if tool_runs is not None:
        whole = tool_runs.withColumn("_cut", cut(F.col("details"), V.TOOL_DETAILS_LIMIT))
        both = whole.select("run_id", count(_json(*TOOL_RUN_ITEM)).alias("whole"), count(_json("tool", "status", "exit_code", F.col("_cut").alias("details"))).alias("short"))
        sizes.append(both.groupBy("run_id").agg(F.sum("whole").alias("full"), F.sum("short").alias("compact")).select("run_id", "full", "compact", F.col("compact").alias("minimal")))
    names = ["dependency_summary", "vulnerability_findings", "evidence_index"] + ["scanner_tool_runs"] * (tool_runs is not None)
    listed = names + ["folders"] * (folders is not None) + ["manifests"] * (manifests is not None)
    block = ["context_compaction", "enabled", "true"]
    compact = [*listed, *block, *(word for name in COMPACTION_COUNTS for word in (name, "0"))]
    least = [*names, *block, "mode", V.MINIMAL_MODE, "note", V.MINIMAL_NOTE, *(["manifest_count", "0"] if manifests is not None else [])]
    head = count(_json(*[c for c in HEAD if c in runs.columns]))
    fixed = [(head + count(F.lit(" ".join(words)))).cast("bigint").alias(tier) for tier, words in (("full", listed), ("compact", compact), ("minimal", least))]
    known = runs.select("run_id", *fixed, F.lit(True).alias("known"))
    parts = reduce(DataFrame.unionByName, [x.withColumn("known", F.lit(None).cast("boolean")) for x in sizes], known)
    summed = parts.groupBy("run_id").agg(*[F.sum(t).cast("bigint").alias(f"{t}_tokens") for t in ("full", "compact", "minimal")], F.bool_or("known").alias("known"))
    return summed.filter("known").drop("known")


def token_counts(documents: DataFrame, text: str, keys: list[str], count=token_count) -> DataFrame:
    """Tokens per group; ``count`` may be any tokenizer expression."""
    return documents.groupBy(*keys).agg(
        F.sum(count(F.col(text))).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("documents")
    )


def context_tier(sizes: DataFrame, budgets: dict[str, int] | None = None, compaction: bool = True) -> DataFrame:
    """Largest payload that fits each stage's budget, per run and stage.

    ``sizes(run_id, full_tokens, compact_tokens, minimal_tokens)``.
    """
    budgets = V.DEFAULT_TOKEN_BUDGETS if budgets is None else budgets
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(b).cast("bigint").alias("budget")) for s, b in budgets.items()])
    rows = sizes.withColumn("_s", F.explode(stages)).select("*", "_s.stage", "_s.budget").drop("_s")
    budget = F.col("budget")
    tier = (
        F.when(F.col("full_tokens") <= budget, "full")
        .when(F.lit(not compaction), "over_budget")
        .when(F.col("compact_tokens") <= budget, "compact")
        .when(F.col("minimal_tokens") <= budget, "minimal")
        .otherwise("over_budget")
    )
    return rows.withColumn("tier", tier)
