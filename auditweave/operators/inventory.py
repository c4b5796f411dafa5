"""File-table operators: policy, skip reasons, statistics, caps, lockfiles.

Input is ``files(repo, run_id, rel_path, size_bytes, content)`` for any number
of repositories; ``content`` may be text or binary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions import paths
from auditweave.functions.ranks import lookup
from auditweave.functions.skew import attach, first_n

IGNORED, TOO_LARGE, BINARY, ENCODING = "ignored_pathspec", "too_large", "binary", "encoding_error"


@dataclass(frozen=True)
class ScanPolicy:
    """Which files a scan reads."""

    include: list[str] = field(default_factory=lambda: list(V.DEFAULT_INCLUDE_GLOBS))
    exclude: list[str] = field(default_factory=lambda: list(V.DEFAULT_EXCLUDE_GLOBS))
    max_file_bytes: int = V.DEFAULT_MAX_FILE_BYTES
    max_files: int = V.DEFAULT_MAX_FILES


def in_excluded_folder(path: Column) -> Column:
    """Any path part is one of the folder names that are always left out."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(s) for s in V.HARD_EXCLUDED_SEGMENTS]))


def hard_exclude(files: DataFrame) -> DataFrame:
    return files.filter(~in_excluded_folder(F.col("rel_path")))


def outside_globs(path: Column, policy: ScanPolicy) -> Column:
    """Excluded by a glob, or not included when there is an include list."""
    excluded = paths.matches_globs(path, policy.exclude)
    if not policy.include:
        return excluded
    return excluded | ~paths.matches_globs(path, policy.include)


def glob_policy(files: DataFrame, policy: ScanPolicy) -> DataFrame:
    return files.filter(~outside_globs(F.col("rel_path"), policy))


def is_ignored(path: Column, policy: ScanPolicy) -> Column:
    return in_excluded_folder(path) | outside_globs(path, policy)


def is_ignore_file(path: Column) -> Column:
    return paths.file_name(path).isin(*V.IGNORE_FILES)


def ignore_rules(files: DataFrame) -> DataFrame:
    """(repo, run_id, folder, kind, line, regex, negated, folders_only): the patterns of all ignore files, a row each.

    ``folder`` is that of the file ('' for the root). Blank lines and comments are no patterns; blanks at the
    end of a line do not count, unless a backslash stands before them.
    """
    name = paths.file_name(F.col("rel_path"))
    lines = F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("line", "raw")
    kind = F.array_position(F.array(*[F.lit(k) for k in V.IGNORE_FILES]), name).cast("int").alias("kind")
    folder = F.when(F.col("rel_path").contains("/"), F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise("").alias("folder")
    raw = files.filter(is_ignore_file(F.col("rel_path"))).select("repo", "run_id", folder, kind, lines)
    text = F.regexp_replace("raw", r"(?<!\\)[ \t]+$", "")
    found = raw.withColumn("glob", text).filter((F.col("glob") != "") & ~F.col("glob").startswith("#"))
    found = found.withColumn("negated", F.col("glob").startswith("!")).withColumn("glob", F.regexp_replace("glob", r"^!|^\\(?=[!#])", ""))
    found = found.filter(F.regexp_replace("glob", "/", "") != "")
    return found.select(
        "repo", "run_id", "folder", "kind", "line", paths.glob_regex_of(F.col("glob")).alias("regex"), "negated", F.col("glob").endswith("/").alias("folders_only")
    )


def nested_ignore(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The files that the ignore files inside their own trees leave.

    A rule speaks of paths below its folder. Of the rules that match a path, the strongest kind of file decides,
    in it the deepest folder, and there the last line; a negated rule keeps the path. What lies below an
    ignored folder is ignored and can't be named again. Paths meet rules by an equality join on the folders
    above them, so a path is compared with the rules above it alone, and folders are judged once for all their
    files. Only folders that have rules take part, and the ignored paths are the only rows that come back.
    """
    keys = ["repo", "run_id"]
    rules = ignore_rules(files) if rules is None else rules
    listed = files.select(*keys, "rel_path")
    folders = listed.select(*keys, F.explode(paths.ancestors(F.col("rel_path"))).alias("path")).filter("path <> ''").distinct()
    targets = folders.withColumn("is_folder", F.lit(True)).unionByName(listed.select(*keys, F.col("rel_path").alias("path"), F.lit(False).alias("is_folder")))
    above = targets.withColumn("folder", F.explode(paths.ancestors(F.col("path"))))
    met = above.join(rules, [*keys, "folder"])
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    hits = met.filter((F.col("is_folder") | ~F.col("folders_only")) & F.rlike(below, F.col("regex")))
    order = F.struct("kind", F.length("folder").alias("depth"), "line")
    decided = hits.groupBy(*keys, "path", "is_folder").agg(F.max_by("negated", order).alias("kept")).filter("not kept").drop("kept")
    hidden = decided.filter("is_folder").select(*keys, F.col("path").alias("up"))
    inside = listed.withColumn("up", F.explode(paths.ancestors(F.col("rel_path")))).join(hidden, [*keys, "up"]).select(*keys, "rel_path")
    gone = inside.unionByName(decided.filter("not is_folder").select(*keys, F.col("path").alias("rel_path"))).distinct()
    return attach(files, gone, [*keys, "rel_path"], ["rel_path"], how="left_anti", salts=1)


def skip_reason(files: DataFrame, policy: ScanPolicy) -> DataFrame:
    """Add ``reason``: the first test a file fails, null when it is scanned.

    Conditions run in order, so content is only inspected for files that pass
    the path and size tests.
    """
    size, raw = F.col("size_bytes"), F.col("content").cast("binary")
    head_has_nul = F.position(F.lit(b"\x00"), F.substring(raw, 1, 1024)) > 0
    reason = (
        F.when(is_ignored(F.col("rel_path"), policy), IGNORED)
        .when(size.isNull(), ENCODING)
        .when(size > policy.max_file_bytes, TOO_LARGE)
        .when(raw.isNull(), ENCODING)
        .when(head_has_nul, BINARY)
        .when(~F.is_valid_utf8(raw.cast("string")), ENCODING)
    )
    return files.withColumn("reason", reason)


def scan_stats(labelled: DataFrame) -> DataFrame:
    """Seen, scanned, skipped and per-reason counts per repository."""
    reason = F.col("reason")
    return labelled.groupBy("repo", "run_id").agg(
        F.count(F.lit(1)).alias("total_files_seen"),
        F.count_if(reason.isNull()).alias("files_scanned"),
        F.count_if(reason.isNotNull()).alias("files_skipped"),
        *[F.count_if(reason == name).alias(name) for name in (IGNORED, BINARY, TOO_LARGE, ENCODING)],
    )


def max_files_cap(
    labelled: DataFrame, max_files: int, tie_break: str | None = None, salts: int = 256
) -> DataFrame:
    """Rows seen before the scan of a repository stops at ``max_files`` accepted files.

    Only repositories that reach the limit are ordered at all, and there only
    the N-th accepted path is needed: every row up to it was seen.
    """
    order_names = ["rel_path"] + ([tie_break] if tie_break else [])
    keys = ["repo", "run_id"]
    accepted = labelled.filter(F.col("reason").isNull()).select(*keys, *order_names)
    full = accepted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max_files).drop("_n")
    candidates = attach(accepted, full, keys, order_names, how="inner")
    stops = (
        first_n(candidates, keys, [F.col(c) for c in order_names], max_files, order_names, salts)
        .filter(F.col("position") == max_files)
        .select(*keys, F.struct(*order_names).alias("_stop"))
    )
    seen = attach(labelled, stops, keys, order_names)
    return seen.filter(F.col("_stop").isNull() | (F.struct(*order_names) <= F.col("_stop"))).drop("_stop")


def language_map(files: DataFrame) -> DataFrame:
    return files.withColumn("language", lookup(paths.file_suffix(F.col("rel_path")), V.LANGUAGE_BY_SUFFIX))


def scanned_files(files: DataFrame, policy: ScanPolicy) -> DataFrame:
    """Files that pass every test, with their language."""
    return language_map(skip_reason(files, policy).filter(F.col("reason").isNull()))


def lockfiles(files: DataFrame, policy: ScanPolicy) -> DataFrame:
    """Distinct lockfile paths; size and content tests do not apply to them."""
    path = F.col("rel_path")
    return (
        files.filter(paths.file_name(path).isin(*V.LOCKFILE_NAMES) & ~is_ignored(path, policy))
        .select("repo", "run_id", "rel_path")
        .distinct()
    )


def lockfile_resolve(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidate paths, absolute or relative, as existing paths inside their repository."""
    root = F.regexp_replace(F.col("root"), "(?<=.)/+$", "")
    inside = F.concat(root, F.lit("/"))
    full = paths.absolute_path(root, F.col("path"))
    relative = (
        candidates.select("repo", full.alias("_full"), inside.alias("_inside"))
        .filter(F.startswith("_full", "_inside"))
        .select("repo", F.expr("substring(_full, length(_inside) + 1)").alias("rel_path"))
        .distinct()
    )
    return relative.join(files.select("repo", "rel_path").distinct(), ["repo", "rel_path"], "left_semi")


def report_exclude(rows: DataFrame, excluded: list[str] | None = None, file: str = "file") -> DataFrame:
    """Drop report rows whose file lies under a configured sub-path."""
    path, under = F.col(file), F.lit(False)
    for prefix in V.DEFAULT_REPORT_EXCLUDES if excluded is None else excluded:
        under = under | (path == prefix) | path.startswith(prefix.rstrip("/") + "/")
    return rows.filter(~under)


@dataclass(frozen=True)
class Tool:
    name: str
    flag: str
    needs_language: str | None = None


TOOLS = [
    Tool("semgrep", "enable_semgrep"),
    Tool("bandit", "enable_bandit", "Python"),
    Tool("osv-scanner", "enable_osv"),
]


def scan_plan(requests: DataFrame, enabled: dict[str, bool], tools: list[Tool] | None = None) -> DataFrame:
    """Tools to run per request: wanted by the request and the configuration, and of use.

    ``requests`` has one flag column per tool and ``languages``. The plan is an
    array expression per row, not a product of tables.
    """
    wanted = []
    for tool in tools or TOOLS:
        useful = F.col(tool.flag) & F.lit(enabled.get(tool.flag, True))
        if tool.needs_language:
            useful = useful & F.array_contains(F.col("languages"), tool.needs_language)
        wanted.append(F.when(useful, F.lit(tool.name)))
    return requests.select("run_id", F.explode(F.array_compact(F.array(*wanted))).alias("tool"))


def repo_from_url(requests: DataFrame) -> DataFrame:
    """Add ``repo_name``; null marks a URL that must be rejected."""
    name = F.regexp_extract(F.col("github_url"), V.HOSTING_URL_PATTERN, 2)
    return requests.withColumn("repo_name", F.nullif(name, F.lit("")))
