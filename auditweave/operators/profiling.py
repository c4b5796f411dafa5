"""Repository profiles from scanned files.

Input is the output of ``inventory.scanned_files``. Every per-repository result
is a combining aggregate over fixed-size buffers: label sets are boolean
maxima, one per known label, so one huge repository costs no more memory than a
small one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions import paths
from auditweave.functions.ranks import lookup

KEYS = ["repo", "run_id"]
ENTRY_PATH, MANIFEST_PATH = "entry_point", "manifest"
#: Entry points that a profile names itself.
FIRST_PATHS = 3


def _present(labels: list[str], prefix: str) -> Column:
    """Sorted array of the labels whose flag column is true."""
    return F.array_compact(F.array(*[F.when(F.col(f"`{prefix}{label}`"), F.lit(label)) for label in sorted(labels)]))


def _flags(condition, labels: list[str], prefix: str) -> list[Column]:
    return [F.coalesce(F.bool_or(condition(label)), F.lit(False)).alias(f"{prefix}{label}") for label in labels]


LANGUAGES = sorted(set(V.LANGUAGE_BY_SUFFIX.values()))
FRAMEWORKS = sorted(V.FRAMEWORK_BY_DEPENDENCY.values())
HINTS = [V.HINT_CONTAINER, V.HINT_LAYERED, V.HINT_ROUTES]


def languages(files: DataFrame) -> DataFrame:
    grouped = files.groupBy(*KEYS).agg(*_flags(lambda name: F.col("language") == name, LANGUAGES, "lang:"))
    return grouped.select(*KEYS, _present(LANGUAGES, "lang:").alias("languages_detected"))


def is_entry_point(path: Column) -> Column:
    return paths.file_name(path).isin(*V.ENTRY_POINT_NAMES)


def entry_points(files: DataFrame) -> DataFrame:
    """One row per distinct entry point path; a list of them would be unbounded."""
    return files.filter(is_entry_point(F.col("rel_path"))).select(*KEYS, F.col("rel_path").alias("path")).distinct()


def _with_dependencies(content: Column, use: Callable[[Column], Column]) -> Column:
    """Apply ``use`` to the parsed dependency maps of a package.json, parsed once."""
    document = F.from_json(content, "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>")
    return F.get(F.transform(F.array(document), use), F.lit(0))


def npm_frameworks(content: Column) -> Column:
    """Frameworks named as a dependency in a package.json."""

    def names(document: Column) -> Column:
        none = F.array().cast("array<string>")
        both = [F.coalesce(F.map_keys(document[m]), none) for m in ("dependencies", "devDependencies")]
        return F.concat(*both)

    found = F.transform(_with_dependencies(content, names), lambda n: lookup(F.lower(n), V.FRAMEWORK_BY_DEPENDENCY))
    return F.array_compact(found)


def python_frameworks(content: Column) -> Column:
    """Frameworks found as a whole word in a Python manifest."""
    text = F.lower(content)
    return F.array_compact(
        F.array(*[F.when(text.rlike(rf"\b{w}\b"), F.lit(V.FRAMEWORK_BY_DEPENDENCY[w])) for w in V.PYTHON_FRAMEWORK_WORDS])
    )


def file_frameworks(path: Column, content: Column, npm: bool = True, python: bool = True) -> Column:
    """Frameworks one file shows; null for files that are no manifest."""
    name, text = paths.file_name(path), content.cast("string")
    found = F.lit(None).cast("array<string>")
    if python:
        found = F.when(name.isin(V.PIP_MANIFEST, V.PYPROJECT_MANIFEST), python_frameworks(text)).otherwise(found)
    if npm:
        found = F.when(name == V.NPM_MANIFEST, npm_frameworks(text)).otherwise(found)
    return found


def _frameworks(files: DataFrame, npm: bool, python: bool) -> DataFrame:
    """One row per repository and framework."""
    found = file_frameworks(F.col("rel_path"), F.col("content"), npm, python)
    return files.select(*KEYS, F.explode(found).alias("framework")).distinct()


def frameworks_npm(files: DataFrame) -> DataFrame:
    return _frameworks(files.filter(paths.file_name(F.col("rel_path")) == V.NPM_MANIFEST), True, False)


def frameworks_py(files: DataFrame) -> DataFrame:
    manifests = paths.file_name(F.col("rel_path")).isin(V.PIP_MANIFEST, V.PYPROJECT_MANIFEST)
    return _frameworks(files.filter(manifests), False, True)


def frameworks(files: DataFrame) -> DataFrame:
    """Sorted union of both kinds per repository."""
    found = file_frameworks(F.col("rel_path"), F.col("content"))
    grouped = (
        files.filter(paths.file_name(F.col("rel_path")).isin(V.NPM_MANIFEST, V.PIP_MANIFEST, V.PYPROJECT_MANIFEST))
        .select(*KEYS, found.alias("_found"))
        .groupBy(*KEYS)
        .agg(*_flags(lambda name: F.array_contains("_found", name), FRAMEWORKS, "fw:"))
    )
    return grouped.select(*KEYS, _present(FRAMEWORKS, "fw:").alias("frameworks_detected"))


def _hint_tests(path: Column) -> dict[str, Column]:
    lower = F.lower(path)
    return {
        V.HINT_CONTAINER: lower.endswith("dockerfile"),
        V.HINT_LAYERED: lower.contains("/services/") | lower.startswith("services/"),
        V.HINT_ROUTES: lower.contains("/routes/") | lower.startswith("routes/"),
    }


def architecture_hints(files: DataFrame) -> DataFrame:
    tests = _hint_tests(F.col("rel_path"))
    grouped = files.groupBy(*KEYS).agg(*_flags(lambda name: tests[name], HINTS, "hint:"))
    return grouped.select(*KEYS, _present(HINTS, "hint:").alias("architecture_hints"))


def folder_summary(files: DataFrame) -> DataFrame:
    """Distinct top-level folders with a purpose guess."""
    purpose = lookup(F.col("path"), {k: v[0] for k, v in V.FOLDER_PURPOSES.items()})
    confidence = lookup(F.col("path"), {k: v[1] for k, v in V.FOLDER_PURPOSES.items()})
    return (
        files.select(*KEYS, paths.top_folder(F.col("rel_path")).alias("path"))
        .distinct()
        .withColumn("purpose_guess", F.coalesce(purpose, F.lit(V.DEFAULT_FOLDER_PURPOSE[0])))
        .withColumn("confidence", F.coalesce(confidence, F.lit(V.DEFAULT_FOLDER_PURPOSE[1])))
    )


def is_manifest(path: Column) -> Column:
    return paths.file_name(path).isin(*V.ECOSYSTEM_BY_MANIFEST)


def dependency_count(path: Column, content: Column) -> Column:
    """Direct dependencies of one manifest; each kind has its own counting rule."""
    name, text = paths.file_name(path), content.cast("string")

    def entries(document: Column) -> Column:
        sizes = [F.when(document[m].isNull(), 0).otherwise(F.size(document[m])) for m in ("dependencies", "devDependencies")]
        return sizes[0] + sizes[1]

    npm = F.coalesce(_with_dependencies(text, entries), F.lit(0))
    lines = F.split(text, V.LINE_BREAK_PATTERN)
    pip = F.size(F.filter(lines, lambda line: (line != "") & ~line.startswith(V.COMMENT_MARK)))
    python = F.regexp_count(text, F.lit(V.PYPROJECT_ENTRY_PATTERN))
    maven = F.regexp_count(text, F.lit(V.MAVEN_ENTRY))
    return (
        F.when(name == V.NPM_MANIFEST, npm)
        .when(name == V.PIP_MANIFEST, pip)
        .when(name == V.PYPROJECT_MANIFEST, python)
        .when(name == V.MAVEN_MANIFEST, maven)
        .cast("bigint")
    )


def manifest_counts(files: DataFrame) -> DataFrame:
    path = F.col("rel_path")
    return files.filter(is_manifest(path)).select(
        *KEYS,
        path.alias("path"),
        lookup(paths.file_name(path), V.ECOSYSTEM_BY_MANIFEST).alias("ecosystem"),
        dependency_count(path, F.col("content")).alias("direct_dependency_count"),
        *[F.col(c) for c in files.columns if c == "doc_id"],
    )


def profile_paths(files: DataFrame) -> DataFrame:
    """(repo, run_id, kind, path): the distinct entry points and manifests, one row each.

    A file may be both. Lists of paths have no bound, so they stay rows.
    """
    path = F.col("rel_path")
    kinds = F.array(F.when(is_entry_point(path), F.lit(ENTRY_PATH)), F.when(is_manifest(path), F.lit(MANIFEST_PATH)))
    return files.select(*KEYS, F.explode(F.array_compact(kinds)).alias("kind"), path.alias("path")).distinct()


def repo_profile(files: DataFrame) -> DataFrame:
    """Profile of every repository: label lists, numbers of paths and the first entry points, all of bounded size.

    The first ``FIRST_PATHS`` entry points in order come from a rank limit that is applied before the
    shuffle too. All paths are in ``profile_paths``.
    """
    tests = _hint_tests(F.col("rel_path"))
    marked = files.select(*KEYS, "language", "rel_path", file_frameworks(F.col("rel_path"), F.col("content")).alias("_found"))
    labels = marked.groupBy(*KEYS).agg(
        *_flags(lambda name: F.col("language") == name, LANGUAGES, "lang:"),
        *_flags(lambda name: F.array_contains("_found", name), FRAMEWORKS, "fw:"),
        *_flags(lambda name: tests[name], HINTS, "hint:"),
    )
    listed = profile_paths(files)
    numbers = listed.groupBy(*KEYS).agg(F.count_if(F.col("kind") == ENTRY_PATH).alias("n_entry_points"), F.count_if(F.col("kind") == MANIFEST_PATH).alias("n_manifests"))
    first = (
        listed.filter(F.col("kind") == ENTRY_PATH)
        .withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("path")))
        .filter(F.col("_n") <= FIRST_PATHS)
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list("path")).alias("first_entry_points"))
    )
    joined = labels.join(numbers, KEYS, "left").join(first, KEYS, "left")
    return joined.select(
        *KEYS,
        _present(LANGUAGES, "lang:").alias("languages_detected"),
        _present(FRAMEWORKS, "fw:").alias("frameworks_detected"),
        _present(HINTS, "hint:").alias("architecture_hints"),
        (F.coalesce("n_entry_points", F.lit(0)) > 0).alias("has_entry_point"),
        F.coalesce("first_entry_points", F.array().cast("array<string>")).alias("first_entry_points"),
        F.coalesce("n_entry_points", F.lit(0)).alias("n_entry_points"),
        F.coalesce("n_manifests", F.lit(0)).alias("n_manifests"),
    )


def empty_profile(runs: DataFrame) -> DataFrame:
    """The profile of ``runs`` (run_id, repo) without files."""
    none = F.array().cast("array<string>")
    return runs.select(
        *KEYS,
        *[none.alias(c) for c in ("languages_detected", "frameworks_detected", "architecture_hints")],
        F.lit(False).alias("has_entry_point"), none.alias("first_entry_points"), F.lit(0).cast("bigint").alias("n_entry_points"), F.lit(0).cast("bigint").alias("n_manifests"),
    )
