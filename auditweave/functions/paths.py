"""Path expressions and the glob dialect of scan policies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Lower-cased last suffix; '' when the name has no character before its dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def tidy_path(path: Column) -> Column:
    """Drop './' parts, doubled and trailing slashes; '..' stays."""
    single = F.regexp_replace(path, "/{2,}", "/")
    no_dots = F.regexp_replace(F.regexp_replace(single, r"(?<=/)(\./)+", ""), r"^(\./)+", "")
    no_tail = F.regexp_replace(no_dots, r"(?<=.)/\.?$", "")
    return F.when(no_tail == "", F.lit(".")).otherwise(no_tail)


def absolute_path(root: Column, path: Column) -> Column:
    """Resolve ``path`` against ``root``; '.' and '..' parts are folded away."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(part))
        ),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _segment_regex(segment: str) -> str:
    """One path segment of a glob: '*', '?' and '[...]' never cross a slash."""
    out, i = [], 0
    while i < len(segment):
        char = segment[i]
        if char == "*":
            while i + 1 < len(segment) and segment[i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "[" and "]" in segment[i + 2 :]:
            end = segment.index("]", i + 2)
            body = segment[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        elif char == "\\" and i + 1 < len(segment):
            i += 1
            out.append(re.escape(segment[i]))
        else:
            out.append(re.escape(char))
        i += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """Regular expression for one ignore-file pattern (without a leading '!')."""
    folder_only = glob.endswith("/")
    body = glob.strip("/") if folder_only else glob.lstrip("/")
    anchored = glob.startswith("/") or "/" in body
    segments = body.split("/")
    regex = "^" if anchored else "^(?:.*/)?"
    for position, segment in enumerate(segments):
        last = position == len(segments) - 1
        if segment == "**":
            regex += ".+" if last else "(?:.*/)?"
        else:
            regex += _segment_regex(segment) + ("" if last else "/")
    if folder_only:
        return regex + "/.*$"
    return regex + ("$" if segments[-1] == "**" else "(?:/.*)?$")


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Ignore-file semantics: the last pattern that matches decides, '!' negates.

    Neighbouring patterns of the same sign become one alternation, so the usual
    policy costs one regular expression per row.
    """
    runs: list[tuple[bool, list[str]]] = []
    for raw in globs:
        glob = raw.strip()
        if not glob or glob.startswith("#"):
            continue
        positive = not glob.startswith("!")
        regex = glob_regex(glob if positive else glob[1:])
        if runs and runs[-1][0] == positive:
            runs[-1][1].append(regex)
        else:
            runs.append((positive, [regex]))
    decided = F.lit(False)
    for positive, regexes in runs:
        hit = path.rlike("|".join(regexes))
        decided = F.when(hit, F.lit(positive)).otherwise(decided) if not positive or len(runs) > 1 else hit
    return decided


def glob_regex_of(glob: Column) -> Column:
    """``glob_regex`` of a column of patterns, for whole paths relative to the pattern's folder.

    '**' as a whole segment crosses slashes; '*', '?' and '[...]' do not. A pattern without a slash inside
    matches at any depth. Unlike ``glob_regex`` it does not match what lies below a match.
    """
    body = F.regexp_replace(glob, "^/+|/+$", "")
    anchored = glob.startswith("/") | body.contains("/")
    some, rest, any_depth = "\x01", "\x02", "\x03"
    out = F.regexp_replace(body, r"([.+^$(){}|])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\[!", "[^"), r"\[\\\^", "[^")
    out = F.regexp_replace(F.regexp_replace(out, r"(?<=^|/)\*\*/", any_depth), r"(?<=^|/)\*\*$", rest)
    out = F.regexp_replace(F.regexp_replace(out, r"(?<!\\)\*+", some), r"(?<!\\)\?", "[^/]")
    for mark, regex in ((some, "[^/]*"), (rest, ".+"), (any_depth, "(?:.*/)?")):
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), out, F.lit("$"))


def ancestors(path: Column) -> Column:
    """All folders above a path, the tree's root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
