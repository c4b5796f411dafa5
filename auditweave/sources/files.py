"""File trees as tables.

Spark's own file sources pass over names that start with a dot or underscore
and fail on files they cannot read, while an audit has to see both. So folders
are expanded level by level in tasks, and only accepted files are opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.operators.inventory import ScanPolicy, is_ignored

VERSION_CONTROL = ".git"
LISTING = "run_id string, repo string, base string, path string, size_bytes bigint, is_folder boolean"
LISTING_COLUMNS = ["run_id", "repo", "base", "path", "size_bytes", "is_folder"]
BYTES_PER_BATCH = 64 * 1024 * 1024


def _children(path: str) -> list[tuple[str, int | None, bool]]:
    """Entries of one folder; links and version-control folders are not followed."""
    system, inside = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    out = []
    for info in system.get_file_info(arrow_fs.FileSelector(inside, allow_not_found=True)):
        is_folder = info.type == arrow_fs.FileType.Directory
        if info.base_name == VERSION_CONTROL or (not scheme and os.path.islink(info.path)):
            continue
        if is_folder or info.type == arrow_fs.FileType.File:
            out.append((scheme + info.path, None if is_folder else info.size, is_folder))
    return out


def _one_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for *owner, path, size, is_folder in batch.itertuples(index=False):
            entries = _children(path) if is_folder else [(path, size, False)]
            yield pd.DataFrame([(*owner, *entry) for entry in entries], columns=LISTING_COLUMNS)


def _all_levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for *owner, path, size, is_folder in batch.itertuples(index=False):
            waiting = [] if not is_folder else [path]
            if not is_folder:
                yield pd.DataFrame([(*owner, path, size, False)], columns=LISTING_COLUMNS)
            while waiting:
                entries = _children(waiting.pop())
                waiting += [p for p, _, folder in entries if folder]
                yield pd.DataFrame([(*owner, *e) for e in entries if not e[2]], columns=LISTING_COLUMNS)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add bytes where ``wanted``; a file that cannot be read has none."""
    for batch in batches:
        contents, held, start = [], 0, 0
        for position, (path, wanted) in enumerate(zip(batch["path"], batch["wanted"], strict=True)):
            body = None
            if wanted:
                try:
                    system, inside = (
                        arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
                    )
                    with system.open_input_file(inside) as handle:
                        body = handle.read()
                except OSError:
                    body = None
            contents.append(body)
            held += len(body or b"")
            if held >= BYTES_PER_BATCH:
                yield batch.iloc[start : position + 1].drop(columns="wanted").assign(content=contents)
                contents, held, start = [], 0, position + 1
        if contents:
            yield batch.iloc[start:].drop(columns="wanted").assign(content=contents)


def requests_below(spark: SparkSession, root: str) -> DataFrame:
    """A request (run_id, repo, root) for each folder below ``root``, with the run named after the folder."""
    base = root.rstrip("/")
    listed = spark.createDataFrame([(None, None, base, base, None, True)], LISTING).mapInPandas(_one_level, LISTING)
    repo = F.substring_index("path", "/", -1)
    return listed.filter("is_folder").select(F.concat(F.lit("run-"), repo).alias("run_id"), repo.alias("repo"), F.col("path").alias("root"))


def scan_files(requests: DataFrame, levels: int = 3) -> DataFrame:
    """Every file below the root of each request, hidden ones too, without version-control folders.

    The first ``levels`` levels are expanded one at a time with the found folders
    dealt out over the session's number of shuffle partitions in between, so a very
    large repository is listed by many tasks. The number is given, because the few
    bytes of a listing say nothing about the work below it.
    """
    partitions = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = F.rtrim(F.col("root"), F.lit("/"))
    listing = requests.select("run_id", "repo", root.alias("base"), root.alias("path"), F.lit(None).cast("bigint").alias("size_bytes"), F.lit(True).alias("is_folder"))
    for _ in range(levels):
        listing = listing.mapInPandas(_one_level, LISTING).repartition(partitions, "path")
    listing = listing.mapInPandas(_all_levels, LISTING)
    relative = F.expr("substring(path, length(base) + 2)")
    return listing.select("run_id", "repo", relative.alias("rel_path"), "size_bytes", "path")


def readable_files(requests: DataFrame, policy: ScanPolicy) -> DataFrame:
    """Files with their bytes; only files that pass the path and size tests are opened."""
    partitions = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = scan_files(requests)
    accepted = ~is_ignored(F.col("rel_path"), policy) & (F.col("size_bytes") <= policy.max_file_bytes)
    rows = listed.withColumn("wanted", accepted).repartition(partitions, "path")
    schema = "run_id string, repo string, rel_path string, size_bytes bigint, path string, content binary"
    return rows.mapInPandas(_read, schema).drop("path")
