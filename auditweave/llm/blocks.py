"""Pairs of rows within groups of any size, in blocks of bounded size.

A group is dealt to chunks of about ``BLOCK`` rows by hash, and each pair of chunks is a block of its own, so no
task holds more than two chunks of a group at a time. All blocks of a batch are compared in step: rows lie
block after block, and for each distance every row meets the one so far behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a block.
BLOCK = 512
#: Pairs that are compared at a time.
PAIRS = 1 << 18

Rows = dict[str, np.ndarray]


def pairs_in_blocks(rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows that share a block: of one chunk in a block of one, of both in a block of two."""
    first = np.flatnonzero(block_starts(rows))
    sizes = np.diff(np.append(first, len(rows["key"])))
    left = np.repeat(first + sizes, sizes) - np.arange(len(rows["key"]))
    chunk, alone = rows["chunk"], rows["i"] == rows["j"]
    at, held, size = np.flatnonzero(left > 1), [], 0
    distance = 1
    while len(at):
        u = at[alone[at] | (chunk[at] != chunk[at + distance])]
        held.append((u, u + distance))
        size += len(u)
        if size >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
        distance += 1
        at = at[left[at] > distance]
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def block_starts(rows: Rows) -> np.ndarray:
    """Which rows begin a block."""
    out = np.ones(len(rows["key"]), bool)
    out[1:] = (np.diff(rows["key"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)
    return out


def joined(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` places, the smallest place that the pairs connect each with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            return label


def in_blocks(rows: DataFrame, key: str, work: Callable[[Rows], tuple[np.ndarray, np.ndarray]], edges: str = "u long, v long") -> DataFrame:
    """Edges (u, v), the smaller first, that ``work`` finds in the blocks of each ``key`` of ``rows`` (vertex, members, ...).

    ``work`` gets the columns of many whole blocks, with ``key``, ``chunk``, and the numbers ``i`` and ``j`` of
    the block's chunks; lists come as arrays of arrays.
    """
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    cells = (
        rows.withColumnRenamed(key, "key")
        .withColumn("parts", parts)
        .withColumn("chunk", F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
        .drop("parts", "other", "members")
    )
    cells = cells.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")

    def found(whole: Rows) -> pa.RecordBatch:
        u, v = work(whole)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows | None = None
        for batch in batches:
            if batch.num_rows:
                new = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
                block = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
                last = int(np.flatnonzero(block_starts(block))[-1])
                if last:
                    yield found({k: x[:last] for k, x in block.items()})
                held = {k: x[last:] for k, x in block.items()}
        if held is not None:
            yield found(held)

    return cells.mapInArrow(run, edges)
