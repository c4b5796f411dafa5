"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.common import chunks, lower_ascii, mixed, staged, text_buffer, text_column, word_shingles

#: A power of two, at most 256.
BINS = 256
#: Low-order bits kept of each bin; two of them go into one byte.
BITS = 4
SHINGLE = 5
#: Bytes of text in a partition.
PARTITION_BYTES = 24 << 20

_STEPS = mixed(np.arange(64 * BINS, dtype=np.uint64) + np.uint64(0x5DEECE66D)).reshape(64, BINS) % np.uint64(BINS)
_STEPS = _STEPS.astype(np.int64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of every bin (a row a text), and which texts have a shingle.

    Each shingle hash falls into one bin by its first bits, where the smallest counts. An empty bin
    takes the value of the first full bin in a fixed random order that belongs to the bin.
    """
    raw, offsets = text_buffer(texts)
    hashes, owner = word_shingles(lower_ascii(raw), offsets, SHINGLE)
    # One sort: text number, bin and 34 bits of the hash in one number.
    packed = np.sort((owner.astype(np.uint64) << np.uint64(42)) | (hashes >> np.uint64(22)))
    cell = packed >> np.uint64(34)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    values = np.full(len(texts) * BINS, _EMPTY)
    values[cell[first].astype(np.int64)] = packed[first] & np.uint64((1 << 34) - 1)
    values = values.reshape(-1, BINS)
    any_full = (values != _EMPTY).any(axis=1)
    full = values[any_full]
    rows, bins = np.nonzero(full == _EMPTY)
    out, step = full.copy(), 0
    while len(rows):
        ahead = _STEPS[step % 64][bins] if step < 64 else (bins + step) % BINS
        found = full[rows, ahead]
        hit = found != _EMPTY
        out[rows[hit], bins[hit]] = found[hit]
        rows, bins, step = rows[~hit], bins[~hit], step + 1
    low = np.zeros((len(texts), BINS), np.uint8)
    low[any_full] = (mixed(out) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low, any_full


def packed_text(low: np.ndarray, full: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text; a text without words has an empty one."""
    both = (low[:, 0::2] << 4) | low[:, 1::2]
    return [both[i].tobytes().hex() if full[i] else "" for i in range(len(low))]


def likeness(a: np.ndarray, a_full: np.ndarray, b: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    """Estimated similarity: the share of equal bins, less what chance makes equal in ``BITS`` bits."""
    chance = 1.0 / (1 << BITS)
    share = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    score = np.clip((share - chance) / (1.0 - chance), 0.0, 1.0)
    return np.where(a_full & b_full, score, (a_full == b_full).astype(float))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the next text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [part.split()[0] for part in RESULT.split(", ")]


def _results(texts: list[str], following: list[str]) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, own_full = fingerprints(pa.array(texts, pa.large_string()))
    new, new_full = fingerprints(pa.array(changed, pa.large_string()))
    nxt, nxt_full = fingerprints(pa.array(following, pa.large_string())) if following[:-1] != texts[1:] else _shifted(own, own_full, following[-1])
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(packed_text(own, own_full), pa.string()),
        pa.array(packed_text(new, new_full), pa.string()),
        pa.array(likeness(own, own_full, new, new_full)),
        pa.array(likeness(own, own_full, nxt, nxt_full)),
    ]


def _shifted(low: np.ndarray, full: np.ndarray, last: str) -> tuple[np.ndarray, np.ndarray]:
    end, end_full = fingerprints(pa.array([last], pa.large_string()))
    return np.concatenate([low[1:], end]), np.concatenate([full[1:], end_full])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id and the columns of ``RESULT``), a row per row of ``docs`` (doc_id, text).

    The next document is the one with the next doc_id, after the last the first; rows without doc_id
    come first, and rows of one doc_id follow each other by a hash of their text. A null text counts as
    empty. Texts without words have an empty fingerprint: likeness 1 to each other and 0 to the rest.
    Fingerprints of equal texts are equal. An empty table gives no rows; a single row follows itself.

    Rows are range-partitioned by id and pass in order; the last row of a partition meets the first
    one of the next partition in a join of one row a partition.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PARTITION_BYTES))
    tie = F.xxhash64("text")
    ordered = rows.withColumn("tie", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def emit(ids: pa.Array, found: list[pa.Array], place: str, part: int, texts: list[str | None]) -> pa.RecordBatch:
        where = [pa.array([place] * len(ids)), pa.array([part] * len(ids), pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([ids, *found, *where], names=["doc_id", *NAMES, "place", "part", "text"])

    blank = [pa.array([None], t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held_id, held_text = TaskContext.get().partitionId(), None, None
        for batch in chunks(batches):
            ids, texts = batch.column(0), text_column(batch).to_pylist()
            if held_text is None:
                yield emit(ids.slice(0, 1), blank, "first", part, [texts[0]])
            else:
                ids, texts = pa.concat_arrays([held_id, ids]), [held_text, *texts]
            if len(texts) > 1:
                yield emit(ids.slice(0, len(texts) - 1), _results(texts[:-1], texts[1:]), "inner", part, [None] * (len(texts) - 1))
            held_id, held_text = ids.slice(len(texts) - 1, 1), texts[-1]
        if held_text is not None:
            yield emit(held_id, blank, "last", part, [held_text])

    passed = staged(ordered.mapInArrow(run, f"doc_id {kind}, {RESULT}, place string, part int, text string"))
    inner = passed.filter("place = 'inner'").select("doc_id", *NAMES)
    heads = passed.filter("place = 'first'").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")
    after = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    tails = passed.filter("place = 'last'").select("doc_id", "text", "part").join(after, "part")
    pairs = tails.join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _results([batch.column(1)[i].as_py()], [batch.column(2)[i].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *found], names=["doc_id", *NAMES])

    return inner.unionByName(pairs.mapInArrow(close, f"doc_id {kind}, {RESULT}"))
