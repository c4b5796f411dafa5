"""Helpers that several operators share: tables, stage tables, and texts as flat byte arrays.

The array helpers work on the buffers of an Arrow text column, so splitting and hashing all words
of a batch is a handful of numpy calls and no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as the contracts define it: a run of anything but blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer spans are hashed by themselves, so that the steps over shorter ones have a bound.
LONG_SPAN = 1 << 12
#: Texts are worked on in pieces of about this many bytes, which bounds a worker's memory.
CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_hash(doc_id: Column) -> Column:
    """crc32 of the id as text: the number that separates held-out rows from the others."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return doc_hash(doc_id) % 5 == 0


def staged(rows: DataFrame) -> DataFrame:
    """Rows computed once and kept in the shared folder, so that a lost executor costs a read.

    The folder is the one of ``spark.checkpoint.dir``. A local session without it keeps the rows
    in Spark's own storage instead; on a cluster the setting is required.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        _use_checkpoint_dir(spark)
        return rows.checkpoint(eager=True)
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _use_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` for files that executors write and read.

    Only a local session without the setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="auditweave-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty texts and 64-bit offsets."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array and the offsets of its texts (one more than texts)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = _byte_lengths(batch, name)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = min(start + CHUNK_ROWS, max(start + 1, int(np.searchsorted(ends, done + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def text_pieces(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Pieces of at most about ``size`` bytes of all texts, in arrays of about ``size`` bytes, and each piece's text number.

    Texts are cut in front of white space only, so every word lies in one piece; a text without any is one piece.
    """
    raw, offsets = text_buffer(texts)
    starts, owners = [offsets[:-1]], [np.arange(len(texts))]
    for i in np.flatnonzero(np.diff(offsets) > size).tolist():
        at, end, cuts = int(offsets[i]) + size, int(offsets[i + 1]), []
        while at < end:
            window = _SPACE[raw[at : min(end, at + size)]]
            if not window.any():
                at += size
                continue
            cuts.append(at + int(window.argmax()))
            at = cuts[-1] + size
        starts.append(np.array(cuts, np.int64))
        owners.append(np.full(len(cuts), i))
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    bounds = np.append(start, offsets[-1])
    first = 0
    while first < len(start):
        stop = min(first + CHUNK_ROWS, max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1))
        stop = min(stop, len(start))
        own = np.ascontiguousarray(bounds[first : stop + 1] - bounds[first])
        data = pa.py_buffer(raw[bounds[first] : bounds[stop]].tobytes())
        yield pa.Array.from_buffers(pa.large_string(), stop - first, [None, pa.py_buffer(own.tobytes()), data]), owner[first:stop]
        first = stop


def _byte_lengths(batch: pa.RecordBatch, name: str) -> np.ndarray:
    _, offsets = text_buffer(text_column(batch, name))
    return np.diff(offsets)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each text."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    edge = inside[1:] != inside[:-1]
    # A text that ends in a word next to one that begins with a word: both edges fall on one place.
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])
    starts = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHashes:
    """64-bit hashes of any byte spans of one buffer.

    A span is taken eight bytes at a time and the state is mixed after each step, starting from the
    span's length; so spans of up to eight bytes and equal length never share a hash, and longer ones
    do so only by chance, whatever their structure. Very long spans take a part of their BLAKE2 digest.
    """

    def __init__(self, raw: np.ndarray):
        self.raw, self.lanes = raw, _lanes(raw)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        lengths = ends - starts
        out = mixed(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D + salt))
        long = lengths > LONG_SPAN
        at = np.flatnonzero(~long)
        step = 0
        while len(at):
            left = lengths[at] - step
            lane = self.lanes[starts[at] + step] & _LOW_BYTES[np.minimum(left, 8)]
            out[at] = mixed((out[at] ^ lane) * np.uint64(0xD6E8FEB86659FD93))
            step += 8
            at = at[left > 8]
        for i in np.flatnonzero(long).tolist():
            digest = hashlib.blake2b(self.raw[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest()
            out[i] = np.frombuffer(digest, "<u8")[0]
        return out


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def equal_spans(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray, others: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Whether each span of ``raw`` has the bytes of the span of ``pool`` beside it."""
    mine, theirs = _lanes(raw), _lanes(pool) if pool is not raw else None
    theirs = mine if theirs is None else theirs
    same = lengths == other_lengths
    long = lengths > LONG_SPAN
    for i in np.flatnonzero(same & long & ((raw is not pool) | (starts != others))).tolist():
        same[i] = np.array_equal(raw[starts[i] : starts[i] + lengths[i]], pool[others[i] : others[i] + lengths[i]])
    at, step = np.flatnonzero(same & ~long & (lengths > 0)), 0
    while len(at):
        left = lengths[at] - step
        good = (mine[starts[at] + step] ^ theirs[others[at] + step]) & _LOW_BYTES[np.minimum(left, 8)] == 0
        same[at[~good]] = False
        step += 8
        at = at[good & (left > 8)]
    return same


def span_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct spans: a key of each in order, a place of each, and the key's number of every span.

    Keys are hashes, and the bytes of all spans of a key are compared. Where they differ, the spans of
    that key get other hashes, which follow from their bytes alone.
    """
    hashes, lengths, salt = SpanHashes(raw), ends - starts, 0
    keys = hashes(starts, ends)
    while True:
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        twin = first[inverse]
        same = equal_spans(raw, starts, lengths, raw, starts[twin], lengths[twin])
        if same.all():
            return distinct, first, inverse
        salt += 1
        again = np.isin(inverse, inverse[~same])
        keys[again] = hashes(starts[again], ends[again], salt)


#: Masks of the lowest 0 to 8 bytes.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and each one's text number; a shorter text is one shingle."""
    starts, ends, counts = word_bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = SpanHashes(raw)(starts, ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(words)) - first
    left = counts[owner] - place
    out = words.copy()
    for step in range(1, n):
        ahead = np.minimum(np.arange(len(words)) + step, len(words) - 1)
        out = np.where(left > step, mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[ahead]), out)
    keep = (left >= n) | (place == 0)
    return out[keep], owner[keep]


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, one after another, and the offsets of the texts."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n_texts + 1))


def code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that begin at the places ``at``."""
    wide = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
    lead = wide[at]
    out = lead.copy()
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        pick = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[pick] & mask
        for step in range(1, more + 1):
            value = (value << 6) | (wide[at[pick] + step] & 0x3F)
        out[pick] = value
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents of each class (or of class 0 and 1), chosen by a hash of the id.

    The bound is on rows of the label table; their texts come by a join with this bounded list. A
    document with several labels has the largest. Of rows that repeat a document, that with the smallest
    hash of its text counts, so reruns agree.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    most = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    chosen = [known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(most[value]) for value in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.any_value("label").alias("label"))


def fields_of(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
