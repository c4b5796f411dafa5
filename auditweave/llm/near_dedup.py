"""Near-duplicate documents by MinHash bands, Odd sketches and a check on full shingle sets.

1. Every text gives its shingle set, ``BANDS`` band keys of ``ROWS`` MinHash values each, and an Odd
   sketch: the MinHash samples folded into ``SKETCH_BITS`` parity bits. The XOR population count of two
   sketches estimates their similarity.
2. Equal sets form classes. A class is a vertex, numbered in order of its smallest doc_id, those without
   any id last; ids of documents come back at the end, so a document may be in several classes.
3. In each band bucket, members are compared with the bucket's smallest member: sketches first,
   then, for the best such partner of each document, the full sets. Confirmed links join components.
4. Buckets that still hold several components are compared in blocks of bounded size. Pairs of
   different components whose sketches come near the threshold connect their documents to suspect
   groups; a block writes a spanning forest of them, not the pairs. In each group, again in blocks,
   every such pair is checked on full sets, unless links found in the block connect it already.

A pair of similarity 0.8 shares no band with a probability of 1.4e-7, and its sketch estimate falls
below ``SKETCH_LEAST`` (five standard errors) with less than 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import chunks, distinct_sets, lower_ascii, mixed, staged, text_buffer, text_column, word_shingles
from auditweave.llm.components import components

BANDS, ROWS = 30, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
WORDS = SKETCH_BITS // 64
SKETCH_LEAST = 0.61
#: Rows of one side of a block in step 4.
BLOCK = 512
#: Stands for a missing vertex in a minimum.
NONE = (1 << 63) - 1

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ADD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)

SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))


def min_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty sets, one column a sample."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), SAMPLES), np.uint64)
    for i in range(SAMPLES if len(starts) else 0):
        out[:, i] = np.minimum.reduceat(hashes * _MULTIPLY[i] + _ADD[i], starts) >> np.uint64(16)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    out = np.zeros((len(minima), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(minima), band + 1, np.uint64)
        for row in range(ROWS):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + minima[:, band * ROWS + row])
        out[:, band] = key
    return out.view(np.int64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Each sample flips the bit that it hashes to."""
    out = np.zeros((len(minima), WORDS), np.uint64)
    rows = np.arange(len(minima))
    for i in range(SAMPLES):
        bit = mixed(minima[:, i] + _SALT[i]) % np.uint64(SKETCH_BITS)
        out[rows, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return out.view(np.int64)


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing sketch bits."""
    share = np.minimum(2.0 * differing_bits / SKETCH_BITS, 0.999)
    return 1.0 + SKETCH_BITS / (4.0 * SAMPLES) * np.log1p(-share)


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_buffer(text_column(batch))
    hashes, owner = word_shingles(lower_ascii(raw), offsets, shingle)
    return distinct_sets(hashes, owner, batch.num_rows)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, offsets = _sets(batch, shingle)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            minima = min_hashes(hashes, offsets)
            keys, sketches = band_keys(minima), odd_sketches(minima)
            digest = [None] * batch.num_rows
            for i in full:
                digest[i] = _digest(hashes[offsets[i] : offsets[i + 1]])
            at = np.full(batch.num_rows, -1)
            at[full] = np.arange(len(full))
            picked = pa.array(np.where(at < 0, 0, at), mask=at < 0)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
            doc_id, text_hash = (batch.column(batch.schema.get_field_index(name)) for name in ("doc_id", "text_hash"))
            columns = [doc_id, text_hash, pa.array(sizes.astype(np.int64)), pa.array(digest, pa.binary()), bands.take(picked)]
            columns += [pa.array(np.ascontiguousarray(sketches[:, w])).take(picked) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "digest", "bands", *(f"s{w}" for w in range(WORDS))])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SIGNATURE)


def _likely(a: str, b: str) -> Column:
    """Sketch estimate of the rows aliased ``a`` and ``b``."""
    bits = sum((F.bit_count(F.col(f"{a}.s{w}").bitwiseXOR(F.col(f"{b}.s{w}"))) for w in range(WORDS)), F.lit(0))
    share = F.least(bits * (2.0 / SKETCH_BITS), F.lit(0.999))
    return 1.0 + SKETCH_BITS / (4.0 * SAMPLES) * F.log1p(-share)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(vertex, partner, is_hub, set): whole shingle sets of the classes in ``wanted``.

    ``wanted`` has the first three, the ``digest`` and one row of each class by ``at_id`` and ``at_hash``;
    a row whose set has another digest only shares that hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, offsets = _sets(batch, shingle)
            flat = pa.py_buffer(hashes.tobytes())
            sets = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int64).tobytes()), flat])
            digest, *passed = (batch.column(batch.schema.get_field_index(name)) for name in ("digest", "vertex", "partner", "is_hub"))
            same = [_digest(hashes[offsets[i] : offsets[i + 1]]) == digest[i].as_py() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*passed, sets.cast(pa.binary())], names=["vertex", "partner", "is_hub", "set"]).filter(pa.array(same, pa.bool_()))

    # Without an id, the hash of the text alone tells rows apart.
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("at_id"), F.xxhash64("text").alias("at_hash"), "text")
    return texts.join(wanted, ["at_id", "at_hash"]).mapInArrow(run, "vertex long, partner long, is_hub boolean, set binary").dropDuplicates(["vertex"])


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Edges among ``pairs`` (u, v, a, b), a and b the packed sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = both and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _near_in_block(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of chunk i: the rows of chunk j in other components that sizes and sketches allow, with the estimates."""
    left, right = np.flatnonzero(rows["chunk"] == rows["i"]), np.flatnonzero(rows["chunk"] == rows["j"])
    sketch, sizes, comp = rows["sketch"], rows["n"], rows["component"]
    same = rows["i"][0] == rows["j"][0]
    for u in left.tolist():
        v = right[right > u] if same else right
        v = v[(comp[v] != comp[u]) & (100 * np.minimum(sizes[v], sizes[u]) >= percent * np.maximum(sizes[v], sizes[u]))]
        if len(v):
            likely = estimate(np.bitwise_count(sketch[v] ^ sketch[u]).sum(axis=1))
            keep = likely >= SKETCH_LEAST
            if keep.any():
                yield u, v[keep], likely[keep]


def _forest(rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups that the pairs of ``_near_in_block`` connect, each as edges to its smallest vertex."""
    ids = rows["vertex"]
    label = np.arange(len(ids))
    for u, v, _ in _near_in_block(rows, percent):
        label[np.isin(label, np.unique(label[v]))] = label[u]
    groups, inverse, sizes = np.unique(label, return_inverse=True, return_counts=True)
    least = np.full(len(groups), NONE)
    np.minimum.at(least, inverse, ids)
    at = np.flatnonzero((sizes[inverse] > 1) & (least[inverse] != ids))
    return ids[at], least[inverse[at]]


def _links(rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components that links on full sets join, the likeliest pairs first; pairs that earlier links of the block connect are left out."""
    found = list(_near_in_block(rows, percent))
    none = np.zeros(0, np.int64)
    if not found:
        return none, none
    u = np.concatenate([np.full(len(v), u) for u, v, _ in found])
    v, likely = np.concatenate([v for _, v, _ in found]), np.concatenate([x for _, _, x in found])
    order = np.argsort(-likely, kind="stable")
    _, label = np.unique(rows["component"], return_inverse=True)
    sets = rows["set"]
    pairs = []
    for a, b in zip(u[order].tolist(), v[order].tolist(), strict=True):
        if label[a] == label[b]:
            continue
        x, y = np.frombuffer(sets[a], np.uint64), np.frombuffer(sets[b], np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both >= percent * (len(x) + len(y) - both):
            pairs.append((a, b))
            label[label == label[b]] = label[a]
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return rows["component"][at[:, 0]], rows["component"][at[:, 1]]


def _in_blocks(rows: DataFrame, group: str, percent: int, work: Callable[[dict[str, np.ndarray], int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges (u, v) that ``work`` finds in the blocks of each ``group`` of ``rows`` (with ``members``).

    A group is split into chunks of about ``BLOCK`` rows by hash, and each pair of chunks is a block of
    its own, so that no task holds more than two chunks of a group at a time.
    """
    cells = (
        rows.withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .withColumnRenamed(group, "key")
        .drop("parts", "other", "members")
    )
    cells = cells.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names) if name != "sketch"}
        out["sketch"] = batch.column(batch.schema.get_field_index("sketch")).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
        return out

    def edges(block: dict[str, np.ndarray]) -> pa.RecordBatch:
        u, v = work(block, percent)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = arrays(batch)
            block = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
            cut = np.flatnonzero((np.diff(block["key"]) != 0) | (np.diff(block["i"]) != 0) | (np.diff(block["j"]) != 0)) + 1
            bounds = [0, *cut.tolist()]
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                yield edges({k: x[start:stop] for k, x in block.items()})
            held = {k: x[bounds[-1] :] for k, x in block.items()}
        if held is not None:
            yield edges(held)

    return cells.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs`` (doc_id, text).

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of distinct
    word shingles, A-Z lower-cased; a text of fewer words is one shingle. ``component_id`` is the
    smallest doc_id reached through links and ``kept`` says that it is the document's own. Null and
    empty texts have an empty set and stay alone. Rows that repeat a doc_id are one document with the
    links of all their texts. A row without doc_id is a document of its own, after all others: in a
    component without any id, the ``component_id`` is null and one row is kept. Other columns, whatever
    their names, are not read.
    """
    if percent < 80:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    docs = docs.select("doc_id", "text")
    rows = staged(signatures(docs, shingle).withColumn("row", F.monotonically_increasing_id()))
    sketch = [f"s{w}" for w in range(WORDS)]
    at = F.min(F.struct(F.coalesce("doc_id", F.lit(NONE)).alias("id"), F.col("text_hash").alias("hash")))
    by_digest = rows.filter("n_shingles > 0").groupBy("digest").agg(at.alias("at"), F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), *(F.any_value(s).alias(s) for s in sketch))
    numbered = by_digest.repartitionByRange("at.id", "digest").sortWithinPartitions("at.id", "digest")
    classes = staged(numbered.withColumn("vertex", F.monotonically_increasing_id()))
    keyed = classes.select("vertex", F.explode("bands").alias("key"))
    # Grouped by key, joined on key and a remainder of it: so the join gets exchanges of its own, which adaptive execution can split.
    tag = F.pmod("key", F.lit(1009)).cast("int").alias("tag")
    hubs = keyed.groupBy("key").agg(F.min("vertex").alias("hub"), F.max("vertex").alias("top")).filter("hub < top").select("key", tag, "hub")
    shared = staged(keyed.select("vertex", "key", tag).join(hubs, ["key", "tag"]))

    pairs = shared.filter("vertex <> hub").select("vertex", "hub").distinct()
    x, h = classes.select("vertex", "n", *sketch).alias("x"), classes.select("vertex", "n", *sketch).alias("h")
    near = (
        pairs.join(x, F.col("x.vertex") == pairs["vertex"])
        .join(h, F.col("h.vertex") == pairs["hub"])
        .filter(_sizes_fit(F.col("x.n"), F.col("h.n"), percent))
        .select(pairs["vertex"], "hub", _likely("x", "h").alias("likely"))
        .filter(F.col("likely") >= SKETCH_LEAST)
    )
    best = staged(near.groupBy("vertex").agg(F.max(F.struct("likely", -F.col("hub"))).alias("best")).select("vertex", (-F.col("best.col2")).alias("partner")))
    is_hub = best.select(F.col("partner").alias("vertex"), F.lit(True).alias("is_hub")).distinct()
    source = classes.select("vertex", "digest", F.col("at.id").alias("at_id"), F.col("at.hash").alias("at_hash"))
    wanted = shared.select("vertex").distinct().join(source, "vertex").join(best, "vertex", "left").join(is_hub, "vertex", "left")
    # The sets of all classes that share a bucket, from one pass over the texts.
    sets = staged(_with_sets(docs, wanted, shingle))
    ends = sets.filter("is_hub").select(F.col("vertex").alias("v"), F.col("set").alias("b"))
    first = _confirm(sets.filter("partner is not null").select(F.col("vertex").alias("u"), F.col("partner").alias("v"), F.col("set").alias("a")).join(ends, "v"), percent)

    # A document whose rows hold several texts ties their classes together.
    several = staged(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("doc_id", "lo"))
    if not several.isEmpty():
        of_class, of_least = classes.select("digest", F.col("vertex").alias("u")), classes.select(F.col("digest").alias("lo"), F.col("vertex").alias("v"))
        same = rows.select("doc_id", "digest").join(several, "doc_id").join(of_class, "digest").join(of_least, "lo")
        first = first.unionByName(same.select("u", "v"))
    edges = staged(first)
    found = components(edges)

    label = found
    marked = shared.join(label, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    marked = staged(marked.select("key", "tag", "vertex", "component"))
    open_keys = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("key", tag, "members")
    details = classes.select("vertex", "n", F.array(*sketch).alias("sketch"))
    rows_of = marked.join(open_keys, ["key", "tag"]).join(details, "vertex").select("key", "members", "vertex", "component", "n", "sketch")
    forest = staged(_in_blocks(rows_of, "key", percent, _forest).distinct())
    if not forest.isEmpty():
        suspects = components(forest).select("vertex", F.col("component").alias("group"))
        sizes = suspects.groupBy("group").agg(F.count("*").alias("members"))
        suspects = staged(suspects.join(sizes, "group").join(label, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")).join(details, "vertex"))
        more = _in_blocks(suspects.join(sets.select("vertex", "set"), "vertex"), "group", percent, _links)
        # Those links join components; what joined before has the component's name now.
        joined = components(more).select(F.col("vertex").alias("component"), F.col("component").alias("larger"))
        names = label.unionByName(joined.select(F.col("component").alias("vertex"), "component").join(label, "vertex", "left_anti"))
        label = staged(names.join(joined, "component", "left").select("vertex", F.coalesce("larger", "component").alias("component")))

    named = classes.select("digest", "vertex").join(label, "vertex", "left").select("digest", F.coalesce("component", "vertex").alias("component"))
    # A component is named by its first class, which has its smallest id, if any of its rows has one.
    firsts = classes.select(F.col("vertex").alias("component"), F.col("doc_id").alias("component_id"))
    of_digest = named.join(firsts, "component").withColumn("kept_row", F.lit(None).cast("long"))
    if not classes.filter("doc_id is null").isEmpty():
        of_digest = staged(of_digest.drop("kept_row"))
        nameless = rows.join(of_digest.filter("component_id is null"), "digest")
        alone = nameless.groupBy("component").agg(F.min(F.struct("text_hash", "row"))["row"].alias("kept_row"))
        of_digest = of_digest.join(alone, "component", "left")
    out = rows.select("doc_id", "n_shingles", "digest", "row").join(staged(of_digest.select("digest", "component_id", "kept_row")), "digest", "left")
    own = F.coalesce("component_id", "doc_id")
    kept = F.when(own.isNull(), F.col("digest").isNull() | (F.col("row") == F.col("kept_row"))).otherwise(F.col("doc_id").eqNullSafe(own))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), kept.alias("kept"))
