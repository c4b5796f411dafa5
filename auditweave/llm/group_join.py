"""Documents whose shingle sets are similar, by a grouped prefix join.

1. Equal sets form classes. A class is a vertex, numbered in order of its smallest doc_id.
2. All shingles have one order: by hash, and behind all others those that stand early in the sets of many
   classes, by that number. Two sets that link share a shingle of their prefixes, the first
   ``n - ceil(t n) + 1`` of each. The frequent shingles of common passages thus reach a prefix only where a
   set has too few others.
3. Classes with equal prefixes and sizes collapse into one group. Groups meet in the buckets of their
   prefix shingles; sizes and places in the prefixes tell which pairs of groups can link.
4. Each group is first compared with the likeliest smallest group of its buckets and each member with its
   group's first one, on full sets. What links joins components.
5. Buckets that still hold several components are expanded to members. Pairs of different components pass the
   filters of sizes and places and a bound on the difference of two sets (parity bitmaps: differing bits are
   never more than differing shingles), and connect suspects; each suspect group is checked on full sets.

No filter can lose a link, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm import blocks
from auditweave.llm.blocks import Rows, in_blocks, joined, pairs_in_blocks
from auditweave.llm.common import chunks, mixed, staged
from auditweave.llm.components import components
from auditweave.llm.near_dedup import NONE, _confirm, _digest, _sets, _sizes_fit

#: A shingle that is in the heads of so many classes goes behind all rarer ones.
FREQUENT = 64
#: Frequent shingles, or classes whose texts are wanted, up to this number (some 16 MB) go to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: 64-bit words of a set's bitmap, and of that of a set of more than LONG_SET shingles.
WORDS, LONG_WORDS, LONG_SET = 8, 32, 1000
#: Texts whose bitmaps are made together.
BITMAP_ROWS = 1 << 10
TOP = np.uint64(1 << 63)

SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest binary, head array<long>, sketch array<long>"


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - (percent * sizes + 99) // 100 + 1


def head_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Shingles kept of each set in hash order: its prefix, and more to take the places of frequent ones."""
    prefix = prefix_sizes(sizes, percent)
    return np.minimum(sizes, prefix + prefix // 2 + 8)


def parity_bitmaps(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each shingle flips the bit that it hashes to; a row of ``LONG_WORDS`` words a set."""
    n, size = len(offsets) - 1, 64 * LONG_WORDS
    out = np.zeros((n, LONG_WORDS), np.uint64)
    bits = (mixed(hashes) % np.uint64(size)).astype(np.int64)
    for first in range(0, n, BITMAP_ROWS):
        last = min(n, first + BITMAP_ROWS)
        owner = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
        times = np.bincount(owner * size + bits[offsets[first] : offsets[last]], minlength=(last - first) * size)
        out[first:last] = np.packbits((times & 1).astype(np.uint8).reshape(-1, size), axis=1, bitorder="little").view(np.uint64)
    return out


def folded(bitmaps: np.ndarray) -> np.ndarray:
    """Long bitmaps as those of ``WORDS`` words: a bit's place is taken modulo the smaller size."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), LONG_WORDS // WORDS, WORDS), axis=1)


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Size, digest, head and bitmap of every text's set; shingles are signed numbers in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, offsets = _sets(batch, shingle)
            sizes = np.diff(offsets)
            kept = head_sizes(sizes, percent) * (sizes > 0)
            ends = np.append(0, np.cumsum(kept))
            at = np.repeat(offsets[:-1] - ends[:-1], kept) + np.arange(ends[-1])
            heads = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((hashes[at] ^ TOP).view(np.int64)))
            bitmaps = parity_bitmaps(hashes, offsets)
            width = np.where(sizes > LONG_SET, LONG_WORDS, WORDS)
            flat = np.where(np.arange(LONG_WORDS) < width[:, None], np.where(sizes[:, None] > LONG_SET, bitmaps, np.tile(folded(bitmaps), LONG_WORDS // WORDS)), 0)
            flat = flat[np.arange(LONG_WORDS) < width[:, None]]
            sketches = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(flat.view(np.int64)))
            digest = [_digest(hashes[a:b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            doc_id, text_hash = (batch.column(batch.schema.get_field_index(name)) for name in ("doc_id", "text_hash"))
            columns = [doc_id, text_hash, pa.array(sizes.astype(np.int64)), pa.array(digest, pa.binary()), heads, sketches]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "digest", "head", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SIGNATURE)


def _tag(column: str) -> Column:
    """A remainder of a key: joined on both, a join gets exchanges of its own, which adaptive execution can split."""
    return F.pmod(column, F.lit(1009)).cast("int").alias("tag")


def _prefix_size(percent: int) -> Column:
    return F.expr(f"int(n - ({percent} * n + 99) div 100 + 1)")


def _whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """(vertex, partner, is_hub, set): whole sets of the classes in ``wanted``, from one pass over the texts.

    ``wanted`` has the first three, the ``digest`` and a row of each class by ``at_id`` and ``at_hash``; a row
    whose set has another digest only shares that hash. ``repeated``: some rows of ``docs`` are the same.
    """
    wanted = staged(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, offsets = _sets(batch, shingle)
            sets = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int64).tobytes()), pa.py_buffer(hashes.tobytes())])
            digest, *passed = (batch.column(batch.schema.get_field_index(name)) for name in ("digest", "vertex", "partner", "is_hub"))
            same = [_digest(hashes[a:b]) == d.as_py() for a, b, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), digest, strict=True)]
            yield pa.RecordBatch.from_arrays([*passed, sets.cast(pa.binary())], names=["vertex", "partner", "is_hub", "set"]).filter(pa.array(same, pa.bool_()))

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("at_id"), F.xxhash64("text").alias("at_hash"), "text")
    sets = texts.join(F.broadcast(wanted) if few else wanted, ["at_id", "at_hash"]).mapInArrow(run, "vertex long, partner long, is_hub boolean, set binary")
    return sets.dropDuplicates(["vertex"]) if repeated else sets


def _exploded_sets(sets: DataFrame) -> DataFrame:
    """(vertex, token): the shingles of whole sets, as numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vertex, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = (np.frombuffer(packed.as_buffer(), np.uint64) ^ TOP).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), vertex)), pa.array(tokens)], names=["vertex", "token"])

    return sets.select("vertex", "set").mapInArrow(run, "vertex long, token long")


def prefixes(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, repeated: bool) -> DataFrame:
    """(vertex, n, prefix): the first shingles of each class in the common order.

    Where the head holds enough shingles that are not frequent, they are the prefix. Other classes have
    all their shingles looked up and sorted.
    """
    heads = classes.select("vertex", F.explode("head").alias("token"))
    frequent = staged(heads.groupBy("token").agg(F.count("*").cast("int").alias("times")).filter(F.col("times") >= FREQUENT))
    few = frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def looked_up(tokens: DataFrame, how: str) -> DataFrame:
        if few:
            return tokens.join(F.broadcast(frequent), "token", how)
        return tokens.withColumn("tag", _tag("token")).join(frequent.withColumn("tag", _tag("token")), ["token", "tag"], how).drop("tag")

    hot = looked_up(heads, "inner").groupBy("vertex").agg(F.collect_list("token").alias("hot"))
    size = _prefix_size(percent)
    cold = F.when(F.col("hot").isNull(), F.col("head")).otherwise(F.array_except("head", "hot"))
    placed = classes.join(hot, "vertex", "left").withColumn("cold", cold).withColumn("size", size)
    early = F.when(F.size("cold") >= F.col("size"), F.slice("cold", F.lit(1), F.col("size")))
    placed = staged(placed.select("vertex", "n", "digest", "at", "size", early.alias("prefix")))
    ready = placed.filter("prefix is not null").select("vertex", "n", "prefix")
    late = placed.filter("prefix is null")
    if late.isEmpty():
        return ready
    wanted = late.select("vertex", "digest", F.col("at.id").alias("at_id"), F.col("at.hash").alias("at_hash"), F.lit(None).cast("long").alias("partner"), F.lit(None).cast("boolean").alias("is_hub"))
    tokens = looked_up(_exploded_sets(_whole_sets(docs, wanted, shingle, repeated)), "left").join(late.select("vertex", "n", "size"), "vertex")
    ranked = F.expr("row_number() over (partition by vertex order by coalesce(times, 0), token)")
    first = tokens.withColumn("place", ranked).filter("place <= size")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])
    return ready.unionByName(first.groupBy("vertex").agg(F.any_value("n").alias("n"), listed.alias("prefix")))


def grouped(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with equal prefix and size as groups: (vertex, group), and (group, n, prefix, members).

    A group is named by its smallest vertex. Two 64-bit hashes of the prefix, one of it reversed, stand for it.
    """
    keys = ["n", "one", "other"]
    rows = found.select("vertex", "n", F.xxhash64("prefix").alias("one"), F.xxhash64(F.reverse("prefix"), F.lit("reversed")).alias("other"))
    named = rows.groupBy(*keys).agg(F.min("vertex").alias("group"), F.count("*").alias("members"))
    several = named.filter("members > 1")
    joined = staged(rows.withColumn("tag", _tag("one")).join(several.withColumn("tag", _tag("one")), [*keys, "tag"], "left"))
    of = joined.select("vertex", F.coalesce("group", "vertex").alias("group"), F.coalesce("members", F.lit(1)).alias("members"))
    return of.select("vertex", "group"), found.join(of.filter("vertex = group"), "vertex").select("group", "n", "prefix", "members")


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Shingles that two sets of these sizes share at least if they link."""
    return F.ceil(percent * (a + b) / (100.0 + percent) - 1e-6)


def _places_fit(a: str, b: str, percent: int) -> Column:
    """Whether two sets can link whose first common shingle stands at these places (from 0)."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    return _sizes_fit(F.col(f"{a}.n"), F.col(f"{b}.n"), percent) & (left >= _least_overlap(F.col(f"{a}.n"), F.col(f"{b}.n"), percent))


def _bitmaps(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short bitmaps of all rows, long ones of those that have them, and which have."""
    long = np.fromiter(map(len, lists), np.int64, len(lists)) == LONG_WORDS
    short, wide = np.zeros((len(lists), WORDS), np.uint64), np.zeros((len(lists), LONG_WORDS), np.uint64)
    if long.any():
        wide[long] = np.concatenate(lists[long]).view(np.uint64).reshape(-1, LONG_WORDS)
        short[long] = folded(wide[long])
    if not long.all():
        short[~long] = np.concatenate(lists[~long]).view(np.uint64).reshape(-1, WORDS)
    return short, wide, long


def _least_common(both: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that two sets with this sum of sizes share at least if they link."""
    return (percent * both + 99 + percent) // (100 + percent)


def _suspects(rows: Rows, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a block that may link, with the number of differing bits."""
    n, component = rows["n"], rows["component"]
    short, wide, long = _bitmaps(rows["sketch"])
    out = [(np.zeros(0, np.int64),) * 3]
    for u, v in pairs_in_blocks(rows):
        keep = (component[u] != component[v]) & (100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v]))
        if "place" in rows:
            # Members of one group meet at their first shingle; two rows of the cell above meet in their own.
            keep &= ((rows["group"][u] != rows["group"][v]) | (rows["place"][u] == 0)) & (rows["own"][u] | rows["own"][v])
            keep &= np.minimum(n[u] - rows["place"][u], n[v] - rows["place"][v]) >= _least_common(n[u] + n[v], percent)
        u, v = u[keep], v[keep]
        bits, most = np.bitwise_count(short[u] ^ short[v]).sum(axis=1).astype(np.int64), n[u] + n[v] - 2 * _least_common(n[u] + n[v], percent)
        both = np.flatnonzero(long[u] & long[v] & (bits <= most))
        bits[both] = np.bitwise_count(wide[u[both]] ^ wide[v[both]]).sum(axis=1)
        keep = bits <= most
        out.append((u[keep], v[keep], bits[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(rows: Rows, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups that suspect pairs connect, each as edges to its smallest vertex."""
    u, v, _ = _suspects(rows, percent)
    ids, place = np.unique(rows["vertex"], return_inverse=True)
    label = joined(place[u], place[v], len(ids))
    at = np.flatnonzero(label != np.arange(len(ids)))
    return ids[at], ids[label[at]]


def _links(rows: Rows, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components that links on full sets join, the likeliest pairs first; pairs that links found before connect already are left out."""
    u, v, bits = _suspects(rows, percent)
    names, label = np.unique(rows["component"], return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    order = np.argsort(bits / (rows["n"][u] + rows["n"][v]), kind="stable")
    for a, b in zip(u[order].tolist(), v[order].tolist(), strict=True):
        x, y = root(label[a]), root(label[b])
        if x != y:
            one, other = (np.frombuffer(rows["set"][k], np.uint64) for k in (a, b))
            both = len(np.intersect1d(one, other, assume_unique=True))
            if 100 * both >= percent * (len(one) + len(other) - both):
                links.append((a, b))
                parent[max(x, y)] = min(x, y)
    at = np.array(links, np.int64).reshape(-1, 2)
    return rows["component"][at[:, 0]], rows["component"][at[:, 1]]


def _folded(long: Column) -> Column:
    """``folded`` of one long bitmap."""
    parts = [F.slice(long, i + 1, WORDS) for i in range(0, LONG_WORDS, WORDS)]
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda p, q: p.bitwiseXOR(q))
    return out


def _best_hubs(groups: DataFrame, shared: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(vertex, partner): each group and, of the smallest groups of its buckets that sizes, places and bitmaps allow, the one with the fewest differing bits."""
    x, h = shared.alias("x"), shared.filter("group = hub").select("token", "tag", "n", "place").alias("h")
    pairs = x.filter("group <> hub").join(h, ["token", "tag"]).filter(_places_fit("x", "h", percent)).select(F.col("x.group").alias("vertex"), "hub").distinct()
    a, b = bitmaps.alias("a"), bitmaps.alias("b")
    near = pairs.join(a, F.col("a.vertex") == pairs["vertex"]).join(b, F.col("b.vertex") == pairs["hub"])
    short = [F.when(F.size(f"{x}.sketch") == WORDS, F.col(f"{x}.sketch")).otherwise(_folded(F.col(f"{x}.sketch"))) for x in "ab"]
    bits = F.aggregate(F.zip_with(*short, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)
    both = F.col("a.n") + F.col("b.n")
    near = near.select(pairs["vertex"], "hub", bits.alias("bits"), (both - 2 * _least_overlap(F.col("a.n"), F.col("b.n"), percent)).alias("most")).filter("bits <= most")
    return near.groupBy("vertex").agg(F.min(F.struct("bits", "hub"))["hub"].alias("partner"))


def similar_documents(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs`` (doc_id, text).

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of distinct
    word shingles, A-Z lower-cased; a text of fewer words is one shingle. ``component_id`` is the smallest
    doc_id reached through links, itself included. Null and empty texts have an empty set and stay alone.
    Rows that repeat a doc_id are one document with the links of all their texts. Rows without doc_id link
    like others; in a component without any id, ``component_id`` is null. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = staged(signatures(docs, shingle, percent))
    at = F.min(F.struct(F.coalesce("doc_id", F.lit(NONE)).alias("id"), F.col("text_hash").alias("hash")))
    by_digest = rows.filter("n_shingles > 0").groupBy("digest").agg(at.alias("at"), F.min("doc_id").alias("doc_id"), *(F.any_value(c).alias(a) for c, a in (("n_shingles", "n"), ("head", "head"), ("sketch", "sketch"))))
    numbered = by_digest.repartitionByRange("at.id", "digest").sortWithinPartitions("at.id", "digest")
    classes = staged(numbered.withColumn("vertex", F.monotonically_increasing_id()))
    bitmaps = classes.select("vertex", "n", "sketch")
    repeated = not rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    member, groups = grouped(staged(prefixes(docs, classes, shingle, percent, repeated)))
    groups = staged(groups)

    # Buckets: prefix shingles that two members have at least, whether of one group or of several.
    entries = groups.select("group", "members", F.explode("prefix").alias("token"))
    crowded = entries.groupBy("token").agg(F.min("group").alias("hub"), F.sum("members").alias("size")).filter("size > 1").select("token", _tag("token"), "hub")
    meeting = entries.select("group", "token", _tag("token")).join(crowded, ["token", "tag"])
    place = (F.array_position("prefix", F.col("token")) - 1).alias("place")
    shared = staged(meeting.join(groups.select("group", "n", "prefix"), "group").select("token", "tag", "group", "hub", "n", place))

    best = _best_hubs(groups, shared, bitmaps, percent).unionByName(member.filter("vertex <> group").select("vertex", F.col("group").alias("partner")))
    best = staged(best)
    source = classes.select("vertex", "digest", F.col("at.id").alias("at_id"), F.col("at.hash").alias("at_hash"))
    is_hub = best.select(F.col("partner").alias("vertex"), F.lit(True).alias("is_hub")).distinct()
    sets = staged(_whole_sets(docs, best.join(is_hub, "vertex", "full").join(source, "vertex"), shingle, repeated))
    ends = sets.filter("is_hub").select(F.col("vertex").alias("v"), F.col("set").alias("b"))
    first = _confirm(sets.filter("partner is not null").select(F.col("vertex").alias("u"), F.col("partner").alias("v"), F.col("set").alias("a")).join(ends, "v"), percent)
    # A document whose rows hold several texts ties their classes together.
    several = staged(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("doc_id", "lo"))
    if not several.isEmpty():
        of_class, of_least = classes.select("digest", F.col("vertex").alias("u")), classes.select(F.col("digest").alias("lo"), F.col("vertex").alias("v"))
        first = first.unionByName(rows.select("doc_id", "digest").join(several, "doc_id").join(of_class, "digest").join(of_least, "lo").select("u", "v"))
    label = components(staged(first))

    # Buckets with several components. Crowded ones become cells of similar sizes: a row is in the cell of its size and in the one below.
    labelled = member.join(label, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    spread = labelled.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    ranges = shared.join(spread, "group").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("members").alias("size")).filter("lo < hi")
    open_rows = shared.join(ranges.select("token", _tag("token"), "size"), ["token", "tag"]).join(labelled, "group")
    cell = F.floor(F.log("n") / float(np.log(100.0 / percent * 1.001)))
    cells = open_rows.withColumn("in", F.explode(F.when(F.col("size") > blocks.BLOCK, F.array(cell, cell - 1)).otherwise(F.array(F.lit(-2).cast("long")))))
    cells = cells.select(F.xxhash64("token", "in").alias("key"), ((F.col("in") == -2) | (F.col("in") == cell)).alias("own"), "vertex", "group", "component", "n", "place")
    cells = staged(cells.withColumn("tag", _tag("key")))
    open_keys = cells.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("own").alias("any"), F.count("*").alias("members")).filter("lo < hi and any").select("key", _tag("key"), "members")
    facts = cells.join(open_keys, ["key", "tag"]).join(classes.select("vertex", "sketch"), "vertex").select("key", "members", "vertex", "component", "n", "sketch", "group", "place", "own")
    forest = staged(in_blocks(facts, "key", lambda block: _forest(block, percent)).distinct())
    if not forest.isEmpty():
        suspects = components(forest).select("vertex", F.col("component").alias("key"))
        sizes = suspects.groupBy("key").agg(F.count("*").alias("members"))
        suspects = suspects.join(sizes, "key").join(label, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")).join(bitmaps, "vertex")
        nobody = {"partner": F.lit(None).cast("long"), "is_hub": F.lit(None).cast("boolean")}
        sets = _whole_sets(docs, suspects.select("vertex").join(source, "vertex").withColumns(nobody), shingle, repeated)
        more = in_blocks(suspects.join(sets.select("vertex", "set"), "vertex"), "key", lambda block: _links(block, percent))
        # Those links join components; what joined before has the component's name now.
        merged = components(more).select(F.col("vertex").alias("component"), F.col("component").alias("larger"))
        names = label.unionByName(merged.select(F.col("component").alias("vertex"), "component").join(label, "vertex", "left_anti"))
        label = staged(names.join(merged, "component", "left").select("vertex", F.coalesce("larger", "component").alias("component")))

    # A component is named by its first class, which has its smallest id, if any of its rows has one.
    firsts = classes.select(F.col("vertex").alias("component"), F.col("doc_id").alias("component_id"))
    named = classes.select("digest", "vertex").join(label, "vertex", "left").select("digest", F.coalesce("component", "vertex").alias("component")).join(firsts, "component")
    out = rows.select("doc_id", "n_shingles", "digest").join(staged(named.select("digest", "component_id")), "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def components_sql(shingle: int, percent: int, kept: bool) -> str:
    """DuckDB SQL for the components of all documents, by counting the shingles that sets share."""
    return rf"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
    select doc_id, case when w is null or len(w) = 0 then [] when len(w) < {shingle} then [array_to_string(w, ' ')]
        else list_sort(list_distinct([array_to_string(w[i : i + {shingle - 1}], ' ') for i in range(1, len(w) - {shingle} + 2)])) end as s
    from words
), classes as (
    select min(doc_id) as c, s, len(s) as n from sets where len(s) > 0 group by s
), tokens as (
    select c, n, unnest(s) as t from classes
), pairs as (
    select a.c as x, b.c as y, any_value(a.n) + any_value(b.n) - count(*) as total, count(*) as shared
    from tokens a join tokens b on a.t = b.t and a.c < b.c and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    group by a.c, b.c
), links as (
    select x, y from pairs where 100 * shared >= {percent} * total union all select y, x from pairs where 100 * shared >= {percent} * total
), reached as (
    select c, c as r from classes union select reached.c, links.y from reached join links on links.x = reached.r
), smallest as (
    select c, min(r) as component_id from reached group by c
), named as (
    select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(component_id, sets.doc_id) as component_id
    from sets left join classes on sets.s = classes.s and len(sets.s) > 0 left join smallest on smallest.c = classes.c
)
select *{", doc_id = component_id as kept" if kept else ""} from named
"""
