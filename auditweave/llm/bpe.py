"""Byte-level BPE encoding and decoding of whole documents through a table of distinct words.

Documents are dealt out in blocks by a hash. Every block lists its distinct words (the pieces that the
tokenizer's own pattern cuts) in packed lists, one for each bucket of the words' hashes. A bucket gathers
the lists of all blocks, keeps a table of its distinct words and encodes each of them once. The ids
return to the blocks in lists of the same order, and in a block to each word's position. Texts are
shuffled once; a frequent word counts once a block, however hot it is.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auditweave.llm.common import chunks, code_points, equal_spans, span_keys, staged, text_buffer, text_column

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes of text that a task splits at a time.
PART_BYTES = 1 << 17
#: Buckets of the table of distinct words: one a block up to this number.
MOST_BUCKETS = 1 << 14
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Splitter:
    """Cuts texts as the byte-level pre-tokenizer does, on flat arrays.

    The class of a code point (letter, number, white space, other) is asked of the tokenizer itself
    when the code point is first seen.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def _ask(self, char: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(cut(before + char)) == 1:
                return kind
        return SPACE

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        out = self.kinds[points]
        if (out == UNKNOWN).any():
            for point in np.unique(points[out == UNKNOWN]).tolist():
                self.kinds[point] = self._ask(chr(point))
            out = self.kinds[points]
        return out

    def segments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places where a text or a special token begins or ends, and the starts of special tokens."""
        data, cuts, specials = raw.tobytes(), [offsets], []
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(token) - 1, "right"):
                    specials.append(at)
                    cuts.append(np.array([at, at + len(token)]))
                    at = data.find(token, at + len(token))
                else:
                    at = data.find(token, at + 1)
        return np.unique(np.concatenate(cuts)), np.array(sorted(specials), np.int64)

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every piece, and the number of pieces of each text."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        bounds, specials = self.segments(raw, offsets)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        points = code_points(raw, at)
        n = len(points)
        kind = self.kinds_of(points)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(at, bounds)] = True
        edge[n] = True
        run = edge.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        start = run.copy()
        # White space before a word in the same segment: its last character stands alone, or is part of the word if it is a blank.
        follow = np.flatnonzero(run[1:n] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
        start[follow - 1] = True
        start[follow[points[follow - 1] == 0x20]] = False
        # An apostrophe that begins a piece takes a short ending from the letters behind it.
        mark = np.flatnonzero(start[:n] & (points == 0x27))
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
        one = points[mark + 1]
        has_two = mark + 2 < n
        two = np.where(has_two, points[np.minimum(mark + 2, n - 1)], 0) * ~edge[np.minimum(mark + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 2] = False
        start[mark[long] + 3] = True
        if len(specials):
            inner = np.zeros(n + 1, np.int64)
            ends = bounds[np.searchsorted(bounds, specials, "right")]
            first, last = np.searchsorted(at, specials), np.searchsorted(at, ends)
            inner[first + 1] += 1
            inner[last] -= 1
            start &= np.cumsum(inner) <= 0
        places = np.append(at, len(raw))[np.flatnonzero(start)]
        starts, ends = places[:-1], places[1:]
        return starts, ends, np.diff(np.searchsorted(starts, offsets))


def splitting_part(definition: str) -> str:
    """A tokenizer's definition without its vocabulary, which splitting does not need."""
    spec = json.loads(definition)
    return json.dumps(spec | {"model": {**spec["model"], "vocab": {}, "merges": []}})


@lru_cache(maxsize=2)
def splitter_of(definition: str) -> Splitter:
    """One splitter a worker process, with all the kinds it has learned."""
    return Splitter(definition)


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``pool`` one after another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return pool[shift + np.arange(total)]


def _piece_bytes(definition: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes and the offsets by id.

    A byte-level vocabulary writes bytes as printable characters: printable Latin-1 ones stand for
    themselves, the others follow from code point 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    spec = json.loads(definition)
    table = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    pieces = [table.get(i, b"") for i in range(max(table) + 1)]
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=offsets[1:])
    return np.frombuffer(b"".join(pieces), np.uint8), offsets


class _Press:
    """Arrays and bytes as Zstandard frames."""

    def __init__(self):
        import zstandard

        self._out, self._in = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, data: bytes | np.ndarray) -> bytes:
        return self._out.compress(data if isinstance(data, bytes) else data.tobytes())

    def unpack(self, frame: bytes) -> bytes:
        return self._in.decompress(frame)


def _packed_blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """(block, ids, texts): documents by block, those of a batch packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _Press()
        for batch in chunks(batches, BLOCK_BYTES):
            block = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            used, first = np.unique(block[order], return_index=True)
            sorted_rows = batch.take(pa.array(order))
            out = []
            for start, stop in zip(first, np.append(first[1:], len(block)), strict=True):
                part = sorted_rows.slice(start, stop - start)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                out.append(press.pack(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out, pa.binary())], names=["block", "packed"])

    return rows.mapInArrow(run, "block int, packed binary").repartition(n_blocks, "block")


class _Block:
    """The documents of a block, its distinct pieces, and where each piece of a text stands among them."""

    def __init__(self, packed: pa.ChunkedArray, definition: str, n_buckets: int, words: bool):
        splitter, press = splitter_of(definition), _Press()
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        flat, sizes, inverses = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], []
        for frame in packed:
            for batch in chunks(iter(pa.ipc.open_stream(press.unpack(frame.as_py()))), PART_BYTES):
                raw, offsets = text_buffer(text_column(batch))
                starts, ends, counts = splitter.pieces(raw, offsets)
                _, first, inverse = span_keys(raw, starts, ends)
                sizes.append((ends - starts)[first])
                flat.append(gather(raw, starts[first], sizes[-1]))
                if not words:
                    self.parts.append((batch.column(batch.schema.get_field_index("doc_id")), counts, inverse.astype(np.int32)))
                inverses.append(len(first))
        size, pool = np.concatenate(sizes), np.concatenate(flat)
        stops = np.cumsum(size)
        keys, first, place = span_keys(pool, stops - size, stops)
        buckets = ((keys >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        self.buckets = buckets[order]
        if words:
            self.sizes = size[first[order]]
            self.flat = gather(pool, (stops - size)[first[order]], self.sizes)
        else:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            cuts = np.append(0, np.cumsum(inverses))
            self.places = [rank[place[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _block_words(blocks: DataFrame, definition: str, n_buckets: int) -> DataFrame:
    """(block, bucket, lengths, words): a block's distinct pieces by bucket of their hash, as packed lists."""

    def run(key: tuple, packed: pa.Table) -> pa.Table:
        block, press = _Block(packed.column("packed"), definition, n_buckets, words=True), _Press()
        used, first = np.unique(block.buckets, return_index=True)
        last = np.append(first[1:], len(block.buckets))
        ends = np.append(0, np.cumsum(block.sizes))
        sizes = block.sizes.astype("<u4")
        pa.default_memory_pool().release_unused()
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
                "bucket": pa.array(used.astype(np.int32)),
                "lengths": pa.array([press.pack(sizes[a:b]) for a, b in zip(first, last, strict=True)], pa.binary()),
                "words": pa.array([press.pack(block.flat[ends[a] : ends[b]]) for a, b in zip(first, last, strict=True)], pa.binary()),
            }
        )

    return blocks.groupBy("block").applyInArrow(run, "block int, bucket int, lengths binary, words binary")


class _Pool:
    """An array that grows at its end; its storage doubles, so that all growing together takes linear time."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1024, kind), 0

    def append(self, more: np.ndarray) -> int:
        """The place where ``more`` begins."""
        begin, self.size = self.size, self.size + len(more)
        if self.size > len(self.data):
            grown = np.zeros(max(self.size, 2 * len(self.data)), self.data.dtype)
            grown[:begin] = self.data[:begin]
            self.data = grown
        self.data[begin : self.size] = more
        return begin

    @property
    def values(self) -> np.ndarray:
        return self.data[: self.size]


class _WordTable:
    """The distinct words of a bucket with their ids; each is encoded when it first comes.

    A word is found by its hash and then compared byte by byte; one that meets another word's hash is
    encoded for itself.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.length, self.pool = _Pool(np.int64), _Pool(np.int64), _Pool(np.uint32)
        self.at, self.size, self.bytes = _Pool(np.int64), _Pool(np.int64), _Pool(np.uint8)

    def ids(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        ends = np.cumsum(sizes)
        keys, first, inverse = span_keys(flat, ends - sizes, ends)
        size, start = sizes[first], (ends - sizes)[first]
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        taken = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        slot, hit = np.full(len(keys), -1), np.flatnonzero(taken)
        if len(hit):
            found = self.slots[at[hit]]
            same = equal_spans(flat, start[hit], size[hit], self.bytes.values, self.at.values[found], self.size.values[found])
            slot[hit[same]] = found[same]
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            slot[fresh] = self.length.size + np.arange(len(fresh))
            self._encode(flat, start[fresh], size[fresh])
            new = fresh[~taken[fresh]]
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.slots = merged[order], np.concatenate([self.slots, slot[new]])[order]
        slot = slot[inverse]
        length = self.length.values[slot]
        return length, gather(self.pool.values, self.begin.values[slot], length)

    def _encode(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        data = flat.tobytes()
        for k in range(0, len(start), 1024):  # as arrays at once, so that no large number of small objects lives
            words = [data[a : a + n].decode() for a, n in zip(start[k : k + 1024].tolist(), size[k : k + 1024].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            length = np.fromiter(map(len, found), np.int64, len(found))
            begin = self.pool.append(np.fromiter((x for own in found for x in own), np.uint32, int(length.sum())))
            self.begin.append(begin + np.cumsum(length) - length)
            self.length.append(length)
        begin = self.bytes.append(gather(flat, start, size))
        self.at.append(begin + np.cumsum(size) - size)
        self.size.append(size)


def _encoded_words(words: DataFrame, definition: str, n_buckets: int) -> DataFrame:
    """(block, bucket, counts, ids): the ids of each packed list. A bucket's table of distinct words lives in one task, and each word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, press = Tokenizer.from_str(definition), _Press()
        tokenizer.no_truncation()
        tokenizer.no_padding()
        bucket, table = None, _WordTable(tokenizer)
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                buckets = batch.column(1).to_numpy(zero_copy_only=False)
                counts, ids = [b""] * len(buckets), [b""] * len(buckets)
                cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a and buckets[a] != bucket:
                        bucket, table = buckets[a], _WordTable(tokenizer)
                    sizes = [np.frombuffer(press.unpack(batch.column(2)[i].as_py()), "<u4").astype(np.int64) for i in range(a, b)]
                    flat = [np.frombuffer(press.unpack(batch.column(3)[i].as_py()), np.uint8) for i in range(a, b)]
                    if not sizes:
                        continue
                    length, found = table.ids(np.concatenate(flat), np.concatenate(sizes))
                    words_end = np.append(0, np.cumsum([len(x) for x in sizes]))
                    ids_end = np.append(0, np.cumsum(length))[words_end]
                    for k in range(b - a):
                        counts[a + k] = press.pack(length[words_end[k] : words_end[k + 1]].astype("<u4"))
                        ids[a + k] = press.pack(found[ids_end[k] : ids_end[k + 1]].astype("<u4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["block", "bucket", "counts", "ids"])

    dealt = words.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block int, bucket int, counts binary, ids binary")


def encode(docs: DataFrame, tokenizer: str | None = None, digests: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, a row per row of ``docs`` (doc_id, text).

    With ``digests`` each block is decoded where it was encoded, by looking its ids up in the id-to-piece
    table instead of ``decode``'s join, which would shuffle a row for every token; the result is (doc_id, n_tokens, ids_sha256, decoded_sha256); no id leaves the task.

    ``tokenizer`` is the path of a byte-level BPE definition on the driver. Ids equal those of the
    tokenizer without special tokens added; special tokens written in a text are recognised. A
    null or empty text has no ids. Repeated rows and null ids are encoded like any others, an empty
    table gives no rows, further columns are not read.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = file.read()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_buckets = min(n_blocks, MOST_BUCKETS)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    blocks = _packed_blocks(rows.select(block.alias("block"), "doc_id", "text"), n_blocks)
    splitting = splitting_part(definition)
    back = _encoded_words(_block_words(blocks, splitting, n_buckets), definition, n_buckets)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        block, press = _Block(left.column("packed"), splitting, n_buckets, words=False), _Press()
        order = np.argsort(right.column("bucket").to_numpy())
        counts, pool = (np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(press.unpack(right.column(c)[int(i)].as_py()), "<u4") for i in order)]) for c in ("counts", "ids"))
        length = counts.astype(np.int64)
        begin = np.cumsum(length) - length
        out = []
        for (ids, counts, inverse), places in zip(block.parts, block.places, strict=True):
            at = places[inverse] if len(places) else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum(length[at]))[np.append(0, np.cumsum(counts))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(gather(pool, begin[at], length[at]).astype(np.int32)))
            out.append(pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "ids"]))
        del block, pool
        pa.default_memory_pool().release_unused()
        made = pa.Table.from_batches([b.cast(result) for b in out], schema=result)
        return pa.Table.from_batches(list(digested(iter(made.to_batches())))) if digests and out else made

    kind = dict(rows.dtypes)["doc_id"]
    result = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("ids", pa.list_(pa.int32()))])
    digested = _decoder(definition) if digests else None
    shape = f"doc_id {kind}, {DIGESTS}" if digests else f"doc_id {kind}, ids array<int>"
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(place, shape)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _decoder(definition: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (doc_id, ids) that digests the ids and the text of their pieces, looked up where the ids were made."""
    pool, offsets = _piece_bytes(definition)
    added = [f.split()[0] for f in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found: list[list] = [[] for _ in added]
                for ids in batch.column(batch.schema.get_field_index("ids")):
                    own = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int64)
                    text = gather(pool, offsets[own], offsets[own + 1] - offsets[own]).tobytes().decode("utf-8", "replace")
                    made = (len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    for column, x in zip(found, made, strict=True):
                        column.append(x)
                columns = [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(c, pa.int64() if n == "n_tokens" else pa.string()) for n, c in zip(added, found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *added])

    return run


def pieces(spark: SparkSession, tokenizer: str | None = None) -> DataFrame:
    """(id, piece): the bytes of every id of the vocabulary."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        pool, offsets = _piece_bytes(file.read())
    data = pool.tobytes()
    listed = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(listed), dtype=np.int32)), "piece": pa.array(listed, pa.binary())}))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``encoded`` with the column ``decoded``: the pieces of ``ids``, joined by id and put together by position.

    The id-to-piece table has a row an id of the vocabulary and goes to every task. Null and empty ids give
    an empty text, bytes that are no UTF-8 become replacement characters. Rows that are the same stay apart.
    """
    names = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_kept"), F.col("ids"))
    # Only the row number travels with a token; the row's columns come back by it.
    rows = staged(rows)
    tokens = rows.select("_row", F.posexplode("ids").alias("_at", "id")).join(F.broadcast(pieces(encoded.sparkSession, tokenizer)), "id")
    joined = tokens.groupBy("_row").agg(F.expr("listagg(piece) within group (order by _at)").alias("_bytes"))
    text = F.coalesce(F.make_valid_utf8(F.col("_bytes").cast("string")), F.lit(""))
    return rows.select("_row", "_kept").join(joined, "_row", "left").select("_kept.*", text.alias("decoded"))
