"""Cross-tokenizer alignment: groups of tokens that two tokenizers end at the same byte, and linked ids by count.

Both token sequences of a text become arrays of end bytes. Along a diagonal (a fixed shift between the two
indexes) stretches of one-to-one tokens are jumped by exponential probing: windows of doubling width are
compared whole, and the last one is halved down to the first difference. There an irregular group is resolved
locally, end by end, which sets the next shift.

Counts need the whole corpus: every block of texts stores its links as numbers of its own distinct pairs, the
pairs with their counts meet in one aggregate, and the totals come back to the blocks by a join on the pair.
So a link costs a few bits and only distinct pairs of a block are shuffled as rows, however frequent they are.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auditweave.llm.bpe import Splitter, _piece_bytes, _Press, _WordTable, default_tokenizer, gather, splitting_part
from auditweave.llm.common import chunks, staged, text_column

#: Characters after which a text is cut at the next safe place, and characters worked on at a time.
PART_CHARS, WORK_CHARS = 1 << 15, 1 << 18
#: Words that a task keeps with their ids before it starts anew.
MOST_WORDS = 1 << 18
#: Bytes of text whose links share one table of pairs.
BLOCK_BYTES = 8 << 20
#: A blank between letters or digits: no token of either kind reaches over its front.
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
MASK = np.int64((1 << 32) - 1)
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def default_piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def diagonal_runs(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Groups of two rising sequences with the same last value, as runs of cuts.

    A run (a, b, n) stands for the cuts (a, b), (a + 1, b + 1), ...: numbers of tokens up to each of ``n``
    common ends. The first group of a run may be irregular, all others are one-to-one.
    """
    first_a, first_b, lengths = [], [], []
    i = j = 0
    while i < len(ends_a):
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        i += 1
        j += 1
        begin, width = i, 1
        first_a.append(i)
        first_b.append(j)
        while (window := ends_a[i : i + width]) and window == ends_b[j : j + width]:
            i += len(window)
            j += len(window)
            width *= 2
        while width > 1:
            width //= 2
            if (window := ends_a[i : i + width]) and window == ends_b[j : j + width]:
                i += len(window)
                j += len(window)
        lengths.append(i - begin + 1)
    return first_a, first_b, lengths


@dataclass
class Groups:
    """Tokens of some parts of texts and the cuts between their groups; counts are by part."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    good: np.ndarray

    @property
    def n_groups(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.cut_a, np.append(0, np.cumsum(self.n_a)), "right"))

    @property
    def links(self) -> np.ndarray:
        """A and B id of the tokens at each common end, as one number."""
        return self.a_ids[self.cut_a - 1].astype(np.int64) << 32 | self.b_ids[self.cut_b - 1].astype(np.int64)


class Aligner:
    """Two tokenizers with the bytes of their tokens."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.splitter = Splitter(json.dumps(json.loads(splitting_part(definition)) | {"added_tokens": []}))
        self.words = _WordTable(self.a)
        self.b = SentencePieceProcessor(model_proto=model)
        self.a_pool, self.a_offsets = _piece_bytes(definition)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.b_pool, self.b_offsets = np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum([len(p) for p in pieces]))
        # With a blank inside a piece, a text can't be cut before encoding.
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        self.size = max(len(self.a_offsets), len(self.b_offsets)) - 1
        numbers = [f"{i}{mark}".encode() for mark in ",|;" for i in range(self.size)]
        self.number_pool, self.number_offsets = np.frombuffer(b"".join(numbers), np.uint8), np.append(0, np.cumsum([len(n) for n in numbers]))

    def parts(self, text: str) -> list[str]:
        """The text in parts that are encoded alone; the blank between two parts is that which both encoders see in front."""
        out, start = [], 0
        while self.cuts and len(text) - start > PART_CHARS and (cut := SAFE.search(text, start + PART_CHARS)):
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]] if text else []

    def _a_tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their number by text; each distinct word is encoded when it first comes."""
        if len(self.words.keys) > MOST_WORDS:
            self.words = _WordTable(self.a)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, counts = self.splitter.pieces(raw, np.append(0, np.cumsum([len(t) for t in texts])))
        lengths, ids = self.words.ids(raw, ends - starts)
        return ids.astype(np.int64), np.diff(np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))])

    def groups(self, parts: list[str]) -> Groups:
        """Tokens and groups of all parts; a part whose token bytes are not blank and text has none and is not good."""
        texts = [" " + p for p in parts]
        want = [t.encode() for t in texts]
        a_ids, n_a = self._a_tokens(want)
        b_ids, n_b = _flat(self.b.encode(parts, num_threads=1))
        good = _same(want, self.a_pool, self.a_offsets, a_ids, n_a) & _same(want, self.b_pool, self.b_offsets, b_ids, n_b)
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        first_a, first_b, lengths = diagonal_runs(*(np.cumsum(np.diff(o)[i]).tolist() for o, i in ((self.a_offsets, a_ids), (self.b_offsets, b_ids))))
        lengths = np.array(lengths, np.int64)
        along = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return Groups(a_ids, b_ids, np.repeat(np.array(first_a, np.int64), lengths) + along, np.repeat(np.array(first_b, np.int64), lengths) + along, n_a, n_b, good)

    def listed(self, found: Groups) -> tuple[bytes, np.ndarray]:
        """All groups as ``a,a|b;`` in decimal, and the bytes before each part and at the end."""
        before_a, before_b = np.append(0, found.cut_a), np.append(0, found.cut_b)
        group_a, group_b = (np.repeat(np.arange(len(c) - 1), np.diff(c)) for c in (before_a, before_b))
        mark_a, mark_b = np.zeros(len(found.a_ids), np.int64), np.zeros(len(found.b_ids), np.int64)
        mark_a[found.cut_a - 1], mark_b[found.cut_b - 1] = self.size, 2 * self.size
        order = np.empty(len(mark_a) + len(mark_b), np.int64)
        order[np.arange(len(mark_a)) + before_b[group_a]] = found.a_ids + mark_a
        order[np.arange(len(mark_b)) + before_a[group_b + 1]] = found.b_ids + mark_b
        lengths = np.diff(self.number_offsets)[order]
        ends = np.append(0, np.cumsum(lengths))
        return gather(self.number_pool, self.number_offsets[order], lengths).tobytes(), ends[np.append(0, np.cumsum(found.n_a + found.n_b))]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for own in lists for i in own), np.int64, int(counts.sum())), counts


def _same(want: list[bytes], pool: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether the joined token bytes of each part are the bytes wanted."""
    lengths = offsets[ids + 1] - offsets[ids]
    made = gather(pool, offsets[ids], lengths).tobytes()
    if made == b"".join(want):
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(counts)]
        if (ends == np.cumsum([len(w) for w in want])).all():
            return np.ones(len(want), bool)
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
    return np.array([made[x:y] == w for x, y, w in zip(ends[:-1].tolist(), ends[1:].tolist(), want, strict=True)], bool)


@lru_cache(maxsize=1)
def aligner_of(definition: str, model: bytes) -> Aligner:
    """One aligner a worker process."""
    return Aligner(definition, model)


def _worked(own: Aligner, texts: list[str]) -> Iterator[tuple[np.ndarray, Groups]]:
    """The texts' parts, some hundred thousand characters at a time: text number of each part, and the groups."""
    parts, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for part in own.parts(text):
            parts.append(part)
            owner.append(i)
            size += len(part)
            if size >= WORK_CHARS:
                yield np.array(owner), own.groups(parts)
                parts, owner, size = [], [], 0
    if parts:
        yield np.array(owner), own.groups(parts)


def _read(byte_tokenizer: str | None, piece_model: str | None) -> tuple[str, bytes]:
    with open(byte_tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = file.read()
    with open(piece_model or default_piece_model(), "rb") as file:
        return definition, file.read()


def align(docs: DataFrame, byte_tokenizer: str | None = None, piece_model: str | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts): tokens of every whole text by both tokenizers, and its groups.

    The k-th group holds the tokens from the (k-1)-th cut to the k-th one. ``byte_tokenizer`` (A) is a
    byte-level BPE definition and encodes a blank and the text; ``piece_model`` (B) is a SentencePiece model,
    which adds the blank. Strings of special tokens are plain text. Texts that are null or empty, or whose
    tokens do not spell blank and text, have no tokens. Repeated rows and null ids are aligned like any
    others, an empty table gives no rows, further columns are not read.
    """
    definition, model = _read(byte_tokenizer, piece_model)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["a_ids", "b_ids", "a_cuts", "b_cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner_of(definition, model)
        for batch in chunks(batches):
            n = batch.num_rows
            lists, good = {name: [[np.zeros(0, np.int64)] for _ in range(n)] for name in names}, np.ones(n, bool)
            for owner, found in _worked(own, text_column(batch).to_pylist()):
                ends_a, ends_b = (np.append(0, np.cumsum(c)) for c in (found.n_a, found.n_b))
                at = np.append(0, np.cumsum(found.n_groups))
                for k, i in enumerate(owner.tolist()):
                    good[i] &= found.good[k]
                    so_far = [sum(map(len, lists[name][i])) for name in names[:2]]
                    lists["a_ids"][i].append(found.a_ids[ends_a[k] : ends_a[k + 1]])
                    lists["b_ids"][i].append(found.b_ids[ends_b[k] : ends_b[k + 1]])
                    lists["a_cuts"][i].append(found.cut_a[at[k] : at[k + 1]] - ends_a[k] + so_far[0])
                    lists["b_cuts"][i].append(found.cut_b[at[k] : at[k + 1]] - ends_b[k] + so_far[1])
            made = []
            for name in names:
                own_lists = [np.concatenate(x) if ok else x[0] for x, ok in zip(lists[name], good, strict=True)]
                offsets = np.append(0, np.cumsum([len(x) for x in own_lists])).astype(np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own_lists).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{name} array<int>" for name in names))


class _Digests:
    """SHA-256 of each text's groups, whose parts come one after another."""

    def __init__(self, n: int):
        self.hashes: list = [None] * n

    def add(self, owner: np.ndarray, data: bytes, ends: np.ndarray) -> None:
        for i, x, y in zip(owner.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if y > x:
                if self.hashes[i] is None:
                    self.hashes[i] = hashlib.sha256()
                else:
                    self.hashes[i].update(b";")
                self.hashes[i].update(data[x : y - 1])


class _LinkBlock:
    """Documents of a block with their links as numbers of its distinct pairs."""

    def __init__(self):
        self.docs: list[pa.RecordBatch] = []
        self.links: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.n, self.size = 0, 0

    def add(self, batch: pa.RecordBatch, own: Aligner) -> None:
        texts = text_column(batch)
        n, strings = batch.num_rows, texts.to_pylist()
        sums, good, digests = {name: np.zeros(n, np.int64) for name in COUNTS}, np.ones(n, bool), _Digests(n)
        links, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for owner, found in _worked(own, strings):
            groups = found.n_groups
            for name, counts in zip(COUNTS, (found.n_a, found.n_b, groups, groups), strict=True):
                np.add.at(sums[name], owner, counts)
            np.logical_and.at(good, owner, found.good)
            digests.add(owner, *own.listed(found))
            links.append(found.links)
            owners.append(np.repeat(owner, groups))
        link, owner = np.concatenate(links), np.concatenate(owners)
        self.links.append(link[good[owner]])
        self.owners.append(owner[good[owner]] + self.n)
        listed = [h.hexdigest() if h is not None and ok else "" for h, ok in zip(digests.hashes, good, strict=True)]
        self.docs.append(pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(sums[c] * good) for c in COUNTS), pa.array(listed, pa.string())], names=["doc_id", *COUNTS, "groups_sha256"]))
        self.n += n
        self.size += sum(map(len, strings))

    def packed(self, press: _Press) -> pa.RecordBatch:
        """One row: documents, distinct pairs with counts, and each document's pair numbers with how often it has them."""
        pairs, number, counts = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        # Pairs are numbered from the most frequent on, so that numbers are small.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, times = np.unique(np.concatenate(self.owners) << 32 | rank[number], return_counts=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.docs[0].schema) as writer:
            for part in self.docs:
                writer.write_batch(part)
        ends = np.searchsorted(keys >> 32, np.arange(self.n + 1)).astype("<u4")
        arrays = [pairs[order], counts[order], ends, (keys & MASK).astype("<u4"), times.astype("<u4")]
        values = [press.pack(sink.getvalue().to_pybytes()), *(press.pack(np.ascontiguousarray(x)) for x in arrays)]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["docs", "pairs", "counts", "ends", "numbers", "times"])


def _link_blocks(docs: DataFrame, definition: str, model: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press, block = aligner_of(definition, model), _Press(), _LinkBlock()
        for batch in chunks(batches):
            block.add(batch, own)
            if block.size >= BLOCK_BYTES:
                yield block.packed(press)
                block = _LinkBlock()
        if block.docs:
            yield block.packed(press)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInArrow(run, "docs binary, pairs binary, counts binary, ends binary, numbers binary, times binary")
    return staged(made.withColumn("block", F.monotonically_increasing_id()))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, number, pair, n): the distinct pairs of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _Press()
        for batch in batches:
            for block, *frames in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pairs, counts = (np.frombuffer(press.unpack(f), "<i8") for f in frames)
                columns = [pa.array(np.full(len(pairs), block)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "number", "pair", "n"])

    return blocks.select("block", "pairs", "counts").mapInArrow(run, "block long, number int, pair long, n long")


def _counted(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): corpus-wide count of each pair, and whether its B id has no higher one."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(int(MASK)))
    highest = totals.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return totals.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, byte_tokenizer: str | None = None, piece_model: str | None = None) -> DataFrame:
    """(a_id, b_id, count, best): how often the corpus links two ids, and whether that is the B id's highest count."""
    counted = _counted(_block_pairs(_link_blocks(docs, *_read(byte_tokenizer, piece_model))))
    return counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit(int(MASK))).cast("int").alias("b_id"), "count", "best")


def alignment_counts(docs: DataFrame, byte_tokenizer: str | None = None, piece_model: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row per row of ``docs`` (doc_id, text).

    Tokens and groups are those of ``align``. A link joins the tokens of both sides at a common end; its
    count is that of ``link_counts``, ``n_best`` counts links with their B id's highest count and
    ``count_sum`` sums the counts. Without tokens all numbers are 0 and the digest is empty.
    """
    blocks = _link_blocks(docs, *_read(byte_tokenizer, piece_model))
    pairs = _block_pairs(blocks)
    back = pairs.select("block", "number", "pair").join(_counted(pairs), "pair").select("block", "number", "count", "best")
    result = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), *((c, pa.int64()) for c in (*COUNTS, "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        press, out = _Press(), []
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        number = right.column("number").to_numpy()
        count[number], best[number] = right.column("count").to_numpy(), right.column("best").to_numpy()
        for row in left.to_pylist():
            found = pa.ipc.open_stream(press.unpack(row["docs"])).read_all()
            ends, numbers, times = (np.frombuffer(press.unpack(row[c]), "<u4").astype(np.int64) for c in ("ends", "numbers", "times"))
            sums = [np.diff(np.append(0, np.cumsum(x))[ends]) for x in (times * best[numbers], times * count[numbers])]
            out.append(found.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])).select(result.names).cast(result))
        return pa.concat_tables(out).combine_chunks() if out else result.empty_table()

    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return blocks.select("block", "docs", "ends", "numbers", "times").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(place, shape)
