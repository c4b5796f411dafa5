"""Fill-in-middle: a text's prefix, middle and suffix, cut at boundaries that a compressed set selects.

The last bytes of all units (tokens or characters) of a batch of texts form one Roaring-style set: places
are dealt to containers by their upper bits, and each container is an array, a bitmap or a list of runs,
whichever is smallest. Cumulative cardinalities tell which container holds the k-th boundary, and a select
inside that container where it lies. A container is made from its own 65,536 bytes of text and the byte
behind them, so a very long text needs no arrays of its own length besides its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import chunks, fields_of, is_space, text_buffer, text_column

SPAN = 1 << 16
WORDS = SPAN // 64
#: The marks before prefix, suffix and middle, and the percentages of documents cut and of cut ones with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SUFFIX_FIRST_PERCENT, SEED = 50, 80, 42


class ArrayContainer:
    """Sorted low halves."""

    def __init__(self, lows: np.ndarray):
        self.lows = lows.astype(np.uint16)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        return self.lows[ranks].astype(np.int64)


class BitmapContainer:
    """A bit for each place, and the number of bits set before each 64-bit word."""

    def __init__(self, lows: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[lows] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = (np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)).astype(np.uint16)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, ranks.astype(np.uint16), "right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        left = ranks - self.before[word]
        return word * 64 + (np.cumsum(bits, axis=1) > left[:, None]).argmax(axis=1)


class RunContainer:
    """First places of runs of neighbours, and the number of places before each run."""

    def __init__(self, lows: np.ndarray):
        first = np.flatnonzero(np.diff(lows, prepend=-2) != 1)
        self.starts, self.before = lows[first].astype(np.uint16), first.astype(np.uint16)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, ranks.astype(np.uint16), "right") - 1
        return self.starts[run].astype(np.int64) + ranks - self.before[run]


def container_of(lows: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted low halves: 2 bytes a place, 4 a run, or 8 KB and its counts."""
    runs = 1 + int(np.count_nonzero(np.diff(lows) != 1))
    sizes = {ArrayContainer: 2 * len(lows), BitmapContainer: SPAN // 8 + 2 * WORDS, RunContainer: 4 * runs}
    return min(sizes, key=sizes.get)(lows)


class BoundarySet:
    """Sorted places in containers by their upper bits, with cumulative cardinalities."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.containers: list[ArrayContainer | BitmapContainer | RunContainer] = []
        self.before = [0]

    def add(self, key: int, lows: np.ndarray) -> None:
        """The places of one container; containers come in order, empty ones are left out."""
        if len(lows):
            self.keys.append(key)
            self.containers.append(container_of(lows))
            self.before.append(self.before[-1] + len(lows))

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The places of these ranks (from 0)."""
        at = np.searchsorted(np.array(self.before), ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        for i in np.unique(at).tolist():
            mine = at == i
            out[mine] = self.keys[i] * SPAN + self.containers[i].select(ranks[mine] - self.before[i])
        return out


def boundaries(raw: np.ndarray, offsets: np.ndarray, unit: str = "token") -> tuple[BoundarySet, np.ndarray]:
    """The last bytes of all units of the texts, and the number of units of each text.

    A token is a word with the white space before it, or the white space at the end of a text; so it ends
    where a word ends or the text does. A character ends before the next byte that begins one.
    """
    found = BoundarySet()
    text_ends = np.unique(offsets[1:][np.diff(offsets) > 0]) - 1
    units = np.zeros(len(offsets) - 1, np.int64)
    for base in range(0, len(raw), SPAN):
        part = raw[base : base + SPAN + 1]
        if unit == "token":
            space = is_space(part)
            last = ~space[:-1] & space[1:]
        else:
            last = (part[1:] & 0xC0) != 0x80
        last = np.append(last, [False] * (min(SPAN, len(raw) - base) - len(last)))
        first, stop = np.searchsorted(text_ends, [base, base + SPAN])
        last[text_ends[first:stop] - base] = True
        lows = np.flatnonzero(last)
        found.add(base // SPAN, lows)
        # Texts that touch this span: each gets the boundaries between its own ends.
        low, high = np.searchsorted(offsets, base, "right") - 1, np.searchsorted(offsets, base + len(last), "left")
        units[low:high] += np.diff(np.searchsorted(lows, offsets[low : high + 1] - base))
    return found, units


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = "token", seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Rows of ``docs`` with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` instead of ``text``.

    Four numbers from the SHA-256 of seed and doc_id decide: two cuts among the n + 1 boundaries, whether the
    document is cut (``plain`` else), and whether the suffix (``spm``) or the prefix (``psm``) comes first. A
    text that is null or empty, or that holds one of the marks, stays plain; plain rows have no counts of
    characters. ``unit`` is token or character. Rows that repeat an id and text give equal rows; a null id
    counts as an empty one. An empty table gives no rows. Other columns are passed on, except those named
    like a result.
    """
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    names = [c for c in docs.columns if c not in (*added, "text")]
    text, digest = F.coalesce("text", F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = marked | (_number(digest, 2) % 100 >= cut_percent)
    suffix_first = _number(digest, 3) % 100 < suffix_first_percent
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text.alias("text"), _number(digest, 0).alias("h1"), _number(digest, 1).alias("h2"), plain.alias("plain"), suffix_first.alias("suffix_first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = text_column(batch)
            raw, offsets = text_buffer(texts)
            found, n = boundaries(raw, offsets, unit)
            first = np.cumsum(n) - n
            h1, h2, stay, flip = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
            cut = np.flatnonzero(~stay & (n > 0))
            ends = []
            for rank in (np.minimum(h1 % (n + 1), h2 % (n + 1))[cut], np.maximum(h1 % (n + 1), h2 % (n + 1))[cut]):
                place = offsets[cut].copy()
                place[rank > 0] = found.select((first[cut] + rank - 1)[rank > 0]) + 1
                ends.append(place)
            form, output, chars = ["plain"] * len(n), texts.to_pylist(), [[None] * len(n), [None] * len(n)]
            for i, start, a, b, stop in zip(cut.tolist(), offsets[cut].tolist(), ends[0].tolist(), ends[1].tolist(), offsets[cut + 1].tolist(), strict=True):
                prefix, middle, suffix = (raw[x:y].tobytes().decode() for x, y in ((start, a), (a, b), (b, stop)))
                chars[0][i], chars[1][i] = len(prefix), len(middle)
                form[i] = "spm" if flip[i] else "psm"
                output[i] = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if flip[i] else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
            made = [pa.array(n), pa.array(form, pa.string()), pa.array(chars[0], pa.int64()), pa.array(chars[1], pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", *added])

    row_type = f"struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in kept.schema.fields)}>"
    made = rows.mapInArrow(run, f"row {row_type}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.select("row.*", *added)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made an output of.

    A cut text holds no mark of its own, so each mark occurs once. The parts are found by their marks in the
    bytes of the output; splitting by a pattern would make several copies of every text.
    """
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def after(mark: str, other: str) -> Column:
        """What follows ``mark``, up to the other mark if that comes later."""
        return F.substring_index(F.substring_index(head, mark, -1), other, 1)

    return F.when(form == "plain", output).otherwise(F.concat(after(PREFIX, SUFFIX), middle, after(SUFFIX, PREFIX)))


def digests(transformed: DataFrame) -> DataFrame:
    """The columns of the contract, with outputs and restored texts as SHA-256."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


FILL_SQL = r"""
with hashed as (
    select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), numbered as (
    select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
        cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
        cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
    from hashed
), counted as (
    select *, len(tokens) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
            when h4 % 100 < 80 then 'spm' else 'psm' end as form
    from numbered
), cut as (
    select *, coalesce(array_to_string(tokens[1:a], ''), '') as prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') as middle,
        coalesce(array_to_string(tokens[b + 1:], ''), '') as suffix
    from counted
)
select doc_id, cast(n as bigint) as n, form,
    case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
    case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(prefix || middle || suffix) as restored_sha256
from cut
"""
