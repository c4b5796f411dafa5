"""Text expressions: digests, redaction, truncation, token counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from auditweave import fixed_values as V


def text_or_none(value: Column) -> Column:
    """Null for empty text."""
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.regexp_replace(value, r"^[\s\x0B\x1C-\x1F]+|[\s\x0B\x1C-\x1F]+$", "")


def short_digest(*parts: Column, length: int = 16) -> Column:
    """First characters of the sha256 over the parts joined by ':'."""
    return F.substring(full_digest(*parts), 1, length)


def full_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def redacted(value: Column) -> Column:
    """Replace secrets; labelled patterns keep their label.

    Texts without any of ``REDACTION_ANCHORS``, one of which every match holds, are left alone.
    """
    lower, suspect = F.lower(value), F.lit(False)
    for anchor in V.REDACTION_ANCHORS:
        suspect = suspect | lower.contains(anchor)
    cleaned = value
    for _name, pattern, keeps_label in V.REDACTION_PATTERNS:
        cleaned = F.regexp_replace(cleaned, pattern, ("$1" if keeps_label else "") + V.REDACTED)
    return F.when(suspect, cleaned).otherwise(value)


def cut(value: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots when cut."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 3), F.lit("..."))).otherwise(value)


def squeeze(value: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(value, r"[\s\x0B\x1C-\x1F]+", " "))


def longest_word_at_each_place(words: Iterable[str]) -> str:
    """A regular expression whose group 1 is, at each place of a text, the longest of ``words`` that begins there.

    The words form a prefix tree, so a place costs a walk down the tree, however many words there are. Matches
    are empty, so words that overlap are all seen; a word that another found word begins with is implied.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        if word:
            node[""] = {}

    def quoted(letter: str) -> str:
        return letter if letter.isalnum() or letter == "_" else f"\\x{{{ord(letter):x}}}"

    def pattern(node: dict) -> str:
        branches = []
        for letter in sorted(k for k in node if k):
            below, prefix = node[letter], quoted(letter)
            while len(below) == 1 and "" not in below:
                (letter, below), *_ = below.items()
                prefix += quoted(letter)
            branches.append(prefix + pattern(below))
        if not branches:
            return ""
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    first = "".join(quoted(letter) for letter in sorted(tree))
    return f"(?=[{first}])(?=({pattern(tree)}))" if tree else "(?!)()"


def token_count(value: Column) -> Column:
    """Default tokenizer: runs of word characters, counted inside the JVM."""
    return F.regexp_count(value, F.lit(V.TOKEN_PATTERN)).cast("bigint")


#: Whether a byte of UTF-8 belongs to a token of ``TOKEN_PATTERN``, a run of ASCII characters of one class.
_IN_TOKEN = np.array([byte < 128 and re.fullmatch(V.TOKEN_PATTERN, chr(byte)) is not None for byte in range(256)])
#: Texts are counted in parts of so many bytes, or one by one where they are longer.
_COUNTED_BYTES = 1 << 22


def count_tokens(texts: pa.Array) -> pa.Array:
    """Tokens of each text, null for null: bytes of tokens that follow none."""
    half = len(texts) // 2
    if half and texts.nbytes > _COUNTED_BYTES:
        return pa.concat_arrays([count_tokens(texts[:half]), count_tokens(texts[half:])])
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    inside = _IN_TOKEN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A text does not go on where the one before it ended.
    first = ends[ends < len(inside)]
    begins[first] = inside[first]
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), ends))
    return pa.array(counts, pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(LongType())
def _counted(texts: pa.Array) -> pa.Array:
    return count_tokens(texts)


def token_count_of_many(value: Column) -> Column:
    """As ``token_count``, for short texts in great number: a whole Arrow batch at a time."""
    return _counted(value)


def token_counter(load: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """Token count from any tokenizer, run on Arrow batches.

    ``load`` is called once per task and returns a function text -> count, so a
    vocabulary is read once and never shipped with each row.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = load()
        for texts in batches:
            yield texts.map(lambda text: 0 if text is None else tokens(text))

    return count
