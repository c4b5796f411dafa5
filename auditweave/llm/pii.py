"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments: runs of up to ``LONGEST`` words that begin and end with a word
which holds a digit or an @ sign. A dynamic programme over the words, with segments of bounded
length, sums over all segmentations for the fit and chooses boundaries and kinds jointly for the
result; of a long run it holds numbers by word, never features. Its labels are the spans of the fixed patterns in a sample of documents; what it adds are
segments that look like them as a whole, such as numbers written without the leading sign.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import chunks, fields_of, text_column

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
#: Words and characters of a segment, at most: a card number in four groups with a mark between them has seven words.
LONGEST, LONGEST_CHARS = 7, 96
#: Documents with a pattern's match that the field is fitted on, and documents with digits but no match, at most.
PER_CLASS = 1500
#: A segment is added if its share of all segmentations' weight is at least this.
ADD_LEAST = 0.6
BUCKETS = 1 << 14

# Fixed patterns. Each is anchored so that it takes the leftmost matches of the plain pattern in
# linear time: an address is found from its @ sign, numbers begin where their digits begin.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ACTIVE = re.compile(r"[0-9@]")
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:=", "\"'>]},;:.!?=%&$#*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by kind and start."""
    out = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            floor = found.end()
        at = text.find("@", max(at + 1, floor))
    for found in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.group().split(".")):
            out.append(("ip", *found.span()))
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *found.span()))
    for found in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in found.group()) <= 15:
            out.append(("phone", *found.span()))
    return out


class Cluster:
    """Words of which segments can be made, plain words among them, and the features of every segment."""

    def __init__(self, text: str, words: list[tuple[int, int]], before: str):
        self.text, self.words, self.before = text, words, before
        self.active = [bool(_ACTIVE.search(text, a, b)) for a, b in words]

    def ending_at(self, j: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """First word, start, end and features of each segment whose last word is ``j``."""
        if not self.active[j]:
            return
        for i in range(max(0, j - LONGEST + 1), j + 1):
            if self.active[i]:
                a, b = _trimmed(self.text, self.words[i][0], self.words[j][1])
                if a < b <= a + LONGEST_CHARS:
                    yield i, a, b, _features(self.text[a:b], self.before if i == 0 else self.text[slice(*self.words[i - 1])])

    @cached_property
    def segments(self) -> dict[tuple[int, int], tuple[int, int, np.ndarray]]:
        """All segments at once, for the fit."""
        return {(i, j): (a, b, feats) for j in range(len(self.words)) for i, a, b, feats in self.ending_at(j)}


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _TRIM_LEFT:
        a += 1
    while a < b and text[b - 1] in _TRIM_RIGHT:
        b -= 1
    return a, b


def _shape(text: str) -> str:
    text = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", text))
    return re.sub(r"(.{1,3}?)\1+", r"\1\1", text)[:24]


def _features(segment: str, before: str) -> np.ndarray:
    """Buckets of what describes a segment as a whole."""
    digits = "".join(c for c in segment if c in "0123456789")
    letters = sum(c.isalpha() for c in segment)
    other = len(segment) - len(digits) - letters
    parts = [
        f"shape|{_shape(segment)}",
        f"digits|{min(len(digits), 20)}|{min(letters, 1)}",
        f"runs|{'-'.join(str(min(len(r), 5)) for r in re.findall('[0-9]+', segment)[:6])}|{min(letters, 1)}",
        f"marks|{''.join(sorted(set(re.sub('[0-9A-Za-z]', '', segment))))[:8]}",
        f"words|{segment.count(' ')}|{min(other, 8)}",
        f"luhn|{len(digits) > 15 and luhn(digits)}|{letters == 0}",
        f"bytes|{digits != '' and segment.count('.') == 3 and all(len(p) < 4 and p.isdigit() and int(p) < 256 for p in segment.split('.'))}",
        f"at|{segment.count('@')}|{'.' in segment.rpartition('@')[2]}",
        f"before|{_shape(before)}",
        "bias",
    ]
    return np.array([crc32(p.encode()) % BUCKETS for p in parts], np.int32)


def clusters(text: str) -> list[Cluster]:
    """Runs of words around digits and @ signs; only words that no segment can hold together part them."""
    words = [m.span() for m in _WORD.finditer(text)]
    active = [k for k, (a, b) in enumerate(words) if _ACTIVE.search(text, a, b)]
    out, first = [], 0
    for at, k in enumerate(active):
        if at + 1 == len(active) or active[at + 1] - k >= LONGEST:
            start = active[first]
            out.append(Cluster(text, words[start : k + 1], text[slice(*words[start - 1])] if start else ""))
            first = at + 1
    return out


def _scores(cluster: Cluster, weights: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    return {key: weights[:, feats].sum(axis=1) for key, (_, _, feats) in cluster.segments.items()}


def segment_marginals(cluster: Cluster, weights: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Share of all segmentations' weight that each segment has under each kind."""
    n, scores = len(cluster.words), _scores(cluster, weights)
    left, right = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    left[0] = right[n] = 0.0
    total = {key: np.logaddexp.reduce(s) for key, s in scores.items()}
    for j in range(n):
        terms = [left[j]] + [left[i] + total[i, j] for i in range(max(0, j - LONGEST + 1), j + 1) if (i, j) in total]
        left[j + 1] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [right[i + 1]] + [right[j + 1] + total[i, j] for j in range(i, min(n, i + LONGEST)) if (i, j) in total]
        right[i] = np.logaddexp.reduce(terms)
    return {(i, j): np.exp(np.minimum(left[i] + s + right[j + 1] - left[n], 0)) for (i, j), s in scores.items()}


def best_segments(cluster: Cluster, weights: np.ndarray) -> list[tuple[str, int, int, float]]:
    """The segmentation of the highest score: kind, start, end and marginal of its segments.

    Features live as long as their segment is scored; what stays of a word is the weight of the
    ``LONGEST`` segments that end at it and the best of them.
    """
    n = len(cluster.words)
    value, left, totals = np.zeros(n + 1), np.zeros(n + 1), np.full((n, LONGEST), -np.inf)
    size, chosen = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for j in range(n):
        value[j + 1], left[j + 1] = value[j], left[j]
        for i, _, _, feats in cluster.ending_at(j):
            scores = weights[:, feats].sum(axis=1)
            totals[j, j - i] = np.logaddexp.reduce(scores)
            left[j + 1] = np.logaddexp(left[j + 1], left[i] + totals[j, j - i])
            kind = int(scores.argmax())
            if value[i] + scores[kind] > value[j + 1]:
                value[j + 1], size[j], chosen[j] = value[i] + scores[kind], j - i + 1, kind
    if not size.any():
        return []
    right = np.zeros(n + 1)
    for i in range(n - 1, -1, -1):
        right[i] = right[i + 1]
        for j in range(i, min(n, i + LONGEST)) if cluster.active[i] else ():
            if totals[j, j - i] > -np.inf:
                right[i] = np.logaddexp(right[i], right[j + 1] + totals[j, j - i])
    out, at = [], n
    while at:
        if not size[at - 1]:
            at -= 1
            continue
        j, i = at - 1, at - int(size[at - 1])
        a, b = _trimmed(cluster.text, cluster.words[i][0], cluster.words[j][1])
        share = np.exp(min(left[i] + (value[at] - value[i]) + right[at] - left[n], 0.0))
        out.append((KINDS[chosen[j]], a, b, float(share)))
        at = i
    return out[::-1]


def train(docs: DataFrame, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights (a row a kind) from at most ``per_class`` documents with a pattern's match and as many without.

    Both samples are the documents with the smallest hashes among those with an @ sign or a digit.
    An empty table gives weights that add nothing.
    """
    some = docs.select("text").filter(F.col("text").rlike("[0-9@]"))
    likely = F.col("text").rlike(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{16}|\+[0-9]")
    order = F.xxhash64("text")
    # The choice is made among hashes; only the texts of the chosen ones travel.
    chosen = [some.filter(side).select(order.alias("hash")).distinct().orderBy("hash").limit(per_class) for side in (likely, ~likely)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = sorted({r["text"] for r in some.join(picked, order == picked["hash"], "left_semi").dropDuplicates(["text"]).collect()}, key=lambda t: crc32(t.encode()))
    rows, goal = [], []
    for text in texts:
        gold = {(a, b): KINDS.index(kind) for kind, a, b in base_spans(text)}
        for cluster in clusters(text):
            spans = {key: gold[a, b] for key, (a, b, _) in cluster.segments.items() if (a, b) in gold}
            shown = {cluster.segments[key][:2] for key in spans}
            lo, hi = cluster.words[0][0], cluster.words[-1][1]
            # Of a match that no segment can show, nothing is learned: the segments that touch it are left out.
            hidden = [(a, b) for a, b in gold if a < hi and lo < b and (a, b) not in shown]
            if hidden:
                free = {key: s for key, s in cluster.segments.items() if all(s[1] <= a or b <= s[0] for a, b in hidden)}
                cluster.segments, spans = free, {key: kind for key, kind in spans.items() if key in free}
            rows.append(cluster)
            goal.append(spans)
    weights = np.zeros((len(KINDS), BUCKETS))
    weights[:, crc32(b"bias") % BUCKETS] = -4.0
    squares = np.full_like(weights, 1e-6)
    for _ in range(6):
        for cluster, spans in zip(rows, goal, strict=True):
            share = segment_marginals(cluster, weights)
            for key, p in share.items():
                slip = p.copy()
                if key in spans:
                    slip[spans[key]] -= 1.0
                kinds = np.flatnonzero(np.abs(slip) > 1e-3)
                feats = cluster.segments[key][2]
                for kind in kinds:
                    squares[kind, feats] += slip[kind] ** 2
                    weights[kind, feats] -= 0.3 * slip[kind] / np.sqrt(squares[kind, feats] + 0.1)
    return weights.astype(np.float32)


def all_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The base spans, and segments of the field that touch none of them, by kind and start."""
    out = list(base)
    order = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in order], list(accumulate((b for _, b in order), max))
    for cluster in clusters(text):
        for kind, a, b, share in best_segments(cluster, weights):
            earlier = bisect_left(starts, b)
            if share >= ADD_LEAST and not (earlier and furthest[earlier - 1] > a):
                out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind; of overlapping spans the first by start counts, then the longer."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            # The rest of an overlapping span goes too.
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


ADDED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
ADDED_NAMES = [f.split()[0] for f in ADDED.split(", ")]


def find_personal_data(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with counts of base spans by kind, their digest, all ``spans`` and the ``redacted`` text.

    Spans are kind:start:end in code points, end exclusive, comma-joined by kind and start; base spans of
    different kinds may overlap. A null text counts as empty and its redacted text is null. The text
    column is read; all columns are passed on, except those named like a result.
    """
    names = [c for c in docs.columns if c not in ADDED_NAMES]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found: list[list] = [[] for _ in ADDED_NAMES]
            for value in batch.column(batch.schema.get_field_index("text")).to_pylist():
                if not value or not _ACTIVE.search(value):
                    row = (0, 0, 0, 0, none, "", value)
                else:
                    base = base_spans(value)
                    spans = all_spans(value, base, weights)
                    counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                    row = (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), redacted(value, spans))
                for column, x in zip(found, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=[*names, *ADDED_NAMES])

    return rows.mapInArrow(run, f"{fields_of(rows)}, {ADDED}")
