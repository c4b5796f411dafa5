"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The chain has two states, clean and toxic. Token labels for the fit are those of the labelled documents:
in a toxic document, the tokens with a feature that toxic documents have and clean ones lack. The
field learns from them what marks such tokens (stems, endings, neighbours) and how they follow each
other. Forward-backward marginals give the offending spans, and their sum the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import SpanHashes, chunks, distinct_sets, fields_of, labelled_sample, lower_ascii, mixed, text_buffer, text_column, word_bounds, word_shingles
from auditweave.llm.near_dedup import band_keys, min_hashes

BUCKETS = 1 << 18
#: Labelled clean and toxic documents that the model is fitted on, at most.
PER_CLASS = (1600, 800)
#: A feature marks toxic tokens if at least this share of its rate is in toxic documents, and if chance
#: would give any feature of the sample such counts with at most this probability.
MARK_SHARE, MARK_CHANCE = 0.9, 0.05
SPAN_LEAST = 0.5
#: Texts of more tokens are cut into segments that go in step.
LONG_TEXT = 1 << 13
#: Marginals from here on count for the document.
COUNTED_LEAST = 0.1
TEXT_BYTES = 2 << 20
STEMS = (4, 5, 6, 7)

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


class Tokens:
    """The words of some texts without punctuation at their ends, and hashes of their parts."""

    def __init__(self, texts: pa.Array):
        raw, self.offsets = text_buffer(texts)
        self.raw = lower_ascii(raw)
        self.starts, self.ends, self.counts = word_bounds(self.raw, self.offsets)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        first, last = self.starts.copy(), self.ends.copy()
        while (move := (first < last) & _PUNCT[self.raw[np.minimum(first, len(self.raw) - 1)]] if len(first) else np.zeros(0, bool)).any():
            first[move] += 1
        while (move := (first < last) & _PUNCT[self.raw[last - 1]] if len(last) else np.zeros(0, bool)).any():
            last[move] -= 1
        self.first, self.last = first, last
        self.hash = SpanHashes(self.raw) if len(self.raw) else None
        self.words = self.hash(first, last) if len(first) else np.zeros(0, np.uint64)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words before and after, 0 at a text's ends."""
        before, after = np.zeros_like(self.words), np.zeros_like(self.words)
        if len(self.words) > 1:
            same = self.owner[1:] == self.owner[:-1]
            before[1:] = np.where(same, self.words[:-1], 0)
            after[:-1] = np.where(same, self.words[1:], 0)
        return before, after

    def parts(self) -> list[np.ndarray]:
        """Hashes of the word, its stems and its ending. A stem longer than the word is the word."""
        if not len(self.words):
            return [np.zeros(0, np.uint64)] * (2 + len(STEMS))
        salted = [self.words]
        for k in STEMS:
            salted.append(mixed(self.hash(self.first, np.minimum(self.first + k, self.last)) + np.uint64(k)))
        salted.append(mixed(self.hash(np.maximum(self.last - 4, self.first), self.last) + np.uint64(99)))
        return salted

    def features(self) -> np.ndarray:
        """A column a feature: buckets of the parts and of the neighbours."""
        before, after = self.neighbours()
        columns = [*self.parts(), mixed(before + np.uint64(101)), mixed(after + np.uint64(102))]
        return np.stack([(c % np.uint64(BUCKETS)).astype(np.int32) for c in columns], axis=1)


def _groups(texts: pa.Array) -> np.ndarray:
    """A number for each text, equal for near copies: texts that share a MinHash band, directly or through others."""
    raw, offsets = text_buffer(texts)
    hashes, owner = word_shingles(lower_ascii(raw), offsets, 2)
    sets, bounds = distinct_sets(hashes, owner, len(texts))
    full = np.flatnonzero(np.diff(bounds))
    label = np.arange(len(texts))
    for column in band_keys(min_hashes(sets, bounds)).T:
        order = np.argsort(column, kind="stable")
        for k in np.flatnonzero(column[order][1:] == column[order][:-1]):
            a, b = label[full[order[k]]], label[full[order[k + 1]]]
            if a != b:
                label[label == b] = a
    return label


def _marks(tokens: Tokens, toxic: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which tokens of toxic documents carry a feature that marks them.

    A feature counts once for each group of near copies. It marks if its rate in toxic groups is
    ``MARK_SHARE`` or more of both rates, and if the bound on the chance of its counts, were the classes
    alike, is below ``MARK_CHANCE`` divided by the number of features. Stems stop at the stem, so that one
    stem with many endings gathers them.
    """
    totals = np.array([len(np.unique(group[~toxic])), len(np.unique(group[toxic]))], float)
    expected = totals[1] / totals.sum()
    bad = toxic[tokens.owner]
    out = np.zeros(len(tokens.words), bool)
    long_enough = tokens.last - tokens.first
    parts = tokens.parts()[:-1]
    for place, part in enumerate(parts):
        fits = (long_enough >= (1 if place == 0 else STEMS[place - 1]))
        keys, inverse = np.unique(part, return_inverse=True)
        counts = []
        for side in (~bad, bad):
            at = np.flatnonzero(side & fits)
            pairs = np.unique(inverse[at] * len(group) + group[tokens.owner[at]])
            counts.append(np.bincount(pairs // len(group), minlength=len(keys)))
        n = np.maximum(counts[0] + counts[1], 1)
        share = counts[1] / n
        # Chernoff's bound for so many toxic groups or more.
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(share > 0, share * np.log(share / expected), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - expected)), 0)
        rare = (share > expected) & (n * gain >= np.log(len(parts) * max(1, len(keys)) / MARK_CHANCE))
        rates = counts[0] / totals[0], counts[1] / totals[1]
        marks = rare & (rates[1] >= MARK_SHARE * (rates[0] + rates[1]))
        out |= marks[inverse] & fits & bad
    return out


def _messages(odds: np.ndarray, step: np.ndarray, counts: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of sequences in step, by token.

    ``a`` is the toxic state's share from the left, ``b`` the two states' shares from the right, scaled to sum 1.
    ``left`` (shares of the two states before the first token) and ``right`` (shares behind the last) default to
    the ends of a text.
    """
    n = len(odds)
    order = np.argsort(-counts, kind="stable")
    begin, lengths = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
    a, b = np.zeros(n), np.ones((n, 2))
    now = np.zeros(len(counts))
    for t in range(longest):
        k = active[t]
        at = begin[:k] + t
        if t or left is not None:
            before = now[:k] if t else left[order][:k]
            toxic = (before * step[1, 1] + (1 - before) * step[0, 1]) * odds[at]
            clean = before * step[1, 0] + (1 - before) * step[0, 0]
        else:
            toxic, clean = odds[at], 1.0
        now[:k] = toxic / (toxic + clean)
        a[at] = now[:k]
    if right is not None:
        b[begin + lengths - 1] = right[order]
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]
        at = begin[:k] + t
        b[at] = _before(odds[at + 1], step, b[at + 1])
    return a, b


def _before(odds: np.ndarray, step: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Shares in front of a token from those behind it."""
    toxic, clean = odds * ahead[:, 1], ahead[:, 0]
    both = np.stack([step[0, 0] * clean + step[0, 1] * toxic, step[1, 0] * clean + step[1, 1] * toxic], axis=1)
    return both / both.sum(axis=1, keepdims=True)


def _long_messages(odds: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages of one long sequence, cut into as many segments as each has tokens.

    The product of a segment's transitions is a small matrix. Chaining the matrices from both sides gives the
    messages at the cuts, from which all segments find their own in step.
    """
    n = len(odds)
    size = int(np.ceil(np.sqrt(n)))
    parts = -(-n // size)
    counts = np.full(parts, size)
    counts[-1] = n - size * (parts - 1)
    begin = np.cumsum(counts) - counts
    product = np.tile(np.eye(2), (parts, 1, 1))
    for t in range(size):
        # No transition leads to the text's first token.
        own = slice(0 if t else 1, parts if t < counts[-1] else parts - 1)
        enter = np.stack([np.ones(own.stop - own.start), odds[begin[own] + t]], axis=1)
        product[own] = np.matmul(product[own], step) * enter[:, None, :]
        product[own] /= product[own].sum(axis=(1, 2), keepdims=True)
    left, right = np.zeros(parts), np.ones((parts, 2))
    share = np.array([1.0, odds[0]])
    for k in range(1, parts):
        share = share @ product[k - 1]
        share = share / share.sum()
        left[k] = share[1]
    for k in range(parts - 1, 0, -1):
        right[k - 1] = product[k] @ right[k]
        right[k - 1] /= right[k - 1].sum()
    first = slice(0, counts[0])
    a, b = _messages(odds[first], step, counts[:1], None, right[:1])
    rest_a, rest_b = _messages(odds[counts[0] :], step, counts[1:], left[1:], right[1:])
    return np.concatenate([a, rest_a]), np.concatenate([b, rest_b])


def forward_backward(emission: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state by token, and expected counts of the four transitions.

    ``emission`` is the toxic state's score of each token (the clean one's is 0) and ``moves`` the
    transition scores; all texts go in step, a long one in segments of its own.
    """
    n = len(emission)
    odds = np.exp(np.clip(emission, -30, 30))
    step = np.exp(moves)
    # Shares of the two states, scaled to sum 1 at each token: a is the toxic one's from the left.
    a, b = np.zeros(n), np.ones((n, 2))
    ends, long = np.cumsum(counts), counts > LONG_TEXT
    for i in np.flatnonzero(long).tolist():
        mine = slice(ends[i] - counts[i], ends[i])
        a[mine], b[mine] = _long_messages(odds[mine], step)
    short = np.repeat(~long, counts)
    a[short], b[short] = _messages(odds[short], step, counts[~long])
    high, low = a * b[:, 1], (1 - a) * b[:, 0]
    marginal = high / np.maximum(high + low, 1e-300)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[1:] == owner[:-1]) if n > 1 else np.zeros(0, np.int64)
    joint = np.empty((2, 2, len(at)))
    for i in (0, 1):
        for j in (0, 1):
            joint[i, j] = (a[at] if i else 1 - a[at]) * step[i, j] * (odds[at + 1] * b[at + 1, 1] if j else b[at + 1, 0])
    total = joint.sum(axis=(0, 1))
    return marginal, (joint / np.where(total > 0, total, 1)).sum(axis=2)


def _evidence(marginal: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """log(1 + expected toxic tokens); the small marginals of the many clean tokens of a long text do not add up."""
    return np.log1p(np.bincount(owner, np.where(marginal >= COUNTED_LEAST, marginal, 0.0), n))


def train(docs: DataFrame, labels: DataFrame, per_class: int | tuple[int, int] = PER_CLASS) -> dict:
    """The field and the calibration, from at most ``per_class`` labelled documents of each class.

    Without both classes every document gets the score of its only class's side, 0.25.
    """
    rows = labelled_sample(docs, labels, "toxic", per_class).orderBy("doc_id").collect()
    sample = [(row["text"], row["label"]) for row in rows]
    y = np.array([v for _, v in sample], bool)
    empty = {"weights": np.zeros(BUCKETS, np.float32), "bias": -6.0, "moves": np.zeros((2, 2)), "slope": 0.0, "offset": -1.1}
    if y.all() or not y.any():
        return empty
    texts = pa.array([t for t, _ in sample], pa.large_string())
    tokens = Tokens(texts)
    gold = _marks(tokens, y, _groups(texts)).astype(float)
    columns = tokens.features()
    n_features = columns.shape[1]
    weights, bias, moves = np.zeros(BUCKETS), -4.0, np.zeros((2, 2))
    inner = tokens.owner[1:] == tokens.owner[:-1]
    truth = np.array([[((gold[:-1] == i) & (gold[1:] == j) & inner).sum() for j in (0, 1)] for i in (0, 1)], float)
    scale = 1.0 / max(1.0, gold.sum())
    size = BUCKETS + 5
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, 31):
        emission = weights[columns].sum(axis=1) + bias
        marginal, expected = forward_backward(emission, moves, tokens.counts)
        slip = (marginal - gold) * scale
        # Clean tokens that are sure already say nothing more.
        busy = np.flatnonzero(np.abs(marginal - gold) > 1e-4)
        slope = np.zeros(size)
        slope[:BUCKETS] = np.bincount(columns[busy].ravel(), np.repeat(slip[busy], n_features), BUCKETS) + 2e-5 * weights
        slope[BUCKETS] = slip.sum()
        slope[BUCKETS + 1 :] = ((expected - truth) * scale).ravel() + 1e-3 * moves.ravel()
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights -= move[:BUCKETS]
        bias -= move[BUCKETS]
        moves = moves - move[BUCKETS + 1 :].reshape(2, 2)
    marginal, _ = forward_backward(weights[columns].sum(axis=1) + bias, moves, tokens.counts)
    found = _evidence(marginal, tokens.owner, len(sample))
    a, b = _fit_line(found, y.astype(float))
    # The sample holds the classes at other rates than the labels; the offset follows the labels' odds.
    rates = {r["toxic"]: r["n"] for r in labels.filter("toxic is not null").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    b += np.log(rates[1] / rates[0]) - np.log(y.sum() / (~y).sum())
    return {"weights": weights.astype(np.float32), "bias": float(bias), "moves": moves, "slope": a, "offset": float(b)}


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, slightly regularised."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        curve = p * (1 - p)
        gradient = np.array([((p - y) * x).sum() + 0.02 * a, (p - y).sum()])
        matrix = np.array([[(curve * x * x).sum() + 0.02, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 0.02]])
        move = np.clip(np.linalg.solve(matrix, gradient), -2, 2)
        a, b = a - move[0], b - move[1]
    return float(a), float(b)


def score_toxicity(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from a score of 0.5 on) and, if asked for, ``spans``.

    ``spans`` lists (start, end, marginal) of runs of words whose toxic marginal is ``SPAN_LEAST`` or
    more, in code points, end exclusive. Null and empty texts have no words and get the score of a text
    without toxic words. The text column is read; all columns but those three names are passed on.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted", "spans")]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model["weights"]
        for batch in chunks(batches, TEXT_BYTES):
            tokens = Tokens(text_column(batch))
            n = batch.num_rows
            emission = np.full(len(tokens.words), model["bias"])
            for column in tokens.features().T if len(tokens.words) else ():
                emission += weights[column]
            marginal, _ = forward_backward(emission, model["moves"], tokens.counts)
            score = 1 / (1 + np.exp(-np.clip(model["slope"] * _evidence(marginal, tokens.owner, n) + model["offset"], -35, 35)))
            columns = [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            if spans:
                columns.append(_spans(tokens, marginal, n).cast(span_type))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted", *(["spans"] if spans else [])])

    return rows.mapInArrow(run, f"{fields_of(rows)}, score double, predicted int" + (", spans array<struct<start:int,end:int,marginal:double>>" if spans else ""))


def _spans(tokens: Tokens, marginal: np.ndarray, n: int) -> pa.Array:
    hit = marginal >= SPAN_LEAST
    begin = hit.copy()
    begin[1:] &= ~hit[:-1] | (tokens.owner[1:] != tokens.owner[:-1])
    at = np.flatnonzero(begin)
    owner = tokens.owner[at]
    stop = hit.copy()
    stop[:-1] &= ~hit[1:] | (tokens.owner[1:] != tokens.owner[:-1])
    end = np.flatnonzero(stop)
    leads = np.concatenate([[0], np.cumsum((tokens.raw & 0xC0) != 0x80)])
    base = leads[tokens.offsets[owner]]
    top = np.maximum.reduceat(np.append(marginal, 0), at) if len(at) else np.zeros(0)
    struct = pa.StructArray.from_arrays(
        [pa.array((leads[tokens.first[at]] - base).astype(np.int32)), pa.array((leads[tokens.last[end]] - base).astype(np.int32)), pa.array(top)], names=["start", "end", "marginal"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), struct)
