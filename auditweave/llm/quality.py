"""Quality verdicts: base counts by rule, then a hashed n-gram logistic regression with calibrated probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import SpanHashes, chunks, code_points, fields_of, is_space, labelled_sample, mixed, text_buffer, text_column, word_bounds

BUCKETS = 1 << 16
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 1500
#: Documents are kept from this probability of good quality on.
KEEP_LEAST = 0.5
#: Bytes of text that a task works on at a time; the n-gram arrays take about two hundred times as much.
TEXT_BYTES = 1 << 19
MIN_WORDS = 50
REPEATED_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    raw, offsets = text_buffer(texts)
    n = len(offsets) - 1
    if not len(raw):
        return {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    starts, ends, counts = word_bounds(raw, offsets)
    hashes = SpanHashes(raw)
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    per_word = leads[ends] - leads[starts]
    owner = np.repeat(np.arange(n), counts)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])

    # Lines with a word, less the distinct ones of each text.
    breaks = np.flatnonzero(raw == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.append(line_starts[1:], len(raw))
    # A line ends before its line break.
    line_ends = line_ends - (raw[line_ends - 1] == 0x0A)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    keys = hashes(line_starts, line_ends)
    order = np.lexsort((keys, line_owner))
    again = np.zeros(len(order), bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])

    # Words covered by a three-word window that the text has twice or more.
    words = hashes(starts, ends)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        window = mixed(mixed(words[:-2] * np.uint64(0xD6E8FEB86659FD93) + words[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + words[2:])
        at = np.flatnonzero(owner[:-2] == owner[2:])
        order_w = at[np.lexsort((window[at], owner[at]))]
        same = (window[order_w][1:] == window[order_w][:-1]) & (owner[order_w][1:] == owner[order_w][:-1])
        twice = np.zeros(len(order_w), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for step in range(3):
            covered[order_w[twice] + step] = True
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": np.bincount(owner, per_word, n).astype(np.int64),
        "n_symbols": np.diff(symbols[offsets]).astype(np.int64),
        "n_dup_lines": np.bincount(line_owner[order][again], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(owner[covered], minlength=n).astype(np.int64),
    }


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word, pair of neighbouring words, and three- and four-character n-gram within a word."""
    raw, offsets = text_buffer(texts)
    starts, ends, counts = word_bounds(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.uint64(0xD6E8FEB86659FD93)
    words = SpanHashes(raw)(starts, ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    beside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mixed(words[beside] * step + words[beside + 1])
    at = np.flatnonzero(((raw & 0xC0) != 0x80) & ~is_space(raw))
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    by_char = np.repeat(owner, last - first)
    left = np.repeat(last, last - first) - np.arange(len(at))
    wide = np.append(code_points(raw, at).astype(np.uint64), np.zeros(3, np.uint64))
    three = mixed(wide[:-3] | wide[1:-2] << np.uint64(21) | wide[2:-1] << np.uint64(42))
    four = mixed(three * step + wide[3:])
    parts = [(words, owner), (pairs, owner[beside]), (three[left >= 3], by_char[left >= 3]), (four[left >= 4], by_char[left >= 4])]
    return np.concatenate([p[0] % np.uint64(BUCKETS) for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts])


def _raw_scores(buckets: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    size = np.bincount(owner, minlength=n)
    return np.bincount(owner, weights[buckets], n) / np.maximum(np.sqrt(size), 1)


def _sampled_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and bucket, text number and count of each text's distinct features, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXT_BYTES):
            buckets, owner = features(text_column(batch))
            pairs, times = np.unique(owner * BUCKETS + buckets, return_counts=True)
            offsets = pa.array(np.searchsorted(pairs // BUCKETS, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % BUCKETS, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["doc_id", "label", "buckets", "times"])

    found = sample.mapInArrow(run, f"{fields_of(sample.select('doc_id', 'label'))}, buckets array<int>, times array<int>").toArrow().combine_chunks()
    # In order of id, so that equal tables give equal models.
    found = found.sort_by("doc_id")
    counts = found.column("buckets").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if found.num_rows else np.zeros(0, np.int64)
    flat = [np.asarray(found.column(c).combine_chunks().flatten() if found.num_rows else [], np.int32) for c in ("buckets", "times")]
    return found.column("label").to_numpy().astype(float), flat[0], np.repeat(np.arange(len(counts), dtype=np.int32), counts), flat[1]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """Weights and calibration, from a sample of at most ``per_class`` labelled documents a class.

    Four fifths of the sample fit the weights (L2-regularised, classes weighted equally), the rest the
    slope and offset that turn scores into probabilities. Without both classes the model says 1.
    """
    y, buckets, owner, times = _sampled_features(labelled_sample(docs, labels, label, per_class))
    if len(set(y.tolist())) < 2:
        return {"weights": np.zeros(BUCKETS, np.float32), "slope": 0.0, "offset": 5.0}
    n = len(y)
    size = np.bincount(owner, times, n)
    value = (times / np.maximum(np.sqrt(size), 1)[owner]).astype(np.float32)
    fit = np.arange(n) % 5 != 0
    share = np.where(y > 0, 0.5 / max(1, (y[fit] > 0).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit
    weights, bias = np.zeros(BUCKETS), 0.0
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, 81):
        score = np.bincount(owner, value * weights[buckets], n) + bias
        slip = (1 / (1 + np.exp(-np.clip(score, -35, 35))) - y) * share
        slope = np.append(np.bincount(buckets, value * slip[owner], BUCKETS) + 1e-5 * weights, slip.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    score = np.bincount(owner, value * weights[buckets], n) + bias
    held = ~fit if len(set(y[~fit].tolist())) == 2 else np.ones(n, bool)
    a, b = _calibrate(score[held], y[held])
    return {"weights": weights.astype(np.float32), "slope": a, "offset": b + a * bias}


def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's scaling by Newton steps, classes weighted equally."""
    high, low = (y > 0).sum(), (y == 0).sum()
    goal = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
    share = np.where(y > 0, 0.5 / high, 0.5 / low)
    scale = max(float(np.abs(score).mean()), 1e-9)
    x, a, b = score / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        gradient = np.array([(share * (p - goal) * x).sum() + 1e-4 * a, (share * (p - goal)).sum()])
        curve = share * p * (1 - p)
        matrix = np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(matrix, gradient), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(a / scale), float(b)


def judge(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``quality`` (probability of label 1) and ``kept``.

    A text fails the base rules with fewer than ``MIN_WORDS`` words or if more than half of its words
    repeat; a null text has no words. Other texts are kept if their probability is ``KEEP_LEAST`` or more.
    The text column is read and all columns are passed on, except those named like a result.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXT_BYTES):
            texts = text_column(batch)
            base = base_counts(texts)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEATED_PERCENT * base["n_words"])
            score = _raw_scores(*features(texts), batch.num_rows, model["weights"])
            good = 1 / (1 + np.exp(-np.clip(model["slope"] * score + model["offset"], -35, 35)))
            columns = [*batch.columns, *(pa.array(x) for x in base.values()), pa.array(failed), pa.array(good), pa.array(~failed & (good >= KEEP_LEAST))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    counts = ", ".join(f"{c} long" for c in added[:5])
    return rows.mapInArrow(run, f"{fields_of(rows)}, {counts}, base_failed boolean, quality double, kept boolean")
