"""Language identification: scripts narrow the candidates, then a Viterbi path over per-word scores labels spans.

The model is a table of n-gram counts by language, summed over every training row in Spark. A word's
score for a language is the sum of its n-grams' log probabilities; languages that do not use the word's
script are out of the question. Along a text, staying with a language is free and switching costs
``SWITCH``, so that short foreign words do not break a span but foreign passages do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import chunks, code_points, fields_of, is_space, lower_ascii, mixed, text_buffer, text_column, text_pieces, word_bounds

BUCKETS = 1 << 15
SWITCH = 6.0
#: Log score of a language that does not use a word's script.
EXCLUDED = -60.0
#: A language uses a script that makes up this share of its words.
SCRIPT_SHARE = 0.002
#: Texts of more words are cut into segments that go in step.
LONG_TEXT = 1 << 13
#: Bytes of text whose paths a task finds together, and whose n-grams it counts together (these take a hundred times as much).
TEXT_BYTES, GRAM_BYTES = 4 << 20, 1 << 19

#: First and last code point of the blocks that hold the letters of each script; other characters of a block are no letters.
SCRIPTS = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x3FFFF),
]
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS})
_FIRST = np.array([a for _, a, _ in SCRIPTS])
_LAST = np.array([b for _, _, b in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) + 1 for name, _, _ in SCRIPTS], np.int8)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters, by Unicode category."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Words:
    """The words of some texts: n-gram buckets by byte, script by word (0: no letter of a known script)."""

    def __init__(self, texts: pa.Array):
        raw, self.offsets = text_buffer(texts)
        self.raw = lower_ascii(raw)
        self.starts, self.ends, self.counts = word_bounds(self.raw, self.offsets)
        n = len(self.raw)
        self.inside = ~is_space(self.raw)
        self.owner_length = self.ends - self.starts
        at = np.flatnonzero((self.raw & 0xC0) != 0x80)
        points = code_points(self.raw, at)
        place = np.searchsorted(_FIRST, points, "right") - 1
        letter = letter_table()[points]
        script = np.zeros(n, np.int8)
        script[at] = np.where((place >= 0) & (points <= _LAST[place]) & letter, _SCRIPT[place], 0)
        #: Whether a text has a letter, of a known script or not.
        self.lettered = np.diff(np.append(0, np.cumsum(letter))[np.searchsorted(at, self.offsets)]) > 0
        self.letters = np.concatenate([[0], np.cumsum(script > 0)])
        self.script = np.maximum.reduceat(script, self.starts) if len(self.starts) else np.zeros(0, np.int8)
        digits = np.concatenate([[0], np.cumsum((self.raw >= 0x30) & (self.raw <= 0x39))])
        # Keys, numbers and addresses belong to no language.
        self.script[digits[self.ends] > digits[self.starts]] = 0

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the three- and four-byte n-grams that begin at each byte of a word, blanks around it included."""
        # A blank between two texts, so that none reaches into the next.
        lengths = np.diff(self.offsets)
        padded = np.full(len(self.raw) + len(lengths) + 3, 0x20, np.uint64)
        place = np.arange(len(self.raw)) + np.repeat(np.arange(len(lengths)), lengths)
        padded[place + 1] = np.where(self.inside, self.raw, 0x20)
        at = place[self.inside]
        three = padded[at] | padded[at + 1] << np.uint64(8) | padded[at + 2] << np.uint64(16)
        # The fourth byte may belong to the next word; behind a word's end it counts as blank.
        over = padded[at + 2] == 0x20
        four = three | np.where(over, np.uint64(0x20), padded[at + 3]) << np.uint64(24) | np.uint64(1 << 40)
        return tuple((mixed(x) % np.uint64(BUCKETS)).astype(np.int32) for x in (three, four))


def train(docs: DataFrame) -> dict:
    """The model of ``docs`` (text, lang): languages, log scores by bucket, scripts by language.

    Every row with a non-null lang counts. What comes back to the driver is one table of at most
    ``BUCKETS`` counts a language, however large the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for texts, langs in (
            (texts, np.array(batch.column(1).to_pylist(), object)[owner]) for batch in chunks(batches, GRAM_BYTES) for texts, owner in text_pieces(text_column(batch), GRAM_BYTES)
        ):
            for lang in sorted(set(langs)):
                words = Words(texts.filter(pa.array(langs == lang)))
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES) + 1, np.int64))
                for buckets in words.grams():
                    total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(words.script, minlength=len(SCRIPT_NAMES) + 1)
        for lang, total in sums.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(total[full])], names=["lang", "bucket", "n"])

    counted = docs.filter("lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES) + 1))
    for i, lang in enumerate(langs):
        mine = table[table["lang"] == lang]
        counts[i, mine["bucket"].to_numpy()] = mine["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)) if len(langs) else grams
    uses = scripts / np.maximum(scripts[:, 1:].sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE
    uses[:, 0] = True
    return {"langs": langs, "logs": logs.astype(np.float32), "uses": uses}


def word_scores(words: Words, model: dict) -> np.ndarray:
    """A row a word, a column a language. A word without letters, or in a script of no language, says nothing."""
    n, n_langs = len(words.starts), len(model["langs"])
    out = np.zeros((n, n_langs), np.float32)
    if not n or not n_langs:
        return out
    three, four = words.grams()
    begins = np.cumsum(words.owner_length) - words.owner_length
    for i in range(n_langs):
        out[:, i] = np.add.reduceat(model["logs"][i][three] + model["logs"][i][four], begins)
    out -= out.max(axis=1, keepdims=True)
    fits = model["uses"][:, words.script].T
    out = np.where(fits, out, np.float32(EXCLUDED))
    out[(words.script == 0) | ~fits.any(axis=1)] = 0
    return out


def _measured(words: Words, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the words, words of each text, letters of each word that count, whether each text has letters."""
    weight = np.where(words.script > 0, words.letters[words.ends] - words.letters[words.starts], 0)
    return word_scores(words, model), words.counts, weight, words.lettered


def best_path(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The label of every word: the best path of each text, all texts of a batch in step.

    A long text is cut into as many segments as each has words, which go in step too. What a segment adds to
    each language from each one before it is a small matrix; the matrices are chained, which gives the
    languages at the cuts, and then all segments find their own paths between these.
    """
    n, n_langs = scores.shape
    ends = np.cumsum(counts)
    label = np.zeros(n, np.int64)
    long = counts > LONG_TEXT
    for i in np.flatnonzero(long).tolist():
        label[ends[i] - counts[i] : ends[i]] = _long_path(scores[ends[i] - counts[i] : ends[i]])
    if not long.all():
        short = np.repeat(~long, counts)
        label[short] = _paths(scores[short], counts[~long])[0]
    return label


def _long_path(scores: np.ndarray) -> np.ndarray:
    n, n_langs = scores.shape
    size = int(np.ceil(np.sqrt(n)))
    parts = -(-n // size)
    steps = np.zeros((parts, size, n_langs))
    steps.reshape(-1, n_langs)[:n] = scores
    # From each language before a segment to each one at its end.
    value = np.full((parts, n_langs, n_langs), -np.inf)
    value[:, np.arange(n_langs), np.arange(n_langs)] = 0
    for t in range(size):
        value = np.maximum(value, value.max(axis=2, keepdims=True) - SWITCH) + steps[:, t, None, :]
    total, entered = np.zeros(n_langs), np.zeros((parts, n_langs), np.int64)
    for k in range(parts):
        if k == 0:  # before the first word there is no language, so it costs no switch
            total = _ending(steps[0])
            continue
        ways = total[:, None] + value[k]
        entered[k] = ways.argmax(axis=0)
        total = ways.max(axis=0)
    last = np.zeros(parts, np.int64)
    last[-1] = total.argmax()
    for k in range(parts - 1, 0, -1):
        last[k - 1] = entered[k, last[k]]
    start = np.full((parts, n_langs), -np.inf)
    start[0] = 0
    start[np.arange(1, parts), last[:-1]] = 0
    return _paths(steps.reshape(-1, n_langs), np.full(parts, size), start, last)[0][:n]


def _ending(steps: np.ndarray) -> np.ndarray:
    """The best value of a path that ends in each language."""
    value = np.zeros(steps.shape[1])
    for row in steps:
        value = np.maximum(value, value.max() - SWITCH) + row
    return value


def _paths(scores: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of sequences in step, and the values at their ends.

    ``start`` has a value for each language before the first word, ``last`` the languages they end in.
    """
    n, n_langs = scores.shape
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    stay = np.zeros((n, n_langs), bool)
    source = np.zeros(n, np.int16)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
    value = np.zeros((len(counts), n_langs)) if start is None else start[order]
    final = np.zeros(len(counts), np.int64)
    for t in range(longest):
        k = active[t]
        at = begin[:k] + t
        before = value[:k]
        top = before.argmax(axis=1)
        enter = before[np.arange(k), top][:, None] - SWITCH
        source[at] = top
        stay[at] = before >= enter
        value[:k] = np.maximum(before, enter) + scores[at]
        ending = k if t + 1 == longest else active[t + 1]
        rows = np.arange(ending, k) if t + 1 < longest else np.arange(k)
        final[rows] = value[rows].argmax(axis=1)
    label = np.zeros(n, np.int64)
    now = final if last is None else last[order]
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = np.where(stay[at, now[:k]], now[:k], source[at])
    return label, value


def identify(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, and with ``spans`` if asked for.

    ``lang_pred`` is the language with the most letters along the best path; ties go to the first by
    name. ``score`` (0 to 1) is the mean of its share of the letters and of its probability against the
    other languages over the whole text. A text that is null or has no letters gets ``und`` and score 0, as does every
    text if the model has no language. ``spans`` lists (lang, first word, end word). The text column is
    read; all columns of ``docs`` but those three names are passed on, for any number of rows.
    """
    langs = model["langs"]
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    kept = docs.select(*(F.col(f"`{c}`") for c in names))
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXT_BYTES):
            n = batch.num_rows
            gathered = [(*_measured(Words(part), model), of) for part, of in text_pieces(text_column(batch), GRAM_BYTES)]
            scores, words, weight, has_letter, of = (np.concatenate(x) for x in zip(*gathered, strict=True))
            counts, lettered = np.bincount(of, words, n).astype(np.int64), np.bincount(of, has_letter, n) > 0
            owner = np.repeat(np.arange(n), counts)
            label = best_path(scores, counts) if langs else np.zeros(len(owner), np.int64)
            mass, sums = np.zeros((n, max(1, len(langs)))), np.zeros((n, max(1, len(langs))))
            np.add.at(mass, (owner, label), weight)
            for i in range(len(langs)):
                sums[:, i] = np.bincount(owner, scores[:, i], n)
            picked = mass.argmax(axis=1)
            total = mass.sum(axis=1)
            shifted = np.exp(np.clip((sums - sums.max(axis=1, keepdims=True)) / 4.0, -700, 0))
            sure = shifted[np.arange(n), picked] / shifted.sum(axis=1)
            none = ~lettered | (not langs)
            pred = [("und" if x else langs[p]) for x, p in zip(none, picked, strict=True)]
            score = np.where(none, 0.0, (np.where(total > 0, mass[np.arange(n), picked] / np.maximum(total, 1), 1.0 / max(1, len(langs))) + sure) / 2)
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(score)]
            if spans:
                cut = np.ones(len(owner), bool)
                cut[1:] = (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])
                at = np.flatnonzero(cut)
                first = at - (np.cumsum(counts) - counts)[owner[at]]
                length = np.diff(np.append(at, len(owner)))
                struct = pa.StructArray.from_arrays([pa.array([langs[i] if langs else "und" for i in label[at]], pa.string()), pa.array(first.astype(np.int32)), pa.array((first + length).astype(np.int32))], names=["lang", "first_word", "end_word"])
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[at], np.arange(n + 1)).astype(np.int32)), struct).cast(span_type))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", *(["spans"] if spans else [])])

    return kept.mapInArrow(run, f"{fields_of(kept)}, lang_pred string, score double" + (", spans array<struct<lang:string,first_word:int,end_word:int>>" if spans else ""))
