"""Hashes of spans: equal bytes agree, and structured strings that defeat polynomials stay apart."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import shingles
from tokenizers import Tokenizer

from auditweave.llm import bpe, near_dedup, quality
from auditweave.llm.common import LONG_SPAN, SpanHashes, span_keys


def thue_morse(size):
    """A word of two letters and the one with the letters exchanged."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def spans(words):
    data = [w if isinstance(w, bytes) else w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    return SpanHashes(np.frombuffer(b"".join(data), np.uint8))(ends - [len(d) for d in data], ends)


@pytest.mark.parametrize("size", [8, 64, 1024, 4096, 8192, 65_536])
def test_structured_words_have_hashes_of_their_own(size):
    a, b = thue_morse(size)
    found = spans([a, b, a + b, b + a, "x" + a, a])
    assert len(set(found.tolist())) == 5 and found[0] == found[5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=12))
def test_hash_depends_on_the_bytes_alone(words):
    words = [*words, b"z" * (LONG_SPAN + 1), b"\0", b"\0\0", b"", b"z" * LONG_SPAN]
    found = spans(words)
    alone = [int(spans([w])[0]) for w in words]
    assert found.tolist() == alone
    assert len(set(alone)) == len(set(words))


def test_equal_hashes_do_not_decide(spark, monkeypatch):
    """With hashes that collide all the time, spans and words are still told apart by their bytes."""
    whole = SpanHashes.__call__
    monkeypatch.setattr(SpanHashes, "__call__", lambda self, starts, ends, salt=0: whole(self, starts, ends, salt) % np.uint64(5 + 40 * salt))
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 30, 400)] + [b"q" * (LONG_SPAN + 5)] * 2
    ends = np.cumsum([len(w) for w in words])
    raw, starts = np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words]
    _, first, inverse = span_keys(raw, starts, ends)
    assert [words[i] for i in first[inverse]] == words and len(first) == len(set(words))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known = bpe._WordTable(own)
    for part in (words[:150], words[150:], words):
        flat = np.frombuffer(b"".join(part), np.uint8)
        length, ids = known.ids(flat, np.array([len(w) for w in part]))
        want = [own.encode(w.decode(), add_special_tokens=False).ids for w in part]
        assert length.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_structured_texts_through_the_operators(spark):
    """Encoding, line counts and near duplicates of texts that differ in one structured word."""
    texts = {}
    for k, size in enumerate((1024, 8192)):
        a, b = thue_morse(size)
        texts |= {10 * k: a, 10 * k + 1: b, 10 * k + 2: f"{a}\n{b}\n{a} x {b} x {a}", 10 * k + 3: f"one {a} two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in bpe.encode(docs, digests=True).collect():
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    judged = {r["doc_id"]: r for r in quality.judge(docs, quality.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))).collect()}
    assert [judged[d]["n_dup_lines"] for d in sorted(texts)] == [0] * len(texts)
    assert [judged[d]["n_repeat_words"] for d in sorted(texts)] == [0] * len(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    assert got == {d: (len(shingles(t, 2)), d) for d, t in texts.items()}
