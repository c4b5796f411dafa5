"""The grouped prefix join against all pairs compared one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from samples import SF, components, empty_documents, odd_documents, shingles

from auditweave.llm import blocks, group_join
from auditweave.llm.queries import QUERIES


def found(spark, texts, parts=5):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_join.similar_documents(docs).collect()}


def wanted(texts):
    ids = components(texts, 3, 90)
    return {d: (len(shingles(t, 3)), ids[d]) for d, t in texts.items()}


def test_query_equals_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_jaccard_join"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == wanted(texts)


@pytest.mark.parametrize(("frequent", "broadcast"), [(2, 1 << 20), (4, 0), (64, 1 << 20)])
def test_families_and_common_passages(spark, monkeypatch, frequent, broadcast):
    """Near copies around the threshold, passages in many documents, short texts; small blocks, both kinds of join."""
    monkeypatch.setattr(group_join, "FREQUENT", frequent)
    monkeypatch.setattr(group_join, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(group_join, "LONG_SET", 40)
    rng = random.Random(frequent)
    texts, passage = {}, [f"p{i}" for i in range(25)]
    for family in range(6):
        base = [f"w{family}x{i}" for i in range(rng.choice([12, 60, 120]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
            texts[len(texts)] = " ".join(words)
    for i in range(30):
        own = [f"o{i}y{k}" for k in range(rng.choice([0, 1, 2, 10, 30]))]
        texts[len(texts)] = " ".join(passage + own if i % 2 else own + passage)
    texts |= {len(texts) + i: t for i, t in enumerate(["a b", "A  b", "a b c", "b", "", None, "a b c a b c a b c", "a b c a b c"])}
    want = wanted(texts)
    assert found(spark, texts) == want
    assert len({c for _, c in want.values()}) > 20 and max(np.unique([c for _, c in want.values()], return_counts=True)[1]) > 10


def test_prefixes_share_a_shingle_whenever_sets_link():
    for n in range(1, 400):
        p = int(group_join.prefix_sizes(np.array([n]), 90)[0])
        assert p == n - -(-9 * n // 10) + 1 and 1 <= p <= int(group_join.head_sizes(np.array([n]), 90)[0]) <= n


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 600, 400, dtype=np.uint64)) for _ in "ab")
        long = group_join.parity_bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = [int(np.bitwise_count(x[0] ^ x[1]).sum()) for x in (group_join.folded(long), long)]
        assert bits[0] <= bits[1] <= len(np.setxor1d(a, b))
    for both in range(2, 300):
        assert group_join._least_common(np.array([both]), 90)[0] == next(o for o in range(300) if 100 * o >= 90 * (both - o))


def test_pairs_of_blocks():
    rng = np.random.default_rng(6)
    keys = np.sort(rng.integers(0, 30, 400))
    i, j = keys % 3, keys % 3 + keys % 2
    rows = {"key": keys, "i": i, "j": j, "chunk": np.where(rng.integers(0, 2, 400) > 0, i, j)}
    got = sorted((a, b) for u, v in blocks.pairs_in_blocks(rows) for a, b in zip(u.tolist(), v.tolist(), strict=True))
    want = [(a, b) for a in range(400) for b in range(a + 1, 400) if keys[a] == keys[b] and (i[a] == j[a] or rows["chunk"][a] != rows["chunk"][b])]
    assert got == want
    u, v = rng.integers(0, 100, (2, 60))
    label = blocks.joined(u, v, 100)
    assert (label[u] == label[v]).all() and (label <= np.arange(100)).all() and len(set(label)) >= 40


def test_odd_rows(spark):
    rows = group_join.similar_documents(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[14] == {14} and by[15] == {14} and by[4] == {3} and by[1] == {1} and by[2] == {2} and by[None] == {None}
    assert group_join.similar_documents(empty_documents(spark)).count() == 0


def test_several_texts_of_an_id_and_rows_without_id(spark):
    def text(name, changed=0):
        return " ".join(f"{name}{i}" if i >= changed else f"{name}x{i}" for i in range(100))

    rows = [(1, text("a")), (2, text("b")), (10, text("a", 2)), (10, text("b", 2)), (4, text("d")), (None, text("d")), (None, text("d", 3)), (None, text("f")), (None, text("f")), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["component_id"]) for r in group_join.similar_documents(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (10, 1), (10, 1), (4, 4), (None, 4), (None, 4), (None, None), (None, None), (None, None)], key=str)
