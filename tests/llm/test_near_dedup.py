"""Near duplicates against all pairs compared one by one."""

from __future__ import annotations

import random

import numpy as np
from samples import SF, components, empty_documents, odd_documents, shingles

from auditweave.llm import near_dedup
from auditweave.llm.components import components as connected
from auditweave.llm.queries import QUERIES


def test_query_equals_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_near_dedup"](spark, SF).collect()
    assert len(rows) == len(texts)
    want = components(texts, 2)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]], 2)) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_crowded_group_in_small_blocks(spark, monkeypatch):
    """Variants of one text, many of them not similar enough to each other or to the smallest."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 3, 4, 5, 6, 8])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(40)}"
        texts[d] = " ".join(words)
    texts |= {200 + d: texts[5] for d in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    assert got == components(texts, 2)
    assert len(set(got.values())) > 3


def test_odd_rows(spark):
    rows = near_dedup.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert by[14] == {(14, True)} and by[15] == {(14, False)}
    assert by[4] == {(3, False)} and by[1] == {(1, True)} and by[2] == {(2, True)}
    assert by[None] == {(None, True)}
    assert near_dedup.near_duplicates(empty_documents(spark)).count() == 0


def test_several_texts_of_an_id_and_rows_without_id(spark):
    """Links of each text of a document count; rows without id are tied by their texts alone."""

    def text(name, changed=0):
        return " ".join(f"{name}{i}" if i >= changed else f"{name}x{i}" for i in range(100))

    rows = [(1, text("a")), (2, text("b")), (3, text("c")), (4, text("d"))]
    rows += [(10, text("a", 2)), (10, text("b", 2)), (11, text("c", 2)), (11, text("e"))]
    rows += [(None, text("d")), (None, text("d", 3)), (None, text("f")), (None, text("g")), (None, text("g")), (None, text("g", 2)), (None, None), (12, text("h"))]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, shingle=2).collect()), key=str)
        want = [(1, 1, True), (2, 1, False), (10, 1, False), (10, 1, False), (3, 3, True), (11, 3, False), (11, 3, False), (4, 4, True), (12, 12, True)]
        want += [(None, 4, False), (None, 4, False), (None, None, True), (None, None, True), (None, None, True), (None, None, False), (None, None, False)]
        assert got == sorted(want, key=str)


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.7, 0.8, 0.9, 0.97):
        for _ in range(40):
            both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
            sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, (1000 - len(both)) // 2, dtype=np.uint64)])) for _ in "ab"]
            truth = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            minima = near_dedup.min_hashes(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            a, b = near_dedup.odd_sketches(minima).view(np.uint64)
            errors.append(near_dedup.estimate(np.bitwise_count(a ^ b).sum()) - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r["vertex"]: r["component"] for r in connected(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
