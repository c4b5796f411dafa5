"""Fill-in-middle against plain slicing of lists of tokens."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import empty_documents, odd_documents

from auditweave.llm import fill_middle
from auditweave.llm.fill_middle import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, boundaries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, text, units):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens = units(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("unit", "units"), [("token", TOKEN.findall), ("character", list)])
def test_equals_plain_slicing(spark, unit, units):
    long = "é\t" * 30_000 + " tail of a long text " * 9000 + "x" * 140_000 + " \n"
    extra = [(100 + i, t) for i, t in enumerate(["<P>", "a <S> b", "<M", "a<S", "<P <S <M >", long, long + "<M>", "  ", "a ", " a", "word"] * 12)]
    docs = odd_documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = fill_middle.fill_in_middle(docs, unit=unit).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((d, *plain_form(d, t, units), t or "") for d, t in texts), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in rows), key=str) == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert "spans" in rows[0] and "text" not in rows[0]
    assert fill_middle.fill_in_middle(empty_documents(spark)).count() == 0


def test_parts_are_found_by_their_marks_without_splitting(spark):
    rows = [("<P>a <<S>b> é<M>", "psm"), ("<S>\n<P>é<<M>P>", "spm"), ("<S><P><M>x", "spm"), ("<P><S><M>", "psm"), ("a<M>b<P>", "plain")]
    made = spark.createDataFrame(rows, "output string, form string").withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    for row in made.collect():
        parts = re.split("<[PSM]>", row["output"])
        back = row["output"] if row["form"] == "plain" else parts[1] + parts[3] + parts[2] if row["form"] == "psm" else parts[2] + parts[3] + parts[1]
        assert row["back"] == back
    # A split makes Java strings of the whole text, several times for each of the three parts.
    assert "split" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_result_names_are_replaced(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "1 as n", "'x' as form", "2 as output", "lang")
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r["form"] for r in out.collect()} <= {"plain", "psm", "spm"}


def test_containers_select_what_they_hold():
    rng = np.random.default_rng(2)
    kinds = {
        ArrayContainer: np.sort(rng.choice(1 << 16, 900, replace=False)),
        BitmapContainer: np.sort(rng.choice(1 << 16, 30_000, replace=False)),
        RunContainer: np.concatenate([np.arange(10, 60_000), np.arange(60_002, 1 << 16)]),
    }
    found, places = BoundarySet(), []
    for key, (kind, lows) in zip((0, 3, 4), kinds.items(), strict=True):
        found.add(key, lows)
        assert type(found.containers[-1]) is kind
        places.append(key * (1 << 16) + lows)
    found.add(9, np.zeros(0, np.int64))
    every = np.concatenate(places)
    assert len(found) == len(every)
    assert (found.select(np.arange(len(every))) == every).all()


def test_boundaries_of_texts_that_cross_containers():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \n"), int(size))) for size in (0, 1, 65_535, 65_537, 0, 200_000, 3)] + ["", " "]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data]))
    found, n = boundaries(raw, offsets)
    assert n.tolist() == [len(TOKEN.findall(t)) for t in texts] and len(found) == n.sum()
    ends = [o + m.end() - 1 for o, t in zip(offsets, texts, strict=False) for m in TOKEN.finditer(t)]
    assert found.select(np.arange(len(found))).tolist() == ends
