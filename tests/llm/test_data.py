"""Mixture, archives, fingerprints, tokens and the pipeline: SQL, round trips and plain Python."""

from __future__ import annotations

import hashlib
import random
import struct

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import differences, oracle_connection
from samples import ODD_TEXTS, SF, components, empty_documents, odd_documents, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from auditweave.llm import bpe, fingerprints, mixing, warc
from auditweave.llm.common import shared_path
from auditweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), oracle_connection(SF), ORACLES[name]) == []


# ------------------------------------------------------------------- mixture
def _targets(sizes):
    """Shares by weight, the excess over three times the size given on, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("group", [4, 16_384])
def test_mixture(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP_ROWS", group)
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 3, 3, 3, 40]), rng.choice(["a", "b", None, "d", "tiny"]) if i > 5 else "tiny") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "'x' as keep_0", "3 as rank")
    got = mixing.mixture(docs).collect()
    assert len(got) == 600 and sorted(got) == sorted(mixing.mixture(docs).collect())
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = _targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in mine} == {size} and mine[0]["target"] == pytest.approx(want[source])
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
        share = mine[0]["target"] / size
        assert all(int(share) <= r["copies"] <= int(share) + 1 for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.1)


@pytest.mark.parametrize("group", [7, 16_384])
def test_crowded_mixture_matches_sql(spark, monkeypatch, tmp_path, group):
    """More rows of a source and size than a group holds: ids out of order, some repeated, and one with the words of many."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", group)
    n = 3 * group if group > 1000 else 1000
    docs = spark.range(n).selectExpr(
        "case when id % 97 = 0 then 5 else (id * 7919) % 1000003 end as doc_id", "case id % 4 when 0 then null when 1 then 'b' else 'a' end as source",
        "case when id % 11 = 0 then null when id % 13 = 0 then '' when id % 17 = 0 then 'one two' else 'one two three' end as text",
    )
    docs = docs.unionByName(spark.createDataFrame([(None, "a", "one two three")] * 3, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = mixing.mixture(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert differences(got, con, mixing.MIXTURE_SQL) == []


def test_mixture_odd_rows(spark):
    docs = odd_documents(spark)
    assert mixing.mixture(docs, keep=("text", "kept")).count() == docs.count()
    assert mixing.mixture(empty_documents(spark)).count() == 0


# ------------------------------------------------------------------ archives
def test_every_archive_has_a_dictionary():
    """Few large records, many small ones, one alone, and records with nothing in common."""
    rng = random.Random(8)
    words = [f"word{rng.randrange(999)}" for _ in range(60_000)]
    large = [(" ".join(rng.sample(words, 30_000))).encode() for _ in range(3)]
    small = [b"WARC/1.1 common head " + " ".join(rng.choices(words, k=4)).encode() for _ in range(3000)]
    for records in (large, large[:1], small, small[:3], [rng.randbytes(5000) for _ in range(40)], [b"x"], [b""]):
        data = warc.archive_bytes(records)
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and list(warc.read_archive(data)) == records
        assert size > 0 or not any(records)
    import zstandard

    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in small)
    assert len(warc.archive_bytes(small)) < 0.8 * plain


def test_archive_round_trip():
    rng = random.Random(1)
    records = [b"WARC/1.1\r\nhead: same\r\n\r\n" + bytes(rng.choice(b"abcdefgh <>/") for _ in range(rng.randrange(5000))) for _ in range(400)]
    data = warc.archive_bytes(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 1000 and list(warc.read_archive(data)) == records
    assert list(warc.read_archive(warc.archive_bytes(records[:2]))) == records[:2]
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    html = [None, "", "same", "same", "same", "é" * 900, "line\r\n\r\nline", "WARC/1.1\r\n\r\n"]
    rows = [(i if i != 3 else None, None if i % 2 else f"http://x/{i}\r\ny", h, "clash") for i, h in enumerate(html)] + [(4, "u", "same", "c"), (None, None, "alone", "c"), (None, None, "alone", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string").repartition(2)
    archives = warc.write_archives(pages, shared_path(spark, "warc"), min_bytes=3)
    got = warc.read_archives(archives).collect()
    kinds = sorted((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload"], r["payload_bytes"]) for r in got)
    assert len(got) == len(rows) and archives.count() > 1
    assert [(k[2], k[3], k[4]) for k in kinds if k[1] == 2] == [("revisit", 4, None)]
    assert [k[2] for k in kinds if k[1] == 4] == ["response", "response"]
    assert [(k[2], k[5]) for k in kinds if k[1] in (0, 1) and not k[0]] == [("response", 0), ("response", 0)]
    assert sorted(k[4] or "" for k in kinds if k[0]) == ["", "alone", "alone"]
    assert warc.read_archives(warc.write_archives(pages.filter("false"), shared_path(spark, "warc"))).count() == 0


# -------------------------------------------------------------- fingerprints
def _check_fingerprints(rows, texts):
    got = {r["doc_id"]: r for r in rows}
    errors = []
    for (d, text), (_, after) in zip(texts, [*texts[1:], texts[0]], strict=True):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for name, other in (("near_edited", changed), ("near_next", after)):
            a, b = shingles(text, 5), shingles(other, 5)
            errors.append(r[name] - (len(a & b) / len(a | b) if a | b else 1.0))
    return errors


def test_fingerprints(spark, monkeypatch):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for size in (10_000, 24 << 20):
        monkeypatch.setattr(fingerprints, "PARTITION_BYTES", size)
        rows = QUERIES["op7_fingerprints"](spark, SF).collect()
        errors = _check_fingerprints(rows, texts)
        assert len(rows) == len(texts) and np.sqrt(np.mean(np.square(errors))) < 0.04 and max(map(abs, errors)) < 0.2
    prints = {}
    for r, (_, text) in zip(sorted(rows), texts, strict=True):
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_odd_rows(spark):
    docs = odd_documents(spark)
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.fingerprint_documents(empty_documents(spark)).count() == 0
    one = fingerprints.fingerprint_documents(docs.filter("doc_id = 5")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"two wtwo ").hexdigest()


# -------------------------------------------------------------------- tokens
def _tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 3000)
    rng = random.Random(9)
    bits = ["a", " ", "  ", "\n", "'s", "'ll", "'", "é", "1", "²", "!", "<|endoftext|>", "\t", "Ⅷ", "日", "\u00a0", "\u0301", "'Re", "🙂", "\x1c", "\x85", "x'd", "they're"]
    texts = [t for t in ODD_TEXTS if t] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 as ids", "2 as block")
    encoded = bpe.encode(docs)
    got = {r["doc_id"]: r for r in bpe.decode(encoded).join(bpe.encode(docs, digests=True), "doc_id").collect()}
    tokenizer = _tokenizer()
    for d, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[d]["ids"] == ids and got[d]["decoded"] == text == tokenizer.decode(ids, skip_special_tokens=False), repr(text)
        assert got[d]["n_tokens"] == len(ids) and got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[d]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_tokens_odd_rows(spark):
    docs = odd_documents(spark)
    rows = bpe.encode(docs).collect()
    assert len(rows) == docs.count() and [r["ids"] for r in rows if r["doc_id"] in (0, 1)] == [[], []]
    assert bpe.decode(bpe.encode(empty_documents(spark))).count() == 0


def test_splitter_kinds_on_all_code_points():
    """Around each character, the array splitter cuts where the tokenizer cuts."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        splitter = bpe.Splitter(file.read())
    points = [c for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000] + list(range(0x1F600, 0x1F640))
    text = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}!" for c in points)
    import pyarrow as pa

    from auditweave.llm.common import text_buffer

    raw, offsets = text_buffer(pa.array([text], pa.large_string()))
    starts, ends, _ = splitter.pieces(raw, offsets)
    got = np.diff(np.append(np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), starts), len(text))).tolist()
    want = [b - a for _, (a, b) in splitter.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    assert got == want


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() == sum(any(c.isalpha() for c in t) for t in texts.values())
    alone = stages["near_dedup"](spark, docs, SF)
    want = components(texts, 5)
    assert alone.columns == docs.columns and {r["doc_id"] for r in alone.collect()} == {d for d, c in want.items() if c == d}
    clean = stages["personal_data"](spark, docs, SF)
    rows = clean.collect()
    assert clean.columns == docs.columns and len(rows) == len(texts) and not any("@mail" in r["text"] or r["n_chars"] != len(r["text"]) for r in rows)
    assert {r["doc_id"] for r in rows if "[EMAIL]" in r["text"]} == {d for d, t in texts.items() if "@mail" in t}
    mixed = stages["mixture"](spark, docs, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(copies.values())
    tokens = stages["tokens"](spark, docs, SF).collect()
    tokenizer = _tokenizer()
    assert all(r["n_tokens"] == len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids) for r in tokens) and len(tokens) == len(texts)


def test_language_stage_keeps_texts_of_several_languages(spark):
    """Six languages are learned; texts that join three of them, and letters of no known script, stay."""
    words = {"ru": "слово быстро человек дорога", "en": "the quick house reading", "fr": "être déjà quelque maison", "de": "straße über nicht gehen", "el": "λόγος άνθρωπος δρόμος", "es": "niño mañana pueblo calle"}
    rows = [(d * 6 + i, " ".join(w.split() * 10), lang) for d in range(40) for i, (lang, w) in enumerate(words.items())]
    rows += [(900, " ".join([words["ru"]] * 6 + [words["en"]] * 5 + [words["fr"]] * 5), None), (901, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁᛃ", None), (902, "12 34", None), (903, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "cast(0 as long) as n_chars")
    kept = {r["doc_id"]: r["lang"] for r in dict(corpus_pipeline.STAGES)["language"](spark, docs, SF).collect()}
    assert kept.keys() == {r[0] for r in rows} - {902, 903} and kept[900] in ("ru", "en", "fr")


def test_pipeline_query(spark):
    rows = QUERIES["pipeline"](spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 100


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_pipeline_odd_rows(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count() * 3, name
        if name == "near_dedup" and docs.count():
            assert out.filter("doc_id is null").count() == 2 and out.filter("doc_id = 15 or doc_id = 4").count() == 0


def test_decode_joins_any_ids(spark):
    """Random ids, most of which cut characters apart, null, empty and repeated rows, against the library."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(13)
    rows = [(i % 40, [rng.randrange(50_257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(30))], "x") for i in range(60)]
    rows += [(100, None, "null"), (101, [], "empty"), rows[0], rows[0]]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string").repartition(4)).collect()
    want = [(d, ids, tokenizer.decode(ids or [], skip_special_tokens=False)) for d, ids, _ in rows]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=str) == sorted(want, key=str)
