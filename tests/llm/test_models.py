"""Language, quality, URLs, toxicity and personal data: brute force for the parts, held-out rows for the models."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import SF, WORD, empty_documents, odd_documents

from auditweave.llm import language, pii, quality, toxicity, urls
from auditweave.llm.common import text_pieces
from auditweave.llm.queries import QUERIES

SF2 = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ language
def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op2_language"](spark, SF2).collect()]
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_best_path_equals_enumeration():
    rng = np.random.default_rng(4)
    counts = np.array([0, 5, 1, 3, 0, 4])
    scores = rng.normal(0, 6, (counts.sum(), 3)).astype(np.float32)
    got, at = language.best_path(scores, counts), 0
    for n in counts:
        def value(path, at=at):
            return sum(scores[at + i, p] for i, p in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))

        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert value(tuple(got[at : at + n])) == pytest.approx(value(best), abs=1e-4)
        at += n


def test_long_paths_equal_short_ones(monkeypatch):
    """Texts cut into segments have the path of the whole, and a very long one takes seconds."""
    rng = np.random.default_rng(12)
    counts = np.array([0, 1, 700, 37, 2, 1500, 64])
    scores = -rng.gamma(1.0, 3.0, (counts.sum(), 4)) * (rng.random((counts.sum(), 4)) < 0.6)
    whole = language._paths(scores, counts)[0]
    monkeypatch.setattr(language, "LONG_TEXT", 30)
    cut = language.best_path(scores, counts)
    owner = np.repeat(np.arange(len(counts)), counts)

    def worth(path):
        switches = (path[1:] != path[:-1]) & (owner[1:] == owner[:-1])
        return np.bincount(owner, scores[np.arange(len(path)), path], len(counts)) - language.SWITCH * np.bincount(owner[1:][switches], minlength=len(counts))

    assert np.allclose(worth(cut), worth(whole)) and (cut == whole).mean() > 0.99
    began = time.perf_counter()
    language.best_path(np.tile(scores, (800, 1)), np.array([800 * len(scores)]))
    assert time.perf_counter() - began < 20


def test_texts_in_pieces(spark):
    """A text far longer than a piece gives the words, letters and scores of the whole."""
    rng = random.Random(3)
    words = ["hello", "guten", "Tag", "naïve", "мир", "12", "x" * 50, "日本"]
    texts = pa.array([" ".join(rng.choices(words, k=k)) + rng.choice(["", " ", "\n\n"]) for k in (0, 1, 4000, 3, 900)] + ["y" * 9000, "  lead"], pa.large_string())
    pieces = list(text_pieces(texts, 1000))
    joined = [""] * len(texts)
    for piece, owner in pieces:
        for text, i in zip(piece.to_pylist(), owner.tolist(), strict=True):
            joined[i] += text
    assert joined == texts.to_pylist() and max(len(p) for piece, _ in pieces for p in piece.to_pylist() if "y" not in p) < 2000
    model = language.train(spark.createDataFrame([("hello naïve", "en"), ("guten Tag", "de"), ("мир", "ru")], "text string, lang string"))
    whole = language._measured(language.Words(texts), model)
    cut = [language._measured(language.Words(piece), model) for piece, _ in pieces]
    assert np.array_equal(whole[0], np.concatenate([c[0] for c in cut])) and np.array_equal(whole[2], np.concatenate([c[2] for c in cut]))


def test_mixed_text_and_scripts(spark):
    texts = {"en": "the cat sat on the mat and the dog ran with them", "de": "der hund und die katze sind nicht mit uns gegangen", "ru": "собака и кошка не пришли сегодня домой", "uk": "собака і кішка не прийшли сьогодні додому"}
    model = language.train(spark.createDataFrame([(t, k) for k, t in texts.items()] * 3, "text string, lang string"))
    docs = spark.createDataFrame([(1, texts["en"] + " " + texts["ru"]), (2, "日本語"), (3, "123 !!"), (4, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.identify(docs, model, spans=True).collect()}
    assert [s["lang"] for s in rows[1]["spans"]] == ["en", "ru"] and rows[1]["spans"][1]["first_word"] == 12
    assert rows[2]["lang_pred"] != "und" and rows[3]["lang_pred"] == rows[4]["lang_pred"] == "und" and rows[4]["score"] == 0


def test_texts_without_letters_have_no_language(spark):
    """Every code point of the scripts' blocks alone, and texts of signs and digits, against ``str.isalpha``."""
    points = [chr(c) for _, first, last in language.SCRIPTS for c in range(first, min(last, first + 3000) + 1) if not 0xD800 <= c < 0xE000]
    texts = [*points, "3 × 4 ÷ 2", "٣٤٥ ٦", "।॥", "・", "҂ ҂҂", "12 34", "×a", "٣ ب", "\u0301", "𝔄", "ª", "ǅ", "一二", "〇"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    known = spark.createDataFrame([("guten Tag und mehr", "de"), ("good day and more", "en")], "text string, lang string")
    found = language.identify(docs, language.train(known), spans=True).collect()
    assert {r["doc_id"]: r["lang_pred"] != "und" for r in found} == {i: any(c.isalpha() for c in t) for i, t in enumerate(texts)}


def test_queries_return_spans(spark):
    for r in QUERIES["op2_language"](spark, SF2).collect():
        ends = [int(s.split(":")[2]) for s in r["spans"].split(",") if s]
        assert ends == sorted(ends)
    toxic = [r for r in QUERIES["op9_toxicity"](spark, SF2).collect() if r["predicted"]]
    assert toxic and all(r["spans"] for r in toxic)


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    found = language.identify(docs, language.train(docs))
    assert found.count() == docs.count() and "kept" in found.columns
    assert {r["lang_pred"] for r in found.filter("text is null or text = ''").collect()} == {"und"}
    none = language.train(empty_documents(spark))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(empty_documents(spark), none).count() == 0


# ------------------------------------------------------------------- quality
def _base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


def test_base_counts():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", "c\n", "é", " ", "\n", "#", "|x ", "a b c ", "\r\n", "\u3000"]) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "\n\n", "a\na\na"]
    got = quality.base_counts(pa.array(texts, pa.large_string()))
    assert [list(x) for x in zip(*(v.tolist() for v in got.values()), strict=True)] == [_base(t) for t in texts]


def test_features_are_words_pairs_and_characters():
    """Equal texts give equal features in any batch, and n-grams count characters, not bytes."""
    texts = ["один два три", "один два три", "два один", "a", "", "日本語です x", "a a a"]
    buckets, owner = quality.features(pa.array(texts, pa.large_string()))
    of = [sorted(buckets[owner == i].tolist()) for i in range(len(texts))]
    assert of[0] == of[1] and of[4] == []
    sizes = [len(w := t.split()) + max(0, len(w) - 1) + sum(max(0, len(x) - 2) + max(0, len(x) - 3) for x in w) for t in texts]
    assert [len(x) for x in of] == sizes
    alone = quality.features(pa.array([texts[5]], pa.large_string()))[0]
    assert sorted(alone.tolist()) == of[5]


def test_quality_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, SF2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == _base(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([bool(a) == b for a, b in judged]) > 0.95


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality.judge(docs.join(labels, "doc_id").filter("doc_id % 3 = 0").withColumnRenamed("quality", "truth"), model).filter("not base_failed").collect()
    assert np.mean([bool(r["truth"]) == r["kept"] for r in rows]) > 0.9


def test_quality_and_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(17)] + [(3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for frame in (docs, empty_documents(spark)):
        for known in (labels, labels.filter("doc_id > 100")):
            assert quality.judge(frame, quality.train(frame, known)).count() == frame.count()
            scored = toxicity.score_toxicity(frame, toxicity.train(frame, known), spans=True).collect()
            assert len(scored) == frame.count() and all(0 <= r["score"] <= 1 for r in scored)


# ---------------------------------------------------------------------- URLs
def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    found = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]


def _rule(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_url_rules(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://ORG", "http://org/", "http://A.Example.ORG/es/x?y#z", "https://xexample.org/es/", "http://com/fr/", "http://x.com/de/a://b", "ftp://example.org/en/1?a=1&b=2", "http://a.com?x=/fr/", "http://é.net/\n"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame([(9000 + i if i else None, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string"))
    rows = urls.judge_urls(pages.selectExpr("*", "'x' as rule", "1 as verdict", "2 as host")).collect()
    given = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(rows) == len(given)
    for r in rows:
        host, path = _parts(given[r["page_id"]])
        rule = _rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0] + rule[1])
        assert r["verdict"] == rule[2] if rule else r["verdict"] in ("allow", "block")
    assert urls.judge_urls(pages.filter("false")).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules=[]).collect()} == {"allow"}


def test_url_trees_learn(spark):
    rows = [(i, f"http://h{i % 7}.{'net' if i % 2 else 'info'}/{'x' * (5 + 30 * (i % 2))}/{i}") for i in range(400)] + [(1000 + i, f"http://h.other/{'x' * (5 + 30 * (i % 2))}/{i}") for i in range(40)]
    judged = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[("net", "/", "block"), ("info", "/", "allow")]).filter("page_id >= 1000").collect()
    assert np.mean([(r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in judged]) > 0.95


# ------------------------------------------------------------------ toxicity
def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(8)
    counts = np.array([4, 0, 1, 3])
    emission, moves = rng.normal(0, 2, counts.sum()), rng.normal(0, 1, (2, 2))
    marginal, expected = toxicity.forward_backward(emission, moves, counts)
    want, joint, at = np.zeros(len(emission)), np.zeros((2, 2)), 0
    for n in counts:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([np.exp(sum(emission[at + i] * p for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))) for path in paths])
        weight /= weight.sum()
        for path, w in zip(paths, weight, strict=True):
            want[at : at + n] += w * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                joint[a, b] += w
        at += n
    assert np.allclose(marginal, want) and np.allclose(expected, joint)


def test_long_messages_equal_short_ones(monkeypatch):
    """Texts cut into segments have the marginals of the whole, and a very long one takes seconds."""
    rng = np.random.default_rng(9)
    counts = np.array([700, 0, 1, 37, 1300, 2, 41])
    emission = rng.normal(-1, 3, counts.sum())
    for moves in (rng.normal(0, 2, (2, 2)), np.zeros((2, 2))):
        monkeypatch.setattr(toxicity, "LONG_TEXT", 1 << 20)
        whole = toxicity.forward_backward(emission, moves, counts)
        monkeypatch.setattr(toxicity, "LONG_TEXT", 20)
        cut = toxicity.forward_backward(emission, moves, counts)
        assert all(np.allclose(x, y, atol=1e-9) for x, y in zip(whole, cut, strict=True))
    began = time.perf_counter()
    toxicity.forward_backward(np.tile(emission, 800), moves, np.array([800 * len(emission)]))
    assert time.perf_counter() - began < 20


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = QUERIES["op9_toxicity"](spark, SF2).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_toxic_spans(spark):
    rng = random.Random(5)
    plain = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    texts = [" ".join(rng.choice(plain) if rng.random() < 0.6 else f"{rng.choice('äöxyz')}{rng.randrange(5000)}" for _ in range(40)) for _ in range(200)]
    rows = [(i, t if i % 2 else t.replace(" four ", " blarg! ", 3).replace("two", "blargy", 1), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source int")
    labels = spark.createDataFrame([(i, 1 if "blarg" in t else 0) for i, t, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    probe = spark.createDataFrame([(1, "é one Blargs! two"), (2, "one two")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(probe, model, spans=True).collect()}
    assert [(s["start"], s["end"]) for s in found[1]["spans"]] == [(6, 12)] and found[1]["predicted"] == 1
    assert found[2]["spans"] == [] and found[2]["predicted"] == 0


# ------------------------------------------------------------- personal data
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for found in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", found[0])
            bad = (kind == "ip" and any(int(p) > 255 for p in found[0].split("."))) or (kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == "phone" and not 8 <= len(digits) <= 15)
            if not bad:
                out.append((kind, *found.span()))
    return out


def test_base_patterns():
    rng = random.Random(7)
    bits = ["1", "2", "0", "9", ".", "@", "a", "-", "+", " ", "(", ")", "é", "12.3.4.5", "a@b.c", "4111111111111111", "+1 (555) 123-4567"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == _plain_spans(text), text


def test_segments_equal_enumeration():
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, (len(pii.KINDS), pii.BUCKETS)).astype(np.float32)
    (cluster,) = pii.clusters("12 3.4 5@6 78 90")
    scores = pii._scores(cluster, weights)

    def splits(at):
        if at == len(cluster.words):
            yield []
            return
        for rest in splits(at + 1):
            yield rest
        for j in range(at, len(cluster.words)):
            for kind in range(len(pii.KINDS)) if (at, j) in scores else ():
                for rest in splits(j + 1):
                    yield [(at, j, kind), *rest]

    every = list(splits(0))
    weight = np.array([sum(scores[i, j][k] for i, j, k in s) for s in every])
    share = np.exp(weight - np.logaddexp.reduce(weight))
    got = pii.segment_marginals(cluster, weights)
    for (i, j), p in got.items():
        want = [sum(w for s, w in zip(every, share, strict=True) if (i, j, k) in s) for k in range(len(pii.KINDS))]
        assert np.allclose(p, want, atol=1e-5)
    best = every[int(weight.argmax())]
    assert [(k, a, b) for k, a, b, _ in pii.best_segments(cluster, weights)] == [(pii.KINDS[k], *cluster.segments[i, j][:2]) for i, j, k in best]


def test_segments_hold_plain_words_and_have_no_cuts():
    weights = np.zeros((len(pii.KINDS), pii.BUCKETS), np.float32)
    card, phone = pii.KINDS.index("card"), pii.KINDS.index("phone")
    weights[:, pii.crc32(b"bias") % pii.BUCKETS] = -4
    weights[card, pii.crc32(b"runs|4-4-4-4|0") % pii.BUCKETS] = weights[phone, pii.crc32(b"runs|3-4-4|0") % pii.BUCKETS] = 12
    for kind, value in (("phone", "020 - 7946 0958"), ("card", "4111 / 1111 / 1111 / 1111")):
        assert pii.all_spans(f"say {value} now", [], weights) == [(kind, 4, 4 + len(value))]
    for before in range(250, 260):  # a table of numbers, with the card on every side of word 256
        text = "7 " * before + "4111 1111 1111 1111" + " 7" * 300
        assert pii.all_spans(text, pii.base_spans(text), weights) == [("card", 2 * before, 2 * before + 19)]
    assert len(pii.clusters("1" + " a" * (pii.LONGEST - 2) + " 2")) == 1 and len(pii.clusters("1" + " a" * (pii.LONGEST - 1) + " 2")) == 2


def test_personal_data_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, SF2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _plain_spans(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))  if base else True


def test_personal_data_odd_rows(spark):
    docs = odd_documents(spark)
    weights = pii.train(docs)
    found = pii.find_personal_data(docs, weights)
    assert found.count() == docs.count() and "kept" in found.columns
    row = found.filter("doc_id = 6").first()
    assert (row["n_email"], row["n_ip"], row["n_phone"]) == (1, 1, 1) and "[EMAIL] [IP]" in row["redacted"]
    assert found.filter("text is null").first()["redacted"] is None
    assert pii.find_personal_data(empty_documents(spark), pii.train(empty_documents(spark))).count() == 0
