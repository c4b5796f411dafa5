"""Alignment against a plain comparison of the two libraries' tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import SF, empty_documents, odd_documents
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from auditweave.llm import alignment
from auditweave.llm.queries import QUERIES


@lru_cache(maxsize=1)
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), of_char


def tokens(text):
    """(id, end byte) of both sides; nothing where the bytes differ."""
    a, b, of_char = libraries()
    if not text:
        return [], []
    want, out = (" " + text).encode(), []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    spelled = [bytes(of_char[c] for c in a.id_to_token(i)) for i in ids]
    other = b.encode(text)
    pieces = [b.id_to_piece(i) for i in other]
    other_spelled = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(other, pieces, strict=True)]
    if b"".join(spelled) != want or b"".join(other_spelled) != want:
        return [], []
    for own, parts in ((ids, spelled), (other, other_spelled)):
        end, row = 0, []
        for i, part in zip(own, parts, strict=True):
            end += len(part)
            row.append((i, end))
        out.append(row)
    return out


def expected(texts):
    """The contract's columns by document, from common ends as sets."""
    split, pairs = {}, Counter()
    for key, text in texts:
        a, b = tokens(text)
        common = {e for _, e in a} & {e for _, e in b}
        links = [(x, y) for x, e in a for y, f in b if e == f] if len(a) < 300 else list(zip([x for x, e in a if e in common], [y for y, e in b if e in common], strict=True))
        groups, start = [], 0
        if len(a) < 300:
            for end in sorted(common):
                groups.append(",".join(str(x) for x, e in a if start < e <= end) + "|" + ",".join(str(y) for y, f in b if start < f <= end))
                start = end
        else:
            of = [defaultdict(list), defaultdict(list)]
            for side, row in enumerate((a, b)):
                k = 0
                for i, e in row:
                    of[side][k].append(str(i))
                    k += e in common
            groups = [",".join(of[0][k]) + "|" + ",".join(of[1][k]) for k in range(len(common))]
        split[key] = (len(a), len(b), groups, links)
        pairs.update(links)
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return {
        key: (n_a, n_b, len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for key, (n_a, n_b, groups, links) in split.items()
    }, pairs


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_plain_comparison(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op13_alignment"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == expected(texts)[0]


def test_odd_rows_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    docs = odd_documents(spark)
    extra = [(50, "a▁b"), (51, "<s> </s> <unk> <0x41>"), (52, "  double  blanks\n\n and\ttabs "), (53, "\x00 nul"), (54, "ﬁ ligature Å Å"), (55, " ")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, pairs = expected(list(enumerate(t for _, t in texts)))
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.alignment_counts(docs).collect()), key=str)
    assert got == sorted(((d, *want[i]) for i, (d, _) in enumerate(texts)), key=str)
    assert got[-1][0] is None and want[0] == (0, 0, 0, 0, 0, 0, "")
    counted = {(r["a_id"], r["b_id"]): r["count"] for r in alignment.link_counts(docs).collect()}
    assert counted == dict(pairs)
    empty = alignment.alignment_counts(empty_documents(spark))
    assert empty.count() == 0 and empty.columns == ["doc_id", *COLUMNS]


def test_groups_spell_the_text(spark):
    docs = odd_documents(spark).filter("doc_id is not null")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in alignment.align(docs).collect():
        a, b = tokens(texts[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"]) == ([i for i, _ in a], [i for i, _ in b])
        assert [a[k - 1][1] for k in r["a_cuts"]] == [b[k - 1][1] for k in r["b_cuts"]] == sorted({e for _, e in a} & {e for _, e in b})


def test_texts_cut_into_parts_give_the_tokens_of_the_whole(monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 40)
    own = alignment.Aligner(*alignment._read(None, None))
    rng = random.Random(1)
    words = ["the", "it's", "naïve", "12", "слово", "日本", "end.", "_x_", "\n", "  ", "🙂", "don't", "A1", "ﬁ", "(b)", " y", "a-b"]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "", "  "]) for _ in range(150))
        parts = own.parts(text)
        assert " ".join(parts) == text and len(parts) > 1
        found = own.groups(parts)
        a, b = tokens(text)
        if found.good.all():
            assert found.a_ids.tolist() == [i for i, _ in a] and found.b_ids.tolist() == [i for i, _ in b]
        else:
            assert a == b == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)))
def test_diagonal_runs_find_all_common_ends(a, b):
    a, b = sorted(a | {121}), sorted(b | {121})
    cuts = [(x + k, y + k) for x, y, n in zip(*alignment.diagonal_runs(a, b), strict=True) for k in range(n)]
    assert cuts == [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]
    assert alignment.diagonal_runs([], []) == ([], [], [])
