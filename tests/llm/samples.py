"""Small tables with everything that may come: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, component long, size string, target int, digest int, spans string, held int"

ODD_TEXTS = [
    None, "", " \t\n\r ", "word", "Word", "two words", "12 34 +1 (555) 010-9999 a.b@c.de 10.0.0.1", "x" * 5000, "ab " * 20_000,
    "naïve café\u2028line \u00a0 nbsp", "<|endoftext|> it's we'LL they've  \n\n x", "日本語 テキスト Ελληνικά русский", "🙂 é e\u0301", "!!! ???",
    "the same text again", "the same text again", "a,b;c 'quoted' don't\r\nline\n\nline\nline",
]


def odd_documents(spark):
    rows = [(i if i != 13 else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, None, "no", 7, "big", 1, 2, "s", 3) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[15], rows[15], rows[3], (None, "without an id", "de", "s1", 3, 0.5, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return odd_documents(spark).filter(F.lit(False))


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(texts: dict, n: int, percent: int = 80) -> dict:
    """Smallest id reachable through all pairs of texts, by plain comparison."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}
