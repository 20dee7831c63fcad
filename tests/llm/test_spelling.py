"""Spelling variants against comparing every two words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from turnmill.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, key string, len string, root string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, shortest=5, least=3, slip=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    form, count = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        count[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    letters = "etabcéÉÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaaaaa", "a" * 300, "th" * 9]
    rows = []
    for i in range(500):
        words = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(w.upper() if w.isascii() and rng.random() < 0.3 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "中", "\n"]).join(words)))
    return rows + rows[:40] + [(None, rows[7][1]), (None, "a b c d"), (900, None), (901, ""), (902, " .. "), (903, "longer " * 9000)]


@pytest.mark.parametrize("many", [256, 6, 1])
def test_against_every_pair(spark, corpus, many):
    got = spelling.spelling_groups(docs_of(spark, corpus), least=2, many=many, slip=7).collect()
    want = plain(corpus, least=2, slip=7)
    assert sum(r[1] is not None for r in want) > 50
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want


def test_one_edit_flips_two_bits_at_most(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    rows = []
    for _ in range(400):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 20)))
        at, new = rng.randrange(len(a)), rng.choice(letters)
        rows.append((a, rng.choice([a[:at] + new + a[at:], a[:at] + new + a[at + 1 :], a[:at] + a[at + 1 :]])))
    df = spark.createDataFrame(rows, "a string, b string").select(spelling.mask("a").alias("a"), spelling.mask("b").alias("b"))
    masks = df.collect()
    assert all(bin(r.a ^ r.b).count("1") <= 2 for r in masks)
    assert len({r.a for r in masks}) > 350


def test_chain_to_root(spark):
    text = " ".join(["words"] * 100 + ["wordsx"] * 40 + ["wordsxy"] * 15 + ["wordsxyz"] * 6 + ["other"] * 5)
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_groups(docs_of(spark, [(1, text)]), slip=None).collect()}
    assert got == {"words": (None, "words"), "wordsx": ("words", "words"), "wordsxy": ("wordsx", "words"), "wordsxyz": ("wordsxy", "words"), "other": (None, "other")}


def test_one_hot_group(spark):
    """Words that share band and length by the thousand: no group of more than ``many`` words is compared, and no pair is lost."""
    words = [f"prefix{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}suffix" for i in range(0, 26**3, 5)]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    known = set(words)
    want = {tuple(sorted((w, v))) for w in words for at in (6, 7, 8) for c in "abcdefghijklmnopqrstuvwxyz" if (v := w[:at] + c + w[at + 1 :]) != w and v in known}
    got = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df, many=64).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
