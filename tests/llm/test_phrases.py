"""Phrases against plain counting of every run of words."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from turnmill.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, score string, rank string, bucket string, size string, f string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, text, lang, *"xxxxxxx") for i, (text, lang) in enumerate(rows)], SCHEMA)


def plain(rows, least, longest, covered, top):
    """(counts, result) by the definition."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang or "und", tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in candidates.items():
        if any(l2 == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= covered * a for (l2, v), b in candidates.items()):
            continue
        score, _, lf, rf = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), lf, rf))
    rows = [(lang, i, p.decode(), -a, lf, rf, total[lang], -s) for lang, found in out.items() for i, (s, a, p, lf, rf) in enumerate(sorted(found)[:top], 1)]
    return counts, rows


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["The", "of", "cat", "é", "Élan", "x1", "漢", "a", "b", "c\x0bd", "\x1c", " "]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?!", " ; "]
    rows = [("".join(rng.choice(words[: rng.randint(3, 12)]) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" .. ", "en"), ("to be or not " * 400, "en"), ("q", "en")]
    rows += [rows[5], rows[5]]
    return rows


@pytest.mark.parametrize(("least", "covered", "top", "bits"), [(30, 80, 2000, 25), (5, 80, 7, 25), (3, 50, 2000, 4), (2, 100, 2000, 12)])
def test_against_plain_counts(spark, corpus, least, covered, top, bits):
    got = phrases.mine_phrases(docs_of(spark, corpus), least=least, covered=covered, top=top, bits=bits).collect()
    assert sorted(map(tuple, got)) == sorted(plain(corpus, least, 4, covered, top)[1])


def test_blocks_and_new_numbers_lose_nothing(spark, corpus, monkeypatch):
    """Small blocks, few numbered words and short slices: phrases across their borders count all the same."""
    counted = {"blocks": 0}
    monkeypatch.setattr(phrases, "SLICE", 7)
    for size in (1, 2, 3, 4):
        numbers, found = phrases.Numbers(), Counter()
        all_ones = np.full((1 << 12) // 64, ~np.uint64(0))
        for text, lang in corpus:
            ids = np.concatenate([*numbers.read(lang or "und", (text or "").encode()), np.zeros(size, np.int64)])
            for batch in phrases._counted(ids, numbers, size, True, 12, all_ones, all_ones):
                counted["blocks"] += 1
                for row in batch.to_pylist():
                    if row["phrase"] is not None:
                        found[row["lang"], tuple(row["phrase"].split(" "))] += row["n"]
        want = {k: n for k, n in plain(corpus, 1, 4, 80, 1)[0].items() if len(k[1]) == size}
        assert found == want
    assert counted["blocks"]


def test_frequent_phrases_with_small_blocks(spark, corpus):
    import subprocess
    import sys

    # Workers read the module anew, so the bounds are changed where they read it.
    code = "from turnmill.llm import phrases as p; p.BLOCK, p.HELD_WORDS, p.SLICE = 50, 5, 9; import numpy as np; n = p.Numbers(); print(sum(map(len, n.read('en', b'ab cd. ' * 100))))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "301"


def test_products_beyond_64_bits(spark):
    a = spark.createDataFrame([(9_000_000_000_000_000_000, 9_000_000_000_000_000_000, 9_100_000_000_000_000_000)], "a long, l long, r long")
    got = a.selectExpr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) AS s").first()[0]
    assert got == 2_000_000 * 9_000_000_000_000_000_000 // (9_000_000_000_000_000_000 + 9_100_000_000_000_000_000)


def test_empty_table(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
