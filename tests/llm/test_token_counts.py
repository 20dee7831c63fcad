"""Token counts against the library that owns the vocabulary."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from turnmill.llm import token_counts

SCHEMA = "doc_id long, text string, n_tokens string, rare string, row string, pre_token string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def of(text, library):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("frequent", [0, 40, 300_000])
def test_counts(spark, library, frequent):
    rng = random.Random(3)
    words = ["the", "Ünï", "x1y2", "don't", "we'll", "'s", "  ", "\n\n", "\t", " ", "漢字", "😀", "<|endoftext|>", "<|endof", "...", "--", "\x1c", " ", " ", "߸", "ꟍ", "١٢٣"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += [None, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|> b", "y" * 30_000, "word " * 40_000, "é" * 5_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "one two")]
    got = token_counts.count_tokens(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA), frequent=frequent).collect()
    want = [(i, len((t or "").encode()), of(t, library), of(t, library) > 512) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_each_pre_token_once(spark):
    found = token_counts.piece_counts(spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a  b", " b", None, ""])], "doc_id long, text string")).collect()
    assert {r["pre_token"]: r["times"] for r in found} == {"a": 2, " b": 3, " ": 1}
    assert len(found) == 3


def test_split_of_every_character(library):
    known = token_counts.PreTokens(open(public_tokenizers.path(token_counts.VOCABULARY), encoding="utf-8").read())
    for point in range(token_counts.TABLE_END):
        text = f"a{chr(point)}b 1{chr(point)} {chr(point)}x{chr(point)}{chr(point)} '"
        assert known.split(text)[0] == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], point


def test_empty_table(spark):
    df = token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert df.collect() == []


def test_other_kinds_are_refused(spark, tmp_path):
    file = tmp_path / "t.json"
    file.write_text(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), encoding="utf-8")
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PreTokens(file.read_text(encoding="utf-8"))
