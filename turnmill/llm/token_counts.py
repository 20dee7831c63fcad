"""Token counts of whole texts, without token ids.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so a text's count is the sum over
its distinct pre-tokens of their frequency times their number of pieces.  Each pre-token of the corpus is
encoded once; the numbers of pieces are then joined to the frequencies of each document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import durable, remembered, ship

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that go to every task with their numbers of pieces: the most frequent ones, of at most so many bytes each.
FREQUENT = 300_000
FREQUENT_BYTES = 64
#: Distinct pre-tokens that a task gathers before it hands them on.
HELD = 300_000
#: Characters below this one are classified by a table; texts with any other are split by the library itself.
TABLE_END = 0x530


def _ranges(kind: str) -> str:
    """Characters below TABLE_END of the general category ``kind``, as ranges of a character class."""
    held = {c for c in range(TABLE_END) if unicodedata.category(chr(c))[0] == kind}
    firsts, lasts = ([c for c in sorted(held) if c + step not in held] for step in (-1, 1))
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts, lasts, strict=True))


def quick_pattern() -> str:
    """The split of byte-level BPE for texts of characters below TABLE_END."""
    letters, numbers, space = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
    return f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


class PreTokens:
    """Pre-tokens of a byte-level BPE as the ``tokenizers`` library gives them, and their numbers of pieces."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the cores
        from tokenizers import Tokenizer

        asked = json.loads(definition)
        split = asked.get("pre_tokenizer") or {}
        added = asked.get("added_tokens") or []
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or asked.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser and prefix space splits into independent pre-tokens")
        if any(not x["special"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.quick = re.compile(quick_pattern()).findall
        self.beyond = re.compile(f"[^\\x00-{chr(TABLE_END - 1)}]").search
        #: Special strings inside texts are one token each, the longest first.
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings it holds."""
        if self.special is None or not self.special.search(text):
            return self._plain(text), 0
        parts = self.special.split(text)
        return [x for part in parts for x in self._plain(part)], len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if self.beyond(text) is None:
            return self.quick(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]


def piece_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(pre_token, times, pieces): every distinct pre-token of the texts once, with its frequency in the corpus and its number of pieces.

    Null and empty texts have none.
    """
    ship(docs.sparkSession)
    shared = _definition(docs, path)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = _pre_tokens(shared), Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(known.split(text)[0])
                if len(seen) > HELD:
                    yield pd.DataFrame({"pre_token": seen.keys(), "times": seen.values()})
                    seen = Counter()
        yield pd.DataFrame({"pre_token": seen.keys(), "times": seen.values()}).astype({"pre_token": "object", "times": "int64"})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _pre_tokens(shared)
        for batch in batches:
            yield batch.assign(pieces=pd.Series(known.pieces(batch["pre_token"].tolist()), index=batch.index, dtype="int64"))

    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''")
    distinct = texts.mapInPandas(gather, "pre_token string, times bigint").groupBy("pre_token").agg(F.sum("times").alias("times"))
    return distinct.mapInPandas(encode, "pre_token string, times bigint, pieces bigint")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal those of the ``tokenizers`` library for the whole text, without begin or end tokens, truncation and padding;
    special strings inside a text count as one token each.  A null or empty text has no bytes and no tokens; texts may be of any
    length, a null id stays null, repeated rows give repeated rows, an empty table an empty result; other columns are ignored.

    The ``frequent`` most frequent short pre-tokens go to every task.  The frequencies of all others are joined by shuffle.
    """
    spark = docs.sparkSession
    shared = _definition(docs, path)
    counted = durable(piece_counts(docs, text_col, path))
    common = spark.sparkContext.broadcast(_most_frequent(counted, frequent))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, pieces_of = _pre_tokens(shared), common.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                pre_tokens, total = known.split(text)
                rare = []
                for pre_token, times in Counter(pre_tokens).items():
                    if (pieces := pieces_of.get(pre_token)) is None:
                        rare.append((pre_token, times))
                    else:
                        total += times * pieces
                rows.append((total, rare))
            yield batch[["doc_id", "n_bytes"]].assign(sure=pd.Series([r[0] for r in rows], index=batch.index, dtype="int64"), rare=pd.Series([r[1] for r in rows], index=batch.index, dtype="object"))

    text = F.coalesce(text_col, F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = "doc_id bigint, n_bytes bigint, sure bigint, rare array<struct<pre_token:string,times:bigint>>"
    each = durable(texts.mapInPandas(sums, schema).withColumn("row", F.monotonically_increasing_id()))
    left = each.select("row", F.explode("rare").alias("r")).select("row", "r.pre_token", "r.times")
    added = left.join(counted.select("pre_token", "pieces"), "pre_token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("sure") + F.coalesce("more", F.lit(0))
    return each.select("row", "doc_id", "n_bytes", "sure").join(added, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def _most_frequent(counted: DataFrame, most: int) -> dict[str, int]:
    """Numbers of pieces of at most ``most`` short pre-tokens: those from the least frequency on that so many reach.

    Frequencies are looked up by halves of powers of two, so that what comes to the driver before the choice is some 120 numbers.
    """
    short = counted.where(F.octet_length("pre_token") <= FREQUENT_BYTES).withColumn("level", F.floor(F.log2(F.col("times").cast("double")) * 2))
    least, total = None, 0
    for level, n in sorted(map(tuple, short.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return {}
    chosen = short.where(F.col("level") >= least).select("pre_token", "pieces").toArrow().to_pydict()
    return dict(zip(chosen["pre_token"], chosen["pieces"], strict=True))


def _definition(docs: DataFrame, path: str | None):
    """The tokenizer's definition (a file of fixed size, under 2 MB) as a broadcast.  Executors needn't have the file."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        definition = file.read()
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(definition.encode()).hexdigest(), definition))


def _pre_tokens(shared) -> PreTokens:
    """One splitter per Python worker and definition."""
    return remembered(f"pre-tokens {shared.value[0]}", lambda: PreTokens(shared.value[1]))
