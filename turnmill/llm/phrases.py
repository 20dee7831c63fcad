"""Phrases by hashed counting passes (PCY, DHP) and their scores by the weakest cut.

Pass n counts phrases of n words exactly, and at the same time the buckets that phrases of n + 1 words hash to.
A phrase of n + 1 words is counted in the next pass only where its bucket has ``least`` occurrences and both of its
phrases of n words are frequent.  Both are told by bit maps of fixed size, which go to every task; they let too
much through at worst, so what is counted exactly decides.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import durable, ship

#: Bits of a bucket's number: 2^25 buckets are a bit map of 4 MB.
BUCKET_BITS = 25
#: Word positions that a task counts at a time, and distinct words that it numbers before it begins anew.
BLOCK = 1 << 19
HELD_WORDS = 300_000
#: Characters of a long text that are split at a time.
SLICE = 1 << 20
#: Parts that a language's candidates are dealt into before the best are taken.
SALTS = 64

# What ends a piece, and what separates words inside one.
STOPS = r".,;:!?\x0A-\x0D"
BLANKS = r"\x20\x09"
_GAP = re.compile(f"[{BLANKS}{STOPS}]".encode())
#: A-Z lower-cased and every stop the same, in one step over the bytes of a text; blanks are then all that separates.
_STOP = b"."
_PLAIN = bytes(ord(_STOP) if re.match(f"[{STOPS}]", chr(i)) else ord(chr(i).lower()) if i < 128 else i for i in range(256))

COUNTED = "lang string, phrase string, bucket int, n bigint"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


class _Words(dict):
    """Numbers of one language's words, from 1 on over all languages; stops are 0."""

    def __init__(self, lang: str, owner: Numbers):
        self.lang, self.owner = lang, owner

    def __missing__(self, unit: bytes) -> int:
        number = 0 if unit == _STOP else self.owner.add(self.lang, unit)
        self[unit] = number
        return number


class Numbers:
    """The words that a task has met, each language's by themselves, with 64-bit hashes."""

    def __init__(self):
        self.words, self.langs, self.hashes, self.of_lang = [b""], [""], array("Q", [0]), {}

    def add(self, lang: str, word: bytes) -> int:
        self.words.append(word)
        self.langs.append(lang)
        self.hashes.append(xxhash.xxh3_64_intdigest(b"%d:%b%b" % (len(lang), lang.encode(), word)))
        return len(self.words) - 1

    def read(self, lang: str, text: bytes) -> Iterator[np.ndarray]:
        """The words of a text in UTF-8 as numbers, a slice of it at a time; a stop at the end."""
        known = self.of_lang.get(lang)
        if known is None:
            known = self.of_lang[lang] = _Words(lang, self)
        at = 0
        while at < len(text):
            cut = _GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            units = text[at:end].translate(_PLAIN).replace(_STOP, b" . ").split()
            yield np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            at = end
        yield np.zeros(1, np.int64)


def _buckets(hashes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bucket of the phrase of ``size`` words that begins at each position."""
    n = len(hashes) - size + 1
    h = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 6] >> (buckets & 63).astype(np.uint64)) & np.uint64(1) == 1


def _counted(ids: np.ndarray, numbers: Numbers, size: int, last: bool, bits: int, open_buckets: np.ndarray | None, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of one block for phrases that begin before its last ``size`` positions: exact counts of phrases of ``size`` words,
    bucket counts of those one word longer (unless this is the ``last`` pass), words by language (in the first)."""
    starts = len(ids) - size
    is_word = ids > 0
    hashes = np.frombuffer(numbers.hashes, np.uint64)[ids]
    fits = reduce(np.logical_and, (is_word[k : k + starts + 1] for k in range(size)))
    own = _buckets(hashes, size, bits)
    if size > 1:
        fits &= _set(open_buckets, own)
        shorter = _set(frequent, _buckets(hashes, size - 1, bits))
        fits &= shorter[: starts + 1] & shorter[1 : starts + 2]
    at = np.flatnonzero(fits[:starts])
    # Numbers for distinct phrases, without loss: word by word, made dense whenever the next word wouldn't fit.
    key, n_words = ids[at], len(numbers.words)
    for k in range(1, size):
        if len(key) and int(key.max() + 1).bit_length() + n_words.bit_length() > 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * n_words + ids[at + k]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    first = at[first]
    words, langs = pa.array(numbers.words, pa.binary()), pa.array(numbers.langs, pa.string())
    parts = [words.take(pa.array(ids[first + k])) for k in range(size)]
    phrase = pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]
    yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[first])), phrase.cast(pa.string()), pa.array(own[first].astype(np.int32)), pa.array(times)], schema=_ARROW)
    if size == 1:
        names, which = np.unique(np.array([numbers.langs[i] for i in ids[first]], dtype=object), return_inverse=True)
        yield _rows(len(names), lang=pa.array(names.tolist(), pa.string()), n=pa.array(np.bincount(which, times, len(names)).astype(np.int64)))
    if not last:
        longer = fits[:starts] & fits[1 : starts + 1] & is_word[size : size + starts]
        bucket, times = np.unique(_buckets(hashes, size + 1, bits)[:starts][longer], return_counts=True)
        yield _rows(len(bucket), bucket=pa.array(bucket.astype(np.int32)), n=pa.array(times))


def _rows(height: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(height, f.type) for f in _ARROW], schema=_ARROW)


def _pass(texts: DataFrame, size: int, last: bool, least: int, bits: int, maps) -> DataFrame:
    """COUNTED rows: phrases (with their bucket), buckets (phrase null) of ``least`` occurrences or more, words by language (both null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_buckets, frequent = maps.value if maps else (None, None)
        numbers, held, n = Numbers(), [], 0

        def told(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            ids = np.concatenate([*held, np.zeros(size * final, np.int64)])
            if len(ids) > size:
                yield from _counted(ids, numbers, size, last, bits, open_buckets, frequent)
            held = [] if final else [ids[len(ids) - size :]]
            n = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for ids in numbers.read(lang, text):
                    held.append(ids)
                    n += len(ids)
                    if n >= BLOCK:
                        yield from told(False)
                if len(numbers.words) > HELD_WORDS:
                    yield from told(True)
                    numbers = Numbers()
        if held:
            yield from told(True)

    summed = texts.mapInArrow(count, COUNTED).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
    return durable(summed.where(f"n >= {least} or (phrase is null and bucket is null)"))


def _bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the rows' buckets: at most 2^bits / 64 rows of a number each come to the driver."""
    found = rows.groupBy(F.expr("bucket >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, bucket & 63))").alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, bits: int = BUCKET_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to ``longest`` words with f >= ``least``, and (lang, n): all words by language.

    A-Z are lower-cased; a phrase doesn't reach over a stop (.,;:!? or a line end); occurrences may overlap.  Null texts are empty,
    a null language is ``und``.  Texts may be of any length.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    found, totals, maps = [], None, None
    for size in range(1, longest + 1):
        rows = _pass(texts, size, size == longest, least, bits, maps)
        phrases = rows.where("phrase is not null")
        if size == 1:
            totals = rows.where("phrase is null and bucket is null").select("lang", "n")
        found.append(phrases.select("lang", "phrase", F.lit(size).alias("size"), F.col("n").alias("f")))
        if size < longest:
            maps = docs.sparkSession.sparkContext.broadcast((_bitmap(rows.where("phrase is null and bucket is not null"), bits), _bitmap(phrases, bits)))
    return reduce(DataFrame.unionByName, found), totals


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000, bits: int = BUCKET_BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Of a phrase of 2 to ``longest`` words with a = f(phrase) >= ``least``, each cut in two with l and r occurrences scores
    floor(2000000 * a / (l + r)); its lowest cut counts, ties to the shortest first part.  A phrase goes if a longer one, itself kept
    or not, holds it and has ``covered`` percent of its occurrences or more.  n: all words of the language.  Ties in score go to the larger
    a, then to the phrase's bytes.  Products are decimals, so no count overflows.  Repeated rows count as often as they occur, an
    empty table has no phrases, other columns are ignored.
    """
    each, totals = frequent_phrases(docs, text_col, lang_col, least, longest, bits)
    words = each.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")
    cuts = words.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    f = each.select("lang", F.col("phrase").alias("part"), "f")
    for side, out in (("left", "l"), ("right", "r")):
        cuts = cuts.join(f.withColumnsRenamed({"part": side, "f": out}), ["lang", side]).drop(side)
    scored = cuts.withColumn("score", F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")

    inside = words.where("size > 2").select("lang", "size", "w", F.col("a").alias("f"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = inside.select("lang", "f", "m", "w", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i")).select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "f")
    holders = inside.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = weakest.join(holders, ["lang", "phrase"], "left").where(F.expr(f"held is null or cast(held as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {covered}"))

    # The best of each part of a language, then of the parts: no task meets a whole language.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = kept.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_r") <= top).drop("_s", "_r")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
