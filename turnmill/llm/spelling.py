"""Spelling variants: words one inserted, deleted or replaced letter apart.

A word's mask has one bit per letter, set where the letter occurs an odd number of times.  One edit flips two bits at
most, so of three bands of the mask at least one stays equal: words are joined by band, value of the band and length,
and verified.  A group of a band with more than ``MANY`` words is split by place: the edit falls into one half of the
word, so two variants agree outside of it; halves are halved again until a group is small or one place is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import ascii_lower, durable, forget

#: Fixed value: what a word consists of.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words that are compared with each other in one group at most, unless a single place is left to differ.
MANY = 256
#: Keys of large groups that go to every task; more are joined by shuffle.
MOST_KEYS = 1_000_000
#: Letters by falling frequency, dealt over the bands in turn, so that each band tells words apart about as well.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz"
#: Bits 0 to 20, 21 to 41 and 42 to 62 of a mask are its bands.
BANDS, WIDTH = 3, 21
#: Jumps of doubling length that reach the end of any chain of forms: counts at least double from word to form.
JUMPS = 6


def mask(word: Column) -> Column:
    """Parity of the letters of each bit, as a long.  Letters beyond a-z share the bits."""

    def bit(letter: Column) -> Column:
        at = F.instr(F.lit(BY_FREQUENCY), letter)
        rank = F.when(at > 0, at - 1).otherwise(F.ascii(letter))
        return F.call_function("shiftleft", F.lit(1).cast("long"), ((rank % BANDS) * WIDTH + F.floor(rank / BANDS) % WIDTH).cast("int"))

    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda seen, letter: F.when(letter == "", seen).otherwise(seen.bitwiseXOR(bit(letter))))


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = 97) -> DataFrame:
    """(word, n): words of the texts, A-Z lower-cased, and how often they occur.

    Where ``slip`` divides h, the crc32 of ``<doc_id>:<word>``, the letter at place h % length is left out; None: nowhere.
    A null id stands as nothing before the colon, null texts have no words, and of a word of one letter that is left out no word remains.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("id", ascii_lower(F.col("run")).alias("word"))
    if slip is not None:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        slipped = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.withColumn("word", F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("word")))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key: band, its value, the length of the shorter word, and the word outside of the places ``lo`` to ``hi`` - 1 where the edit may be."""
    outside = [F.substring(F.col("word"), F.lit(1), F.col("lo")), F.when(F.col("hi") < F.col("len"), F.expr("substring(word, char_length(word) - (len - hi) + 1)")).otherwise("")]
    return rows.withColumn("key", F.xxhash64("len", "band", _band("mask", F.col("band")), "lo", "hi", *outside))


def _band(column: str, band: Column) -> Column:
    return F.call_function("shiftright", F.col(column), (band * WIDTH).cast("int")).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _matches(rows: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): verified pairs of equal keys; a pair only counts in the first band on which it agrees."""
    left = rows.where("role = 0").select("key", "band", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    right = rows.select("key", "role", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"))
    flipped = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2
    first = reduce(lambda x, y: x & y, ((F.col("band") <= k) | (_band("a_mask", F.lit(k)) != _band("b_mask", F.lit(k))) for k in range(BANDS - 1)))
    new = (F.col("role") == 1) | (F.col("a") < F.col("b"))
    return left.join(right, "key").where(new & flipped & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, many: int = MANY) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n; distinct) that differ by one inserted, deleted or replaced code point, once.

    Complete for words over any letters and of any length.  A word takes part in groups of its own length (role 0) and, as the longer
    one of a pair, in those of the length below (role 1).
    """
    sized = words.select("word", "n", F.char_length("word").alias("size"), mask(F.col("word")).alias("mask"))
    rows = sized.select("word", "n", "mask", F.explode(F.array(*[F.struct((F.col("size") - role).alias("len"), F.lit(role).alias("role"), F.lit(band).alias("band")) for role in (0, 1) for band in range(BANDS)])).alias("x"))
    rows = _keyed(rows.select("word", "n", "mask", "x.*", F.lit(0).alias("lo"), (F.col("x.len") + 1).alias("hi")))
    found, kept = [], []
    while True:
        large = durable(rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > many).select("key"))
        kept.append(large)
        n_large = large.count()
        keys = F.broadcast(large) if n_large <= MOST_KEYS else large
        found.append(_matches(rows.join(keys, "key", "left_anti") if n_large else rows))
        if not n_large:
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))).alias("x")
        rows = durable(_keyed(rows.join(keys, "key", "left_semi").select("word", "n", "mask", "len", "role", "band", halves).select("word", "n", "mask", "len", "role", "band", "x.*")))
        kept.append(rows)
    pairs = durable(reduce(DataFrame.unionByName, found).dropDuplicates(["a", "b"]))
    forget(*kept)
    return pairs


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, times: int = 2, slip: int | None = 97, many: int = MANY) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``shortest`` code points and ``least`` occurrences or more.

    form: the near word (one edit away) with the largest n, ties to the smaller in code-point order, if its n is at least ``times`` (2 or
    more) that of the word; else null, and so form_n.  root: where the chain of forms ends; the word itself if it has no form.
    n_near counts near words.  Repeated rows count as often as they occur; words may be of any length; an empty table
    has no words; other columns are ignored.
    """
    if times < 2:
        raise ValueError("times below 2 doesn't bound the chains of forms")
    words = durable(counted_words(docs, id_col, text_col, slip).where((F.char_length("word") >= shortest) & (F.col("n") >= least)))
    pairs = near_words(words, many)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    good = -F.col("best.less") >= F.col("n") * times
    told = durable(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    ends = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = durable(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ends = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    forget(pairs)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
