"""Toxic spans and document scores by a linear-chain conditional random field.

1. Labelled tokens: from labelled training documents, how often each word, and each prefix of 3 to 8 letters, occurs in toxic and in other
   documents.  Where a toxic document has a word with significantly more toxic documents, or with such a prefix, that token is labelled toxic.
   These words serve for labels alone; no score looks them up.
2. A chain over the tokens of whole labelled texts is fitted to those labels.  Its features are hashed: a token's word, prefixes, suffixes and
   shape, and the words before and behind it.
3. Every text is tagged as a whole: forward-backward marginals give the offending offsets, and their sum and noisy-or, by a logistic
   curve fitted to the training documents, the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import durable, ship
from turnmill.llm.crf import expectations, marginals, maximise
from turnmill.llm.near_dedup import Near, linked
from turnmill.llm.shingles import mix, shingle_set

#: Bounds of the fit, in labelled rows chosen by seeded hash: of token labels and the curve; of the chain, for each of the two labels.
SAMPLE, CHAIN_SAMPLE = 20_000, 1_500
#: Least log-odds of a word or prefix in toxic documents, for a labelled token.
LEAST_ODDS = 3.5
#: How many words and prefixes may be among those by chance.
CHANCE = 3
#: What counts as a copy of a training document: a similarity of 0.8 of the whole sets of three-word shingles.
COPIES = Near(words=3, percent=80)
MIN_HASHES = 16
#: Hashed features; tokens of a piece of the fit; passes and shrinkage of the fit; marginals below FLOOR don't count for a document.
DIMENSION, PIECE, ROUNDS, SHRINK, FLOOR = 1 << 17, 100_000, 25, 0.1, 0.05
#: Tasks of the chain's fit, each of which sends one gradient (a megabyte) to the driver in each pass.
PARTIAL_SUMS = 4
LETTERS = re.compile(r"[^\W\d_]+")


def keys_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, min(8, len(word)) + 1))]


#: Beginnings of the hashed names of features: word, prefix, suffix, shape, word before, word behind; and the one that every token has.
WORD, PREFIX, SUFFIX, SHAPE, BEFORE, BEHIND, EVERY = (zlib.crc32(mark) for mark in (b"=", b"^", b"$", b"#", b"<", b">", b"*"))


def features_of(word: str) -> list[int]:
    """Numbers of a token's own features: word, prefixes of 3 to 8 letters, suffixes of 2 and 3, shape."""
    low, crc = word.lower(), zlib.crc32
    raw = low.encode("utf-8", "surrogatepass")
    plain = len(raw) == len(low)
    out = [crc(raw, WORD)]
    # The hash of a prefix goes on from that of the one before it.
    at = crc(raw[:2] if plain else low[:2].encode("utf-8", "surrogatepass"), PREFIX)
    for n in range(2, min(8, len(low))):
        at = crc(raw[n : n + 1] if plain else low[n].encode("utf-8", "surrogatepass"), at)
        out.append(at)
    for n in (2, 3):
        if len(low) > n:
            out.append(crc(raw[-n:] if plain else low[-n:].encode("utf-8", "surrogatepass"), SUFFIX))
    out.append(crc(b"%d" % (min(len(word), 12) + (0 if word == low else 20 if word.isupper() else 40)), SHAPE))
    out.append(EVERY)
    return [x % DIMENSION for x in out]


def beside(word: str, mark: int) -> int:
    """Number of the feature of a token with this word next to it: BEFORE or BEHIND."""
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass"), mark) % DIMENSION


class Weighed(dict):
    """word -> place of its three weights: as the token itself, before one, behind one.  Forgotten between batches when too many."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.parts = weights.tolist(), ([], [], [])

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self.parts[0])
        self.parts[0].append(sum(map(self.weights.__getitem__, features_of(word))))
        self.parts[1].append(self.weights[beside(word, BEFORE)])
        self.parts[2].append(self.weights[beside(word, BEHIND)])
        return place

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of the texts: log potentials of label 1, where a text begins, and the texts' first tokens (one more at the end)."""
        if len(self) > 200_000:
            self.clear()
            self.parts = ([], [], [])
        lists = [[self[w] for w in LETTERS.findall(t)] for t in texts]
        ends = np.cumsum([0, *map(len, lists)])
        at = np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1]))
        own, before, behind = (np.array(p) for p in self.parts)
        return (*joined_emissions(at, ends, own, before, behind), ends)


def joined_emissions(at: np.ndarray, ends: np.ndarray, own: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.zeros(len(at), bool)
    start[ends[:-1][np.diff(ends) > 0]] = True
    emit = own[at] if len(at) else np.zeros(0)
    if len(at) > 1:
        inner = ~start[1:]
        emit[1:] += before[at[:-1]] * inner
        emit[:-1] += behind[at[1:]] * inner
    return emit, start


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    curve: tuple[float, float, float]
    cut: float = 0.5


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most about ``sample`` labelled documents, chosen by a hash of doc_id.  Several labels of a document count as the largest.

    Of copies and near copies of one label the least doc_id is kept, else the words of a text that was copied a hundred
    times would look like a hundred witnesses.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    chosen = own.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    # The side sent to every task has ``sample`` rows at most, whatever the input's size.
    rows = durable(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "toxic").dropDuplicates(["_id"]))
    return durable(rows.join(copies_among(rows), F.col("_id") == F.col("_copy"), "left_anti").select("text", "toxic"))


def copies_among(rows: DataFrame) -> DataFrame:
    """_copy: ids of rows that are copies, by the full shingle sets, of a row of their label with a lesser id.

    Candidates are the least ids among the rows that share one of MIN_HASHES least hashes; a shared one alone proves nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salts = mix(np.arange(1, MIN_HASHES + 1, dtype=np.uint64))
        for batch in batches:
            ids, labels, buckets = [], [], []
            for row, text, toxic in zip(batch["_id"], batch["text"], batch["toxic"], strict=True):
                found = shingle_set(text, COPIES.words)
                if len(found):
                    ids += [row] * MIN_HASHES
                    labels += [toxic] * MIN_HASHES
                    buckets += [int(mix(found ^ salt).min()) >> 1 for salt in salts]
            yield pd.DataFrame({"_id": np.array(ids, np.int64), "toxic": np.array(labels, np.int32), "bucket": np.array(buckets, np.int64)})

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([linked(shingle_set(x, COPIES.words), shingle_set(y, COPIES.words), COPIES) for x, y in zip(left, right, strict=True)], dtype=bool)

    buckets = rows.mapInPandas(run, "_id long, toxic int, bucket long")
    lead = Window.partitionBy("toxic", "bucket")
    # Buckets of a sample of bounded size.
    pairs = buckets.withColumn("lead", F.min("_id").over(lead)).where("_id <> lead").select("_id", "lead").distinct()
    text = lambda name: rows.select(F.col("_id").alias(f"_{name}"), F.col("text").alias(name))
    met = pairs.join(text("a"), F.col("lead") == F.col("_a")).join(text("b"), F.col("_id") == F.col("_b"))
    return met.where(alike("a", "b")).select(F.col("_id").alias("_copy")).distinct()


def learn_lexicon(rows: DataFrame) -> set[str]:
    """Words (``=word``) and prefixes (``^pre``) of toxic documents; their number depends on the training rows' vocabulary alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[toxic].update({k for w in set(LETTERS.findall((text or "").lower())) for k in keys_of(w)})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield told(seen)
        yield told(seen)

    def told(seen) -> pd.DataFrame:
        out = pd.DataFrame({"key": pd.Series([*seen[0], *seen[1]], dtype=object), "toxic": np.repeat([0, 1], [len(seen[0]), len(seen[1])]).astype("int32"), "n": np.array([*seen[0].values(), *seen[1].values()], np.int64)})
        for c in seen:
            c.clear()
        return out

    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return set()
    a, b, share = F.col("a"), F.col("b"), bad / (bad + good)
    counts = rows.mapInPandas(run, "key string, toxic int, n long").groupBy("key").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).where("a >= 3")
    counts = durable(counts)
    # An entry's log-likelihood ratio must be one that chance gives to about CHANCE of all entries tested.
    least = 2 * float(np.log(max(counts.count(), 1) / CHANCE))
    odds = F.ln((a + 0.5) / (b + 0.5)) - float(np.log((bad + 1) / (good + 1)))
    evidence = 2 * (a * F.ln(a / ((a + b) * share)) + F.when(b > 0, b * F.ln(b / ((a + b) * (1 - share)))).otherwise(0.0))
    strong = counts.select("key", odds.alias("odds"), evidence.alias("evidence")).where((F.col("odds") > LEAST_ODDS) & (F.col("evidence") > least))
    return {r["key"] for r in strong.select("key").toLocalIterator()}


def pieces_of(rows: DataFrame, lexicon: set[str]) -> DataFrame:
    """The tokens of training texts in pieces for the fit: arrays of word places, labels and chains' ends, and the features of each word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marked: dict[str, bool] = {}

        def label(word: str) -> bool:
            if (known := marked.get(word)) is None:
                marked[word] = known = any(k in lexicon for k in keys_of(word.lower()))
            return known

        def packed(chains: list[tuple[list[str], int]]) -> pd.DataFrame:
            places: dict[str, int] = {}
            at = np.array([places.setdefault(w, len(places)) for words, _ in chains for w in words], np.int32)
            toxic = np.array([t and label(w) for words, t in chains for w in words], bool)
            own = [features_of(w) for w in places]
            out = {"at": at, "toxic": toxic, "ends": np.cumsum([0, *(len(w) for w, _ in chains)]).astype(np.int64), "sizes": np.array(list(map(len, own)), np.int32), "own": np.array([f for one in own for f in one], np.int32)}
            out |= {"before": np.array([beside(w, BEFORE) for w in places], np.int32), "behind": np.array([beside(w, BEHIND) for w in places], np.int32)}
            return pd.DataFrame({k: [v.tobytes()] for k, v in out.items()})

        chains, n = [], 0
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = LETTERS.findall(text or "")
                # A text beyond PIECE tokens is fitted as several chains; scores never cut one.
                for i in range(0, len(words), PIECE):
                    chains.append((words[i : i + PIECE], toxic))
                    n += len(chains[-1][0])
                    if n >= PIECE:
                        yield packed(chains)
                        chains, n = [], 0
        if chains:
            yield packed(chains)

    return rows.mapInPandas(run, ", ".join(f"{c} binary" for c in PIECE_COLUMNS))


PIECE_COLUMNS = {"at": np.int32, "toxic": bool, "ends": np.int64, "sizes": np.int32, "own": np.int32, "before": np.int32, "behind": np.int32}


def gradient(piece: dict[str, np.ndarray], weights: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log-likelihood of a piece's labels: by feature and by pair of labels; and the log-likelihood."""
    at, ends, labels = piece["at"], piece["ends"], piece["toxic"].astype(float)
    n_words = len(piece["sizes"])
    word_of = np.repeat(np.arange(n_words), piece["sizes"])
    own = np.bincount(word_of, weights=weights[piece["own"]], minlength=n_words)
    emit, start = joined_emissions(at, ends, own, weights[piece["before"]], weights[piece["behind"]])
    chance, pairs, total = expectations(emit, start, step)
    left = labels - chance
    by_word = np.bincount(at, weights=left, minlength=n_words)
    inner = ~start[1:]
    by_before = np.bincount(at[:-1], weights=left[1:] * inner, minlength=n_words)
    by_behind = np.bincount(at[1:], weights=left[:-1] * inner, minlength=n_words)
    out = np.bincount(piece["own"], weights=by_word[word_of], minlength=DIMENSION)
    out += np.bincount(piece["before"], weights=by_before, minlength=DIMENSION) + np.bincount(piece["behind"], weights=by_behind, minlength=DIMENSION)
    before = np.where(start, 0, np.concatenate([[0], labels[:-1]]))
    seen = np.bincount((before * 2 + labels).astype(int), minlength=4).reshape(2, 2)
    return out, seen - pairs, float(emit @ labels + (seen * step).sum() - total)


def learn_chain(rows: DataFrame, lexicon: set[str], sample: int = CHAIN_SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and label steps of greatest likelihood.  The tokens stay in the tasks, each round sums their gradients.

    Fitted to about ``sample`` rows of each label at most, whole texts, chosen by hash.
    """
    spark = rows.sparkSession
    order = F.xxhash64(F.lit(5), "text")
    chosen = rows.where(F.lit(False))
    for r in rows.groupBy("toxic").count().collect():
        chosen = chosen.union(rows.where((F.col("toxic") == r["toxic"]) & (F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * min(1, sample / r["count"])))))
    pieces = durable(pieces_of(durable(chosen).coalesce(PARTIAL_SUMS), lexicon))

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, step = shared.value[:-4], shared.value[-4:].reshape(2, 2)
            total, pairs, value = np.zeros(DIMENSION), np.zeros((2, 2)), 0.0
            for batch in batches:
                for i in range(len(batch)):
                    by_feature, by_pair, more = gradient({c: np.frombuffer(batch[c].iloc[i], kind) for c, kind in PIECE_COLUMNS.items()}, own, step)
                    total, pairs, value = total + by_feature, pairs + by_pair, value + more
            yield pd.DataFrame({"slope": [np.concatenate([total, pairs.ravel()]).tobytes()], "value": [value]})

        value, slope = -SHRINK / 2 * float(x @ x), -SHRINK * x
        # PARTIAL_SUMS rows of fixed length, in the order of their partitions.
        for r in pieces.mapInPandas(run, "slope binary, value double").collect():
            slope += np.frombuffer(r["slope"])
            value += r["value"]
        shared.destroy()
        return value, slope

    best = maximise(evaluate, np.zeros(DIMENSION + 4), ROUNDS)
    return best[:-4], best[-4:].reshape(2, 2)


def evidence_of(words: Weighed, step: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Noisy-or and sum of each text's marginals (those of FLOOR or more), the marginals of all tokens, and the texts' first tokens."""
    emit, start, ends = words.emissions([t or "" for t in texts])
    chance = marginals(emit, start, step)
    strong = np.where(chance >= FLOOR, chance, 0.0)
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[ends])
    return -np.expm1(np.minimum(sums(np.log1p(-np.minimum(strong, 1 - 1e-12))), 0.0)), np.maximum(sums(strong), 0.0), chance, ends


def inputs(any_: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(any_), any_, np.log1p(total)], axis=1)


def learn_curve(rows: DataFrame, weights: np.ndarray, step: np.ndarray) -> tuple[float, float, float]:
    """A logistic curve from a document's evidence to its label, over all training rows (their number is bounded)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Weighed(weights)
        for batch in batches:
            any_, total, *_ = evidence_of(words, step, list(batch["text"]))
            yield pd.DataFrame({"any": any_, "total": total, "toxic": batch["toxic"].to_numpy()})

    seen = rows.mapInPandas(run, "any double, total double, toxic int").toPandas()
    if not len(seen):
        return -3.0, 0.0, 0.0
    x, y, w = inputs(seen["any"].to_numpy(), seen["total"].to_numpy()), seen["toxic"].to_numpy(float), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1]), x.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * w)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Labels are read only of rows where ``usable`` (over doc_id) holds.  Without labels of both kinds nothing is toxic and all scores are alike."""
    ship(docs.sparkSession)
    rows = training_rows(docs.select("doc_id", "text"), labels, usable, sample)
    lexicon = learn_lexicon(rows)
    # Without a labelled token there is nothing to fit.
    weights, step = learn_chain(rows, lexicon) if lexicon else (np.zeros(DIMENSION), np.array([[0.0, -30.0], [0.0, 0.0]]))
    weights = weights.astype(np.float32)
    return Model(weights, step, learn_curve(rows, weights, step))


def tagger(model: Model, spans: bool = True):
    """A function of a text column: struct(score, spans).  score is 0 to 1; spans are (start, end, chance), in characters of the text.

    Every whole text is tagged; null counts as empty, and an empty text has the score of a text without evidence.
    Nothing but the text goes into a score.
    """

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,chance:double>>")
    def tag(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, curve = Weighed(model.weights), np.array(model.curve)
        for batch in texts:
            any_, total, chance, ends = evidence_of(words, model.step, list(batch))
            found: list[list] = [[] for _ in range(len(batch))]
            if spans:
                hits = np.flatnonzero(chance >= model.cut)
                for i in np.unique(np.searchsorted(ends, hits, side="right") - 1):
                    own = chance[ends[i] : ends[i + 1]]
                    found[i] = [{"start": m.start(), "end": m.end(), "chance": float(p)} for m, p in zip(LETTERS.finditer(batch.iloc[i]), own, strict=True) if p >= model.cut]
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-inputs(any_, total) @ curve)), "spans": found})

    return tag


def learnable(id_col: str = "doc_id", modulus: int = 3, held: int = 1) -> Column:
    """Whether crc32 of the id as text leaves a remainder other than ``held``; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans, spans (start, end, chance) of every row.

    Offsets count characters of the whole text, of any length.  A null id counts as held out; repeated rows are scored alike; other columns are
    ignored; an empty table gives no rows.  A score of exactly ``threshold`` is predicted 1.
    """
    tagged = docs.select("doc_id", tagger(train(docs, labels, learnable()))("text").alias("tag"))
    return tagged.select("doc_id", (~learnable()).alias("held_out"), "tag.score", (F.col("tag.score") >= threshold).cast("int").alias("predicted"), F.size("tag.spans").alias("n_spans"), "tag.spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    return docs.where(tagger(train(docs, labels, learnable()), spans=False)("text")["score"] < threshold)
