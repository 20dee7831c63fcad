"""Language-model scores of whole texts: a subword lattice over an existing piece vocabulary.

The lattice's units are the pieces of the vocabulary, single bytes for characters that have none, and one end; together they are one distribution.
The vocabulary's own scores are the first weights of all segmentations.  ROUNDS of expectation maximisation over the training words then count
how often each piece is used, every cut by its weight.  A document's probability is the sum over all its segmentations into
units, by forward recursion in log space.  Texts alone are read: no column tells a text's language or kind.

Counts of all words meet by shuffle.  HEAD words of highest count, a fixed number whatever the input's size, are sent to every task;
the other words of each document are joined by shuffle, and none of them is frequent, so no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import durable, remembered, ship
from turnmill.llm.lattice import Lattice, rank_weights

VOCABULARY = "piece_bpe_32k.model"
#: Words that every task holds; words that a task holds before it hands on their counts.
HEAD, HELD_WORDS = 250_000, 300_000
#: Rounds of expectation maximisation; what each piece and the end get besides their counts.
ROUNDS = 3
EVERY_PIECE, EVERY_END = 0.01, 1.0


def read_pieces(path: str | None = None) -> tuple[list[str], list[float]]:
    """The vocabulary's ordinary pieces and their scores; a file of fixed size."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e8]
    return [model.id_to_piece(i) for i in kept], [model.get_score(i) for i in kept]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: its count in training documents, other: in the rest.  ``docs``: text, train."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[Counter] = [Counter(), Counter()]

        def told() -> pd.DataFrame:
            out = pd.concat([pd.DataFrame({"word": list(c), "train": k == 0, "n": list(c.values())}) for k, c in enumerate(seen)])
            for c in seen:
                c.clear()
            return out.astype({"train": "bool", "n": "int64"})

        for batch in batches:
            for text, train in zip(batch["text"], batch["train"], strict=True):
                seen[0 if train else 1].update(words_of(text))
                if sum(map(len, seen)) > HELD_WORDS:
                    yield told()
        yield told()

    each = docs.select("text", "train").mapInPandas(run, "word binary, train boolean, n long")
    return each.groupBy("word").agg(F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("train"), 0).otherwise(F.col("n"))).alias("other"))


def in_chunks(batches: Iterator[pd.DataFrame], rows: int = 60_000, size: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Batches together, up to so many words or bytes of words."""
    held, n, bytes_ = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        bytes_ += sum(map(len, batch["word"]))
        if n >= rows or bytes_ >= size:
            yield pd.concat(held)
            held, n, bytes_ = [], 0, 0
    if held:
        yield pd.concat(held)


def shared_lattice(pieces: list[str]) -> Lattice:
    """One lattice per Python worker and vocabulary."""
    return remembered(f"lattice {len(pieces)} {hash(tuple(pieces))}", lambda: Lattice(pieces))


def spelled(words) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in words]


def piece_uses(words: DataFrame, pieces: list[str], weights: np.ndarray) -> np.ndarray:
    """How often each piece (and, last, a byte) is used in the cuts of the training words (word, n), each cut by its weight."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice, total = shared_lattice(pieces), np.zeros(len(pieces) + 1)
        for chunk in in_chunks(batches):
            total += lattice.expected_uses(spelled(chunk["word"]), weights, chunk["n"].to_numpy(np.float64))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"piece": used.astype("int32"), "uses": total[used]})

    uses = np.zeros(len(pieces) + 1)
    # One row for each piece of the vocabulary at most.
    for r in words.mapInPandas(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        uses[r["piece"]] = r["uses"]
    return uses


def unit_weights(uses: np.ndarray, n_ends: int) -> tuple[np.ndarray, float]:
    """Log weights of pieces and of one byte, and that of the end, from the units' expected counts."""
    counts = uses + EVERY_PIECE
    total = float(counts.sum()) + n_ends + EVERY_END
    each = counts / total
    each[-1] /= 256
    return np.log(each), float(np.log((n_ends + EVERY_END) / total))


def fitted(words: DataFrame, pieces: list[str], first: np.ndarray, n_ends: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights after ``rounds`` over the training words (word, n).  Without training words pieces weigh what the vocabulary says, together as much as the end."""
    if words.isEmpty():
        counts = np.exp(first)
        counts[-1] *= 256
        return unit_weights(counts, n_ends)
    weights, end = first, 0.0
    for _ in range(rounds):
        weights, end = unit_weights(piece_uses(words, pieces, weights), n_ends)
    return weights, end


def least_uses(rated: DataFrame, head: int) -> int:
    """The least count at which no more than ``head`` words have that count or a higher one."""
    have, least = 0, 1 << 62
    for r in rated.where("uses > 2").groupBy("uses").count().orderBy(F.desc("uses")).toLocalIterator():
        have += r["count"]
        if have > head:
            break
        least = r["uses"]
    return least


def score_texts(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words, A-Z lower-cased, and one end; a null text is empty and has the end alone.  Scores are log10
    probabilities of whole texts of any length; base_score is that of single words with half a count added.  Without training rows nothing is
    known: the counts are 0, and pieces weigh what the vocabulary says.  Repeated rows are counted and scored as often as they
    occur; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces, scores = read_pieces(path)
    first = rank_weights(scores)
    id_ = F.col(id_col).cast("long")
    # A row is named by its id and a hash of its text, which any recomputation gives again; wholly equal rows share a name.
    named = docs.select(id_.alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"), F.xxhash64(id_, text_col, F.col(text_col).isNull()).alias("row"))
    ends = named.where("train").count()
    words = durable(count_words(named))
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    total, vocabulary = facts["n"] + ends, facts["distinct"] + (1 if ends else 0)
    divisor = total + 0.5 * (vocabulary + 1)
    weights, end = fitted(words.where("n > 0").select("word", "n"), pieces, first, ends)

    def marginals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = shared_lattice(pieces)
        for chunk in in_chunks(batches):
            own = lattice.log_marginals(spelled(chunk["word"]), weights) / np.log(10)
            n = chunk["n"].to_numpy()
            yield pd.DataFrame({"word": chunk["word"], "uses": n + chunk["other"], "known": (n > 0).astype("int64"), "base": np.log10((n + 0.5) / divisor), "own": own})

    rated = durable(words.mapInPandas(marginals, "word binary, uses long, known long, base double, own double"))
    columns = ["known", "base", "own"]
    top = rated.where(F.col("uses") >= least_uses(rated, head)).select("word", *columns).toPandas()
    shared = spark.sparkContext.broadcast((b" ".join(map(bytes, top["word"])), top[columns].to_numpy(np.float64)))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, table = shared.value
        place = {w: i for i, w in enumerate(listed.split(b" "))} if listed else {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, doc_id, train, text in zip(batch["row"], batch["doc_id"].astype("object"), batch["train"], batch["text"], strict=True):
                found = words_of(text)
                at = np.fromiter((place.get(w, -1) for w in found), np.int64, len(found))
                rest = Counter(found[k] for k in np.flatnonzero(at < 0))
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                head_row = {"tokens": len(found) + 1, "train": bool(train), "sums": table[at[at >= 0]].sum(axis=0)}
                # The row of the document itself comes first, under a key that is no word and nearly no other row's.
                for part, values in zip(out, ([doc_id] * (len(rest) + 1), [row] * (len(rest) + 1), (b" %d" % row, *rest), (0, *rest.values()), [head_row, *[None] * len(rest)]), strict=True):
                    part += values
            yield pd.DataFrame({"doc_id": pd.Series(out[0], dtype="Int64"), "row": np.array(out[1], np.int64), "word": pd.Series(out[2], dtype=object), "n": np.array(out[3], np.int64), "head": pd.Series(out[4], dtype=object)})

    each = named.mapInPandas(add_up, "doc_id long, row long, word binary, n long, head struct<tokens:long,train:boolean,sums:array<double>>")
    joined = each.join(rated.select(F.col("word").alias("_word"), *columns), F.col("word") == F.col("_word"), "left")
    sums = [F.sum(F.coalesce(F.col("head.sums")[k], F.lit(0.0)) + F.coalesce(F.col(c) * F.col("n"), F.lit(0.0))).alias(c) for k, c in enumerate(columns)]
    summed = joined.groupBy("doc_id", "row").agg(F.count("head").alias("times"), F.sum("head.tokens").alias("tokens"), F.max("head.train").alias("train"), *sums)
    # Wholly equal rows were added up together: each gets its share of the sums.
    apart = summed.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    end_base = float(np.log10((ends + 0.5) / divisor))
    return apart.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        (F.col("tokens") / F.col("times")).cast("long").alias("n_tokens"),
        (F.round(F.col("known") / F.col("times")) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("times") + F.lit(end_base)).alias("base_score"),
        (F.col("own") / F.col("times") + F.lit(end / float(np.log(10)))).alias("score"),
    )


def held_out_by_hash(id_col: str = "doc_id", modulus: int = 5, remainder: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score_texts(docs, ~held_out_by_hash())
