"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last of that prefix's encoding.
It is the one token that (a) ends there, (b) encodes its own bytes as itself, and (c) forms a valid pair with
the last token of the prefix before it.  Storing that token per prefix gives the encoding by walking back,
allows exact appends (earlier entries never change), and after an edit only entries from the edit on are
made anew, until they agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import remembered, ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces whose tokens a Python worker remembers; beyond that it begins anew.
CACHE_PIECES = 200_000
#: Pairs of tokens whose validity it remembers.
CACHE_PAIRS = 500_000
#: Tokens that are gathered before they are handed on, so that memory doesn't depend on how many long texts come together.
HELD_TOKENS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens.  The file is a vocabulary of fixed size, some 50,000 lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixCoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = list(map(str, range(len(self.bytes_of))))
        self.pattern = regex.compile(pattern)
        self.parts = {rank: self._last_merge(token, rank) for token, rank in ranks.items()}
        self.joined = {pair: rank for rank, pair in self.parts.items() if pair}
        self.longest = max(map(len, ranks), default=1)
        #: Finds every token that ends at a byte; bytes stand as the characters of the same numbers.
        self.found = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.parts[rank] != ():
                self.found.add_word(token.decode("latin-1"), (rank, len(token)))
        self.found.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte.  () marks a token that its own bytes don't encode to."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < best:
                    best, at = r, i
            if at < 0:
                return ()
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def valid_pair(self, left: int, right: int) -> bool:
        """Whether left followed by right is the encoding of their joint bytes.

        Undo merges, latest first, on the two sides of the seam: if at any moment the
        two tokens at the seam could have merged before the merge that was undone last, that merge would have come first.
        """
        if (known := self.pairs.get((left, right))) is not None:
            return known
        a, b, undone, good = left, right, 1 << 60, True
        while True:
            if self.joined.get((a, b), undone) < undone:
                good = False
                break
            of_a, of_b = self.parts[a], self.parts[b]
            # On equal ranks the left one was merged first, so the right one is undone first.
            if of_a and (not of_b or a > b):
                undone, a = a, of_a[1]
            elif of_b:
                undone, b = b + 1, of_b[0]
            elif of_a:
                undone, a = a, of_a[1]
            else:
                break
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def extend(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """Fill ``last``, the last token of each prefix of ``data`` (entry i: of the prefix of i + 1 bytes), from ``start`` on."""
        del last[start:]
        back = max(0, start - self.longest)
        for end, (token, size) in self.found.iter(data[back:].decode("latin-1")):
            end += back
            if end == len(last) and (size > end or self.valid_pair(last[end - size], token)):
                last.append(token)
        if len(last) < len(data):
            raise ValueError("the vocabulary lacks a byte of the text")
        return last

    def _last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The unique token that ends at ``end``, tried from the longest on."""
        for begin in range(max(0, end - self.longest), end):
            token = self.ranks.get(data[begin:end])
            if token is None or self.parts[token] == ():
                continue
            if begin == 0 or self.valid_pair(last[begin - 1], token):
                return token
        raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")

    def edit(self, data: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace data[begin:end] by ``new``; entries before the edit stay, those behind it stay once ``longest`` of them in a row agree."""
        changed = data[:begin] + new + data[end:]
        out, tail, same = last[:begin], last[end:], 0
        shift = begin + len(new)
        for at in range(begin, len(changed)):
            out.append(self._last_token(changed, at + 1, out))
            same = same + 1 if at >= shift and out[-1] == tail[at - shift] else 0
            if same >= self.longest:
                return changed, out + tail[at + 1 - shift :]
        return changed, out

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding that the prefix table holds, by walking back."""
        out, at = [], len(data)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        if (known := self.cache.get(piece)) is None:
            data = piece.encode("utf-8")
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None and self.parts[whole] != () else tuple(self.tokens(data, self.extend(data, [])))
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        """Every match of the pattern by itself; whatever no match covers is left out, as in the public library."""
        pieces = self.pattern.findall(text)
        try:
            return list(chain.from_iterable(map(self.cache.__getitem__, pieces)))
        except KeyError:
            return list(chain.from_iterable(map(self.encode_piece, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _coder(shared, pattern: str) -> PrefixCoder:
    """One coder per Python worker and broadcast vocabulary."""
    return remembered(f"bpe {shared.value[0]}", lambda: PrefixCoder(shared.value[1], pattern))


def _vocabulary(df: DataFrame, path: str | None):
    """The ranks (a fixed-size vocabulary, under 2 MB) as a broadcast, and the pattern.  Executors needn't have the file."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    ranks = read_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((key, ranks)), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Whole texts are encoded, null as empty; an empty text has no ids, and its digests
    are those of the empty string.  Other columns are ignored; repeated rows give repeated rows.
    """
    ship(docs.sparkSession)
    shared, pattern = _vocabulary(docs, path)

    def told(ids_of: list, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        out.insert(0, "doc_id", pd.array(ids_of, "Int64"))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(shared, pattern)
        for batch in batches:
            ids_of, rows, held = [], [], 0
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = coder.encode(text)
                row = (len(ids), hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest())
                rows.append((*row, np.array(ids, np.int32)) if with_ids else row)
                ids_of.append(doc_id)
                held += len(ids)
                if held > HELD_TOKENS:
                    yield told(ids_of, rows)
                    ids_of, rows, held = [], [], 0
            yield told(ids_of, rows)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, schema)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode_texts(docs, path=path, with_ids=False)
