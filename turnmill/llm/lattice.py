"""Subword lattices: every way to cut a word into pieces of a fixed vocabulary, summed in log space, many words at once."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
START = "▁"  # the vocabulary's mark of a word's start
#: Characters from which on a word is walked by itself, its arcs found for BLOCK positions at a time; shorter ones go together by length.
LONG = 256
BLOCK = 50_000
#: Characters of the words of one length that go together.
TOGETHER = 2_000_000


class Lattice:
    """``pieces``: the vocabulary in a fixed order; piece i has the log weight ``weights[i]``.  The last weight, beyond
    the pieces, is that of one byte; characters without a piece are spelled in bytes."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        prefixes: dict[str, int] = {}
        for piece in pieces:
            for n in range(1, len(piece)):
                prefixes.setdefault(piece[:n], -1)
        for i, piece in enumerate(pieces):
            prefixes[piece] = i
        codes = [self._hash(p) for p in prefixes]
        order = np.argsort(np.array(codes, np.uint64))
        self.keys = np.array(codes, np.uint64)[order]
        self.values = np.array(list(prefixes.values()), np.int64)[order]
        self.longest = max(map(len, pieces), default=1)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of words of one length, as rows of code points: (from, to, rows, weight index, times), by from."""
        n, length = codes.shape
        for i in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                with np.errstate(over="ignore"):
                    h = h * _BASE + codes[rows, j - 1] + _U(1)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                there = self.keys[at] == h
                piece = np.where(there, self.values[at], -1)
                if j == i + 1 and (lacks := piece < 0).any():
                    own = codes[rows[lacks], i]
                    size = 1 + (own > 0x7F).astype(float) + (own > 0x7FF) + (own > 0xFFFF)
                    yield i, j, rows[lacks], np.full(len(own), len(self.pieces)), size
                whole = piece >= 0
                if whole.any():
                    yield i, j, rows[whole], piece[whole], np.ones(int(whole.sum()))
                rows, h = rows[there], h[there]
                if not len(rows):
                    break

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, code points) of the words of each length below LONG, each with the start mark before it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for length in np.unique(lengths[lengths < LONG]):
            every = np.flatnonzero(lengths == length)
            step = max(1, TOGETHER // int(length))
            for begin in range(0, len(every), step):
                own = every[begin : begin + step]
                text = "".join(START + words[i] for i in own)
                yield own, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), int(length)).astype(np.uint64)

    def long_words(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(position, code points) of the other words."""
        for i, word in enumerate(words):
            if len(word) + 1 >= LONG:
                yield i, np.frombuffer((START + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def arcs_from(self, codes: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, weight index, times) of one word's arcs that leave its places ``begin`` to ``end`` - 1, by from."""
        places = np.arange(begin, min(end, len(codes)))
        h, found = np.zeros(len(places), np.uint64), []
        for n in range(1, self.longest + 1):
            fits = places + n <= len(codes)
            places, h = places[fits], h[fits]
            with np.errstate(over="ignore"):
                h = h * _BASE + codes[places + n - 1] + _U(1)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            there = self.keys[at] == h
            piece = np.where(there, self.values[at], -1)
            if n == 1:
                lacks = places[piece < 0]
                own = codes[lacks]
                found.append((lacks, lacks + 1, np.full(len(lacks), len(self.pieces)), 1 + (own > 0x7F).astype(float) + (own > 0x7FF) + (own > 0xFFFF)))
            whole = places[piece >= 0]
            found.append((whole, whole + n, piece[piece >= 0], np.ones(len(whole))))
            places, h = places[there], h[there]
            if not len(places):
                break
        begins, ends, index, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(begins, kind="stable")
        return begins[order], ends[order], index[order], times[order]

    def walk(self, codes: np.ndarray, weights: np.ndarray) -> list[float]:
        """Log of the summed weight of all cuts of each prefix of one word."""
        alpha = [-math.inf] * (len(codes) + 1)
        alpha[0] = 0.0
        for begin in range(0, len(codes), BLOCK):
            begins, ends, index, times = self.arcs_from(codes, begin, begin + BLOCK)
            for i, j, w in zip(begins.tolist(), ends.tolist(), (weights[index] * times).tolist(), strict=True):
                x, y = alpha[i] + w, alpha[j]
                alpha[j] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return alpha

    def forward(self, codes: np.ndarray, arcs: Iterable, weights: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all cuts of each prefix, of many words of one length."""
        alpha = np.full((len(codes), codes.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for i, j, rows, index, times in arcs:
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + weights[index] * times)
        return alpha

    def log_marginals(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Log probability of each word, summed over all its cuts."""
        out = np.zeros(len(words))
        for own, codes in self.groups(words):
            out[own] = self.forward(codes, self.arcs(codes), weights)[:, -1]
        for i, codes in self.long_words(words):
            out[i] = self.walk(codes, weights)[-1]
        return out

    def expected_uses(self, words: list[str], weights: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """How often each piece (and, last, a byte) occurs in the words' cuts, each cut by its posterior weight and each word ``counts`` times (once)."""
        total = np.zeros(len(self.pieces) + 1)
        counts = np.ones(len(words)) if counts is None else counts
        for own, codes in self.groups(words):
            arcs = list(self.arcs(codes))
            alpha = self.forward(codes, arcs, weights)
            beta = np.full(alpha.shape, -np.inf)
            beta[:, -1] = 0
            for i, j, rows, index, times in reversed(arcs):
                step = weights[index] * times + beta[rows, j]
                beta[rows, i] = np.logaddexp(beta[rows, i], step)
            n = counts[own]
            for i, j, rows, index, times in arcs:
                share = np.exp(alpha[rows, i] + weights[index] * times + beta[rows, j] - alpha[rows, -1])
                total += np.bincount(index, weights=share * times * n[rows], minlength=len(total))
        for k, codes in self.long_words(words):
            total += counts[k] * self._long_uses(codes, weights)
        return total

    def _long_uses(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of one long word, with the arcs of a block at a time: only the two sums per place are kept."""
        alpha = np.array(self.walk(codes, weights))
        total, beta = np.zeros(len(self.pieces) + 1), [-math.inf] * (len(codes) + 1)
        beta[-1] = 0.0
        for begin in range((len(codes) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            begins, ends, index, times = self.arcs_from(codes, begin, begin + BLOCK)
            w = weights[index] * times
            for i, j, step in zip(begins[::-1].tolist(), ends[::-1].tolist(), w[::-1].tolist(), strict=True):
                x, y = step + beta[j], beta[i]
                beta[i] = x if y == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
            behind = np.array(beta[begin : begin + BLOCK + self.longest + 1])
            total += np.bincount(index, weights=np.exp(alpha[begins] + w + behind[ends - begin] - alpha[-1]) * times, minlength=len(total))
        return total


def log_probability(words: list[str], pieces: Lattice, weights: np.ndarray, end: float) -> float:
    """Natural log of a document's marginal probability: the forward recursion over its whole lattice, the end included.

    No unit reaches over a word's border, so the recursion's value at each word's end is the only way on, and the sum over all cuts of the
    document is the product over its words.
    """
    return end + float(pieces.log_marginals(words, weights).sum())


def rank_weights(scores: Iterable[float], byte_share: float = 1e-3) -> np.ndarray:
    """Log weights from a vocabulary whose scores are negated ranks: inverse to the rank, with a share for spelling in bytes."""
    mass = 1 / (100 - np.array(list(scores), float))
    return np.log(np.append(mass / mass.sum() * (1 - byte_share), byte_share / 256))
