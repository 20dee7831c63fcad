"""Word-shingle sets and their HyperMinHash registers, as numpy arrays."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from turnmill.llm.common import remembered

MANTISSA_BITS = 10
_U = np.uint64


class WordIds(dict):
    """64-bit hashes of words, remembered; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made



def mix(x: np.ndarray) -> np.ndarray:
    """An invertible mix of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased, words split at ASCII white space.
    Fewer than k words: the whole sequence as one; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = remembered("shingles", WordIds)
    if len(known) > 200_000:
        known.clear()
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(ids))
    out = np.full(len(ids) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * _U(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i])
    return np.unique(out)


@functools.cache
def _probes(n: int) -> np.ndarray:
    """For each register a fixed random order in which an empty one asks the others."""
    return np.random.default_rng(20_011).integers(0, n, (n, 4096), dtype=np.int16)


def registers(found: np.ndarray, n: int) -> np.ndarray:
    """n HyperMinHash registers of a set of hashes (not empty): for each bucket its least hash, kept as the count of leading
    zeros (6 bits) and the bits after the first one (10 bits).  An empty bucket takes the register of the first
    filled one in an order of its own, which keeps the chance of equality at the Jaccard similarity for small sets too."""
    with np.errstate(over="ignore"):
        bucket = ((found >> _U(32)) * _U(n)) >> _U(32)
        first = np.empty(len(found), bool)
        first[0] = True
        np.not_equal(bucket[1:], bucket[:-1], out=first[1:])
        filled = bucket[first].astype(np.int64)
        # Within a bucket hash * n mod 2 ** 64 rises with the hash, so the first hash has the least value.
        least = found[first] * _U(n)
    exponent = np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
    mantissa = (least << np.minimum(zeros + _U(1), _U(63))) >> _U(64 - MANTISSA_BITS)
    out = np.zeros(n, np.uint16)
    out[filled] = ((zeros << _U(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    if len(filled) < n:
        there = np.zeros(n, bool)
        there[filled] = True
        empty = np.flatnonzero(~there)
        probes = _probes(n)
        for width in (24, 4096):
            hit = there[probes[empty, :width]]
            any_hit = hit.any(axis=1)
            if width == 4096:
                any_hit[:] = True
            chosen = empty[any_hit]
            out[chosen] = out[probes[chosen, hit[any_hit].argmax(axis=1)]]
            empty = empty[~any_hit]
            if not len(empty):
                break
    return out


@functools.cache
def _cells() -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends in [0, 1] of the values that share a register."""
    zeros = np.arange(40)[:, None]
    step = np.arange(1 << MANTISSA_BITS)[None, :]
    low = (1 + step / (1 << MANTISSA_BITS)) * 0.5 ** (zeros + 1.0)
    return low.ravel(), (low + 0.5 ** (zeros + 1.0) / (1 << MANTISSA_BITS)).ravel()


@functools.cache
def _cell_chances(step: int) -> np.ndarray:
    """For a bucket of 2 ** (step / 2) hashes, the chance of each register."""
    low, high = _cells()
    per_bucket = 2.0 ** (step / 2)
    return np.exp(per_bucket * np.log1p(-np.minimum(low, 1 - 1e-16))) - np.exp(per_bucket * np.log1p(-np.minimum(high, 1 - 1e-16)))


@functools.cache
def chance_equal(step_a: int, step_b: int) -> float:
    """The chance that two registers of unrelated sets are equal by accident."""
    return float(_cell_chances(step_a) @ _cell_chances(step_b))


def size_step(size: int, n: int) -> int:
    return int(round(2 * np.log2(max(size / n, 1.0))))


def estimate(equal: np.ndarray | int, n: int, size_a: int, size_b: int):
    """Jaccard similarity from the number of equal registers, less the equalities to expect by accident."""
    accident = chance_equal(size_step(size_a, n), size_step(size_b, n))
    return (equal / n - accident) / (1 - accident)


def least_estimate(threshold: float, n: int, size: int, sigmas: float = 6.0) -> float:
    """What a pair at the threshold falls below with a chance of about 1e-9: six standard errors, those of small sets larger."""
    return threshold - sigmas * (threshold * (1 - threshold) / max(1, min(size, n))) ** 0.5
