"""A linear-chain conditional random field with two labels over the tokens of many documents at once."""

from __future__ import annotations

import numpy as np


def forward_backward(emit: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward vectors (n x 2, each scaled to a sum of 1) of chains that lie one behind the other, and the log of
    the product of their partition sums.

    ``emit``: log potential of label 1 on each token (label 0 has none); ``start``: where a chain begins, behind a label 0;
    ``step[a, b]``: log potential of label b behind label a.  A token is a 2 x 2 matrix, one that begins a chain has two equal rows, so
    that nothing passes it.  All are cut into about sqrt(n) blocks; what each block does as a whole is multiplied up
    first, then all blocks are walked side by side.
    """
    n = len(emit)
    if not n:
        return np.empty((0, 2)), np.empty((0, 2)), 0.0
    length = max(8, int(n**0.5))
    blocks = -(-n // length)
    g = np.ones(blocks * length)
    g[:n] = np.exp(np.clip(emit, -30, 30))
    begins = np.ones(blocks * length, bool)
    begins[:n] = start
    t = np.exp(step)
    across = lambda x: np.ascontiguousarray(x.reshape(blocks, length).T)
    m00, m01 = np.full((length, blocks), t[0, 0]), across(t[0, 1] * g)
    m10, m11 = across(np.where(begins, t[0, 0], t[1, 0])), across(np.where(begins, t[0, 1], t[1, 1]) * g)

    p00, p01, p10, p11 = (np.full(blocks, x) for x in (1.0, 0.0, 0.0, 1.0))
    for j in range(length):
        p00, p01, p10, p11 = p00 * m00[j] + p01 * m10[j], p00 * m01[j] + p01 * m11[j], p10 * m00[j] + p11 * m10[j], p10 * m01[j] + p11 * m11[j]
        scale = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / scale, p01 / scale, p10 / scale, p11 / scale
    f0, f1, b0, b1 = (np.empty(blocks) for _ in range(4))
    x, y = 1.0, 0.0
    for k in range(blocks):
        f0[k], f1[k] = x, y
        x, y = x * p00[k] + y * p10[k], x * p01[k] + y * p11[k]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(blocks - 1, -1, -1):
        b0[k], b1[k] = x, y
        x, y = p00[k] * x + p01[k] * y, p10[k] * x + p11[k] * y
        x, y = x / (x + y), y / (x + y)
    alpha, beta, scales = np.empty((length, blocks, 2)), np.empty((length, blocks, 2)), np.empty((length, blocks))
    for j in range(length):
        f0, f1 = f0 * m00[j] + f1 * m10[j], f0 * m01[j] + f1 * m11[j]
        scales[j] = scale = f0 + f1
        f0, f1 = f0 / scale, f1 / scale
        alpha[j, :, 0], alpha[j, :, 1] = f0, f1
    for j in range(length - 1, -1, -1):
        beta[j, :, 0], beta[j, :, 1] = b0, b1
        b0, b1 = m00[j] * b0 + m01[j] * b1, m10[j] * b0 + m11[j] * b1
        scale = b0 + b1
        b0, b1 = b0 / scale, b1 / scale
    back = lambda x: x.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return back(alpha), back(beta), float(np.log(scales.T.ravel()[:n]).sum())


def marginals(emit: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(label 1) of every token."""
    alpha, beta, _ = forward_backward(emit, start, step)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1)


def expectations(emit: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(label 1) of every token, how often each pair of labels is to be expected one behind the other, and the log partition sum."""
    alpha, beta, total = forward_backward(emit, start, step)
    if not len(emit):
        return np.empty(0), np.zeros((2, 2)), 0.0
    both = alpha * beta
    before = np.where(start[:, None], [1.0, 0.0], np.vstack([[[1.0, 0.0]], alpha[:-1]]))
    own = np.stack([np.ones(len(emit)), np.exp(np.clip(emit, -30, 30))], axis=1) * beta
    pairs = before[:, :, None] * np.exp(step)[None] * own[:, None, :]
    return both[:, 1] / both.sum(axis=1), (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0), total


def maximise(evaluate, x: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """Limited-memory quasi-Newton ascent.  ``evaluate(x)``: a concave function's value and gradient, called ``rounds`` times at most."""
    (value, slope), past, left = evaluate(x), [], rounds - 1
    while left > 0 and np.abs(slope).max(initial=0) > 1e-3:
        way, kept = slope.copy(), []
        for s, y, r in reversed(past):
            kept.append(a := r * (s @ way))
            way -= a * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            way += s * (a - r * (y @ way))
        size = 1.0
        while left > 0:
            left -= 1
            new = x + size * way
            new_value, new_slope = evaluate(new)
            if new_value >= value + 1e-4 * size * (slope @ way):
                break
            size /= 4
        else:
            return x
        s, y = new - x, slope - new_slope
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        gain, x, value, slope = new_value - value, new, new_value, new_slope
        if gain < 1e-5 * abs(value):
            break
    return x
