"""NumPy parts of features that built-in functions cannot express; imported by workers."""

from __future__ import annotations

import hashlib
import math

import numpy as np


#: Pairs of templates that are compared at once.
PAIRS = 2_000_000


def matches(t: np.ndarray, tolerance: float) -> int:
    """Unordered pairs of rows that differ by no more than the tolerance in every column: rows are
    sorted by their first column, and each is compared with those only that follow it within reach."""
    t = t[np.argsort(t[:, 0], kind="stable")]
    # A little further than the tolerance, as sums round; the pairs themselves are compared exactly.
    reach = np.searchsorted(t[:, 0], t[:, 0] + tolerance * (1 + 1e-9), "right") - np.arange(len(t)) - 1
    ends, total, start = np.cumsum(reach), 0, 0
    while start < len(t):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - reach[start] + PAIRS, "right")))
        n = reach[start:stop]
        first = np.repeat(np.arange(start, stop), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        near = np.ones(len(first), bool)
        for column in t.T:
            near &= np.abs(column[second] - column[first]) <= tolerance
        total += int(near.sum())
        start = stop
    return total


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float | None:
    """-ln of the ratio of template matches at m + 1 and m."""
    n, sd = len(x), x.std() if len(x) else 0.0
    if n < m + 2 or sd == 0:
        return None
    found = [matches(np.lib.stride_tricks.sliding_window_view(x, size), r * sd) for size in (m, m + 1)]
    return -math.log(found[1] / found[0]) if all(found) else None


def spectrum(slot: np.ndarray, g: np.ndarray, slots: int, interval_min: int, per_day: int) -> tuple[float | None, float | None, float | None]:
    if len(g) < 2 * per_day:
        return None, None, None
    x = np.full(slots, g.mean())
    x[slot] = g
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    power[0] = 0
    total = power.sum()
    if total <= 0:
        return None, None, None
    frequency = np.fft.rfftfreq(slots, interval_min / 60.0)
    share = power[1:] / total
    positive = share[share > 0]
    entropy = float(-(positive * np.log(positive)).sum() / math.log(len(positive))) if len(positive) > 1 else None
    return float(power[(frequency >= 1 / 28) & (frequency <= 1 / 20)].sum() / total), float(1 / frequency[1 + int(share.argmax())]), entropy


#: Weights of points that a local line takes at once.
WEIGHTS = 2_000_000


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.5, rounds: int = 3) -> np.ndarray:
    """Locally weighted straight lines over the nearest share of points, made robust by weighing
    residuals, at every x. Points of one x share a line, so lines are as many as different values; each
    is fitted from sums by value within its reach, WEIGHTS of them at once: memory grows with the points."""
    n = len(x)
    if n < 3:
        return y.astype(float).copy()
    k, robust, fit = min(n, max(2, int(share * n + 1e-10))), np.ones(n), y.astype(float).copy()
    u, at = np.unique(x, return_inverse=True)
    # The k nearest are a run of the sorted points; around the run centred on a value one is the nearest.
    ordered = np.sort(x)
    first = np.searchsorted(ordered[: n - k + 1] + ordered[k - 1 :], 2 * u, "right")
    runs = np.clip(first[:, None] + np.arange(-2, 2), 0, n - k)
    reach = np.maximum(np.maximum(u[:, None] - ordered[runs], ordered[runs + k - 1] - u[:, None]).min(1), 1e-12)
    low, high = np.searchsorted(u, u - reach, "left"), np.searchsorted(u, u + reach, "right")
    for _ in range(rounds + 1):
        weight, weighed, line = np.bincount(at, robust), np.bincount(at, robust * y), np.empty(len(u))
        start = 0
        while start < len(u):
            stop = start + max(1, WEIGHTS // max(1, high[start] - low[start]) // 2)
            mine, near_ = slice(start, stop), slice(low[start:stop].min(), high[start:stop].max())
            v, own = u[near_], u[mine, None]
            near = np.clip(1 - (np.abs(own - v[None]) / reach[mine, None]) ** 3, 0, None) ** 3
            total = np.maximum(near @ weight[near_], 1e-300)
            mx, my = near @ (weight[near_] * v) / total, near @ weighed[near_] / total
            off = v[None] - mx[:, None]
            sxx = (near * off**2) @ weight[near_]
            sxy = (near * off) @ weighed[near_] - my * ((near * off) @ weight[near_])
            line[mine] = my + np.where(sxx > 1e-12, sxy / np.maximum(sxx, 1e-12), 0) * (u[mine] - mx)
            start = stop
        fit = line[at]
        residual = np.abs(y - fit)
        scale = 6 * np.median(residual)
        if scale <= 0:
            break
        robust = np.clip(1 - (residual / scale) ** 2, 0, None) ** 2
    return fit


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_INITIAL = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_start(text: np.ndarray) -> np.ndarray:
    """The first 52 bits of the MD5 of each row of bytes. Rows of up to 55 bytes are one block each, and
    are hashed side by side, as a call of hashlib costs several times the hash itself."""
    n, size = text.shape
    if size > 55:
        return np.array([int(hashlib.md5(row.tobytes()).hexdigest()[:13], 16) for row in text], np.int64)
    block = np.zeros((n, 64), np.uint8)
    block[:, :size], block[:, size], block[:, 56], block[:, 57] = text, 128, 8 * size & 255, 8 * size >> 8
    word = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(n, v) for v in _INITIAL)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * i % 16
        f += a
        f += _SINES[i]
        if at <= size // 4 or at == 14:  # other words are 0
            f += word[at]
        turn = np.uint32(_TURNS[i // 16][i % 4])
        np.left_shift(f, turn, out=t)
        f >>= np.uint32(32) - turn
        t |= f
        t += b
        a, d, c, b, t = d, c, b, t, a
    first, second = ((v + w).byteswap().astype(np.int64) for v, w in zip((a, b), _INITIAL))
    return first << 20 | second >> 12
