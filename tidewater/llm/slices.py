"""Slices of flat UTF-8 buffers: byte-level boundaries, their xxhash values, and exact groups.

All rows of a block lie end to end in one buffer. A table of 256 entries says which bytes belong to
a term, so boundaries are where its value changes or a row ends. Equal slices meet by their 64-bit
xxhash; every slice is then compared with its class's first one byte by byte, and a class in which
one differs is divided by its bytes, so a collision never joins two terms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from tidewater.llm.blocks import ranges

#: Bytes of terms: A-Z, a-z and all beyond ASCII.
IN_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
# The constants of the published 64-bit hash.
P1, P2, P3, P4, P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, start and end of every maximal run of term bytes that lies inside one row."""
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    wanted = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[wanted], ends[wanted]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit xxhash of each slice, as the library gives it: slices under 32 bytes side by side
    in arrays, longer ones by the library."""
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    h = sizes.astype(np.uint64) + P5
    at, left = starts.copy(), sizes.copy()
    short = sizes < 32
    with np.errstate(over="ignore"):
        for _ in range(3):
            i = np.flatnonzero(short & (left >= 8))
            lane = _turn(eight[at[i]] * P2, 31) * P1
            h[i] = _turn(h[i] ^ lane, 27) * P1 + P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(short & (left >= 4))
        h[i] = _turn(h[i] ^ (four[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
        at[i] += 4
        left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(short & (left >= 1))
            h[i] = _turn(h[i] ^ (data[at[i]].astype(np.uint64) * P5), 11) * P1
            at[i] += 1
            left[i] -= 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a[i] : a[i] + sizes[i]] equals the slice of that size at b[i]."""
    differs = data[ranges(a, sizes)] != data[ranges(b, sizes)]
    before = np.concatenate(([0], np.cumsum(differs)))
    ends = np.cumsum(sizes)
    return before[ends] == before[ends - sizes]


def grouped(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = xxhash64
) -> tuple[np.ndarray, np.ndarray]:
    """A class number for each slice, equal just for equal bytes, and each class's first slice."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, own = np.unique(hashed(data, starts, ends), return_index=True, return_inverse=True)
    sizes = ends - starts
    chief = first[own]
    equal = sizes == sizes[chief]
    i = np.flatnonzero(equal)
    equal[i] = same_bytes(data, starts[i], starts[chief[i]], sizes[i])
    if not equal.all():
        broken = np.isin(own, own[~equal])
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(broken).tolist():
            own[i] = known.setdefault(data[starts[i] : ends[i]].tobytes(), len(first) + len(known))
        _, first, own = np.unique(own, return_index=True, return_inverse=True)
    return own, first
