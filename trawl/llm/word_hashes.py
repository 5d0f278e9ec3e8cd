"""Words of texts as hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .elias_fano import U

#: The primes of xxh64.
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes that bytes.split() splits at.
_SPACE = np.isin(np.arange(256), [*b" \t\n\r\x0b\x0c"])
#: Words of so many bytes or more are hashed one by one.
LONG = 32


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places where the words of data.split() begin, and their sizes."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """xxh64 of each of data.split(), in order, and the places where these words begin."""
    starts, sizes = word_places(data)
    out = np.empty(len(starts), U)
    # Eight bytes from each place on, the first in the lowest bits.
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    order = np.argsort(np.minimum(sizes, LONG).astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(np.minimum(sizes, LONG), minlength=LONG + 1))
    for size in range(1, LONG):
        own = order[ends[size - 1] : ends[size]]
        if len(own):
            out[own] = _hashes(eight, starts[own], size)
    for k in order[ends[LONG - 1] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return out, starts


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _hashes(eight: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """xxh64 of the words of size bytes, less than LONG, at these places."""
    with np.errstate(over="ignore"):
        h = np.full(len(at), _P5 + U(size), U)
        for k in range(0, size, 8):
            left, x = size - k, eight[at + k]
            if left >= 8:
                h = _turned(h ^ _turned(x * _P2, 31) * _P1, 27) * _P1 + _P4
                continue
            if left >= 4:
                h = _turned(h ^ (x & U(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
            for j in range(left & 4, left):
                h = _turned(h ^ (x >> U(8 * j) & U(0xFF)) * _P5, 11) * _P1
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
        return h ^ (h >> U(32))
