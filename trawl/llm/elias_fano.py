"""Elias-Fano sequences on NumPy arrays: vectorised access and successor search over memory-mapped words."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

U = np.uint64


def _selected(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of each word's r-th set bit, from 0."""
    at, word, r = np.zeros(len(word), np.int64), word.copy(), r.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        go = r >= below
        r -= np.where(go, below, 0)
        at += np.where(go, width, 0)
        word = np.where(go, word >> U(width), word)
    return at


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits, one a byte, as 64-bit words and one more word."""
    words = np.zeros((len(bits) + 63) // 64 + 1, U)
    words.view(np.uint8)[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
    return words


@dataclass(frozen=True)
class EliasFano:
    """n ascending numbers: the low bits of each, and unary gaps of the high bits with counts of ones and zeros before each word."""

    n: int
    low_bits: int
    top: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(U), len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, ((most + 1) // max(n, 1)).bit_length() - 1)
        fields = np.empty((n, low_bits), np.uint8)
        for k in range(low_bits):
            fields[:, k] = (values >> U(k)) & U(1)
        highs = (values >> U(low_bits)).astype(np.int64)
        top = int(highs[-1]) if n else 0
        bits = np.zeros(n + top + 1, np.uint8)
        bits[highs + np.arange(n)] = 1
        high = _packed(bits)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, low_bits, top, _packed(fields.reshape(-1)), high, ones)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        low = self.low[word] >> shift
        over = (self.low[word + 1] << U(1)) << (U(63) - shift)
        return (low | over) & U((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _selected(self.high[word], i - self.ones[word])
        return ((place - i).astype(U) << U(self.low_bits)) | self.lows(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero among the high bits."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(zeros, k, side="right") - 1
        return word * 64 + _selected(~self.high[word], k - zeros[word])

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that isn't below each x, and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = np.minimum((x >> U(self.low_bits)), U(self.top + 1)).astype(np.int64)
        within = high <= self.top
        h = np.minimum(high, self.top)
        stop = self._zero(h) - h
        start = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) + 1 - h, 0)
        start = np.where(within, start, self.n)
        stop = np.where(within, stop, self.n)
        low = x & U((1 << self.low_bits) - 1)
        at, end, open_ = start.copy(), stop.copy(), np.flatnonzero(start < stop)
        while len(open_):  # halve what is left of each run of equal high bits
            middle = (at[open_] + end[open_]) >> 1
            below = self.lows(middle) < low[open_]
            at[open_[below]] = middle[below] + 1
            end[open_[~below]] = middle[~below]
            open_ = open_[at[open_] < end[open_]]
        equal = at < stop
        equal[equal] = self.lows(at[equal]) == low[equal]
        return at, equal

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.low_bits, self.top], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def from_parts(cls, parts: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*map(int, parts[f"{name}.shape"]), parts[f"{name}.low"], parts[f"{name}.high"], parts[f"{name}.ones"])


def to_bytes(parts: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: a table of contents, then each at a multiple of 8 bytes."""
    contents, at, blobs = {}, 0, []
    for name, array in parts.items():
        data = np.ascontiguousarray(array).tobytes()
        contents[name] = [array.dtype.str, at, len(array)]
        data += b"\0" * (-len(data) % 8)
        blobs.append(data)
        at += len(data)
    head = json.dumps(contents).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(blobs)


def from_buffer(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of such a file, as views of a byte array (a memory map)."""
    head = int.from_bytes(data[:8].tobytes(), "little")
    contents = json.loads(data[8 : 8 + head].tobytes())
    body = data[8 + head :]
    return {name: body[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in contents.items()}
