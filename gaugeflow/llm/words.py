"""Words of many texts at once, hashed with numpy inside a task.

A word is a run of bytes other than space and 0x09-0x0D. Texts are handled in blocks of about a
quarter of a megabyte, so memory follows the block (or one longer text), never the partition. A word's hash is a
polynomial in its bytes over a fixed table of random 64-bit values, modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 18
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _odd(seed: int) -> tuple[np.uint64, np.uint64]:
    p = int(np.random.default_rng(seed).integers(2**63)) * 2 + 1
    return _U(p), _U(pow(p, -1, 2**64))


class _Powers:
    """p**i and p**-i modulo 2**64, grown by an eighth or to what is asked for, so that seeds of short runs stay small."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, len(self.up) * 9 // 8, 1024)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, p)])) for p in self.base)
        return self.up[:n], self.down[:n]


_POWERS: dict[int, _Powers] = {}


def _powers(seed: int) -> _Powers:
    return _POWERS.setdefault(seed, _Powers(seed))


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 1000).integers(0, 2**64, 256, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Block:
    """Texts lo..hi-1 of a batch. Word i is data[start[i]:end[i]]; text j has words first[j]..first[j+1]-1."""

    lo: int
    hi: int
    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 1) -> np.ndarray:
        codes = np.frombuffer(self.data, np.uint8)
        up, down = _powers(seed).to(len(codes) + 1)
        total = np.zeros(len(codes) + 1, _U)
        np.cumsum(_table(seed)[codes] * up[: len(codes)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def windows(self, hashes: np.ndarray, n: int, seed: int = 2) -> np.ndarray:
        """The hash of words i..i+n-1 for every i up to len-n; those that leave their text are to be skipped."""
        if len(hashes) < n:
            return np.zeros(0, _U)
        up, down = _powers(seed).to(len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, _U)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def blocks(texts: list[bytes | None], lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of consecutive texts, in order, covering all; null is a text without words."""
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi] or b"") <= size):
            held += len(texts[hi] or b"") + 1
            hi += 1
        part = [x or b"" for x in texts[lo:hi]]
        data = b"\n".join([*part, b""])
        if lower:
            data = data.translate(LOWER)
        space = _SPACE[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        bounds = np.cumsum([0, *(len(x) + 1 for x in part)])
        yield Block(lo, hi, data, start, end, np.searchsorted(start, bounds))
        lo = hi


def binaries(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
