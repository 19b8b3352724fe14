"""A seeded, portable stream of random numbers: ChaCha with 8 rounds under a hashed key.

The key is the SHA-256 of the salt, a zero byte and the seed (little-endian, 64 bits). The order of
draws is part of every generator's result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

MASK = 0xFFFFFFFF
LARGEST = (1 << 64) - 1
#: The words "expand 32-byte k".
SIGMA = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)
#: Columns, then diagonals, of the 4 x 4 state.
QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def block(key: tuple[int, ...], counter: int) -> tuple[int, ...]:
    """The sixteen 32-bit words of one block."""
    start = [*SIGMA, *key, counter & MASK, counter >> 32 & MASK, 0, 0]
    x = list(start)
    for _ in range(4):
        for a, b, c, d in QUARTERS:
            for p, q, r, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                x[p] = (x[p] + x[q]) & MASK
                v = x[r] ^ x[p]
                x[r] = (v << turn | v >> (32 - turn)) & MASK
    return tuple((v + s) & MASK for v, s in zip(x, start))


def _turn(x: np.ndarray, by: int, spare: np.ndarray) -> None:
    np.left_shift(x, np.uint32(by), out=spare)
    np.right_shift(x, np.uint32(32 - by), out=x)
    np.bitwise_or(x, spare, out=x)


#: So many blocks are mixed together: enough for each call, and their state is near the core.
TOGETHER = 16384


def mixed(start: np.ndarray) -> np.ndarray:
    """The numbers of blocks from their starting states, (4, 4, n), as (n, 8): low word first.

    The state's rows are taken together: a round works on its four columns at once, and on its
    diagonals as columns of the rows turned against each other.
    """
    n = start.shape[2]
    out = np.empty((n, 16), np.uint32)
    for low in range(0, n, TOGETHER):
        part = start[:, :, low : low + TOGETHER]
        a, b, c, d = (np.ascontiguousarray(x) for x in part.copy())
        spare = np.empty_like(a)
        for _ in range(4):
            for turn in (1, -1):
                for x, y, z, by in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                    x += y
                    z ^= x
                    _turn(z, by, spare)
                b, c, d = b[[turn % 4, (1 + turn) % 4, (2 + turn) % 4, (3 + turn) % 4]], c[[2, 3, 0, 1]], d[[-turn % 4, (1 - turn) % 4, (2 - turn) % 4, (3 - turn) % 4]]
        for k, x in enumerate((a, b, c, d)):
            x += part[k]
            out[low : low + TOGETHER, 4 * k : 4 * k + 4] = x.T
    return out.view("<u8")


def blocks(key: tuple[int, ...], counter: int, n: int) -> list[int]:
    """The 64-bit numbers of `n` blocks on from `counter`."""
    at = np.arange(counter, counter + n, dtype=np.uint64)
    start = np.empty((4, 4, n), np.uint32)
    start[:3] = np.array([*SIGMA, *key], np.uint32).reshape(3, 4, 1)
    start[3, 0], start[3, 1], start[3, 2:] = at.astype(np.uint32), (at >> np.uint64(32)).astype(np.uint32), 0
    return mixed(start).ravel().tolist()


def first_blocks(keys: list[tuple[int, ...]]) -> list[list[int]]:
    """The first eight numbers under each key."""
    start = np.zeros((4, 4, len(keys)), np.uint32)
    start[0] = np.array(SIGMA, np.uint32).reshape(4, 1)
    start[1:3] = np.array(keys, np.uint32).T.reshape(2, 4, -1)
    return mixed(start).tolist()


def numbers(key: tuple[int, ...], first: list[int] | None = None) -> Iterator[int]:
    """The numbers of all blocks; more are made at a time as more are drawn. `first`: those of the
    first block, if they are known."""
    counter, made = 0, 4
    if first is not None:
        yield from first
        counter = 1
    while True:
        yield from blocks(key, counter, made)
        counter, made = counter + made, min(2048, 2 * made)


def threshold(p: float) -> int:
    """chance(p) holds for the draws under this."""
    return math.ceil(p * 2.0**53) << 11


def key_of(salt: bytes, seed: int) -> tuple[int, ...]:
    return struct.unpack("<8I", hashlib.sha256(salt + b"\0" + struct.pack("<Q", seed)).digest())


class Stream:
    """Draws, one after the other: `draw()` gives 64 bits, the others what they make of them."""

    def __init__(self, salt: bytes, seed: int):
        self.key = key_of(salt, seed)
        self.draw = numbers(self.key).__next__

    @staticmethod
    def short(salt: bytes, seeds: range, together: int = 256) -> Iterator["Stream"]:
        """A stream for each seed, their first numbers made together: for few draws from each."""
        for at in range(0, len(seeds), together):
            keys = [key_of(salt, seed) for seed in seeds[at : at + together]]
            for key, first in zip(keys, first_blocks(keys)):
                stream = Stream.__new__(Stream)
                stream.key, stream.draw = key, numbers(key, first).__next__
                yield stream

    def u64(self) -> int:
        return self.draw()

    def below(self, n: int) -> int:
        """Uniform under n: draws beyond the last whole multiple of n are drawn again."""
        whole = LARGEST - LARGEST % n
        while (x := self.draw()) >= whole:
            pass
        return x % n

    def unit(self) -> float:
        """The top 53 bits, in [0, 1)."""
        return (self.draw() >> 11) * 2.0**-53

    def chance(self, p: float) -> bool:
        return self.draw() < threshold(p)

    def weighted(self, cumulative: list[int]) -> int:
        """The first index whose running sum reaches a draw of 1 to the sum of all."""
        return bisect_left(cumulative, self.draw() % cumulative[-1] + 1)

    def binomial(self, n: int, p: float) -> int:
        under, draw = threshold(p), self.draw
        return sum([draw() < under for _ in range(n)])

    def shuffle(self, items: list) -> None:
        for k in range(len(items) - 1, 0, -1):
            j = self.below(k + 1)
            items[k], items[j] = items[j], items[k]
