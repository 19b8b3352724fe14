"""Many seeded streams side by side, drawn from in step.

A lane is a stream and the words drawn from it. Lanes take a step together, so that a step's
arithmetic is done for all of them at once; each lane's numbers, and what is made of them, are those
of functions.random.Stream, draw by draw.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .random import LARGEST, SIGMA, key_of, mixed

#: Numbers of a lane that are kept at a time. A step draws at most STEP of them.
KEPT, STEP = 512, 128
#: About how many words the lanes taken together have.
WORDS = 1 << 22


class Lanes:
    """Streams by (salt, seed). `draw(lanes)` gives a number of each of these lanes."""

    def __init__(self, streams: Sequence[tuple[bytes, int]]):
        n = len(streams)
        self.keys = np.array([key_of(salt, seed) for salt, seed in streams], np.uint32).reshape(n, 8)
        self.numbers = np.empty((n, KEPT), np.uint64)
        self.made = np.zeros(n, np.uint64)
        self.at = np.full(n, KEPT)
        self.flat = self.numbers.reshape(-1)

    def ready(self, lanes: np.ndarray) -> None:
        """Before a step: at least STEP numbers wait in each of these lanes. If one has fewer, all are
        filled again, so that blocks are made many at a time."""
        at = self.at[lanes]
        if not len(at) or at.max() <= KEPT - STEP:
            return
        each = at // 8
        gone = each * 8
        columns = np.arange(KEPT)
        rows = np.take_along_axis(self.numbers[lanes], np.minimum(columns + gone[:, None], KEPT - 1), 1)
        count = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        counter = np.repeat(self.made[lanes], each) + count.astype(np.uint64)
        start = np.empty((4, 4, len(count)), np.uint32)
        start[0] = np.array(SIGMA, np.uint32).reshape(4, 1)
        start[1:3] = np.repeat(self.keys[lanes], each, axis=0).T.reshape(2, 4, -1)
        start[3, 0], start[3, 1], start[3, 2:] = counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), 0
        rows[columns >= KEPT - gone[:, None]] = mixed(start).reshape(-1)
        self.numbers[lanes] = rows
        self.made[lanes] += each.astype(np.uint64)
        self.at[lanes] = at - gone

    def draw(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] = at + 1
        return self.flat[lanes * KEPT + at]

    def ahead(self, lanes: np.ndarray, n: int) -> np.ndarray:
        """The next `n` numbers of each lane, (lanes, n), still to be drawn."""
        return self.flat[(lanes * KEPT + self.at[lanes])[:, None] + np.arange(n)]

    def below(self, lanes: np.ndarray, n) -> np.ndarray:
        """Uniform under n, a number or one for each lane: see Stream.below."""
        n = np.asarray(n, np.uint64)
        whole = np.uint64(LARGEST) - np.uint64(LARGEST) % n
        x = self.draw(lanes)
        while (again := x >= whole).any():
            x[again] = self.draw(lanes[again])
        return (x % n).astype(np.int64)

    def weighted(self, lanes: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """See Stream.weighted; one list of running sums for all lanes."""
        return picked(self.draw(lanes), sums)


def picked(numbers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The first index whose running sum reaches a number's rest, of 1 to the sum of all."""
    return np.searchsorted(sums, numbers % sums[-1] + np.uint64(1))


class Words:
    """The words of all lanes as rows of letters: lane l has rows first[l] to first[l + 1], line by
    line. `begins` marks a line's first word; `line` is the row of that word, and `pool` the row that
    a number of lines before it begin at."""

    def __init__(self, layouts: Sequence[np.ndarray], width: int, window: int = 0):
        each = np.array([int(x.sum()) for x in layouts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(each)])
        sizes = np.concatenate([np.zeros(0, np.int64), *layouts]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        lane = np.repeat(np.arange(len(layouts)), [len(x) for x in layouts])
        number = np.arange(len(sizes)) - np.repeat(np.concatenate([[0], np.cumsum([len(x) for x in layouts])])[:-1].astype(np.int64), [len(x) for x in layouts])
        back = np.arange(len(sizes)) - np.minimum(number, window)
        self.line = np.repeat(starts, sizes)
        self.pool = np.repeat(starts[back], sizes) if len(sizes) else self.line
        self.begins = self.line == np.arange(len(self.line))
        self.sizes, self.lane = sizes, lane
        self.letters = np.zeros((len(self.line), width), np.uint8)
        self.length = np.zeros(len(self.line), np.int64)

    def put(self, lane: int, lines: list[list[str]]) -> None:
        """A lane's words from a list of them."""
        row = int(self.first[lane])
        for line in lines:
            for w in line:
                self.letters[row, : len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)
                self.length[row] = len(w)
                row += 1

    def many(self, alone: Callable[[int], list[list[str]]], cost: int) -> np.ndarray:
        """The lanes to fill in step, the longest first. The few longest of all are filled `alone` if
        that is sooner done than steps for so few; a step costs about as much as `cost` words."""
        each = np.diff(self.first)
        order = np.argsort(-each, kind="stable")
        few = min(len(order), 64)
        ordered = each[order[: few + 1]]
        spent = np.concatenate([[0], np.cumsum(ordered[:few])]) + cost * np.append(ordered, 0)[: few + 1]
        cut = int(np.argmin(spent)) if few else 0
        for lane in order[:cut].tolist():
            self.put(lane, alone(lane))
        return order[cut:]

    def steps(self, alone: Callable[[int], list[list[str]]], cost: int = 15):
        """(lanes, rows) of each step: the lanes that have a word left, and its row."""
        order = self.many(alone, cost)
        if not len(order):
            return
        ordered, base = np.diff(self.first)[order], self.first[order]
        active = np.searchsorted(-ordered, -np.arange(int(ordered[0])), side="left")
        for t, n in enumerate(active.tolist()):
            yield order[:n], base[:n] + t


def flat(letters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters as bytes in a row and the offsets of the words."""
    offsets = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return letters[np.arange(letters.shape[1]) < length[:, None]], offsets
