"""The fingerprint of a corpus from its pieces: stretches of its stream that tasks measure on their own.

A piece gives sums (counts of neighbouring letters, lengths, lines, words near each other), its words'
counts, and its first and last words, from which stitched() finds what lies across two pieces. The
values are those of textstats.fingerprint; only float sums may differ in their last digits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .textstats import entropy, given

#: The reach of a repeat, and of the type-token window.
REACH = 500
#: A byte's number: 0 for the space behind a word, a-z, then other letters and digits.
PLACE = np.full(256, 255, np.uint8)
PLACE[32] = 0
for _k, _c in enumerate(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    PLACE[_c] = _k + 1
SIDE = 64
SUMS = ("words", "length", "square", *[f"wlen_{k}" for k in range(1, 11)], "lines", "first", "last", "para", "paras", "near", "same", "edit")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def scattered(x: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all of a number's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Text:
    """Words in a row: `rows` of letters as PLACE has them, padded with zeros, their `length`, the lines'
    sizes (none is empty) and which lines start a paragraph, and a key of each word: exact for words of
    up to 12 letters a-z, a hash of 63 bits for others."""

    rows: np.ndarray
    length: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    key: np.ndarray

    @staticmethod
    def of(letters: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> "Text":
        length = np.diff(offsets)
        width = int(length.max()) if len(length) else 0
        rows = np.zeros((len(length), width), np.uint8)
        rows[np.arange(width) < length[:, None]] = PLACE[letters]
        key = np.zeros(len(length), np.uint64)
        for k in range(min(width, 12)):
            c = rows[:, k].astype(np.uint64)
            key = np.where(c > 0, key * np.uint64(32) + c, key)
        odd = np.flatnonzero((length > 12) | (rows > 26).any(axis=1))
        other = np.zeros(len(odd), np.uint64)
        for k in range(width if len(odd) else 0):
            c = rows[odd, k].astype(np.uint64)
            other = np.where(c > 0, scattered(other + c * _MIX), other)
        key[odd] = other | np.uint64(1 << 63)
        return Text(rows, length, sizes[sizes > 0], starts[sizes > 0], key)


def within_one(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether rows of letters are exactly one edit apart."""
    found = (n == m) & ((a != b).sum(axis=1) == 1)
    for x, y, some in ((a, b, m - n == 1), (b, a, n - m == 1)):
        at = np.flatnonzero(some)
        if len(at):
            x_, y_ = x[at], y[at]
            agree = np.logical_and.accumulate(x_ == y_, axis=1)
            moved = np.zeros_like(y_)
            moved[:, :-1] = y_[:, 1:]
            found[at] = (agree | (x_ == moved)).all(axis=1)
    return found


def near_in_lines(text: Text) -> np.ndarray:
    """Which words have another one of their line within one edit, by the keys of operators.statistics.near_words."""
    n = len(text.length)
    near = np.zeros(n, bool)
    line = np.repeat(np.arange(len(text.sizes), dtype=np.uint64), text.sizes)
    at, lines = 0, np.concatenate([[0], np.cumsum(text.sizes)])
    while at < len(text.sizes):
        # Whole lines, about 32,768 words at a time.
        to = max(at + 1, int(np.searchsorted(lines, lines[at] + 32768, side="right")) - 1)
        a, b = lines[at], lines[to]
        rows, length = text.rows[a:b], text.length[a:b]
        width = int(length.max())
        salt = scattered(line[a:b] * _MIX + np.uint64(7))
        # A word's hash is a sum over its letters from the front, so that what is left without a letter
        # is the part before it and the part behind, moved by one place.
        power = np.cumprod(np.full(width + 1, 0xD1342543DE82EF95, np.uint64))
        terms = rows[:, :width].astype(np.uint64) * power[:width]
        moved = rows[:, 1:width].astype(np.uint64) * power[: width - 1] if width > 1 else np.zeros((len(rows), 0), np.uint64)
        own = terms.sum(axis=1, dtype=np.uint64)
        tail = np.zeros((len(rows), width), np.uint64)
        if width > 1:
            tail[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        head = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        inside = np.arange(width) < length[:, None]
        word = np.broadcast_to(np.arange(len(rows))[:, None], inside.shape)[inside]
        changed = (own[:, None] - terms + np.uint64(101) * power[:width])[inside]
        shorter = (head + tail)[inside]
        size = length[word]
        keys = np.concatenate([scattered(own + length.astype(np.uint64)) + salt, scattered(shorter + (size - 1).astype(np.uint64)) + salt[word], scattered(~(changed + size.astype(np.uint64))) + salt[word]])
        owner = np.concatenate([np.arange(len(rows)), word, word])
        kind = np.repeat(np.array([0, 1, 2], np.uint8), [len(rows), len(word), len(word)])
        order = np.argsort(keys)
        keys, owner, kind = keys[order], owner[order], kind[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.cumsum(new) - 1
        many = np.bincount(group)
        owns = np.bincount(group, kind == 0)
        # Words alike or one substitution apart share such a key; a word less a letter is another's own.
        hit = np.where(kind == 2, many[group] > 1, np.where(kind == 0, many[group] > 1, owns[group] > 0))
        near[a:b][owner[hit]] = True
        at = to
    return near


def sums(text: Text, page: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By page (each word's page, ascending): the SUMS, the counts of neighbouring letters in the columns
    that occur, and those columns, a * SIDE + b. Pairs of words across two pages don't count."""
    n, length = len(text.length), text.length
    by = lambda of, weights=None: np.bincount(of, weights, pages)
    begin = np.concatenate([[0], np.cumsum(text.sizes)[:-1]]).astype(np.int64) if len(text.sizes) else np.zeros(0, np.int64)
    of_line = page[begin] if len(begin) else begin
    out = np.zeros((pages, len(SUMS)))
    out[:, 0], out[:, 1], out[:, 2] = by(page), by(page, length), by(page, length**2)
    out[:, 3:13] = np.bincount(page * 10 + np.clip(length, 1, 10) - 1, minlength=10 * pages).reshape(pages, 10)
    last = begin + text.sizes - 1
    out[:, 13], out[:, 14], out[:, 15] = by(of_line), by(of_line, length[begin]), by(of_line, length[last])
    out[:, 16], out[:, 17] = by(of_line, length[begin] * text.starts), by(of_line, text.starts.astype(float))
    out[:, 18] = by(page, near_in_lines(text).astype(float)) if n else 0
    beside = page[1:] == page[:-1]
    same = text.key[1:] == text.key[:-1]
    out[:, 19] = by(page[1:], (same & beside).astype(float))
    close = np.flatnonzero(beside & ~same & (np.abs(np.diff(length)) <= 1))
    hit = close[within_one(text.rows[close], text.rows[close + 1], length[close], length[close + 1])]
    out[:, 20] = by(page[hit + 1])
    # A space in front of a word and behind it: pairs of a row moved by one place.
    def codes(k: int) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(length >= k)
        a = text.rows[some, k - 1].astype(np.int64) if k else np.zeros(len(some), np.int64)
        b = text.rows[some, k].astype(np.int64) if k < text.rows.shape[1] else np.zeros(len(some), np.int64)
        return a * SIDE + b, some

    places = range(text.rows.shape[1] + 1) if n else ()
    whole = np.zeros(SIDE * SIDE, np.int64)
    for k in places:
        whole += np.bincount(codes(k)[0], minlength=SIDE * SIDE)
    columns = np.flatnonzero(whole)
    if pages == 1:
        return out, whole[columns][None], columns
    place, pairs = np.zeros(SIDE * SIDE, np.int64), np.zeros(pages * len(columns), np.int64)
    place[columns] = np.arange(len(columns))
    for k in places:
        found, some = codes(k)
        pairs += np.bincount(page[some] * len(columns) + place[found], minlength=len(pairs))
    return out, pairs.reshape(pages, len(columns)), columns


def gaps(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a stream of small numbers, in some order, with the distance to the same number before;
    a very large one for the first of each."""
    n = len(ids)
    bits = max(n - 1, 1).bit_length()
    order = (ids.astype(np.int64) << bits) | np.arange(n)
    order.sort()
    at = order & ((1 << bits) - 1)
    gap = np.full(n, 1 << 40)
    same = np.flatnonzero((order[1:] >> bits) == (order[:-1] >> bits)) + 1
    gap[same] = at[same] - at[same - 1]
    return at, gap


def _repeats(ids: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """Repeats within 10 and 100, and windows as repeats() has them, over a short stretch on its own."""
    order = (ids << bits) | places[: len(ids)]
    order.sort()
    # Of one word, how far apart; of two words, more than REACH, as the places need fewer bits.
    gap = np.diff(order)
    return np.array([np.count_nonzero(gap <= 10), np.count_nonzero(gap <= 100), np.minimum(gap, REACH).sum(dtype=np.int64) + (REACH if len(ids) else 0)])


def repeats(ids: np.ndarray) -> tuple[int, int, int]:
    """Of a stream of small numbers beyond its first REACH: repeats within 10 and 100, and how many
    windows of REACH count a word as their first of its kind. Stretches are short enough for a core's
    cache, and each begins REACH early."""
    bits, size = 15, 1 << 14
    kind = np.uint32 if len(ids) and int(ids.max()) < 1 << 32 - bits else np.int64
    ids, places = ids.astype(kind), np.arange(size + REACH, dtype=kind)
    found = np.zeros(3, np.int64)
    for at in range(REACH, len(ids), size):
        stretch = ids[at - REACH : at + size]
        found += _repeats(stretch, places, bits) - _repeats(stretch[:REACH], places, bits)
    return tuple(found.tolist())


@dataclass
class Ends:
    """A piece's words for those beside it: how many in all, the keys of its first REACH and last
    2 REACH, its repeats(), and the letters of its first and last word."""

    n: int
    head: np.ndarray
    tail: np.ndarray
    repeats: tuple[int, int, int]
    first: np.ndarray
    last: np.ndarray


def stitched(pieces: list[Ends]) -> dict[str, float]:
    """same and edit across pieces, and the repeats and windows of the whole stream."""
    before, n, same, edit, near, far, windows, last = np.zeros(0, np.uint64), 0, 0, 0, 0, 0, 0, None
    for piece in (p for p in pieces if p.n):
        if last is not None:
            if before[-1] == piece.head[0]:
                same += 1
            else:
                width = max(len(last), len(piece.first))
                a, b = (np.pad(x, (0, width - len(x)))[None] for x in (last, piece.first))
                edit += int(within_one(a, b, np.array([len(last)]), np.array([len(piece.first)]))[0])
        context = before[-REACH:]
        at, gap = gaps(np.unique(np.concatenate([context, piece.head]), return_inverse=True)[1])
        new = at >= len(context)
        at, gap = at[new] - len(context) + n, gap[new]
        near, far = near + int((gap <= 10).sum()) + piece.repeats[0], far + int((gap <= 100).sum()) + piece.repeats[1]
        windows += int(np.minimum(np.minimum(gap, REACH), at + 1).sum()) + piece.repeats[2]
        n += piece.n
        before, last = np.concatenate([before, piece.tail])[-2 * REACH :], piece.last
    if n <= REACH:
        mattr = len(np.unique(before)) / n if n else 0.0
    else:
        # No window begins behind the last that is whole.
        at, gap = gaps(np.unique(before, return_inverse=True)[1])
        at = at + n - len(before)
        low = np.maximum(at - np.minimum(gap, REACH) + 1, 0)
        beyond = at > n - REACH
        windows -= int((at - low + 1 - np.maximum(n - REACH - low + 1, 0))[beyond].sum())
        mattr = windows / (n - REACH + 1) / REACH
    return {"same": same, "edit": edit, "near": near, "far": far, "mattr": mattr}


def values(total: np.ndarray, pairs: np.ndarray, ends: dict[str, float], types: int, once: int, top: np.ndarray) -> list[float]:
    """The fingerprint from a corpus's SUMS, its counts of letters side by side (SIDE x SIDE), what
    stitched() says, its numbers of types and of those found once, and the counts of its 500 most
    frequent words."""
    s = dict(zip(SUMS, total.tolist()))
    n = s["words"]
    if not n:
        return [0.0] * 30
    pairs = pairs.reshape(SIDE, SIDE)
    single, inside = pairs.sum(axis=0), pairs.copy()
    inside[0, :] = inside[:, 0] = 0
    glyphs = int((single[1:] > 0).sum())
    mean = s["length"] / n
    out = [math.log2(glyphs), entropy(single), given(pairs), given(inside), entropy(pairs[0]), entropy(pairs[:, 0])]
    out += [mean, math.sqrt(max(s["square"] / n - mean * mean, 0.0)), *[s[f"wlen_{k}"] / n for k in range(1, 11)]]
    y = np.log(np.sort(top)[::-1][:500].astype(float))
    x = np.log(np.arange(1, len(y) + 1))
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()) if len(y) > 1 else 0.0
    between = max(n - 1, 1)
    out += [slope, once / types, ends["mattr"], (s["same"] + ends["same"]) / between, (s["edit"] + ends["edit"]) / between, s["near"] / n, ends["near"] / n, ends["far"] / n]
    out += [s["first"] / s["lines"] - mean, s["last"] / s["lines"] - mean, s["para"] / s["paras"] - mean if s["paras"] else 0.0, n / s["lines"]]
    return [x + 0.0 for x in out]


def ends_of(text: Text, ids: np.ndarray | None = None) -> Ends:
    if not len(text.key):
        none = np.zeros(0, np.uint64)
        return Ends(0, none, none, (0, 0, 0), none, none)
    ids = np.unique(text.key, return_inverse=True)[1] if ids is None else ids
    word = lambda k: text.rows[k, : text.length[k]]
    return Ends(len(ids), text.key[:REACH], text.key[-2 * REACH :], repeats(ids), word(0), word(-1))
