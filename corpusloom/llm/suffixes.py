"""Suffix arrays of byte strings by induced sorting, in whole-array steps.

A suffix is S-type if it is less than the next one, else L-type; an S-type suffix behind an L-type
one is leftmost smaller (LMS). LMS substrings are sorted and named by rank, the string of names is
sorted recursively, and the order of the LMS suffixes then induces that of all suffixes.

* Over bytes, inducing goes bucket by bucket, and within one by waves: a wave holds the suffixes
  that the wave before induced in the same bucket. So a pass takes a number of array steps that
  depends on the alphabet and the longest run of one byte, and work linear in the text.
* A string of names has about as many symbols as places, so its buckets hold next to nothing. There
  all chains are followed side by side: two suffixes compare by symbol and type up to the next LMS
  place, which both reach together if they haven't differed, and there by the rank that the
  recursion gave it. Each step only looks at suffixes still tied.

Places and ranks are 32-bit; a text must be shorter than 2^30.
"""

from __future__ import annotations

import numpy as np

NONE = np.empty(0, np.int32)


def s_types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S-type; the end of the text counts as less than any symbol."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    differs = np.flatnonzero(t[:-1] != t[1:])
    if len(differs):
        # A run of equal symbols has the type of its last one; the last run is L-type.
        s[: differs[-1] + 1] = np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1))
    return s


def lms_places(s: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)


def _split(parts: list[list[np.ndarray]], symbols: np.ndarray, positions: np.ndarray) -> None:
    """Appends positions to their symbols' lists, keeping their order."""
    if len(positions):
        order = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=256)
        positions, end = positions[order], 0
        for c in np.flatnonzero(counts):
            parts[c].append(positions[end : end + counts[c]])
            end += counts[c]


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that sorted LMS suffixes induce.

    `lms` is sorted as far as is known; first bytes needn't be grouped.
    """
    symbols = np.flatnonzero(np.bincount(t, minlength=256))
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _split(seeds, t[lms], lms)
    ahead: list[list[np.ndarray]] = [[] for _ in range(256)]
    lower: list[np.ndarray] = [NONE] * 256
    # The text's last suffix is L-type and comes first: the end before it is the least of all.
    ahead[t[-1]].append(np.array([len(t) - 1], np.int32))
    for c in symbols:
        waves = []
        wave = np.concatenate(ahead[c]) if ahead[c] else NONE
        ahead[c] = []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            before = before[~s[before]]
            first = t[before]
            same = first == c
            _split(ahead, first[~same], before[~same])
            wave = before[same]
        if waves:
            lower[c] = np.concatenate(waves)
        if seeds[c]:
            before = np.concatenate(seeds[c]) - 1
            seeds[c] = []
            _split(ahead, t[before], before)
    upper: list[np.ndarray] = [NONE] * 256
    for c in symbols[::-1]:
        waves = []
        wave = np.concatenate(ahead[c]) if ahead[c] else NONE
        ahead[c] = []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            before = before[s[before]]
            first = t[before]
            same = first == c
            _split(ahead, first[~same], before[~same])
            wave = before[same]
        if waves:
            upper[c] = np.concatenate(waves)[::-1]
        back = lower[c][::-1]
        before = back[back > 0] - 1
        before = before[s[before]]
        _split(ahead, t[before], before)
    return np.concatenate([x for c in symbols for x in (lower[c], upper[c])])


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring among the distinct ones, by place in `lms`; `ordered`: the LMS
    places in the order of their substrings."""
    n = len(t)
    at = np.empty(n, np.int32)
    at[lms] = np.arange(len(lms), dtype=np.int32)
    at = at[ordered]
    length = (np.append(lms[1:], np.int32(n - 1))[at] - ordered + 1).astype(np.int32)
    a, b = ordered[:-1], ordered[1:]
    new = length[:-1] != length[1:]
    # The last one reaches the text's end, which no other does.
    new |= (at[:-1] == len(lms) - 1) | (at[1:] == len(lms) - 1)
    open_ = np.flatnonzero(~new).astype(np.int32)
    depth = 0
    while len(open_):
        differ = t[a[open_] + depth] != t[b[open_] + depth]
        new[open_[differ]] = True
        depth += 1
        open_ = open_[~differ]
        open_ = open_[length[open_] > depth]
    names = np.empty(len(lms), np.int32)
    names[at] = np.concatenate([[0], np.cumsum(new)])
    return names


def _chained(start: np.ndarray, coded: np.ndarray, deep: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the chains from `start`, and whether each differs from the one before it.

    A chain is compared by `coded` at its start and by `deep` behind it, up to the first place behind
    the start that is in `stops`, that one included. Both end with a symbol of their own that is
    less than all others and in `stops`.
    """
    bits = int(deep.max()).bit_length()
    if int(coded.max()).bit_length() + bits < 63:
        key = (coded[start] << bits) | deep[start + 1]
        order = np.argsort(key)
    else:
        key = np.stack([coded[start], deep[start + 1]], axis=1)
        order = np.lexsort((key[:, 1], key[:, 0]))
    key = key[order]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) if key.ndim == 1 else (key[1:] != key[:-1]).any(axis=1)
    del key
    # Places in the order that are tied with a neighbour and don't stand at a stop: equal ones stay.
    tied = ~new
    tied[:-1] |= ~new[1:]
    going = np.flatnonzero(tied)
    depth = 1
    going = going[~stops[start[order[going]] + depth]]
    while len(going):
        depth += 1
        head = new[going]
        head[0] = True
        group = np.cumsum(head)
        held = order[going]
        place = start[held] + depth
        key = deep[place]
        if int(group[-1]).bit_length() + bits < 63:
            again = np.argsort((group << bits) | key)
        else:
            again = np.lexsort((key, group))
        order[going] = held[again]
        key, ended = key[again], stops[place[again]]
        fresh = head
        fresh[1:] |= key[1:] != key[:-1]
        new[going] = fresh
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        going = going[~(alone | ended)]
    return order, new


def _of_names(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string over any alphabet, by following chains."""
    n = len(t)
    s = s_types(t)
    stops = np.zeros(n + 1, bool)
    lms = lms_places(s)
    stops[lms] = stops[n] = True
    coded = np.zeros(n + 1, np.int64)
    coded[:n] = 2 * (t.astype(np.int64) + 1) + s
    if len(lms):
        order, new = _chained(lms, coded, coded, stops)
        names = np.cumsum(new) - 1
        if new.all():
            order = lms[order]
        else:
            string = np.empty(len(lms), np.int32)
            string[order] = names
            order = lms[_of_names(string)]
        # A chain's last place counts by its rank.
        deep = coded * (len(lms) + 1)
        deep[order] += np.arange(1, len(lms) + 1)
    else:
        deep = coded
    return _chained(np.arange(n, dtype=np.int32), coded, deep, stops)[0].astype(np.int32)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of a byte string, as an array of uint8, in order."""
    if not len(t):
        return NONE
    s = s_types(t)
    lms = lms_places(s)
    if len(lms):
        order = induce(t, s, lms)
        leftmost = np.zeros(len(t), bool)
        leftmost[lms] = True
        order = order[leftmost[order]]
        names = _names(t, lms, order)
        lms = order if names.max() == len(lms) - 1 else lms[_of_names(names)]
    return induce(t, s, lms)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix the length of the prefix it shares with the one before it in `order`: the
    permuted array.

    Where a suffix and its neighbour stand behind equal bytes, its value is one less than that of
    the suffix before; only the others are compared, eight bytes at a time. The values compared add
    up to n log n at most.
    """
    n = len(t)
    prior = np.full(n, -1, np.int32)
    prior[order[1:]] = order[:-1]
    own = np.ones(n, bool)
    own[1:] = (prior[1:] < 1) | (t[:-1] != t[prior[1:] - 1])
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    value = np.zeros(n, np.int32)
    places = np.flatnonzero(own & (prior >= 0)).astype(np.int32)
    for k in range(0, len(places), 1 << 17):
        at = places[k : k + (1 << 17)]
        other = prior[at]
        length = np.zeros(len(at), np.int32)
        room = n - np.maximum(at, other)
        going = np.arange(len(at), dtype=np.int32)
        depth = 0
        while len(going):
            a, b = (word[np.minimum(x[going] + depth, n)].view("<u8").ravel() for x in (at, other))
            x = a ^ b
            low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int32) // 8  # equal bytes in front
            length[going] = np.minimum(depth + np.where(x == 0, 8, low), room[going])
            going = going[(x == 0) & (length[going] == depth + 8)]
            depth += 8
        value[at] = length + at
    first = np.flatnonzero(prior < 0)
    value[first] = first
    np.maximum.accumulate(value, out=value)
    value -= np.arange(n, dtype=np.int32)
    return value


def repeated(t: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a string of `length` bytes that also starts elsewhere in `t`."""
    hit = np.zeros(len(t), bool)
    if len(t) >= length:
        order = suffix_array(t)
        long = common_prefixes(t, order)[order] >= length
        hit[order[long]] = True
        hit[order[:-1][long[1:]]] = True
    return hit
