"""Seeded corpora: a generator fills a layout of lines with words.

A generator is sequential in its draws, and the order of draws is part of its result. One corpus is
one row of work for an Arrow function. A registered simulation fills every page of the documents
corpus on its own, so its tasks are as large as a page and as many as there are pages.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.functions import textstats
from corpusloom.functions.lanes import STEP, WORDS, Lanes, Words, flat, picked
from corpusloom.functions.random import Stream, threshold
from corpusloom.sources import corpus

#: The letters of made-up words, letters alike, and the parts put on or off.
ALPHABET = "ocheydaiklrstqnmpfg"
ALIKE = "oay|ei|kt|pf|lr|ds|nm|ch"
PREFIXES = "qo,o,ch,sh,d,y"
SUFFIXES = "y,dy,aiin,ain,al,ar,ol,or,am"
EDGE = " "
DECIMAL = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?")
#: What fills a layout, a list of numbers of words, with lines of words.
Generator = Callable[[Stream, list[int]], list[list[str]]]
#: The same for many streams in step; a third function fills one layout on its own, by its number.
InLanes = Callable[[Lanes, list[np.ndarray], Callable[[int], list[list[str]]]], Words]


class BadParameter(ValueError):
    """A generator's parameter is missing, malformed or out of its range."""


def is_decimal(text: str) -> bool:
    return DECIMAL.fullmatch(text) is not None


class Parameters:
    """A generator's parameters: numbers, decimal strings, strings or booleans by name."""

    def __init__(self, given: dict | None):
        self.given = given or {}

    def number(self, name: str, default: float, low: float = -math.inf, high: float = math.inf) -> float:
        x = self.given.get(name, default)
        if isinstance(x, str) and is_decimal(x):
            x = float(x)
        if isinstance(x, (bool, str)) or not isinstance(x, (int, float)) or not math.isfinite(x):
            raise BadParameter(f"{name} must be a finite number or a decimal string")
        if not low <= x <= high:
            raise BadParameter(f"{name} must be in [{low:g}, {high:g}]")
        return float(x)

    def chance(self, name: str, default: float) -> float:
        return self.number(name, default, 0.0, 1.0)

    def whole(self, name: str, default: int, low: int, high: int) -> int:
        """A non-negative integer, moved into [low, high]."""
        x = self.given.get(name, default)
        if isinstance(x, str) and is_decimal(x) and not set(x) & set("-."):
            x = int(x)
        if isinstance(x, bool) or not isinstance(x, int) or not 0 <= x < 1 << 64:
            raise BadParameter(f"{name} must be a non-negative integer or an integer string")
        return min(max(x, low), high)

    def text(self, name: str, default: str) -> str:
        x = self.given.get(name, default)
        if not isinstance(x, str):
            raise BadParameter(f"{name} must be a string")
        return x

    def letters(self) -> str:
        found = plain(self.text("alphabet", ALPHABET))
        if not found:
            raise BadParameter("alphabet must contain at least one glyph")
        return found

    def parts(self, name: str, default: str, apart: str) -> list[str]:
        return [x for x in map(plain, self.text(name, default).split(apart)) if x]


def plain(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isalnum())


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1"), np.uint8)


@cache
def falling(n: int, exponent: float) -> list[int]:
    """Running sums of integer weights that fall with a power of the rank; equal ones for 0."""
    weights = [1e6 if exponent == 0 else 1e6 / math.exp(exponent * math.log(k)) for k in range(1, n + 1)]
    return list(accumulate(max(1, int(w)) for w in weights))


def word_maker(p: Parameters) -> Callable[[Stream], str]:
    """Words of 1 + Binomial(len_n, len_p) letters."""
    glyphs, n, chance = p.letters(), p.whole("len_n", 9, 0, 30), p.chance("len_p", 0.45)
    sums = falling(len(glyphs), p.number("zipf_s", 0.0, 0.0, 4.0))
    under, total = threshold(chance), sums[-1]

    def word(rng: Stream) -> str:
        draw = rng.draw
        length = 1 + sum([draw() < under for _ in range(n)])
        return "".join([glyphs[bisect_left(sums, draw() % total + 1)] for _ in range(length)])

    return word


def letters_in(lanes: Lanes, at: np.ndarray, n: int, under: int, sums: np.ndarray, glyphs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_maker's words for these lanes: rows of 1 + n letters, and how many of them count."""
    drawn = lanes.ahead(at, 2 * n + 1)
    length = 1 + (drawn[:, :n] < np.uint64(under)).sum(axis=1) if under < 1 << 64 else np.full(len(at), 1 + n)
    most = int(length.max())
    lanes.at[at] += n + length
    return glyphs[picked(drawn[:, n : n + most], sums)], length


def gibberish(p: Parameters, resources: dict) -> Generator:
    word = word_maker(p)
    return lambda rng, layout: [[word(rng) for _ in range(n)] for n in layout]


def gibberish_in_lanes(p: Parameters, resources: dict) -> InLanes:
    glyphs, n, under = coded(p.letters()), p.whole("len_n", 9, 0, 30), threshold(p.chance("len_p", 0.45))
    sums = np.array(falling(len(glyphs), p.number("zipf_s", 0.0, 0.0, 4.0)), np.uint64)

    def fill(lanes: Lanes, layouts: list[np.ndarray], alone: Callable) -> Words:
        words = Words(layouts, n + 1)
        for at, row in words.steps(alone):
            lanes.ready(at)
            made, length = letters_in(lanes, at, n, under, sums, glyphs)
            words.letters[row, : made.shape[1]] = made
            words.length[row] = length
        return words

    return fill


def bagofwords(p: Parameters, resources: dict) -> Generator:
    """Words drawn on their own from a bag [(word, count)]."""
    bag = resources.get("word_bag")
    if bag is None:
        raise BadParameter("word_bag is missing")
    if not bag:
        raise BadParameter("word_bag is empty")
    sums = list(accumulate(max(1, n) for _, n in bag))
    return lambda rng, layout: [[bag[rng.weighted(sums)][0] for _ in range(n)] for n in layout]


def charmarkov(p: Parameters, resources: dict) -> Generator:
    """Letters given the `order` before them, fewer where those were never seen; the context starts
    anew on each line."""
    model = resources.get("glyph_model")
    if model is None:
        raise BadParameter("glyph_model is missing")
    order = p.whole("order", model["order"], 0, 6)
    if order != model["order"]:
        raise BadParameter("order does not match the glyph model's")
    longest = p.whole("max_len", 20, 2, 64)
    table = {c: ([g for g, _ in seen], list(accumulate(n for _, n in seen))) for c, seen in model["counts"].items() if sum(n for _, n in seen)}
    if not table:
        raise BadParameter("glyph model is empty")

    def glyph(rng: Stream, context: str) -> str:
        for known in range(order, -1, -1):
            found = table.get(EDGE * (order - known) + context[order - known :])
            if found:
                return found[0][rng.weighted(found[1])]
        return EDGE

    def generate(rng: Stream, layout: list[int]) -> list[list[str]]:
        out = []
        for n in layout:
            context, line = EDGE * order, []
            while len(line) < n:
                word = ""
                while len(word) < longest:
                    g = glyph(rng, context)
                    if g == EDGE and not word:
                        continue
                    if g == EDGE:
                        break
                    word += g
                    context = (context + g)[-order:]
                context = (context + EDGE)[-order:]
                line.append(word)
            out.append(line)
        return out

    return generate


def charmarkov_in_lanes(p: Parameters, resources: dict) -> InLanes | None:
    """None for a model too large to be told apart by number: its contexts, all combinations of its
    letters, are those of a table."""
    model = resources["glyph_model"]
    order, longest = model["order"], p.whole("max_len", 20, 2, 64)
    alphabet = EDGE + "".join(sorted({g for seen in model["counts"].values() for g, _ in seen} - {EDGE}))
    size = len(alphabet)
    if size**order * size > 1 << 20 or any(len(c) != order for c in model["counts"]) or not all(g.isascii() for g in alphabet):
        return None
    table = {c: seen for c, seen in model["counts"].items() if sum(n for _, n in seen)}
    sums, which = np.zeros((size**order, size), np.uint64), np.zeros((size**order, size), np.int64)
    for number, context in enumerate(map("".join, product(alphabet, repeat=order))):
        found = next((table[c] for k in range(order, -1, -1) if (c := EDGE * (order - k) + context[order - k :]) in table), [(EDGE, 1)])
        upto = list(accumulate(n for _, n in found))
        sums[number] = upto + [upto[-1]] * (size - len(upto))
        which[number, : len(found)] = [alphabet.index(g) for g, _ in found]
    glyphs, total, wrap = coded(alphabet), sums[:, -1].copy(), size ** max(order - 1, 0)

    def fill(lanes: Lanes, layouts: list[np.ndarray], alone: Callable) -> Words:
        words = Words(layouts, longest)
        each = np.diff(words.first)
        lane = words.many(alone, 60)
        lane = lane[each[lane] > 0]
        # A lane's word is done at its own time: each has the row it is at, its context and length.
        row, end = words.first[lane], words.first[lane + 1]
        context, length = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        moved = lambda c, g: c % wrap * size + g if order else c
        drawn = STEP
        while len(lane):
            if drawn == STEP:
                lanes.ready(lane)
                drawn = 0
            drawn += 1
            at = lanes.draw(lane) % total[context] + np.uint64(1)
            g = which[context, (sums[context] < at[:, None]).sum(axis=1)]
            edge = g == 0
            inside = np.flatnonzero(~edge)
            words.letters[row[inside], length[inside]] = glyphs[g[inside]]
            length[inside] += 1
            context[inside] = moved(context[inside], g[inside])
            done = np.flatnonzero((edge & (length > 0)) | (length == longest))
            words.length[row[done]] = length[done]
            row[done] += 1
            length[done] = 0
            over = row[done] == end[done]
            begins = words.begins[np.minimum(row[done], len(words.begins) - 1)]
            context[done] = np.where(begins, 0, moved(context[done], 0))
            if over.any():
                left = np.ones(len(lane), bool)
                left[done[over]] = False
                lane, row, end, context, length = (x[left] for x in (lane, row, end, context, length))
        return words

    return fill


def editor(p: Parameters) -> Callable[[Stream, str], str]:
    """One change of a word: a letter replaced by one alike, put in or taken out, or a part put on or
    off at an end."""
    glyphs = p.letters()
    weights = [p.number(name, w, 0.0, 1000.0) for name, w in (("w_substitute", 4.0), ("w_insert", 1.0), ("w_delete", 2.0), ("w_affix", 1.5))]
    kinds = list(accumulate(int(w * 1000.0) for w in weights))
    if not kinds[-1]:
        raise BadParameter("at least one edit weight must be positive")
    alike: dict[str, str] = {}
    for group in p.parts("similar", ALIKE, "|"):
        for g in group if len(group) > 1 else "":
            alike.setdefault(g, group.replace(g, ""))
    prefixes, suffixes = p.parts("prefixes", PREFIXES, ","), p.parts("suffixes", SUFFIXES, ",")
    shortest = p.whole("min_len", 1, 1, 10)

    def edit(rng: Stream, word: str) -> str:
        kind = rng.weighted(kinds)
        if kind == 0:
            k = rng.below(len(word))
            others = alike.get(word[k], glyphs)
            return word[:k] + others[rng.below(len(others))] + word[k + 1 :]
        if kind == 1:
            k = rng.below(len(word) + 1)
            return word[:k] + glyphs[rng.below(len(glyphs))] + word[k:]
        if kind == 2:
            if len(word) <= shortest:
                return word
            k = rng.below(len(word))
            return word[:k] + word[k + 1 :]
        front = rng.chance(0.5)
        pool = prefixes if front else suffixes
        if not pool:
            return word
        part = pool[rng.below(len(pool))]
        if len(word) > len(part) and (word.startswith(part) if front else word.endswith(part)):
            return word[len(part) :] if front else word[: -len(part)]
        return part + word if front else word + part

    return edit


def selfcite(p: Parameters, resources: dict) -> Generator:
    """Words copied from their line or the lines before, and changed: each depends on the last."""
    word, edit = word_maker(p), editor(p)
    window, most = p.whole("window_lines", 4, 0, 50), p.whole("max_edits", 2, 1, 6)
    here, changes, new = (threshold(p.chance(name, x)) for name, x in (("p_current_line", 0.3), ("p_modify", 0.85), ("p_new_word", 0.01)))
    shortest = p.whole("min_len", 1, 1, 10)
    longest = p.whole("max_len", 8, shortest, 40)

    def generate(rng: Stream, layout: list[int]) -> list[list[str]]:
        out: list[list[str]] = []
        draw, below = rng.draw, rng.below
        for n in layout:
            pool = [w for earlier in out[len(out) - min(window, len(out)) :] for w in earlier]
            line: list[str] = []
            for _ in range(n):
                if draw() < new:
                    line.append(word(rng))
                    continue
                own = line if line and draw() < here else pool or line
                if not own:
                    line.append(word(rng))
                    continue
                made = own[below(len(own))]
                if draw() < changes:
                    for _ in range(1 + below(most)):
                        changed = edit(rng, made)
                        if shortest <= len(changed) <= longest:
                            made = changed
                line.append(made)
            out.append(line)
        return out

    return generate


def affixed(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Parts as rows of letters and their lengths."""
    lengths = np.array([len(x) for x in parts], np.int64)
    rows = np.zeros((len(parts), max(map(len, parts), default=0)), np.uint8)
    for k, x in enumerate(parts):
        rows[k, : len(x)] = coded(x)
    return rows, lengths


def editor_in_lanes(p: Parameters, width: int) -> Callable[[Lanes, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """editor() for the words of some lanes: rows of `width` letters, which have room for one change,
    and their lengths; zeros behind a word's end."""
    glyphs = coded(p.letters())
    weights = [p.number(name, w, 0.0, 1000.0) for name, w in (("w_substitute", 4.0), ("w_insert", 1.0), ("w_delete", 2.0), ("w_affix", 1.5))]
    kinds = np.array(list(accumulate(int(w * 1000.0) for w in weights)), np.uint64)
    alike: dict[str, str] = {}
    for group in p.parts("similar", ALIKE, "|"):
        for g in group if len(group) > 1 else "":
            alike.setdefault(g, group.replace(g, ""))
    others = [alike.get(chr(c), p.letters()) for c in range(256)]
    other, n_other = affixed(others)
    sides = [affixed(p.parts(name, default, ",")) for name, default in (("prefixes", PREFIXES), ("suffixes", SUFFIXES))]
    shortest, columns = p.whole("min_len", 1, 1, 10), np.arange(width)

    def edit(lanes: Lanes, at: np.ndarray, word: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, length = word.copy(), length.copy()
        kind = lanes.weighted(at, kinds)
        some = np.flatnonzero(kind == 0)
        if len(some):
            k = lanes.below(at[some], length[some])
            old = word[some, k]
            word[some, k] = other[old, lanes.below(at[some], n_other[old])]
        some = np.flatnonzero(kind == 1)
        if len(some):
            k = lanes.below(at[some], length[some] + 1)[:, None]
            put = glyphs[lanes.below(at[some], len(glyphs))]
            old = word[some]
            moved = np.where(columns < k, old, np.roll(old, 1, axis=1))
            moved[np.arange(len(some)), k[:, 0]] = put
            word[some] = moved
            length[some] += 1
        some = np.flatnonzero((kind == 2) & (length > shortest))
        if len(some):
            k = lanes.below(at[some], length[some])[:, None]
            old = word[some]
            less = np.roll(old, -1, axis=1)
            less[:, -1] = 0
            word[some] = np.where(columns < k, old, less)
            length[some] -= 1
        some = np.flatnonzero(kind == 3)
        if len(some):
            front = lanes.draw(at[some]) < np.uint64(threshold(0.5))
            for here, (parts, sizes) in zip((some[front], some[~front]), sides):
                if not len(here) or not len(parts):
                    continue
                which = lanes.below(at[here], len(parts))
                part, size = parts[which], sizes[which]
                old, n = word[here], length[here]
                reach = np.arange(parts.shape[1])
                within = reach < size[:, None]
                first = np.zeros_like(n) if parts is sides[0][0] else n - size
                place = np.clip(first[:, None] + reach, 0, width - 1)
                same = ((np.take_along_axis(old, place, 1) == part) | ~within).all(axis=1) & (n > size)
                if parts is sides[0][0]:
                    # Off: what is behind the part; on: the part, then the word.
                    source = columns + np.where(same, size, -size)[:, None]
                    new = np.where((source >= 0) & (source < width), np.take_along_axis(old, np.clip(source, 0, width - 1), 1), 0)
                    on = ~same[:, None] & (columns[: parts.shape[1]] < size[:, None])
                    new[:, : parts.shape[1]] = np.where(on, part, new[:, : parts.shape[1]])
                else:
                    source = columns - np.where(same, n - size, n)[:, None]
                    ends = (source >= 0) & (source < size[:, None])
                    new = np.where(ends, np.where(same[:, None], 0, np.take_along_axis(part, np.clip(source, 0, parts.shape[1] - 1), 1)), old)
                word[here] = new
                length[here] = n + np.where(same, -size, size)
        return word, length

    return edit


def selfcite_in_lanes(p: Parameters, resources: dict) -> InLanes:
    alphabet, n, under = coded(p.letters()), p.whole("len_n", 9, 0, 30), threshold(p.chance("len_p", 0.45))
    sums = np.array(falling(len(alphabet), p.number("zipf_s", 0.0, 0.0, 4.0)), np.uint64)
    window, most = p.whole("window_lines", 4, 0, 50), p.whole("max_edits", 2, 1, 6)
    here, changes, new = (threshold(p.chance(name, x)) for name, x in (("p_current_line", 0.3), ("p_modify", 0.85), ("p_new_word", 0.01)))
    shortest = p.whole("min_len", 1, 1, 10)
    longest = p.whole("max_len", 8, shortest, 40)
    # A word is new, or of an accepted length; a change adds a letter or a part to it.
    width = max(n + 1, longest)
    room = width + max(1, *map(len, p.parts("prefixes", PREFIXES, ",") + p.parts("suffixes", SUFFIXES, ",")), 1)
    edit = editor_in_lanes(p, room)
    less = lambda x, bound: x < np.uint64(bound) if bound < 1 << 64 else np.ones(len(x), bool)

    def fill(lanes: Lanes, layouts: list[np.ndarray], alone: Callable) -> Words:
        words = Words(layouts, width, window)

        def fresh(at: np.ndarray, row: np.ndarray) -> None:
            made, length = letters_in(lanes, at, n, under, sums, alphabet)
            words.letters[row, : made.shape[1]] = np.where(np.arange(made.shape[1]) < length[:, None], made, 0)
            words.length[row] = length

        for at, row in words.steps(alone, 60):
            lanes.ready(at)
            line, pool = words.line[row], words.pool[row]
            anew = less(lanes.draw(at), new)
            mine = np.zeros(len(at), bool)
            begun = np.flatnonzero(~anew & (row > line))
            mine[begun] = less(lanes.draw(at[begun]), here)
            # From the line itself, or the lines before it, or the line if there are none before.
            mine |= pool == line
            low, high = np.where(mine, line, pool), np.where(mine, row, line)
            anew |= low == high
            some = np.flatnonzero(anew)
            if len(some):
                fresh(at[some], row[some])
            some = np.flatnonzero(~anew)
            if not len(some):
                continue
            at, row, low, high = at[some], row[some], low[some], high[some]
            source = low + lanes.below(at, high - low)
            word, length = words.letters[source], words.length[source]
            some = np.flatnonzero(less(lanes.draw(at), changes))
            if len(some):
                times = 1 + lanes.below(at[some], most)
                for k in range(most):
                    more = some[times > k]
                    if not len(more):
                        break
                    wide = np.zeros((len(more), room), np.uint8)
                    wide[:, :width] = word[more]
                    changed, size = edit(lanes, at[more], wide, length[more])
                    fits = (size >= shortest) & (size <= longest)
                    word[more[fits]] = changed[fits, :width]
                    length[more[fits]] = size[fits]
            words.letters[row] = word
            words.length[row] = length
        return words

    return fill


def slotgram(p: Parameters, resources: dict) -> Generator:
    """Words filled slot by slot from a table; now and then the line's last word again."""
    slots = textstats.slot_table(p.text("slots", textstats.SLOTS))
    if slots is None or len(slots) > 32:
        raise BadParameter("slots must be 1 to 32, each with a choice")
    fill = [p.chance("p_fill", 0.35)] * len(slots)
    if "p_fill_slots" in p.given:
        try:
            fill = [float(x) for x in p.text("p_fill_slots", "").split(",")]
        except ValueError:
            raise BadParameter("p_fill_slots must be comma-separated numbers") from None
        if len(fill) != len(slots) or not all(0 <= x <= 1 for x in fill):
            raise BadParameter(f"p_fill_slots needs {len(slots)} values in [0, 1]")
    exponent = p.number("zipf_s", 0.0, 0.0, 4.0)
    filled = [(threshold(chance), choices, (sums := falling(len(choices), exponent)), sums[-1]) for chance, choices in zip(fill, slots)]
    shortest, again = p.whole("min_len", 1, 1, 8), p.chance("p_repeat", 0.0)

    def word(rng: Stream) -> str:
        draw = rng.draw
        for _ in range(64):
            made = "".join([choices[bisect_left(sums, draw() % total + 1)] for under, choices, sums, total in filled if draw() < under])
            if len(made) >= shortest:
                return made
        return slots[0][0]

    def generate(rng: Stream, layout: list[int]) -> list[list[str]]:
        out = []
        for n in layout:
            line: list[str] = []
            for _ in range(n):
                line.append(line[-1] if line and rng.chance(again) else word(rng))
            out.append(line)
        return out

    return generate


def slotgram_in_lanes(p: Parameters, resources: dict) -> InLanes | None:
    slots = textstats.slot_table(p.text("slots", textstats.SLOTS))
    fill_ = [float(x) for x in p.text("p_fill_slots", "").split(",")] if "p_fill_slots" in p.given else [p.chance("p_fill", 0.35)] * len(slots)
    exponent, shortest, again = p.number("zipf_s", 0.0, 0.0, 4.0), p.whole("min_len", 1, 1, 8), threshold(p.chance("p_repeat", 0.0))
    tables = [(threshold(chance), *affixed(choices), np.array(falling(len(choices), exponent), np.uint64)) for chance, choices in zip(fill_, slots)]
    width = max(sum(int(sizes.max()) for _, _, sizes, _ in tables), len(slots[0][0]))
    spare = max(rows.shape[1] for _, rows, _, _ in tables)
    if width > 64 or any(under >> 64 for under, *_ in tables) or again >> 64:
        return None

    def fill(lanes: Lanes, layouts: list[np.ndarray], alone: Callable) -> Words:
        words = Words(layouts, width)
        for at, row in words.steps(alone, 100):
            lanes.ready(at)
            begun = np.flatnonzero(~words.begins[row])
            same = np.zeros(len(at), bool)
            same[begun] = lanes.draw(at[begun]) < np.uint64(again)
            if same.any():
                words.letters[row[same]], words.length[row[same]] = words.letters[row[same] - 1], words.length[row[same] - 1]
                at, row = at[~same], row[~same]
            for _ in range(64):
                if not len(at):
                    break
                made, length = np.zeros((len(at), width + spare), np.uint8), np.zeros(len(at), np.int64)
                for under, rows, sizes, sums in tables:
                    some = np.flatnonzero(lanes.draw(at) < np.uint64(under))
                    if not len(some):
                        continue
                    which = picked(lanes.draw(at[some]), sums)
                    for k in range(rows.shape[1]):
                        made[some, length[some] + k] = rows[which, k]
                    length[some] += sizes[which]
                done = length >= shortest
                words.letters[row[done]], words.length[row[done]] = made[done, :width], length[done]
                at, row = at[~done], row[~done]
                lanes.ready(at)
            words.letters[row] = 0
            words.letters[row, : len(slots[0][0])] = coded(slots[0][0])
            words.length[row] = len(slots[0][0])
        return words

    return fill


#: The families that have a way to fill many layouts in step, with the same words.
IN_LANES: dict[str, Callable[[Parameters, dict], InLanes | None]] = {"gibberish": gibberish_in_lanes, "charmarkov": charmarkov_in_lanes, "selfcite": selfcite_in_lanes, "slotgram": slotgram_in_lanes}

#: The registry of families. Another one is registered by adding it here.
FAMILIES: dict[str, Callable[[Parameters, dict], Generator]] = {"gibberish": gibberish, "bagofwords": bagofwords, "charmarkov": charmarkov, "selfcite": selfcite, "slotgram": slotgram}


def build(family: str, params: dict | None = None, resources: dict | None = None) -> Generator:
    """A family's generator, its parameters checked."""
    if family not in FAMILIES:
        raise BadParameter(f"unknown generator family: {family}")
    return FAMILIES[family](Parameters(params), resources or {})


def filler(family: str, params: dict | None = None, resources: dict | None = None) -> Callable[[list[tuple[bytes, int]], list[np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """What fills layouts by (salt, seed), all words in a row, as their letters and offsets. The words
    are those that build() gives for each on its own."""
    make = build(family, params, resources)
    in_step = IN_LANES[family](Parameters(params), resources or {}) if family in IN_LANES else None

    def fill(streams: list[tuple[bytes, int]], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        alone = lambda k: make(Stream(*streams[k]), sizes[k].tolist())
        if in_step is not None and len(streams) > 1:
            words = in_step(Lanes(streams), sizes, alone)
            return flat(words.letters, words.length)
        encoded = [w.encode() for k in range(len(streams)) for line in alone(k) for w in line]
        return np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in encoded])]).astype(np.int64)

    return fill


def together(pages: list, sizes: list[np.ndarray], times: int, most: int = WORDS) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Pages with their layouts, as many at a time as have at most so many words, `times` over. A page
    counts as 256 words at least: its numbers need as much."""
    some, words = [], 0
    for k, layout in enumerate(sizes):
        n = max(int(layout.sum()), 256) * times
        if some and words + n > most:
            yield [pages[i] for i in some], [sizes[i] for i in some]
            some, words = [], 0
        some.append(k)
        words += n
    if some:
        yield [pages[i] for i in some], [sizes[i] for i in some]


def listed(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of numbers, a NumPy array for each."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def line_columns(letters: np.ndarray, offsets: np.ndarray, sizes: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The number of each line in its layout, and its words."""
    if len(letters) >> 31:
        raise OverflowError("a page's words are beyond an array's bytes")
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
    lines = np.concatenate([np.zeros(1, np.int64), *sizes]).cumsum().astype(np.int32)
    return pa.array(np.concatenate([np.zeros(0, np.int32), *[np.arange(len(x), dtype=np.int32) for x in sizes]])), pa.ListArray.from_arrays(pa.array(lines), words)


def word_bag(tokens: DataFrame) -> DataFrame:
    """(w, n, before, total): every word with its count and the running sum before it, the most
    frequent words first."""
    counted = tokens.groupBy("w").agg(F.count("*").alias("n"))
    # Words of one count are many; their first letters keep the order.
    counted = counted.withColumn("head", F.left("w", F.lit(2)))
    part = Window.partitionBy("n", "head").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    inside = counted.withColumn("inside", F.sum("n").over(part) - F.col("n"))
    sums = counted.groupBy("n", "head").agg(F.sum("n").alias("sum"))
    everything = Window.partitionBy(F.lit(0))
    upto = F.sum("sum").over(everything.orderBy(F.desc("n"), "head").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select("n", "head", (upto - F.col("sum")).alias("ahead"), F.sum("sum").over(everything).alias("total"))
    return inside.join(sums, ["n", "head"]).select("w", "n", (F.col("ahead") + F.col("inside")).alias("before"), "total")


def bag_head(bag: DataFrame, most: int) -> list[tuple[str, int]]:
    """The `most` most frequent words of a bag, as a resource for one task."""
    return [(r["w"], r["n"]) for r in bag.orderBy(F.desc("n"), "w").limit(most).select("w", "n").collect()]


def glyph_model(lines: DataFrame, order: int = 3) -> DataFrame:
    """(context, glyph, n): letters given the `order` before them, an edge behind each word and
    edges before a line."""
    text = F.concat(F.lit(EDGE * order), F.array_join("words", EDGE), F.lit(EDGE))
    at = F.explode(F.sequence(F.lit(1), F.length("x") - order))
    return lines.where(F.size("words") > 0).select(text.alias("x")).select("x", at.alias("k")).select(F.expr(f"substr(x, k, {order})").alias("context"), F.expr(f"substr(x, k + {order}, 1)").alias("glyph")).groupBy("context", "glyph").agg(F.count("*").alias("n"))


def glyph_table(model: DataFrame, order: int) -> dict:
    """The model as a resource for one task: bounded by the alphabet to the power of order + 1."""
    table: dict = {}
    for r in model.orderBy("context", "glyph").collect():
        table.setdefault(r["context"], []).append((r["glyph"], r["n"]))
    return {"order": order, "counts": table}


def layouts(lines: DataFrame) -> DataFrame:
    """(page_no, layout): the number of words of each of a page's lines, empty ones left out."""
    counted = lines.where(F.size("words") > 0).groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", F.size("words").alias("n")))).alias("x"))
    return counted.select("page_no", F.transform("x", lambda x: x["n"]).alias("layout"))


def uniform(lines: int, words: int, lines_each: int) -> list[tuple[int, bool, bool]]:
    """A regular layout: (words, starts a paragraph, ends one) of each line."""
    each = max(1, lines_each)
    return [(words, k % each == 0, k % each == each - 1 or k + 1 == lines) for k in range(lines)]


def truncated(layout: list[tuple[int, bool, bool]], most: int) -> list[tuple[int, bool, bool]]:
    """The longest run of first lines with at most `most` words; its last line ends a paragraph."""
    upto = accumulate(n for n, _, _ in layout)
    kept = [x for x, total in zip(layout, upto) if total <= most]
    return kept[:-1] + [(*kept[-1][:2], True)] if kept else []


def dealt(pages: DataFrame) -> DataFrame:
    """(page_no, layout) spread over all tasks: little data, but much work on each row."""
    return pages.select("page_no", "layout").repartition(2 * pages.sparkSession.sparkContext.defaultParallelism, "page_no")


def simulate(pages: DataFrame, family: str, seeds: int, params: dict | None = None, resources: dict | None = None, salt: str = "") -> DataFrame:
    """`pages` (page_no, layout) filled `seeds` times, as (page_no, seed, line_no, words): each page
    is a corpus of its own, and its salt ends in its number."""
    build(family, params, resources)  # before any task runs
    table = pages.sparkSession.sparkContext.broadcast(resources or {})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = filler(family, params, table.value)
        for batch in batches:
            for some, layouts in together(batch.column(0).to_pylist(), listed(batch.column(1)), seeds):
                lanes = [(page, seed) for page in some for seed in range(seeds)]
                sizes = [x for x in layouts for _ in range(seeds)]
                number, words = line_columns(*fill([(f"{salt}{family}/{page}".encode(), seed) for page, seed in lanes], sizes), sizes)
                lines = [len(x) for x in sizes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([page for page, _ in lanes], np.int64), lines)), pa.array(np.repeat(np.array([seed for _, seed in lanes], np.int64), lines)), number, words],
                    ["page_no", "seed", "line_no", "words"],
                )

    return dealt(pages).mapInArrow(rows, "page_no bigint, seed bigint, line_no int, words array<string>")


def drawn_pages(pages: DataFrame, seeds: int, bag: DataFrame, salt: str = "") -> DataFrame:
    """simulate() of bagofwords over a bag of any size: the same draws, found in its table by a range
    join.

    Running sums are cut into blocks of a width that makes about five rows a word of the bag, so a
    draw is compared with few words.
    """
    types, total = bag.agg(F.count("*"), F.coalesce(F.max("total"), F.lit(0))).first()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, layout in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for seed in range(seeds):
                    rng = Stream(f"{salt}bagofwords/{page}".encode(), seed)
                    lines = [[rng.u64() % total for _ in range(n)] for n in layout]
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([page] * n, pa.int64()), pa.array([seed] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(lines, pa.list_(pa.int64()))],
                        ["page_no", "seed", "line_no", "draws"],
                    )

    width = max(1, total // (4 * max(types, 1)))
    draws = dealt(pages).mapInArrow(rows, "page_no bigint, seed bigint, line_no int, draws array<bigint>")
    line = ["page_no", "seed", "line_no"]
    draws = draws.select(*line, F.posexplode_outer("draws").alias("i", "draw")).withColumn("block", F.expr(f"draw div {width}"))
    words = bag.select("w", "n", "before", F.explode(F.sequence(F.expr(f"before div {width}"), F.expr(f"(before + n - 1) div {width}"))).alias("block"))
    found = draws.join(words, (draws["block"] == words["block"]) & (F.col("draw") >= F.col("before")) & (F.col("draw") < F.col("before") + F.col("n")), "left")
    drawn = F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("i", "w"))))
    return found.groupBy(*line).agg(F.transform(drawn, lambda x: x["w"]).alias("words"))


def registered(family: str):
    """The query: two seeds of a family over every page of the corpus."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = corpus.lines(spark, sf_dir)
        pages = layouts(lines)
        if family == "bagofwords":
            made = drawn_pages(pages, 2, storage.cut(word_bag(corpus.tokens(spark, sf_dir))))
        else:
            resources = {"glyph_model": glyph_table(glyph_model(lines), 3)} if family == "charmarkov" else None
            made = simulate(pages, family, 2, resources=resources)
        return made.select("page_no", "seed", "line_no", F.array_join("words", ".").alias("line"))

    return run
