"""Layouts filled in step against the same filled one by one."""

import numpy as np
import pytest

from corpusloom.functions.random import Stream
from corpusloom.operators import generators

MODEL = {"order": 2, "counts": {"  ": [("a", 3), ("b", 1)], " a": [("b", 2), (" ", 1)], "ab": [("a", 1), (" ", 4)], "ba": [(" ", 1)], " b": [("c", 5)], "bc": [("a", 1), (" ", 1)]}}
CASES = [
    ("gibberish", {}), ("gibberish", {"len_n": 0}), ("gibberish", {"len_p": 1.0, "zipf_s": 1.2}), ("slotgram", {}), ("slotgram", {"p_repeat": 0.4, "min_len": 3, "zipf_s": 1.0}), ("slotgram", {"slots": "a,b|c,_", "p_fill": 0.0}),
    ("selfcite", {}), ("selfcite", {"max_len": 40, "max_edits": 6, "window_lines": 1, "len_n": 20}), ("selfcite", {"p_modify": 1.0, "w_affix": 50.0, "min_len": 3}), ("selfcite", {"window_lines": 0, "suffixes": "", "p_new_word": 0.2}),
    ("charmarkov", {}), ("charmarkov", {"max_len": 3}),
]


@pytest.mark.parametrize("family,params", CASES)
def test_words_in_step_are_those_one_by_one(family, params):
    resources = {"glyph_model": MODEL} if family == "charmarkov" else None
    rng = np.random.default_rng(4)
    sizes = [rng.integers(0 if k % 3 else 1, 9, rng.integers(1, 12)) for k in range(40)] + [np.array([700, 3]), np.array([0]), np.array([], np.int64)]
    streams = [(b"salt/%d" % (k // 2), k % 2) for k in range(len(sizes))]
    letters, offsets = generators.filler(family, params, resources)(streams, sizes)
    make = generators.build(family, params, resources)
    expected = [w for s, n in zip(streams, sizes) for line in make(Stream(*s), n.tolist()) for w in line]
    text = letters.tobytes().decode()
    assert [text[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())] == expected
    number, lines = generators.line_columns(letters, offsets, sizes)
    assert [len(x) for x in lines.to_pylist()] == [n for x in sizes for n in x.tolist()] and number.to_pylist() == [k for x in sizes for k in range(len(x))]
