import struct

import pytest

from corpusloom.functions import canonical
from corpusloom.functions.random import Stream, block
from corpusloom.operators import generators


def test_block_of_zeros():
    assert struct.pack("<16I", *block((0,) * 8, 0)).hex().startswith("3e00ef2f895f40d67f5bb8e81f09a5a1")


def test_numbers_are_the_blocks_words():
    draws = Stream(b"k", 9)
    for counter in range(40):
        words = block(draws.key, counter)
        assert [draws.u64() for _ in range(8)] == [high << 32 | low for low, high in zip(words[::2], words[1::2])]


def test_short_streams_are_streams():
    for seed, short in zip(range(3, 303), Stream.short(b"s", range(3, 303), 128)):
        long = Stream(b"s", seed)
        assert [short.u64() for _ in range(20)] == [long.u64() for _ in range(20)]


def test_streams_repeat():
    assert [Stream(b"a", 5).below(100) for _ in range(3)] == [Stream(b"a", 5).below(100)] * 3
    draws = Stream(b"a", 6)
    assert all(0 <= draws.below(7) < 7 for _ in range(200)) and 0 <= draws.unit() < 1


@pytest.mark.parametrize("x, text", [(0.0, "0"), (-0.0, "0"), (1.5, "1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (0.000001, "0.000001"), (123456.789, "123456.789"), (-5e-324, "-5e-324")])
def test_numbers(x, text):
    assert canonical.number(x) == text


def test_canonical_json():
    assert canonical.dumps({"b": [1, True, None], "a": {"é": "\n"}}) == '{"a":{"é":"\\n"},"b":[1,true,null]}'
    with pytest.raises(ValueError):
        canonical.loads('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        canonical.loads("NaN")
    assert canonical.identity({}) == canonical.digest(b"{}")


@pytest.mark.parametrize("family", ["gibberish", "selfcite", "slotgram"])
def test_generators_fill_the_layout(family):
    make = generators.build(family)
    lines = make(Stream(b"x", 1), [3, 0, 5])
    assert [len(x) for x in lines] == [3, 0, 5] and lines == make(Stream(b"x", 1), [3, 0, 5])
    assert all(w for line in lines for w in line)


