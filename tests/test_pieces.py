"""A fingerprint from pieces against that of the whole corpus."""

import numpy as np
import pytest

from corpusloom.functions import pieces, textstats


def text(lines, starts):
    words = [w for ws in lines for w in ws]
    letters = np.frombuffer("".join(words).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return pieces.Text.of(letters, offsets, np.array([len(ws) for ws in lines], np.int64), np.array(starts, bool))


@pytest.mark.parametrize("n_lines,cuts,letters", [(300, (), "abcde"), (300, (1, 2, 60, 61, 150, 290), "abcdeX9"), (40, (7, 9), "ab"), (500, (100, 101, 102, 103, 104), "abcdefghijklmnopqrstuvwxyz"), (1, (), "a")])
def test_pieces(n_lines, cuts, letters):
    rng = np.random.default_rng(n_lines)
    pool = ["".join(rng.choice(list(letters), rng.integers(1, 16))) for _ in range(80)] + ["ab", "ba", "b", "a", "aa"]
    lines = [[str(w) for w in rng.choice(pool, rng.integers(0 if n_lines > 1 else 3, 12))] for _ in range(n_lines)]
    starts = [k % 7 == 0 for k in range(n_lines)]
    bounds = [0, *cuts, n_lines]
    parts = [text(lines[a:b], starts[a:b]) for a, b in zip(bounds, bounds[1:])]
    total, pairs, ends, counts = np.zeros(len(pieces.SUMS)), np.zeros(pieces.SIDE**2), [], {}
    for p in parts:
        found, some, columns = pieces.sums(p, np.zeros(len(p.length), np.int64), 1)
        total += found[0]
        pairs[columns] += some[0]
        ends.append(pieces.ends_of(p))
        for k in p.key.tolist():
            counts[k] = counts.get(k, 0) + 1
    n = np.array(sorted(counts.values(), reverse=True))
    got = pieces.values(total, pairs, pieces.stitched(ends), len(n), int((n == 1).sum()), n[:500])
    expected = textstats.fingerprint(lines, {k for k, s in enumerate(starts) if s})
    assert np.allclose(got, expected, atol=1e-9), [(a, b, c) for a, b, c in zip(textstats.NAMES, got, expected) if abs(b - c) > 1e-9]
