"""The pipeline's near-duplicate stage against brute force over edited copies."""

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import minhash, simhash


def edited_copies(families=40, copies=6, seed=11):
    """Texts of 80 to 300 words; copies have some words replaced, up to a similarity of about 0.6."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(2000)]
    texts = []
    for _ in range(families):
        base = list(rng.choice(words, int(rng.integers(80, 300))))
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(1, max(2, len(copy) // 25))), replace=False):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    return [texts[k] for k in rng.permutation(len(texts))]


def brute_force(texts):
    """The least index of each text's component."""
    found = [set(minhash.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            shared = len(found[a] & found[b])
            if shared and 5 * shared >= 4 * len(found[a] | found[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(x) for x in range(len(texts))]


def test_edited_copies_against_brute_force(spark, table):
    texts = edited_copies()
    expected = brute_force(texts)
    docs = spark.read.parquet(table(texts) + "/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == set(expected)
    # What the stage found before: fingerprints of three-word shingles within two bits.
    bits = [simhash.fingerprint(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if expected[a] == expected[b]]
    assert any((bits[a] ^ bits[b]).bit_count() > 2 for a, b in pairs)


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(900)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    # Two texts of null ids, two of one id, one with a null and a known id, one row twice.
    ids = [(None, 0), (None, 1), (7, 2), (7, 3), (None, 4), (9, 4), (5, 5), (5, 5)]
    docs = spark.createDataFrame([(i, texts[k]) for i, k in ids], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], texts.index(r["text"])) for r in minhash.firsts(docs).collect()), key=lambda x: x[1])
    assert got == [(None, 0), (None, 1), (7, 2), (7, 3), (9, 4), (5, 5)]


def as_sets(spark, found, bands):
    rows = [(k, simhash.majority(s) - (simhash.majority(s) >> 63 << 64), bands, np.unique(s.astype(np.uint32).view(np.int32)).tolist()) for k, s in enumerate(found)]
    return spark.createDataFrame(rows, "id bigint, bits bigint, bands array<bigint>, shingles array<int>")


def test_fingerprints_within_two_bits_are_linked_without_a_common_band(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    # One shingle more, a quarter less, and one of another text.
    found = [base, np.append(base, np.uint64(5)), base[100:], rng.integers(0, 2**64, 400, dtype=np.uint64)]
    bits = [simhash.majority(s) for s in found]
    assert (bits[0] ^ bits[1]).bit_count() <= 2
    pairs = {(r["a"], r["b"]) for r in minhash.near(as_sets(spark, found, [])).collect()}
    assert pairs == {(a, b) for a in range(4) for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= 2}
    got = {r["vertex"]: r["root"] for r in minhash.roots(as_sets(spark, found, [])).collect()}
    assert got == {0: 0, 1: 0}


def group_of_near_copies(members=150, seed=2):
    """Sets of one base, each with its own edits: many similar to no other, all in one bucket."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    found = []
    for _ in range(members):
        copy = base.copy()
        for at in rng.choice(30, int(rng.integers(1, 15)), replace=False):
            copy[5 * at : 5 * at + 5] = rng.integers(0, 2**64, 5, dtype=np.uint64)
        found.append(np.unique(copy))
    return found


def components_of(found):
    root = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            shared = len(np.intersect1d(found[a], found[b]))
            if 9 * shared >= 4 * (len(found[a]) + len(found[b])) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


@pytest.mark.parametrize("most", [minhash.MOST, 4000, 100])
def test_a_large_bucket_is_connected_without_its_pairs(spark, most):
    found = group_of_near_copies()
    expected = components_of(found)
    assert 10 < len(set(expected)) < len(found) - 10
    whole = as_sets(spark, found, [1, 2])
    rows = whole.selectExpr("explode(bands) key", "id", "size(shingles) n", "id root")
    links = minhash.within(rows, whole, most)
    assert links.count() < 8 * len(found)
    got = {r["vertex"]: r["root"] for r in simhash.components(links).collect()}
    assert [got.get(k, k) for k in range(len(found))] == expected
    # Before, the members were paired in rows: here the center's alone are, and a row of each in a part.
    assert minhash.central(rows).count() < len(found)
    if most == minhash.MOST:
        assert minhash.blocks(rows, most).count() == len(found)


def test_blocks_of_a_bucket_join_all_but_its_largest_component(spark):
    found = group_of_near_copies(60, 4)
    whole = as_sets(spark, found, [1])
    rows = whole.selectExpr("explode(bands) key", "id", "size(shingles) n", "if(id < 40, 0, id) root")
    met = {}
    for r in minhash.blocks(rows, 1200).collect():
        met.setdefault(r["part"], set()).add(r["id"])
    together = {(a, b) for ids in met.values() for a in ids for b in ids}
    assert len(met) > 10
    assert all((a, b) in together for a in range(60) for b in range(60) if a >= 40 or b >= 40)


def test_spanning_against_brute_force():
    for seed in range(5):
        found = [np.unique(s.astype(np.uint32).view(np.int32)) for s in group_of_near_copies(80, seed)]
        expected = components_of(found)
        root = list(range(80))
        for a, b in minhash.spanning(found, np.arange(80)):
            x, y = sorted((root[a], root[b]))
            assert x != y
            root = [x if r == y else r for r in root]
        assert root == expected


def test_no_table_of_the_stage_holds_a_groups_pairs(spark, table, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklm"), 7)) for _ in range(4000)]
    base = list(rng.choice(words, 150))
    texts = []
    for _ in range(400):
        copy = list(base)
        for at in rng.choice(30, int(rng.integers(2, 6)), replace=False):
            copy[5 * at] = rng.choice(words)
        texts.append(" ".join(copy))
    made, cut, written = [], minhash.common.cut, minhash.common.written

    def counted(keep):
        def kept(df):
            df = keep(df)
            made.append(df.count())
            return df

        return kept

    monkeypatch.setattr(minhash.common, "cut", counted(cut))
    monkeypatch.setattr(minhash.common, "written", counted(written))
    docs = spark.read.parquet(table(texts) + "/documents.parquet")
    assert {r["doc_id"] for r in minhash.firsts(docs).collect()} == set(brute_force(texts))
    # The members' bands; their pairs are 79800.
    assert max(made) <= minhash.BANDS * len(texts)
