"""The fingerprint's parts against plain Python."""

import numpy as np

from corpusloom.operators import statistics


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def test_near_words(spark):
    rng = np.random.default_rng(6)
    lines = [["".join(rng.choice(list("ab" if k % 2 else "abcd"), rng.integers(1, 6))) for _ in range(rng.integers(1, 9))] for k in range(400)] + [[], ["ab", "ba"], ["aa", "a"]]
    df = spark.createDataFrame([(k, ws) for k, ws in enumerate(lines)], "k int, words array<string>")
    got = {r["k"]: r["near"] for r in statistics.near_words(df).collect()}
    for k, ws in enumerate(lines):
        assert got[k] == sum(any(i != j and distance(a, b) <= 1 for j, b in enumerate(ws)) for i, a in enumerate(ws)), ws


def test_a_corpus_without_words_is_zero(spark, tmp_path):
    rows = [(0, "12 34", None, "s", 0), (1, "ab cd", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["stratum"]: r.asDict() for r in statistics.fingerprint(spark, str(tmp_path)).collect()}
    assert all(got[""][n] == 0.0 for n in statistics.NAMES) and got["en"]["wlen_mean"] == 2.0
