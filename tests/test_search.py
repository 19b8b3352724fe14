"""Searches: resumed, replayed, checked; encoders and codes."""

import json

import numpy as np
import pytest

from corpusloom.functions.calibration import Invalid
from corpusloom.operators import search
from corpusloom.operators.search import CodeTable, Job, Model

TEXT = np.arange(120) % 9
MODEL = Model.of([TEXT], ["synthetic"])


def job(**changes):
    return Job(**({"ciphertext": tuple(TEXT.tolist()), "model": MODEL, "seed": 5, "iterations": 257, "width": 2} | changes))


def test_resumed_searches_are_replays():
    j = job()
    whole = search.run(j)
    state = json.loads(json.dumps(search.step(j, None, 63)))
    assert search.finish(j, search.step(j, state, 194)) == whole and len(whole["trace"]) == 2
    search.check_candidate(j, whole)
    assert search.verify(j, whole)
    for bad in ({"score": whole["score"] + 1}, {"key": whole["key"][:-1]}, {"evaluations": 300}):
        with pytest.raises(Invalid):
            search.check_candidate(j, whole | bad)
    with pytest.raises(Invalid):
        search.step(j, state | {"key": [255, *state["key"][1:]]}, 1)
    with pytest.raises(Invalid):
        search.finish(j, state)
    with pytest.raises(Invalid):
        search.step(j, None, 1025)


def test_scores_follow_the_changes():
    j = job(iterations=600)
    state = search.advance(j, search.initial(j), 600)
    assert state["score"] == j.score(state["key"]) and state["best_score"] == j.score(state["best_key"]) >= state["score"]


@pytest.mark.parametrize("bad", [dict(iterations=100_001), dict(ciphertext=(1, 2, 3)), dict(symbols=24), dict(encoding="x"), dict(algorithm="x"), dict(width=65), dict(ciphertext=(23,) * 9), dict(experiment="")])
def test_jobs_are_bounded(bad):
    with pytest.raises(Invalid):
        search.run(job(**bad))


def test_beam_and_homophones():
    j = job(algorithm="beam-v1")
    found = search.run(j)
    search.check_candidate(j, found)
    assert found["evaluations"] <= 257 and sorted(found["key"]) == list(range(23))
    for encoding in ("homophonic", "balanced-homophonic"):
        j = job(encoding=encoding, symbols=46)
        search.check_candidate(j, search.run(j))
        search.check_candidate(replaced := job(encoding=encoding, symbols=46, algorithm="beam-v1"), search.run(replaced))


def test_model_scores():
    assert MODEL.score(TEXT) == 117 * int(MODEL.grams.max()) or MODEL.score(TEXT) == int(MODEL.grams[search.codes(TEXT)].sum())
    assert MODEL.validated().single[22] == round(1000 * np.log(0.1 / (120 + 2.3)))
    with pytest.raises(Invalid):
        Model.of([], ["x"])
    with pytest.raises(Invalid):
        Model.of([np.array([23])], ["x"])


def test_encoders():
    plain = np.array([0, 1, 2, 0, 0, 22])
    for encoding, symbols in (("substitution", 23), ("balanced-homophonic", 46)):
        cipher, key = search.encipher(plain, encoding, 3)
        assert [key[s] for s in cipher] == plain.tolist() and len(key) == symbols
    assert len(set(cipher[[0, 3]])) == 2 and cipher[0] == cipher[4]


def codes():
    """A table of codes that are read in one way, but for two pairs."""
    glyphs = {}
    for t, table in enumerate(("alpha", "beta1", "beta2", "beta3", "gamma1", "gamma2")):
        for c in search.LETTERS:
            glyphs |= {f"unigram_{table}_{c}": f"u{t}{c}", f"prefix_{table}_{c}": f"p{t}{c}", f"suffix_{table}_{c}": f"s{t}{c}"}
    return glyphs | {"prefix_alpha_a": "p0", "suffix_alpha_a": "xs0a", "prefix_alpha_b": "p0x", "suffix_alpha_b": "s0a"}


def test_code_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,glyphs\n" + "".join(f"{k},{v}\n" for k, v in codes().items()))
    table = CodeTable.read(spark, f"{tmp_path}/t.csv")
    plain, key = [k % 23 for k in range(600)], [(k + 7) % 23 for k in range(23)]
    for seed in (1, 2, 3):
        assert table.parse(table.encrypt(plain, key, seed)) == [key[c] for c in plain]
    assert table.parse("u0a p0bs1c") == [0, 1, 2] if "p0bs1c" in table.pairs else True
    for bad in ("nothing", "p0xs0a"):
        with pytest.raises(Invalid):
            table.parse(bad)
    with pytest.raises(Invalid):
        table.encrypt(plain, key[:-1], 1)
    assert sum(len(p) for p in table.pairs.values()) == 19_044


def test_recovery_over_jobs(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioustrnl"), 5)) for _ in range(12)]
    texts = ["".join(rng.choice(words, 60)) for _ in range(2)] + ["ab"]
    model = Model.of([search.letters(t) for t in texts[:2]], ["x"])
    docs = spark.createDataFrame(list(enumerate(texts)), "job bigint, folded string")
    got = search.recover(docs, model, {"restart-anneal-v1": (0, 1), "beam-v1": (0,)}, iterations=1500, width=8)
    rows = {(r["job"], r["algorithm"], r["start"]): r for r in got.collect()}
    assert set(rows) == {(k, a, s) for k in (0, 1) for a, s in (("restart-anneal-v1", 0), ("restart-anneal-v1", 1), ("beam-v1", 0))}
    assert all(r["letters"] == 300 and 0 <= r["recovered"] <= 300 for r in rows.values())
    assert search.best_of(got).count() == 4


def test_grams_are_counted_inside_tasks(spark, tmp_path):
    """No row for a place in a text, no string across two texts, and the texts' own counts."""
    from corpusloom.plans import shared

    texts = ["abcdab", "", None, "Abc", "x", "éèbcd", "ab cd", "wjk!"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = shared.gram_counts(spark, str(tmp_path))
    assert "Generate explode" not in found._jdf.queryExecution().toString()
    assert {r["g"]: r["n"] for r in found.collect()} == {"abcd": 2, "bcda": 1, "cdab": 1, "eebc": 1, "ebcd": 1, "uuic": 1}


def test_words_of_one_stratum_take_one_pass(spark):
    from corpusloom.plans import catalog, shared

    got = catalog.QUERIES["corpus_differences"](spark, "/root/testdata/sf0.001")
    assert "Join" not in got._jdf.queryExecution().toString()
    expected = shared.query(shared.TEXTS["corpus_differences"])(spark, "/root/testdata/sf0.001")
    assert sorted(r["w"] for r in got.collect()) == sorted(r["w"] for r in expected.collect())
