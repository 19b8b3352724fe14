"""Targets, rules, work units, grids and partitions."""

import itertools
import json
import math

import numpy as np
import pytest

from corpusloom.functions import calibration, canonical, textstats, workunits
from corpusloom.functions.calibration import Corpus, Invalid, Target, TargetOptions
from corpusloom.functions.random import Stream
from corpusloom.functions.workunits import Grid, Refinement
from corpusloom.operators import generators


def corpus(*lines):
    words = [x.split(".") for x in lines]
    return Corpus.of(words, {0}, {len(words) - 1})


SIX = corpus("daiin.chol.chor", "qokedy.shedy.daiin", "ol.chey.dar", "otedy.daiin.qokain", "chedy.okal.chol", "daiin.dain.ol")
PARAGRAPHS = Corpus.of(SIX.lines, {0, 3}, {2, 5})
PLAIN = Target(tuple(SIX.values()), (0.1,) * 30)


def named(c):
    return dict(zip(textstats.NAMES, c.values()))


def test_periodic_and_similar_texts():
    f = named(corpus("ab.ab.ab"))
    assert (f["h0"], f["h2"], f["h2_word"], f["h_initial"], f["wlen_mean"], f["wlen_2"], f["adjacent_same"], f["hapax_frac"], f["line_len_mean"]) == (1, 0, 0, 0, 2, 1, 1, 0, 3)
    assert f["h1"] == pytest.approx(math.log2(3))
    f = named(corpus("daiin.dain.chol", "chol.chor.qokedy.daiin"))
    assert f["adjacent_same"] == pytest.approx(1 / 6) and f["adjacent_edit1"] == pytest.approx(2 / 6)
    assert f["line_edit1"] == pytest.approx(4 / 7) and f["recent_repeat_10"] == pytest.approx(2 / 7) and f["hapax_frac"] == 0.6
    assert Corpus.of([]).values() == [0.0] * 30


def test_fingerprint_against_its_definitions():
    rng = np.random.default_rng(3)
    lines = [["".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(rng.integers(1, 12))] for _ in range(120)]
    f, words = dict(zip(textstats.NAMES, textstats.fingerprint(lines, {0, 7}))), [w for ws in lines for w in ws]
    width = min(500, len(words))
    assert f["mattr500"] == pytest.approx(np.mean([len(set(words[k : k + width])) / width for k in range(len(words) - width + 1)]))
    near = sum(any(i != j and textstats.edit_distance(a, b, 1) <= 1 for j, b in enumerate(ws)) for ws in lines for i, a in enumerate(ws))
    assert f["line_edit1"] == pytest.approx(near / len(words))
    assert f["adjacent_edit1"] == pytest.approx(sum(textstats.edit_distance(a, b, 1) == 1 for a, b in zip(words, words[1:])) / (len(words) - 1))
    assert f["recent_repeat_10"] == pytest.approx(sum(w in words[max(0, k - 10) : k] for k, w in enumerate(words)) / len(words))


def test_edit_distance():
    assert [textstats.edit_distance(a, b, 1) for a, b in (("daiin", "daiin"), ("daiin", "dain"), ("daiin", "chol"), ("", "a"))] == [0, 1, 2, 1]
    assert textstats.edit_distance("kitten", "sitting", 10) == 3
    for a, b in itertools.product(["", "a", "ab", "ba", "abc", "acb", "abd"], repeat=2):
        assert textstats.within_one(a, b) == (textstats.edit_distance(a, b, 3) <= 1)


def test_candidates():
    slots = textstats.slot_table(textstats.SLOTS)
    three = corpus("daiin.chol.chor.qokedy.shedy", "qokeedy.daiin.ol.chey.dar", "otedy.daiin.qokain.chedy.okal")
    s = textstats.candidates(three.lines, three.starts, slots)
    assert s["slot_conformance"] == 1.0 and s["bigram_asymmetry"] > 0.5 and list(s) == list(textstats.CANDIDATES)
    s = textstats.candidates([x.split(".") for x in ("abba.abba.abba", "baab.baab.baab")])
    assert s["bigram_asymmetry"] == 0 and s["h2_backward_minus_forward"] == 0 and "slot_conformance" not in s
    assert textstats.candidates([x.split(".") for x in ("a.bb.ccc.dddd", "e.ff.ggg.hhhh")])["wlen_position_slope"] > 0
    assert set(textstats.candidates([]).values()) == {0.0}
    assert textstats.slot_table("_,_") is None and textstats.slot_table("") is None


def test_quantiles_and_bounds():
    assert [calibration.quantile([1.0, 2.0, 3.0, 4.0], q) for q in (0, 1, 0.5)] == [1, 4, 2.5] and calibration.quantile([], 0.5) == 0
    assert calibration.quantile([1.0, 2.0, 3.0, 4.0], 0.99) == pytest.approx(3.97)
    assert calibration.wilson(8, 8)[0] == pytest.approx(0.6756, abs=1e-3) and calibration.wilson(7, 8)[0] == pytest.approx(0.5291, abs=1e-3)
    assert calibration.wilson(0, 8)[1] == pytest.approx(0.3244, abs=1e-3) and calibration.wilson(0, 0) == (0, 1)
    assert [calibration.median(x) for x in ([3.0, 1.0, 2.0], [4.0, 1.0, 3.0, 2.0], [])] == [2, 2.5, 0]


def test_rules():
    assert calibration.acceptance([1.0, 1.5, 1.9, 2.0, 0.5, 1.2, 1.8, 1.1], 2.0)["compatible"]
    assert not calibration.acceptance([1.0, 1.5, 1.9, 2.5, 0.5, 1.2, 1.8, 3.0], 2.0)["compatible"] and not calibration.acceptance([], 2.0)["compatible"]
    around = [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]]
    assert calibration.centroid_test(around, [0.0, 0.0], [1.0, 1.0])["p_value"] == 1
    assert calibration.centroid_test(around, [10.0, 10.0], [1.0, 1.0])["p_value"] == pytest.approx(0.2)
    assert calibration.centroid_test(around[:1], [0.0, 0.0], [1.0, 1.0]) is None
    pool = [1.0 + 0.02 * k for k in range(60)] + [50.0, 200.0, 900.0, 5000.0]
    assert 1.5 < calibration.subset_median_quantile(pool, 8) < 3 and calibration.subset_median_quantile([], 8) == 0
    assert calibration.upper_rank(1.0, [1.0] * 999) == 1 and calibration.upper_rank(2.0, [1.0] * 999) == 0.001
    for bad in ((math.nan, [0.0]), (0.0, []), (0.0, [math.inf])):
        with pytest.raises(Invalid):
            calibration.upper_rank(*bad)


def test_exact_medians():
    pool = [1.0, 2.0, 2.0, 5.0, 7.0, 11.0]
    brute = [calibration.median(c) for c in itertools.combinations(pool, 4)]
    exact = calibration.subset_medians(pool, 4)
    assert exact == sorted((v, brute.count(v)) for v in set(brute))
    assert calibration.audit(pool, 4.0, (4,))[4]["above"] == pytest.approx(sum(v > 4 for v in brute) / len(brute))
    assert calibration.binomial_tail(8, 0.1, 4) == pytest.approx(sum(math.comb(8, k) * 0.1**k * 0.9 ** (8 - k) for k in range(4, 9)))
    assert calibration.zero_error_bound(299) < 0.01 < calibration.zero_error_bound(298)


def test_inverse_and_distances():
    inv = calibration.inverse([[4.0, 7.0], [2.0, 6.0]])
    assert np.allclose(inv, [[0.6, -0.7], [-0.2, 0.4]]) and calibration.inverse([[1.0, 2.0], [2.0, 4.0]]) is None
    m = np.random.default_rng(1).normal(size=(30, 30))
    assert np.allclose(calibration.inverse(m.tolist()), np.linalg.inv(m))
    values = SIX.values()
    assert PLAIN.distance(values) == 0
    assert PLAIN.distance([values[0] + 0.1, *values[1:]]) == pytest.approx(math.sqrt(1 / 30))
    unit = Target(tuple(v + 0.05 for v in values), (0.1,) * 30, precision=tuple(tuple(float(i == j) for j in range(30)) for i in range(30)))
    assert unit.distance(values) == pytest.approx(unit.distance(values, "mahalanobis"))
    assert Target.of({"target": unit.document(), "provenance": {}}) == unit == Target.of(unit.document())
    for bad in (dict(scale=(0.0,) * 30), dict(weight=(-1.0,) * 30), dict(weight=(0.0,) * 30), dict(mean=(math.nan,) * 30), dict(precision=((1.0,) * 30,) * 29), dict(version="x")):
        with pytest.raises(Invalid):
            Target(**({"mean": PLAIN.mean, "scale": PLAIN.scale} | bad)).distance(values)
    with pytest.raises(Invalid):
        PLAIN.distance(values, "mahalanobis")
    with pytest.raises(Invalid):
        PLAIN.distance([math.nan, *values[1:]])


def test_blocks_and_targets():
    assert PARAGRAPHS.blocks() == [(0, 3), (3, 6)] and SIX.blocks() == [(0, 6)]
    assert Corpus.of([["a"], ["b"], ["c"]], {1}).blocks() == [(0, 1), (1, 3)]
    drawn = PARAGRAPHS.resampled(Stream(b"x", 1))
    assert drawn.words >= PARAGRAPHS.words and set(drawn.lines) <= set(PARAGRAPHS.lines)
    assert PARAGRAPHS.subsampled(0.5, Stream(b"x", 2)).words == 9
    boot = TargetOptions(20, 7)
    built = calibration.build_target(PARAGRAPHS, boot)
    assert built == calibration.build_target(PARAGRAPHS, boot) and built.mean == tuple(PARAGRAPHS.values())
    assert np.allclose(built.scale, calibration.build_simple_target(PARAGRAPHS, 20, 7).scale, atol=1e-6)
    whole = calibration.build_target(PARAGRAPHS, TargetOptions(20, 7, covariance_lambda=1.0))
    assert whole.distance(SIX.values(), "mahalanobis") == pytest.approx(whole.distance(SIX.values()))
    assert calibration.build_target(PARAGRAPHS, TargetOptions(20, 7, "subsample", 0.5, 0.3)).precision is not None
    for bad in (TargetOptions(5, 1, "x"), TargetOptions(5, 1, "subsample", 1.0), TargetOptions(5, 1, covariance_lambda=2.0), TargetOptions(1, 1, covariance_lambda=0.5)):
        with pytest.raises(Invalid):
            calibration.build_target(PARAGRAPHS, bad)
    assert calibration.conditional_target(PARAGRAPHS, boot).weight[-1] == 0
    spread = calibration.spread(calibration.self_distances(PARAGRAPHS, built, 10, 3))
    assert spread["min"] <= spread["q50"] <= spread["q99"] <= spread["max"]


LAYOUT = generators.uniform(20, 7, 5)


def unit(**changes):
    return workunits.make("test", "selfcite", {"p_modify": "0.6", "window_lines": 2}, PLAIN, LAYOUT, seeds=3) | changes


def test_units_run_and_resume():
    u = unit()
    done = workunits.run(u, PLAIN, LAYOUT)
    assert done == workunits.run(u, PLAIN, LAYOUT) and done["replicates"]["n"] == 3
    checkpoint = None
    for _ in range(4):
        checkpoint = json.loads(json.dumps(workunits.step(u, PLAIN, LAYOUT, checkpoint)))
    assert workunits.finish(u, PLAIN, LAYOUT, checkpoint) == done
    # Cutting the seeds anew changes no corpus.
    assert workunits.run(unit(seed_start=1, seed_count=1), PLAIN, LAYOUT)["seeds"] == done["seeds"][1:2]
    checkpoint["seeds"][0]["distance"] += 1
    with pytest.raises(Invalid):
        workunits.finish(u, PLAIN, LAYOUT, checkpoint)
    assert workunits.unit_id(u) == workunits.unit_id(u | {"metric": "z"}) != workunits.unit_id(u | {"metric": "mahalanobis"})


@pytest.mark.parametrize("bad", [dict(schema_version="x"), dict(family="x"), dict(seed_count=0), dict(seed_count=257), dict(params={"A": 1}), dict(params={"a": []}), dict(target_digest="x"), dict(resources_digest="x"), dict(metric="mahalanobis"), dict(metric="x"), dict(seed_start=(1 << 64) - 2)])
def test_units_are_checked(bad):
    with pytest.raises(Invalid):
        workunits.run(unit(**bad), PLAIN, LAYOUT)


def test_grids():
    g = Grid("t", "selfcite", {"p_modify": [0.5, 0.7, 0.9], "max_len": [6, 8]}, {"window_lines": 4}, 4)
    assert len(g) == 6 and [p["max_len"] for p in g.points()] == [6, 6, 6, 8, 8, 8] and g.point(1)["p_modify"] == 0.7 and g.point(5)["window_lines"] == 4
    assert g.point(g.nearest({"p_modify": 0.75, "max_len": 9})) == {"window_lines": 4, "max_len": 8, "p_modify": 0.7} and g.nearest({"p_modify": 0.75}) is None
    for bad in (dict(replicates=0), dict(integers=["x"]), dict(fixed={"p_modify": 0.1}), dict(family="x"), dict(axes={}), dict(axes={"a": []}), dict(metric="x")):
        with pytest.raises(Invalid):
            Grid(**({"experiment": "t", "family": "selfcite", "axes": {"p_modify": [0.5]}} | bad)).validated()


def test_refinement():
    g = Grid("t", "selfcite", {"p_modify": [0.5, 0.7, 0.9], "max_len": [6, 10], "similar": ["ab", "cd"]})
    r = Refinement(g, 0.5)
    g = r.next(g, {"p_modify": 0.9, "max_len": 6, "similar": "cd"})
    assert g.axes == {"max_len": [6, 8], "p_modify": [0.8, 0.9], "similar": ["cd"]}
    g = r.next(g, {"p_modify": 0.8, "max_len": 8, "similar": "cd"})
    assert g.axes == {"max_len": [7, 8, 9], "p_modify": [0.75, 0.8, 0.85], "similar": ["cd"]}
    g = r.next(g, {"p_modify": 0.8, "max_len": 8, "similar": "cd"})
    assert g.axes["max_len"] == [7, 8, 9]  # half a step rounds up to one
    only = Grid("t", "selfcite", {"max_len": [6, 7]})
    assert Refinement(only, 0.4).next(only, {"max_len": 6}) is None


def test_ledgers():
    g = Grid("t", "selfcite", {"p_modify": [0.5, 0.7]}, replicates=2)
    header = workunits.ledger_header(g, PLAIN, LAYOUT)
    lines = list(workunits.ledger_lines(header, [{"index": 1}, {"index": 0}]))
    assert workunits.read_ledger(lines) == (header, [{"index": 0}, {"index": 1}]) and workunits.bound(header, g, PLAIN, LAYOUT)
    assert not workunits.bound(header, g, PLAIN, LAYOUT[:5])
    for bad in ([], ['{"ledger": "x"}']):
        with pytest.raises(Invalid):
            workunits.read_ledger(bad)


def test_partition():
    words = {"A": [60, 0, 0], "B": [0, 10, 0], "C": [30, 0, 0], "D": [0, 5, 0], "E": [20, 0, 0], "F": [0, 15, 0]}
    fractions = {"confirmation": 0.2, "discovery": 0.55, "validation": 0.25}
    roles = workunits.assign(words, fractions)
    assert roles["A"] == "discovery" and set(roles.values()) == set(workunits.ROLES)
    assert roles == workunits.assign(words, dict(reversed(fractions.items())))


def test_generators():
    three = corpus("daiin.chol.chor.qokedy", "shedy.qokeedy.daiin.ol", "chey.dar.otedy.daiin")
    text = [" " * 2 + " ".join(ws) + " " for ws in three.lines]
    counts: dict = {}
    for t in text:
        for k in range(len(t) - 2):
            seen = counts.setdefault(t[k : k + 2], {})
            seen[t[k + 2]] = seen.get(t[k + 2], 0) + 1
    resources = {"word_bag": [("daiin", 3), ("ol", 1)], "glyph_model": {"order": 2, "counts": {c: sorted(s.items()) for c, s in counts.items()}}}
    layout = [n for n, _, _ in LAYOUT]
    for family in generators.FAMILIES:
        fill = generators.build(family, {}, resources)
        made = [fill(Stream(b"wu", s), layout) for s in (1, 1, 2)]
        assert made[0] == made[1] != made[2] and [len(x) for x in made[0]] == layout and all(w for x in made[0] for w in x)
    assert {c for x in generators.build("charmarkov", {}, resources)(Stream(b"x", 0), [8] * 50) for w in x for c in w} <= set("".join(w for ws in three.lines for w in ws))
    slots = textstats.slot_pattern(textstats.slot_table(textstats.SLOTS))
    import re

    assert all(re.match(slots, w) for x in generators.build("slotgram")(Stream(b"s", 1), [8] * 60) for w in x)
    assert {w for x in generators.build("slotgram", {"slots": "a,b|c,_", "p_fill": 1.0})(Stream(b"s", 2), [10] * 5) for w in x} <= {"ac", "bc"}
    assert all(len(set(x)) == 1 for x in generators.build("slotgram", {"p_repeat": 1.0})(Stream(b"s", 3), [6] * 3))
    near = [w for x in generators.build("selfcite", {"p_modify": 0.5, "window_lines": 1})(Stream(b"x", 3), [8] * 200) for w in x]
    assert sum(near[k] in near[k + 1 : k + 9] for k in range(len(near) - 8)) / len(near) > 0.2 and max(map(len, near)) <= 8
    a, b = (generators.build("selfcite", p)(Stream(b"s", 1), layout) for p in ({"p_modify": "0.6", "window_lines": "3"}, {"p_modify": 0.6, "window_lines": 3}))
    assert a == b


@pytest.mark.parametrize("family, params", [
    ("nope", {}), ("gibberish", {"len_p": 1.5}), ("gibberish", {"alphabet": "..."}), ("gibberish", {"zipf_s": 5}), ("charmarkov", {}), ("bagofwords", {}),
    ("selfcite", {"w_substitute": 0, "w_insert": 0, "w_delete": 0, "w_affix": 0}), ("selfcite", {"p_modify": "0.60x"}), ("selfcite", {"window_lines": "-3"}), ("selfcite", {"window_lines": "03"}),
    ("slotgram", {"slots": "_,_"}), ("slotgram", {"p_fill_slots": "0.5,0.5"}), ("selfcite", {"p_modify": True}), ("gibberish", {"len_p": float("inf")}),
])
def test_parameters_are_checked(family, params):
    with pytest.raises(generators.BadParameter):
        generators.build(family, params)


def test_layouts():
    assert sum(n for n, _, _ in generators.uniform(5, 3, 2)) == 15 and generators.uniform(3, 1, 2) == [(1, True, False), (1, False, True), (1, True, True)]
    assert generators.truncated([(4, True, False), (4, False, False), (4, False, True)], 9) == [(4, True, False), (4, False, True)]
    assert generators.truncated([(4, True, True)], 3) == []
    assert workunits.estimate("search", iterations=257, length=120) == 31 and workunits.estimate("generation", seeds=4, words=2998) == 360
    assert canonical.identity(workunits.layout_document(LAYOUT)) == canonical.identity(workunits.layout_document(workunits.layout_of(workunits.layout_document(LAYOUT))))


def test_planted_corpora():
    made = workunits.plant("sha256:x", "selfcite", {"p_modify": 0.7}, LAYOUT, 3, TargetOptions(3, 1))
    assert made["layout"] == list(LAYOUT) and made["text"].count("\n") == 24 and made == workunits.plant("sha256:x", "selfcite", {"p_modify": 0.7}, LAYOUT, 3, TargetOptions(3, 1))
    lines = [x.split(".") for x in made["text"].split("\n") if x]
    assert made["target"].mean == tuple(Corpus.of(lines, {0, 5, 10, 15}).values())
