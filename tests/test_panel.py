"""Panels, contracts, artifacts."""

import copy

import numpy as np
import pytest
from pyspark.errors import PySparkException

from corpusloom.functions import contracts
from corpusloom.functions.calibration import Invalid, Target
from corpusloom.functions.random import Stream
from corpusloom.operators import panel, search
from corpusloom.sources import artifacts


def test_passages_and_controls():
    assert panel.passage("abcdef", 9, Stream(b"x", 1)) == "abcdef" and panel.passage("abcdef", 3, Stream(b"x", 1)) in "abcdef"
    made = panel.controls([1, 1, 2, 3, 3, 3], Stream(b"x", 2))
    assert list(made) == list(panel.CONTROLS) and sorted(made["shuffled"]) == [1, 1, 2, 3, 3, 3] and set(made["generated-unigram"]) <= {1, 2, 3}


def test_panel(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioustrnl"), 5)) for _ in range(8)]
    texts = ["".join(rng.choice(words, 40)) for _ in range(2)] + ["abc"]
    model = search.Model.of([search.letters(t) for t in texts[:2]], ["x"])
    cases = panel.cases(spark.createDataFrame(list(enumerate(texts)), "job bigint, folded string"), 60).cache()
    assert cases.count() == 6 and {len(r["ciphertext"]) for r in cases.collect()} == {60}
    runs = panel.run(cases, model, {"restart-anneal-v1": 2, "beam-v1": 1}, iterations=300, width=3).cache()
    rows = runs.collect()
    assert len(rows) == 18 and all((r["recovered"] is None) == (r["control"] != "message") for r in rows)
    # What is done isn't run again.
    assert panel.run(cases, model, {"restart-anneal-v1": 2}, iterations=300, done=runs.where("start = 0")).count() == 6
    found = {(r["job"], r["control"], r["algorithm"], r["budget"]): r for r in panel.evaluate(runs, (1, 2)).collect()}
    assert len(found) == 24
    for (job, control, algorithm, budget), r in found.items():
        own = [x for x in rows if (x["job"], x["control"], x["algorithm"]) == (job, control, algorithm) and x["start"] < (1 if algorithm == "beam-v1" else budget)]
        top = max(own, key=lambda x: (x["score"], -x["start"]))
        assert (r["starts"], r["score"], r["best_start"]) == (len(own), top["score"], top["start"])
        assert r["outputs"] == len({x["plaintext"] for x in own}) and r["tied"] == len({x["plaintext"] for x in own if x["score"] == top["score"]})
        if control == "message":
            assert r["controls_at_least"] == sum(found[job, c, algorithm, budget]["score"] >= r["score"] for c in panel.CONTROLS[1:])
        else:
            assert r["controls_at_least"] is None
    moved = panel.compare_budgets(panel.evaluate(runs, (1, 2)), 1, 2).collect()
    assert sum(r["cases"] for r in moved) == 4 and sum(r["further_evaluations"] for r in moved if r["algorithm"] == "restart-anneal-v1") == 600
    assert [search.matches(*x) for x in (("abc", "abd"), ("a", "ab"), ("", ""))] == [2, -1, 0]


GOOD = {
    "corpus-snapshot": {"sources": [{"source_id": "a"}], "transformations": [{"transformation_id": "t", "output": {"artifact_id": "b"}, "inputs": ["a"]}], "views": [{"view_id": "v", "input_artifact_ids": ["b"]}]},
    "experiment": {"validation": {"quorum": 2, "initial_replicas": 2, "max_replicas": 6}, "metrics": [{"metric_id": "m"}], "controls": [], "search": {"candidate_count": 26, "shard_size": 10}, "stopping_rule": {"max_work_units": 3}},
    "work-unit": {"partition": {"role": "control", "control_id": "c"}, "inputs": [{"artifact_id": "a", "logical_name": "x"}]},
    "result-envelope": {"started_at": "2026-01-01T00:00:00+00:00", "finished_at": "2026-01-01T00:00:01+00:00"},
    "validation-record": {"result_ids": ["a", "b"], "result_output_digests": ["x", "x"], "quorum": 2, "decision": "canonical", "canonical_output_digest": "x"},
}


def changed(kind, *path, to):
    d = copy.deepcopy(GOOD[kind])
    at = d
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = to
    return kind, d


@pytest.mark.parametrize("kind, bad", [
    changed("corpus-snapshot", "views", 0, "input_artifact_ids", to=["z"]), changed("corpus-snapshot", "transformations", 0, "output", to={"artifact_id": "a"}),
    changed("experiment", "validation", "quorum", to=3), changed("experiment", "stopping_rule", "max_work_units", to=2), changed("experiment", "metrics", to=[{"metric_id": "m"}] * 2),
    changed("work-unit", "partition", "control_id", to=None), changed("work-unit", "partition", "role", to="search"), changed("result-envelope", "finished_at", to="2025-01-01T00:00:00+00:00"),
    changed("validation-record", "quorum", to=3), changed("validation-record", "result_output_digests", to=["x", "y"]), ("nothing", {}),
])
def test_contracts(kind, bad):
    for name, document in GOOD.items():
        assert contracts.checked(name, document).startswith("sha256:")
    with pytest.raises(Invalid):
        contracts.checked(kind, bad)


def test_bundles():
    unit = contracts.checked("work-unit", GOOD["work-unit"])
    envelope = GOOD["result-envelope"] | {"work_unit": unit}
    documents = {"u": ("work-unit", GOOD["work-unit"]), "e": ("result-envelope", envelope)}
    assert contracts.bundle(documents, [("e", "work_unit", "u")])["u"] == unit
    for bad in ([("e", "work_unit", "x")], [("e", "started_at", "u")]):
        with pytest.raises(Invalid):
            contracts.bundle(documents, bad)


def test_artifacts(spark, tmp_path):
    target = Target((1.0,) * 30, (0.5,) * 30)
    artifacts.write_json(spark, f"{tmp_path}/t", {"target": target.document(), "provenance": {"words": 3}})
    assert artifacts.read_target(spark, f"{tmp_path}/t") == target
    inputs = spark.createDataFrame([("a", '{"model":{"x":[1,2]},"seed":1}'), ("b", '{"model":{"x":[1,2]},"seed":2}'), ("c", '{"seed":3}')], artifacts.INPUTS)
    slim, objects = artifacts.split(inputs)
    assert objects.count() == 1 and all("model" not in r["body"] for r in slim.collect())
    assert {r["id"]: r["part"] for r in artifacts.hydrated(slim, objects).collect()} == {"a": '{"x":[1,2]}', "b": '{"x":[1,2]}', "c": None}
    for broken in (objects.limit(0), objects.withColumn("body", objects["digest"])):
        with pytest.raises(PySparkException, match="missing or changed"):
            artifacts.hydrated(slim, broken).collect()


def test_snapshots(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    artifacts.snapshot({"t": table, "none": table.limit(0)}, str(tmp_path), 100)
    found = artifacts.restored(spark, str(tmp_path), 100)
    assert found["t"].count() == 2 and found["none"].count() == 0
    spark.createDataFrame([(3, "c")], "k int, v string").write.mode("append").parquet(f"{tmp_path}/100/t")
    spark.catalog.refreshByPath(f"{tmp_path}/100/t")
    with pytest.raises(Invalid):
        artifacts.restored(spark, str(tmp_path), 100)
    day = 86_400
    assert artifacts.expired([0, 40 * day, 5 * day], 50 * day) == [0, 5 * day] and artifacts.expired([0], 90 * day) == []
