"""Sweeps and targets over tables against the same in memory, and the stream's rules over batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import calibration, textstats, workunits
from corpusloom.functions.calibration import Corpus, Target, TargetOptions
from corpusloom.functions.workunits import Grid
from corpusloom.operators import generators, sweeps

LINES = "page_no bigint, line_no int, words array<string>, n_words int, para_start boolean"


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 6))) for _ in range(60)]
    rows = []
    for page in range(9):
        for k in range(int(rng.integers(1, 6))):
            ws = [str(w) for w in rng.choice(words, rng.integers(1, 9))]
            rows.append((page, k, ws, len(ws), k == 0))
    return spark.createDataFrame(rows, LINES).cache()


def in_memory(df):
    rows = df.orderBy("page_no", "line_no").collect()
    return textstats.fingerprint([r["words"] for r in rows], {k for k, r in enumerate(rows) if r["para_start"]})


def test_values_of_a_table_are_those_in_memory(spark, lines):
    got = sweeps.values_by(lines.select(F.lit("x").alias("what"), *sweeps.LINE), "what")["x"]
    assert np.allclose(got, in_memory(lines), atol=1e-9)


def test_resamples(spark, lines):
    total = lines.agg(F.sum("n_words")).first()[0]
    drawn = sweeps.resampled(lines, 4)
    sums = [r[0] for r in drawn.groupBy("run").agg(F.sum("n_words")).select("sum(n_words)").collect()]
    assert len(sums) == 4 and all(s >= total for s in sums)
    part = sweeps.resampled(lines, 3, fraction=0.5)
    got = part.groupBy("run").agg(F.sum("n_words").alias("n"), F.max("n_words")).collect()
    assert len(got) == 3 and all(int(total * 0.5) <= r["n"] < total for r in got)
    target, values = sweeps.target(lines, TargetOptions(3))
    assert np.allclose(target.mean, in_memory(lines), atol=1e-9) and len(values) == 3 and min(target.scale) >= 1e-6


def test_ledgers_and_refinement(spark, lines, tmp_path):
    against = Target(tuple(in_memory(lines)), (0.5,) * 30)
    pages = generators.layouts(lines)
    grid = Grid("t", "selfcite", {"p_modify": [0.5, 0.9], "max_len": [6, 8]}, replicates=2)
    entries = sweeps.ledger(pages, grid, against)
    assert [e["index"] for e in entries] == [0, 1, 2, 3] and all(len(e["distances"]) == 2 for e in entries)
    run = sweeps.simulated(pages, "selfcite", grid.points(), 2, "t").where("run = 5")
    assert against.distance(in_memory(run)) == pytest.approx(entries[2]["distances"][1])
    header = workunits.ledger_header(grid, against, [(3, True, True)])
    sweeps.write_ledger(spark, f"{tmp_path}/ledger", header, entries)
    assert sweeps.read_ledger(spark, f"{tmp_path}/ledger") == (header, entries)
    report = sweeps.refined(pages, grid, against, 2)
    assert [x["level"] for x in report["levels"]] == [0, 1] and report["simulations"] == 8 + 2 * report["levels"][1]["points"]
    found = sweeps.calibrated(pages, grid, {"p_modify": 0.9, "max_len": 8}, [e["min"] for e in entries], against, ("gibberish",))
    order = sorted(entries, key=lambda e: (e["median"], e["index"]))
    assert found["hidden_point"]["index"] == 3 and found["hidden_rank"] == 1 + [e["index"] for e in order].index(3) and set(found["controls"]) == {"gibberish"}


def test_units_run_in_tasks(spark):
    layout = generators.uniform(12, 6, 4)
    against = Target((1.0,) * 30, (1.0,) * 30)
    units = [workunits.make("t", f, {}, against, layout, seeds=3) for f in ("gibberish", "slotgram")]
    rows = sweeps.run_units(spark, units, against, layout).collect()
    whole = [workunits.run(u, against, layout) for u in units]
    assert {(r["unit"], r["seed"]): r["distance"] for r in rows} == {(k, s["seed"]): s["distance"] for k, w in enumerate(whole) for s in w["seeds"]}
    got = {r["unit"]: r for r in sweeps.replicates(sweeps.run_units(spark, units, against, layout)).collect()}
    assert [got[k]["specimen_seed"] for k in (0, 1)] == [w["specimen_seed"] for w in whole]


def test_conditional_ranks(spark):
    layout = [8] * 12
    observed = generators.build("gibberish")(sweeps.Stream(b"x", 9281), layout)
    pages = spark.createDataFrame([(1, observed), (2, []), (3, [["a"] * 100])], "page_no bigint, lines array<array<string>>")
    got = {r["page_no"]: r for r in sweeps.conditional_ranks(pages, "gibberish", {}, TargetOptions(4, 91), most_words=96).collect()}
    assert math.isfinite(got[1]["score"]) and got[1]["p"] in [k / 20 for k in range(1, 21)] and got[2]["p"] is None and got[3]["p"] is None
    assert calibration.conditional_target(Corpus.of(observed, {0}, {11}), TargetOptions(4, 91)).weight[-1] == 0


def test_rates_go_on_over_batches(spark, tmp_path):
    """Two files are two batches: a window that began in the first goes on in the second."""
    from corpusloom.streaming import credit

    schema = "id bigint, guest_id bigint, moment bigint, unit_id bigint, result string, amount double"
    batches = [[(1, 7, 0, 1, "a", 1.0), (2, 7, 5, 1, "a", 1.0), (3, 8, 5, 1, "b", 1.0)], [(4, 7, 9, 1, "b", 1.0), (5, 7, 10, 2, "a", 1.0), (6, 8, 2000, 1, "a", 1.0), (7, 9, 3, 1, "a", 2.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["id"]: (r["n"], r["limited"]) for r in credit.drained(credit.rate_limited(stream(), 2, 10)).collect()}
    assert got == {1: (1, False), 2: (2, False), 4: (3, True), 5: (1, False), 3: (1, False), 6: (1, False), 7: (1, False)}
    verdicts = {r["id"]: (r["verdict"], r["late"]) for r in credit.drained(credit.submitted(stream())).collect()}
    assert verdicts == {1: ("received", False), 2: ("duplicate", False), 3: ("received", False), 4: ("conflict", False), 5: ("received", False), 6: ("conflict", True), 7: ("received", False)}
    trusted = spark.createDataFrame([(1, "a")], "unit_id bigint, trusted string")
    credit.credited(stream(), trusted, f"{tmp_path}/credit")
    given = spark.read.parquet(f"{tmp_path}/credit").collect()
    assert {(r["guest_id"], r["id"]) for r in given} == {(7, 1), (8, 6), (9, 7)}


def test_submissions_make_no_python_group_of_a_key(spark, tmp_path):
    """A key without a unit goes on over batches, and verdicts come from the engine's own windows."""
    from corpusloom.streaming import credit

    schema = "id bigint, guest_id bigint, moment bigint, unit_id bigint, result string"
    for rows in ([(1, 7, 0, None, "a"), (2, 7, 5, None, None)], [(3, 7, 700, None, "a"), (4, 7, 1, None, "b"), (5, 8, 1, 2, None), (6, 8, 1, 2, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    work = credit.submitted(events)
    rows, kept = work.judge(spark.createDataFrame([(1, 7, 0, None, "a")], schema), None)
    assert "Pandas" not in rows._jdf.queryExecution().toString() and kept.count() == 1
    got = {r["id"]: (r["verdict"], r["late"]) for r in credit.drained(work).collect()}
    assert got == {1: ("received", False), 2: ("conflict", False), 3: ("duplicate", True), 4: ("conflict", False), 5: ("received", False), 6: ("conflict", False)}


def test_bootstrapped_values_are_those_of_the_drawn_pages(spark, lines, monkeypatch):
    """Each run's draws, slab by slab, put together and measured in memory."""
    rows = lines.orderBy("page_no", "line_no").collect()
    pages = sorted({r["page_no"] for r in rows})
    words = np.array([sum(len(r["words"]) for r in rows if r["page_no"] == p) for p in pages])
    got = sweeps.bootstrapped(lines, 5, 3)
    slabs = min(len(pages), 3 * spark.sparkContext.defaultParallelism)
    for run, n in enumerate(sweeps.enough(words, 3, range(5))):
        drawn = sweeps.drawn_blocks(3, run, n, len(pages))
        assert words[drawn].sum() >= words.sum() > words[drawn[:-1]].sum()
        stream = [r for k in range(slabs) for b in drawn if b % slabs == k for r in rows if r["page_no"] == pages[b]]
        expected = textstats.fingerprint([r["words"] for r in stream], {k for k, r in enumerate(stream) if r["para_start"]})
        assert np.allclose(got[run], expected, atol=1e-9)
    assert TargetOptions().resamples == 200 and sweeps.target.__defaults__[0] == TargetOptions()


def test_a_page_of_any_size_is_ranked(spark):
    """The registered rank test declares no bounds: a page of over 20,000 lines has its rank."""
    observed = [["ab"]] * 20_001
    pages = spark.createDataFrame([(1, observed)], "page_no bigint, lines array<array<string>>")
    row = sweeps.conditional_ranks(pages, "gibberish", {"len_n": 1}, TargetOptions(2, 91), references=1, targets=1).first()
    assert math.isfinite(row["score"]) and row["p"] in (0.5, 1.0)


@pytest.mark.parametrize("name", ["bootstrap_scale", "self_distance", "compare_targets", "calibrate_report", "sweep_ledger", "refine_levels"])
def test_registered_targets_have_all_resamples(spark, monkeypatch, name):
    asked = []

    def bootstrapped(lines, resamples, seed=1):
        asked.append(resamples)
        raise InterruptedError

    monkeypatch.setattr(sweeps, "bootstrapped", bootstrapped)
    monkeypatch.setattr(sweeps, "values_by", lambda lines, group: {})
    with pytest.raises(InterruptedError):
        sweeps.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [200] and sweeps.JUDGED == 8
