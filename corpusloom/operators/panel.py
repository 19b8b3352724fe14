"""Recovery panels: passages enciphered, matched with controls that have no message, and searched.

A case is a passage under a key of its own. Its controls are the same ciphertext shuffled, and symbols
drawn from it with replacement: a method that recovers messages scores these lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.functions.random import Stream
from corpusloom.operators import search
from corpusloom.operators.search import Job, Model

CONTROLS = ("message", "shuffled", "generated-unigram")
CASES = "job bigint, control string, ciphertext array<int>, plain string"
RUNS = "job bigint, control string, algorithm string, start int, score bigint, evaluations int, recovered int, letters int, plaintext string, result_digest string"


def passage(text: str, length: int, rng: Stream) -> str:
    """A random stretch of a text; a shorter text is its own."""
    at = rng.below(len(text) - length + 1) if len(text) > length else 0
    return text[at : at + length]


def controls(cipher: list[int], rng: Stream) -> dict[str, list[int]]:
    shuffled = cipher.copy()
    rng.shuffle(shuffled)
    return {"message": cipher, "shuffled": shuffled, "generated-unigram": [cipher[rng.below(len(cipher))] for _ in cipher]}


def cases(texts: DataFrame, length: int, encoding: str = "substitution", seed: int = 1) -> DataFrame:
    """`texts` (job, folded) as CASES: a passage of each, and its controls. Texts under four letters
    have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for job, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rng = Stream(f"panel/{seed}".encode(), job)
                plain = passage(text, length, rng)
                cipher, _ = search.encipher(search.letters(plain), encoding, job)
                out += [(job, c, symbols, plain) for c, symbols in controls(cipher.tolist(), rng).items()]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], ["job", "control", "ciphertext", "plain"])

    return texts.where(F.length("folded") >= 4).select("job", "folded").mapInArrow(rows, CASES)


def run(cases: DataFrame, model: Model, algorithms: dict[str, int], encoding: str = "substitution", iterations: int = 10_000, width: int = 16, done: DataFrame | None = None) -> DataFrame:
    """CASES searched by each algorithm from its number of starts, as RUNS. What is in `done` (job,
    control, algorithm, start) isn't run again."""
    spark = cases.sparkSession
    table = spark.sparkContext.broadcast(model)
    symbols = search.SIZE if encoding == "substitution" else 2 * search.SIZE
    starts = spark.createDataFrame([(a, s) for a, n in algorithms.items() for s in range(n)], "algorithm string, start int")
    jobs = cases.crossJoin(F.broadcast(starts))
    if done is not None:
        jobs = jobs.join(done.select("job", "control", "algorithm", "start"), ["job", "control", "algorithm", "start"], "left_anti")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for job, control, cipher, plain, algorithm, start in zip(*(c.to_pylist() for c in batch.columns)):
                found = search.run(Job(tuple(cipher), table.value, symbols, encoding, algorithm, start, start, iterations, width))
                right = int(np.sum(np.array(list(found["plaintext"])) == np.array(list(plain)))) if control == "message" else None
                out.append((job, control, algorithm, start, found["score"], found["evaluations"], right, len(plain), found["plaintext"], found["result_digest"]))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 10, kinds)], [f.split()[0] for f in RUNS.split(", ")])

    jobs = jobs.select("job", "control", "ciphertext", "plain", "algorithm", "start")
    return jobs.repartition(4 * spark.sparkContext.defaultParallelism, "job", "control", "algorithm", "start").mapInArrow(rows, RUNS)


def evaluate(runs: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """Runs under each budget of starts: the best score, the earliest start of equals; how many
    outputs differ and share the best score; recovery of messages; and, for messages, how many of
    their controls score at least as high. The beam has one start under any budget."""
    spark = runs.sparkSession
    budget = spark.createDataFrame([(b,) for b in budgets], "budget int")
    within = runs.join(F.broadcast(budget), (F.col("start") < F.col("budget")) & ((F.col("algorithm") != "beam-v1") | (F.col("start") == 0)))
    key = ["job", "control", "algorithm", "budget"]
    best = F.max_by(F.struct("start", "score", "recovered", "letters"), F.struct("score", -F.col("start"))).alias("x")
    found = within.groupBy(*key).agg(best, F.count("*").alias("starts"), F.sum("evaluations").alias("evaluations"), F.count_distinct("plaintext").alias("outputs"))
    tied = within.join(found.select(*key, F.col("x.score").alias("score")), [*key, "score"]).groupBy(*key).agg(F.count_distinct("plaintext").alias("tied"))
    found = found.join(tied, key).select(*key, "starts", "evaluations", "outputs", "tied", "x.score", F.col("x.start").alias("best_start"), (F.col("x.recovered") / F.col("x.letters")).alias("recovery"), (F.col("x.recovered") == F.col("x.letters")).alias("exact"))
    others = found.where("control <> 'message'").select("job", "algorithm", "budget", F.col("score").alias("other"))
    above = found.where("control = 'message'").join(others, ["job", "algorithm", "budget"]).groupBy("job", "algorithm", "budget").agg(F.count_if(F.col("other") >= F.col("score")).alias("n"))
    above = above.select("job", "algorithm", "budget", F.lit("message").alias("control"), F.col("n").alias("controls_at_least"))
    return found.join(above, key, "left")


def outcome() -> Column:
    """Of a message under a budget: recovered exactly, read wrongly, or without any run."""
    return F.when(F.col("exact"), "exact").when(F.col("exact").isNull(), "unavailable").otherwise("wrong")


def compare_budgets(found: DataFrame, before: int, after: int) -> DataFrame:
    """How the outcomes of messages change from one budget to a larger one, by algorithm, with the
    evaluations that the further starts cost."""
    side = lambda b: found.where((F.col("control") == "message") & (F.col("budget") == b)).select("job", "algorithm", outcome().alias(f"at_{b}"), F.col("evaluations").alias(f"evaluations_{b}"))
    both = side(before).join(side(after), ["job", "algorithm"])
    cost = (F.col(f"evaluations_{after}") - F.col(f"evaluations_{before}")).cast("long")
    return both.groupBy("algorithm", f"at_{before}", f"at_{after}").agg(F.count("*").alias("cases"), F.sum(cost).alias("further_evaluations"))


def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel over all benchmark texts: passages of 80 letters, two starts of annealing and the beam."""
    made = cases(search.folded(spark, sf_dir), 80)
    runs = storage.cut(run(made, Model.trained(spark, sf_dir), {"restart-anneal-v1": 2, "beam-v1": 1}, iterations=1500, width=8))
    return evaluate(runs, (1, 2))


QUERIES = {"panel_summary": panel_summary}
