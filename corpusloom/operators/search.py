"""Key recovery: an n-gram model, annealing and beam search over substitution keys, with records
that can be checked and replayed.

A search is sequential, so a job (one ciphertext, algorithm and start) is one row of work for an
Arrow function; jobs are spread over the cluster. The model has one score for each four letters of
the alphabet, 23^4 in all, whatever the corpus, and travels with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import canonical
from corpusloom.functions.calibration import Invalid
from corpusloom.functions.random import Stream
from corpusloom.plans import shared

LETTERS = shared.LETTERS
SIZE = len(LETTERS)
#: Fixed value: the score of a letter that a partial key doesn't know.
UNKNOWN = -3300
VERSION, MODEL, RECORD, CHECKPOINT = "search-1", "ngram-1", "search-result-1", "search-checkpoint-1"
ENCODINGS = ("substitution", "homophonic", "balanced-homophonic")
#: A checkpoint's trace has a digest of the state every so many proposals.
TRACED = 128


def _logs(counts: np.ndarray) -> np.ndarray:
    """Smoothed log shares in thousandths, halves away from zero."""
    logs = np.log((counts + 0.1) / (float(counts.sum()) + 0.1 * len(counts))) * 1000.0
    return -np.floor(-logs + 0.5).astype(np.int64)


def codes(letters: np.ndarray) -> np.ndarray:
    """The index of every four letters in a row."""
    if len(letters) < 4:
        return np.empty(0, np.int64)
    x = letters.astype(np.int64)
    return ((x[:-3] * SIZE + x[1:-2]) * SIZE + x[2:-1]) * SIZE + x[3:]


@dataclass(frozen=True)
class Model:
    """Scores of four letters in a row, and of single ones."""

    grams: np.ndarray
    single: np.ndarray
    sources: tuple[str, ...] = ("corpus",)

    @staticmethod
    def of(texts: Sequence[np.ndarray], sources: Sequence[str]) -> "Model":
        if not texts or not sources:
            raise Invalid("training needs texts and the names of their sources")
        if any(len(t) and (t.min() < 0 or t.max() >= SIZE) for t in texts):
            raise Invalid("a training text has a letter beyond the alphabet")
        grams = sum(np.bincount(codes(t), minlength=SIZE**4) for t in texts)
        return Model(_logs(grams), _logs(sum(np.bincount(t, minlength=SIZE) for t in texts)), tuple(sources))

    @staticmethod
    def trained(spark: SparkSession, sf_dir: str) -> "Model":
        """From the whole documents table: counts of four letters, at most 23^4 of them, and of letters."""
        counted = shared.gram_counts(spark, sf_dir).collect()
        grams = np.zeros(SIZE**4, np.int64)
        place = {c: k for k, c in enumerate(LETTERS)}
        for g, n in counted:
            a, b, c, d = (place[x] for x in g)
            grams[((a * SIZE + b) * SIZE + c) * SIZE + d] = n
        return Model(_logs(grams), _logs(grams.reshape(SIZE, -1).sum(axis=1)))

    def document(self) -> dict:
        return {"version": MODEL, "alphabet": LETTERS, "training_sources": list(self.sources), "quadgrams": self.grams.tolist(), "unigrams": self.single.tolist()}

    @cached_property
    def digest(self) -> str:
        return canonical.identity(self.document())

    def validated(self) -> "Model":
        both = np.concatenate([self.grams, self.single])
        if len(self.grams) != SIZE**4 or len(self.single) != SIZE or not self.sources or both.min() < -1_000_000 or both.max() > 0:
            raise Invalid("unsupported or malformed language model")
        return self

    def score(self, letters: np.ndarray) -> int:
        return int(self.grams[codes(letters)].sum())


@dataclass(frozen=True)
class Job:
    """A bounded search. It holds no answer: only the ciphertext and how to search it."""

    ciphertext: tuple[int, ...]
    model: Model
    symbols: int = SIZE
    encoding: str = "substitution"
    algorithm: str = "restart-anneal-v1"
    seed: int = 0
    start: int = 0
    iterations: int = 10_000
    width: int = 16
    experiment: str = "search"

    @cached_property
    def digest(self) -> str:
        """The job's identity; the model stands in it by its own."""
        own = {k: getattr(self, k) for k in ("symbols", "encoding", "algorithm", "seed", "start", "iterations", "width", "experiment")}
        return canonical.identity({"version": VERSION, "ciphertext": list(self.ciphertext), "model": self.model.digest} | own)

    def validated(self) -> "Job":
        self.model.validated()
        text = self.ciphertext
        sized = 4 <= len(text) <= 20_000 and 2 <= self.symbols <= 92 and min(text) >= 0 and max(text) < self.symbols
        if not sized or not 1 <= self.iterations <= 100_000 or not 1 <= self.width <= 64 or not 0 < len(self.experiment) <= 160:
            raise Invalid("the search is beyond its bounds")
        if self.encoding not in ENCODINGS or self.algorithm not in ALGORITHMS:
            raise Invalid("unknown encoding or algorithm")
        if (self.encoding == "substitution" and self.symbols != SIZE) or (self.encoding == "balanced-homophonic" and self.symbols % SIZE):
            raise Invalid("the encoding doesn't have so many symbols")
        return self

    @cached_property
    def cipher(self) -> np.ndarray:
        return np.array(self.ciphertext, np.int64)

    def decoded(self, key: Sequence[int]) -> np.ndarray:
        return np.array(key, np.int64)[self.cipher]

    def score(self, key: Sequence[int]) -> int:
        return self.model.score(self.decoded(key))

    def fits(self, key: Sequence[int]) -> bool:
        """Whether a key is one of the encoding's: each letter as often as it must be."""
        if len(key) != self.symbols or not all(0 <= c < SIZE for c in key):
            return False
        return self.encoding == "homophonic" or all(n == self.symbols // SIZE for n in np.bincount(key, minlength=SIZE))

    def room(self) -> int:
        """How many symbols a letter may stand for."""
        return self.symbols if self.encoding == "homophonic" else self.symbols // SIZE


def initial(job: Job) -> dict:
    """The state before any proposal: the letters in turn, shuffled."""
    job.validated()
    key = [k % SIZE for k in range(job.symbols)]
    Stream(f"search/start/{job.digest}".encode(), job.seed).shuffle(key)
    score = job.score(key)
    return {"version": CHECKPOINT, "job_digest": job.digest, "iteration": 0, "key": key, "best_key": key, "score": score, "best_score": score, "trace": []}


def check_checkpoint(job: Job, state: dict) -> None:
    """Raises Invalid unless the state is of the job and its scores are those of its keys."""
    sound = state["version"] == CHECKPOINT and state["job_digest"] == job.digest and 0 <= state["iteration"] <= job.iterations
    sound = sound and job.fits(state["key"]) and job.fits(state["best_key"]) and len(state["trace"]) == state["iteration"] // TRACED
    if not sound or state["score"] != job.score(state["key"]) or state["best_score"] != job.score(state["best_key"]) or state["best_score"] < state["score"]:
        raise Invalid("the checkpoint doesn't match the job or its candidates' scores")


def advance(job: Job, state: dict, proposals: int) -> dict:
    """So many more proposals, within the budget. Each has a stream of its own, so a search may stop
    and go on anywhere. Only the places of the symbols that change are scored again."""
    key, best = list(state["key"]), list(state["best_key"])
    score, best_score, trace = state["score"], state["best_score"], list(state["trace"])
    plain, grams = job.decoded(key), job.model.grams
    n = len(plain)
    places = [np.flatnonzero(job.cipher == s) for s in range(job.symbols)]
    windows = [np.unique(np.concatenate([p - k for k in range(4)])) if len(p) else p for p in places]
    windows = [w[(w >= 0) & (w < n - 3)] for w in windows]
    mixed: dict[tuple[int, int], np.ndarray] = {}
    salt = f"search/proposal/{job.digest}".encode()

    def over(at: np.ndarray) -> int:
        return int(grams[((plain[at] * SIZE + plain[at + 1]) * SIZE + plain[at + 2]) * SIZE + plain[at + 3]].sum())

    end = min(state["iteration"] + proposals, job.iterations)
    span = range(state["iteration"], end)
    for iteration, rng in zip(span, Stream.short(salt, span)):
        a, b = rng.below(job.symbols), rng.below(job.symbols)
        anew = job.encoding == "homophonic" and rng.below(2) == 0
        to_a = rng.below(SIZE) if anew else key[b]
        to_b = key[b] if anew else key[a]
        if a != b:
            pair = (min(a, b), max(a, b))
            if pair not in mixed:
                mixed[pair] = np.union1d(windows[a], windows[b])
            at = mixed[pair]
            before = over(at)
            plain[places[a]], plain[places[b]] = to_a, to_b
            change = over(at) - before
            heat = max(n * 0.7 * ((job.iterations - iteration) / job.iterations), 1.0)
            if change >= 0 or rng.unit() < math.exp(change / heat):
                key[a], key[b] = to_a, to_b
                score += change
                if score > best_score or (score == best_score and key < best):
                    best_score, best = score, key.copy()
            else:
                plain[places[a]], plain[places[b]] = key[a], key[b]
        if (iteration + 1) % TRACED == 0:
            trace.append(canonical.identity([iteration + 1, key, best, score, best_score]))
    return state | {"iteration": end, "key": key, "best_key": best, "score": score, "best_score": best_score, "trace": trace}


def step(job: Job, state: dict | None, proposals: int) -> dict:
    """1 to 1024 proposals on from a state that is checked first."""
    job.validated()
    if job.algorithm != "restart-anneal-v1" or not 1 <= proposals <= 1024:
        raise Invalid("a step is of annealing, with 1 to 1024 proposals")
    if state is None:
        state = initial(job)
    else:
        check_checkpoint(job, state)
    return advance(job, state, proposals)


def record(job: Job, key: Sequence[int], evaluations: int, trace: list[str]) -> dict:
    """What a search found; its digest is that of the record with an empty one."""
    plain = job.decoded(key)
    found = {
        "version": RECORD, "job_digest": job.digest, "algorithm": job.algorithm, "key": list(map(int, key)), "plaintext": "".join(LETTERS[c] for c in plain),
        "score": job.model.score(plain), "evaluations": evaluations, "trace": trace, "result_digest": "",
    }
    return found | {"result_digest": canonical.identity(found)}


def finish(job: Job, state: dict) -> dict:
    job.validated()
    check_checkpoint(job, state)
    if state["iteration"] != job.iterations:
        raise Invalid("the search's budget isn't used up")
    return record(job, state["best_key"], state["iteration"], state["trace"])


def anneal(job: Job) -> dict:
    return finish(job, advance(job, initial(job), job.iterations))


def beam(job: Job) -> dict:
    """Partial keys, extended symbol by symbol in the order of frequency; the `width` best go on.

    A window with an unknown letter counts by single letters. The budget is of extensions; what it
    leaves open is filled with the letters left over, in order.
    """
    job.validated()
    counts = np.bincount(job.cipher, minlength=job.symbols)
    order = sorted(range(job.symbols), key=lambda s: (-int(counts[s]), s))
    windows = np.lib.stride_tricks.sliding_window_view(job.cipher, 4)
    grams, spent, trace, open_ = job.model.grams, 0, [], 255
    single = np.full(256, UNKNOWN, np.int64)
    single[:SIZE] = job.model.single
    # Beyond the alphabet, for places that a partial key doesn't know.
    power = np.array([SIZE**3, SIZE**2, SIZE, 1])
    beam_ = [[open_] * job.symbols]
    for symbol in order:
        grown = []
        for key in beam_:
            for letter in range(SIZE):
                if spent >= job.iterations:
                    break
                if key.count(letter) >= job.room():
                    continue
                new = key.copy()
                new[symbol] = letter
                plain = np.array(new)[windows]
                whole = (plain != open_).all(axis=1)
                score = int(grams[plain[whole] @ power].sum()) + int(single[plain[~whole]].sum())
                grown.append((new, score))
                spent += 1
        if not grown:
            break
        grown.sort(key=lambda x: (-x[1], x[0]))
        grown = grown[: job.width]
        trace.append(canonical.identity([[k, s] for k, s in grown]))
        beam_ = [k for k, _ in grown]
        if spent >= job.iterations:
            break
    complete = []
    for key in beam_:
        left = iter([c for c in range(SIZE) for _ in range(job.room() - key.count(c))] if job.encoding != "homophonic" else [0] * job.symbols)
        key = [next(left) if c == open_ else c for c in key]
        complete.append((-job.score(key), key))
    return record(job, min(complete)[1], spent, trace)


#: The registry of algorithms. Another one is registered by adding it here.
ALGORITHMS = {"restart-anneal-v1": anneal, "beam-v1": beam}


def run(job: Job) -> dict:
    return ALGORITHMS[job.validated().algorithm](job)


def check_candidate(job: Job, found: dict) -> None:
    """Raises Invalid unless a record's text, score and identity are those of its key."""
    job.validated()
    if not job.fits(found["key"]) or found["evaluations"] > job.iterations or len(found["trace"]) > job.iterations // TRACED + job.symbols:
        raise Invalid("the candidate has another shape")
    if record(job, found["key"], found["evaluations"], found["trace"]) != found:
        raise Invalid("the candidate's output, score or identity differs")


def verify(job: Job, found: dict) -> bool:
    """Whether a checked candidate is what a full replay finds too."""
    check_candidate(job, found)
    return run(job) == found


def matches(a: str, b: str) -> int:
    """At how many places two texts agree; -1 if their lengths differ."""
    return sum(x == y for x, y in zip(a, b)) if len(a) == len(b) else -1


# Encoders and codes ----------------------------------------------------------------------------


def letters(text: str) -> np.ndarray:
    return np.array([LETTERS.index(c) for c in text], np.int64)


def encipher(plain: np.ndarray, encoding: str, seed: int) -> tuple[np.ndarray, list[int]]:
    """A text under a seeded key: symbols, and the letter of each symbol. Homophones of a letter take
    turns in a shuffled order."""
    symbols = SIZE if encoding == "substitution" else 2 * SIZE
    key = [k % SIZE for k in range(symbols)]
    rng = Stream(b"encipher", seed)
    rng.shuffle(key)
    of = [[s for s, c in enumerate(key) if c == letter] for letter in range(SIZE)]
    turn = [0] * SIZE
    out = []
    for c in plain.tolist():
        out.append(of[c][turn[c] % len(of[c])])
        turn[c] += 1
    return np.array(out, np.int64), key


class CodeTable:
    """A verbose code: glyph strings for a letter on its own, before or behind another.

    `glyphs` maps place_table_letter to a string, as a CSV of two columns has it: places `unigram`,
    `prefix` and `suffix`, tables in the order of `tables`.
    """

    def __init__(self, glyphs: dict[str, str], tables: Sequence[str] = ("alpha", "beta1", "beta2", "beta3", "gamma1", "gamma2"), counts: Sequence[int] = (28, 14, 11, 11, 7, 7)):
        self.glyphs, self.tables, self.counts = glyphs, tuple(tables), tuple(counts)
        self.single = {glyphs[f"unigram_{t}_{c}"]: k for t in tables for k, c in enumerate(LETTERS)}
        self.pairs: dict[str, list[tuple[str, str, int, int]]] = {}
        for (t, (i, a)), (u, (j, b)) in product(product(tables, enumerate(LETTERS)), repeat=2):
            first, second = f"prefix_{t}_{a}", f"suffix_{u}_{b}"
            self.pairs.setdefault(glyphs[first] + glyphs[second], []).append((first, second, i, j))

    @staticmethod
    def read(spark: SparkSession, path: str, **settings) -> "CodeTable":
        return CodeTable({r[0]: r[1] for r in spark.read.csv(path, header=True).collect()}, **settings)

    def parse(self, text: str) -> list[int]:
        """The letters of a text of codes: a token is a letter's own code, or else a single pair's."""
        found: list[int] = []
        for token in text.split():
            if token in self.single:
                found.append(self.single[token])
            elif len(pairs := self.pairs.get(token, [])) == 1:
                found += pairs[0][2:]
            else:
                raise Invalid(f"{'ambiguous' if pairs else 'unparsed'} token: {token}")
        return found

    def encrypt(self, plain: Sequence[int], key: Sequence[int], seed: int, salt: bytes = b"verbose-code", tries: int = 10_000) -> str:
        """Letters under a key, in singles and pairs, tables drawn from a shuffled deck; a pair whose
        code could be read otherwise is drawn again."""
        if sorted(key) != list(range(SIZE)) or not all(0 <= c < SIZE for c in plain):
            raise Invalid("the text or key isn't of the alphabet")
        rng = Stream(salt, seed)
        tokens, at = [], 0
        while at < len(plain):
            size = 1 if at + 1 == len(plain) or rng.unit() < 17.0 / 36.0 else 2
            tokens.append([LETTERS[key[c]] for c in plain[at : at + size]])
            at += size
        deck: list[str] = []

        def drawn() -> str:
            if not deck:
                deck.extend(t for t, n in zip(self.tables, self.counts) for _ in range(n))
                rng.shuffle(deck)
                deck.reverse()
            return deck.pop()

        out = []
        for token in tokens:
            if len(token) == 1:
                out.append(self.glyphs[f"unigram_{drawn()}_{token[0]}"])
                continue
            for _ in range(tries):
                first, second = f"prefix_{drawn()}_{token[0]}", f"suffix_{drawn()}_{token[1]}"
                word = self.glyphs[first] + self.glyphs[second]
                if word not in self.single and [p[:2] for p in self.pairs[word]] == [(first, second)]:
                    out.append(word)
                    break
            else:
                raise Invalid("no code without a second reading in so many draws")
        return " ".join(out)


# Spark -----------------------------------------------------------------------------------------

RECORDS = "job bigint, algorithm string, start int, score bigint, evaluations int, letters bigint, recovered bigint, result_digest string"


def recover(texts: DataFrame, model: Model, algorithms: dict[str, tuple[int, ...]], encoding: str = "substitution", iterations: int = 10_000, width: int = 16) -> DataFrame:
    """`texts` (job, folded) enciphered by a key of their own and searched by each algorithm from each
    of its starts, as RECORDS. Texts of fewer than four letters, or more than a job's 20,000, are
    beyond a search and have no row."""
    spark = texts.sparkSession
    shared_model = spark.sparkContext.broadcast(model)
    starts = [(a, s) for a, ss in algorithms.items() for s in ss]
    table = spark.createDataFrame(starts, "algorithm string, start int")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for job_id, text, algorithm, start in zip(*(c.to_pylist() for c in batch.columns)):
                plain = letters(text)
                cipher, key = encipher(plain, encoding, job_id)
                job = Job(tuple(cipher.tolist()), shared_model.value, len(key), encoding, algorithm, start, start, iterations, width)
                found = run(job)
                right = int((job.decoded(found["key"]) == plain).sum())
                out.append((job_id, algorithm, start, found["score"], found["evaluations"], len(plain), right, found["result_digest"]))
            columns = zip(*out) if out else [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in RECORDS.split(", ")])

    jobs = texts.where(F.length("folded").between(4, 20_000)).select("job", "folded").crossJoin(F.broadcast(table))
    # Few rows, much work on each: spread evenly.
    return jobs.repartition(4 * spark.sparkContext.defaultParallelism, "job", "algorithm", "start").mapInArrow(rows, RECORDS)


def best_of(records: DataFrame) -> DataFrame:
    """The best start of each (job, algorithm): the highest score, the earliest of equals."""
    return records.groupBy("job", "algorithm").agg(F.max_by(F.struct("start", "score", "recovered", "letters"), F.struct("score", -F.col("start"))).alias("x")).select("job", "algorithm", "x.*")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.query(shared.SEARCH["normalize_text"][0])(spark, sf_dir).select(F.col("item_id").alias("job"), "folded")


def anneal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, two starts of annealing at the published budget."""
    return recover(folded(spark, sf_dir), Model.trained(spark, sf_dir), {"restart-anneal-v1": (0, 1)})


def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text by the beam at the published width and budget."""
    return recover(folded(spark, sf_dir), Model.trained(spark, sf_dir), {"beam-v1": (0,)})


def homophonic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of(recover(folded(spark, sf_dir), Model.trained(spark, sf_dir), {"restart-anneal-v1": (0, 1)}, "balanced-homophonic"))


QUERIES = {f.__name__: f for f in (anneal_search, beam_search, homophonic_search)}
