"""Targets, parameter sweeps and their judgement, over whole corpora.

A simulated or resampled corpus is a set of rows (run, page_no, line_no, words): pages are filled or
drawn by tasks of their own, which measure what they made as pieces of the run's stream (see
functions.pieces). So a run may be as large as the corpus, its words leave the task only as counts, and
of each run the driver gets sums and the 500 highest counts of each part of its words.

Corpora bounded by a declared layout are handled inside a task: see functions.workunits, and
run_units() for many units at once.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusloom import storage
from corpusloom.functions import calibration, canonical, pieces, workunits
from corpusloom.functions.calibration import Corpus, Target, TargetOptions
from corpusloom.functions.random import Stream
from corpusloom.functions.textstats import NAMES
from corpusloom.functions.workunits import Grid, Refinement
from corpusloom.operators import generators, statistics
from corpusloom.sources import corpus

LINE = ["page_no", "line_no", "words", "n_words", "para_start"]
#: The registered grid and its replicates; those that the rules of a calibration judge.
GRID = Grid("sweep-1", "selfcite", {"p_modify": [0.5, 0.85], "max_len": [6, 8]}, replicates=2, integers=["max_len"])
JUDGED = 8


PARTS = "what string, bucket int, piece bigint, data binary"
#: About how many words a piece has.
PIECE = 1 << 20


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["what", "bucket", "piece", "data"])


def _measured(what: str, piece: int, text: pieces.Text, buckets: int) -> Iterator[tuple]:
    """A piece's rows of PARTS: its sums and ends in bucket -1, its words' counts in the others."""
    keys, ids, counts = np.unique(text.key, return_inverse=True, return_counts=True)
    total, pairs, columns = pieces.sums(text, np.zeros(len(text.key), np.int64), 1)
    yield what, -1, piece, pickle.dumps((total[0], columns, pairs[0], pieces.ends_of(text, ids)))
    of = (pieces.scattered(keys) % np.uint64(buckets)).astype(np.int64)
    for k in np.unique(of).tolist():
        yield what, k, piece, pickle.dumps((keys[of == k], counts[of == k].astype(np.int32)))


def _merged(parts: pa.Table) -> pa.Table:
    """A bucket of one corpus, from all its pieces: what values need of it."""
    what, bucket = parts["what"][0].as_py(), parts["bucket"][0].as_py()
    found = [pickle.loads(d) for _, d in sorted(zip(parts["piece"].to_pylist(), parts["data"].to_pylist()))]
    if bucket < 0:
        total, pairs = sum(x[0] for x in found), np.zeros(pieces.SIDE**2, np.int64)
        for _, columns, some, _ in found:
            pairs[columns] += some.astype(np.int64)
        kept = total, pairs, pieces.stitched([x[3] for x in found])
    else:
        keys, of = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([x[1] for x in found])).astype(np.int64)
        kept = len(keys), int((counts == 1).sum()), -np.sort(-counts)[:500]
    return pa.Table.from_batches([_rows([(what, bucket, 0, pickle.dumps(kept))])])


def _values(merged: dict[str, tuple], types: dict[str, list[tuple]]) -> dict[str, list[float]]:
    found = {}
    for what, (total, pairs, ends) in merged.items():
        parts = types.get(what, [])
        top = np.concatenate([np.zeros(0, np.int64), *[x[2] for x in parts]])
        found[what] = pieces.values(total, pairs, ends, sum(x[0] for x in parts), sum(x[1] for x in parts), top)
    return found


def values_of(parts: DataFrame) -> dict[str, list[float]]:
    """The 30 values of each corpus whose pieces are `parts`, on the driver."""
    merged, types = {}, {}
    for r in parts.groupBy("what", "bucket").applyInArrow(_merged, PARTS).collect():
        if r["bucket"] < 0:
            merged[r["what"]] = pickle.loads(r["data"])
        else:
            types.setdefault(r["what"], []).append(pickle.loads(r["data"]))
    return _values(merged, types)


def _text(batch: pa.RecordBatch, words: str = "words", starts: str = "para_start") -> pieces.Text:
    """The lines of a batch as words in a row."""
    lists = batch.column(batch.schema.get_field_index(words))
    flat = lists.flatten().cast(pa.large_string())
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    letters = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(flat) else np.zeros(0, np.uint8)
    flags = batch.column(batch.schema.get_field_index(starts)).fill_null(False).to_numpy(zero_copy_only=False)
    return pieces.Text.of(letters, offsets - offsets[0], sizes, flags.astype(bool))


def values_by(lines: DataFrame, group: str) -> dict:
    """The 30 values of each group of lines, on the driver: a group's stream is its pages in order."""
    tasks = 3 * lines.sparkSession.sparkContext.defaultParallelism

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
            for a, b in zip(cuts, cuts[1:]):
                yield _rows(list(_measured(names[a], task << 32 | at, _text(batch.slice(a, b - a)), tasks)))
                at += 1

    kind = lines.schema[group].dataType
    named = lines.select(F.col(group).cast("string").alias("what"), "page_no", "line_no", "words", "para_start")
    dealt = named.repartitionByRange(tasks, "what", "page_no", "line_no").sortWithinPartitions("what", "page_no", "line_no")
    found = values_of(dealt.mapInArrow(rows, PARTS))
    return {int(k) if isinstance(kind, IntegralType) else k: v for k, v in found.items()}


def resampled(lines: DataFrame, resamples: int, seed: int = 1, fraction: float | None = None) -> DataFrame:
    """`lines` of pages drawn anew, as (run, page_no, ...): with replacement until there are at least
    as many words as in all, or without, in a random order, up to a fraction of the words.

    A page is a block: its lines stay together, and its place in the draws is its new number.
    """
    spark = lines.sparkSession
    sizes = lines.groupBy("page_no").agg(F.sum("n_words").cast("long").alias("words"))
    sizes = storage.cut(statistics.positions(sizes.select(F.lit(0).alias("all"), "page_no", F.lit(0).alias("line_no"), F.lit(1).cast("long").alias("n_words"), "words"), "all").select("page_no", "words", F.col("at").alias("block")))
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    wanted = total if fraction is None else int(total * fraction)
    factor = 1.3
    while True:
        if fraction is None:
            draws = spark.range(int(n * factor) + 64).select(F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("run"), F.col("id").alias("i"))
            drawn = draws.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "run", "i"), F.lit(max(n, 1)))).join(sizes, "block")
        else:
            drawn = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("run"))
            # A random order: the rank of a hash, by the same running sums.
            order = drawn.select("run", F.xxhash64(F.lit(seed), "run", "block").alias("page_no"), F.lit(0).alias("line_no"), F.lit(1).cast("long").alias("n_words"), "block", "words", F.col("page_no").alias("page"))
            drawn = statistics.positions(order, "run", F.expr("shiftright(page_no, 44)")).select("run", "block", "words", F.col("page").alias("page_no"), F.col("at").alias("i"))
        placed = drawn.select("run", F.col("i").alias("page_no"), F.lit(0).alias("line_no"), F.col("words").alias("n_words"), F.col("page_no").alias("page"))
        placed = storage.cut(statistics.positions(placed, "run").where(F.col("at") < wanted).select("run", "page", F.col("page_no").alias("i"), "n_words"))
        short = placed.groupBy("run").agg(F.sum("n_words").alias("w")).where(F.col("w") < wanted)
        if fraction is not None or not n or short.isEmpty():
            break
        factor *= 2
    own = lines.select(F.col("page_no").alias("page"), "line_no", "words", "n_words", "para_start")
    return placed.drop("n_words").join(own, "page").select("run", F.col("i").alias("page_no"), "line_no", "words", "n_words", "para_start")


def drawn_blocks(seed: int, run: int, n: int, blocks: int) -> np.ndarray:
    """The first n draws of a run, with replacement."""
    start = pieces.scattered(np.array([seed & (1 << 64) - 1, run], np.uint64)).sum(dtype=np.uint64)
    return (pieces.scattered(start + np.arange(n, dtype=np.uint64) * pieces._MIX) % np.uint64(blocks)).astype(np.int64)


def enough(words: np.ndarray, seed: int, runs: range) -> list[int]:
    """How many draws each run takes until it has at least as many words as there are."""
    wanted, out = int(words.sum()), []
    for run in runs:
        n = int(len(words) * 1.1) + 64
        while wanted and (upto := np.cumsum(words[drawn_blocks(seed, run, n, len(words))]))[-1] < wanted:
            n *= 2
        out.append(int(np.searchsorted(upto, wanted)) + 1 if wanted else 0)
    return out


def bootstrapped(lines: DataFrame, resamples: int, seed: int = 1) -> list[list[float]]:
    """The values of `resamples` corpora of pages drawn with replacement, until there are at least as
    many words as in all.

    Pages are dealt into slabs by their number, whatever they hold. A run's stream is its draws from
    the first slab, in their order, then those from the second, and so on: a task has a slab and
    measures its stretch of every run, so no run's words are ever written. Runs' counts of words are
    found from the pages that each word is on, by part of all words.
    """
    spark = lines.sparkSession
    sizes = lines.groupBy("page_no").agg(F.sum("n_words").cast("long").alias("words"))
    sizes = storage.cut(statistics.positions(sizes.select(F.lit(0).alias("all"), "page_no", F.lit(0).alias("line_no"), F.lit(1).cast("long").alias("n_words"), "words"), "all").select("page_no", "words", F.col("at").alias("block")))
    known = sizes.select("block", "words").toPandas()
    n = len(known)
    if not n or not known["words"].sum():
        return []
    words = np.zeros(n, np.int64)
    words[known["block"].to_numpy()] = known["words"].to_numpy()
    total, runs = int(words.sum()), range(resamples)
    draws = enough(words, seed, runs)
    slabs = max(1, min(n, max(3 * spark.sparkContext.defaultParallelism, total // PIECE)))
    buckets = max(3 * spark.sparkContext.defaultParallelism, total // (2 * PIECE))

    def slab_parts(slab: int, block: np.ndarray, text: pieces.Text) -> Iterator[tuple]:
        """A slab's rows: its stretch of each run, and its pages' words in their buckets."""
        count = (n - slab + slabs - 1) // slabs
        page = np.repeat(block // slabs, text.sizes)
        keys, ids = np.unique(text.key, return_inverse=True)
        ids = ids.astype(np.int32)
        own, pairs, columns = pieces.sums(text, page, count)
        pairs = pairs.astype(np.float64)
        length = np.bincount(page, minlength=count)
        start = np.cumsum(length) - length
        taken = []
        for run in runs:
            drawn = drawn_blocks(seed, run, draws[run], n)
            taken.append((drawn[drawn % slabs == slab] // slabs).astype(np.int32))
        # How often each run has each page, a row for a run; all sums over pages are two products.
        times = np.stack([np.bincount(x, minlength=count) for x in taken]).astype(np.float64)
        all_sums, all_pairs = times @ own, np.rint(times @ pairs).astype(np.int64)
        for run in runs:
            drawn = taken[run][length[taken[run]] > 0]
            sums = all_sums[run]
            before, after = (start + length - 1)[drawn[:-1]], start[drawn[1:]]
            same = text.key[before] == text.key[after]
            near = np.flatnonzero(~same & (np.abs(text.length[before] - text.length[after]) <= 1))
            before, after = before[near], after[near]
            sums[-2:] += same.sum(), pieces.within_one(text.rows[before], text.rows[after], text.length[before], text.length[after]).sum()
            stream = np.concatenate([np.zeros(0, ids.dtype), *[ids[x:y] for x, y in zip(start[drawn].tolist(), (start + length)[drawn].tolist())]])
            word = lambda k: text.rows[k, : text.length[k]]
            none, n_words = np.zeros(0, np.uint8), len(stream)
            first, last = (word(start[drawn[0]]), word((start + length - 1)[drawn[-1]])) if n_words else (none, none)
            ends = pieces.Ends(n_words, keys[stream[: pieces.REACH]], keys[stream[-2 * pieces.REACH :]], pieces.repeats(stream), first, last)
            yield str(run), -1, slab, pickle.dumps((sums, columns, all_pairs[run], ends))
        pair, counts = np.unique(page.astype(np.int64) * len(keys) + ids, return_counts=True)
        page, word_ = np.divmod(pair, max(len(keys), 1))
        of = (pieces.scattered(keys) % np.uint64(buckets)).astype(np.int64)[word_]
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            some = order[bounds[k] : bounds[k + 1]]
            yield "", k, slab, pickle.dumps((keys[word_[some]], (page[some] * slabs + slab).astype(np.int32), counts[some].astype(np.int32)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            sized = whole.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for row in slab_parts(whole.column(0)[0].as_py(), whole.column(1).to_numpy()[sized > 0], _text(whole)):
                yield _rows([row])

        for batch in batches:
            names = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
            for a, b in zip(cuts, cuts[1:]):
                if waiting and waiting[0].column(0)[0].as_py() != names[a]:
                    yield from done()
                    waiting = []
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from done()

    def counted(parts: pa.Table) -> pa.Table:
        """A bucket of words: each run's numbers of types and of those found once, and its highest counts."""
        found = [pickle.loads(d) for d in parts["data"].to_pylist()]
        key, block, times = (np.concatenate([x[k] for x in found]) for k in range(3))
        order = np.argsort(key, kind="stable")
        key, block, times = key[order], block[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out = []
        for run in runs:
            drawn = np.bincount(drawn_blocks(seed, run, draws[run], n), minlength=n).astype(np.int32)
            counts = np.add.reduceat(drawn[block] * times, first)
            counts = counts[counts > 0]
            out.append((str(run), len(counts), int((counts == 1).sum()), (-np.partition(-counts, 499)[:500] if len(counts) > 500 else counts).astype(np.int64)))
        return pa.Table.from_batches([_rows([("", parts["bucket"][0].as_py(), 0, pickle.dumps(out))])])

    placed = lines.select("page_no", "line_no", "words", "para_start").join(sizes.select("page_no", "block"), "page_no").withColumn("slab", (F.col("block") % slabs).cast("int"))
    dealt = placed.select("slab", "block", "words", "para_start", "line_no").repartition(slabs, "slab").sortWithinPartitions("slab", "block", "line_no")
    with storage.scope():
        parts = storage.written(dealt.drop("line_no").mapInArrow(measure, PARTS))
        merged = {r["what"]: pickle.loads(r["data"]) for r in parts.where("bucket < 0").groupBy("what", "bucket").applyInArrow(_merged, PARTS).collect()}
        types: dict[str, list[tuple]] = {}
        for r in parts.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(counted, PARTS).collect():
            for what, *found in pickle.loads(r["data"]):
                types.setdefault(what, []).append(tuple(found))
    found = _values(merged, types)
    return [found[str(run)] for run in runs]


def target(lines: DataFrame, options: TargetOptions = TargetOptions()) -> tuple[Target, list[list[float]]]:
    """A target of a corpus of any size, and the values of its resamples."""
    whole = values_by(lines.select(F.lit(-1).alias("run"), *LINE), "run").get(-1, [0.0] * len(NAMES))
    if options.method == "subsample":
        found = values_by(resampled(lines, options.resamples, options.seed, options.fraction), "run")
        drawn = [found[k] for k in sorted(found)]
    else:
        drawn = bootstrapped(lines, options.resamples, options.seed)
    return calibration.target_of(whole, drawn, options), drawn


def simulated(pages: DataFrame, family: str, points: list[dict], replicates: int, salt: str = "", resources: dict | None = None) -> DataFrame:
    """`pages` (page_no, layout) filled for each point and replicate, as lines (run, page_no, ...):
    run = point * replicates + seed. A page's stream is salted by its number and the parameters."""
    for point in points:
        generators.build(family, point, resources)
    salts = [f"{salt}{canonical.identity({'family': family, 'params': point})}" for point in points]
    table = pages.sparkSession.sparkContext.broadcast(resources)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills = [generators.filler(family, point, table.value) for point in points]
        for batch in batches:
            for some, sizes in generators.together(batch.column(0).to_pylist(), generators.listed(batch.column(1)), replicates):
                for point, fill in enumerate(fills):
                    streams = [(f"{salts[point]}/{page}".encode(), seed) for seed in range(replicates) for page in some]
                    number, words = generators.line_columns(*fill(streams, sizes * replicates), sizes * replicates)
                    lines = [len(x) for x in sizes] * replicates
                    run = np.repeat(np.array([point * replicates + seed for _, seed in streams], np.int32), lines)
                    yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(np.repeat(np.array(some * replicates, np.int64), lines)), number, words], ["run", "page_no", "line_no", "words"])

    made = generators.dealt(pages).mapInArrow(rows, "run int, page_no bigint, line_no int, words array<string>")
    # Pages of the documents corpus are single paragraphs.
    return made.withColumn("n_words", F.size("words")).withColumn("para_start", F.col("line_no") == 0)


def simulated_values(pages: DataFrame, family: str, points: list[dict], replicates: int, salt: str = "", resources: dict | None = None) -> dict[int, list[float]]:
    """The values of simulated()'s runs, measured in the tasks that make them."""
    for point in points:
        generators.build(family, point, resources)
    salts = [f"{salt}{canonical.identity({'family': family, 'params': point})}" for point in points]
    table = pages.sparkSession.sparkContext.broadcast(resources)
    tasks = 2 * pages.sparkSession.sparkContext.defaultParallelism

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills = [generators.filler(family, point, table.value) for point in points]
        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for some, sizes in generators.together(batch.column(0).to_pylist(), generators.listed(batch.column(1)), replicates):
                words = int(sum(x.sum() for x in sizes))
                lines = np.concatenate(sizes)
                starts = np.concatenate([np.arange(len(x)) == 0 for x in sizes])
                for point, fill in enumerate(fills):
                    letters, offsets = fill([(f"{salts[point]}/{page}".encode(), seed) for seed in range(replicates) for page in some], sizes * replicates)
                    for seed in range(replicates):
                        own = offsets[seed * words : (seed + 1) * words + 1]
                        text = pieces.Text.of(letters[own[0] : own[-1]], own - own[0], lines, starts)
                        yield _rows(list(_measured(str(point * replicates + seed), task << 32 | at, text, 2 * tasks)))
                at += 1

    dealt = pages.select("page_no", "layout").repartitionByRange(tasks, "page_no").sortWithinPartitions("page_no")
    return {int(k): v for k, v in values_of(dealt.mapInArrow(rows, PARTS)).items()}


def ledger(pages: DataFrame, grid: Grid, against: Target) -> list[dict]:
    """An entry for each point of the grid, by index: its replicates' values and distances."""
    grid.validated()
    found = simulated_values(pages, grid.family, grid.points(), grid.replicates, grid.experiment)
    entries = []
    for index, point in enumerate(grid.points()):
        values = [found.get(index * grid.replicates + k, [0.0] * len(NAMES)) for k in range(grid.replicates)]
        distances = [against.distance(v, grid.metric) for v in values]
        entries.append({
            "index": index, "params": point, "distances": distances, "fingerprints": values, "median": calibration.median(distances),
            "mean": sum(distances) / len(distances), "min": min(distances), "max": max(distances), "specimen_seed": min(range(len(distances)), key=lambda k: (distances[k], k)),
            "result_hash": canonical.result_hash([(k, v, d) for k, (v, d) in enumerate(zip(values, distances))]),
        })
    return entries


def best(entries: list[dict]) -> dict:
    return min(entries, key=lambda e: (e["median"], e["index"]))


def refined(pages: DataFrame, grid: Grid, against: Target, levels: int, shrink: float = 0.5, last_replicates: int | None = None, epsilon: float | None = None) -> dict:
    """A sweep, then finer ones around the best point of the last, until the levels are done or no
    axis can move."""
    if not 1 <= levels <= 16 or (epsilon is not None and last_replicates not in (None, grid.replicates)):
        raise calibration.Invalid("1 to 16 levels; a threshold holds for its own number of replicates only")
    refinement, found, reason = Refinement(grid.validated(), shrink), [], "level_budget_exhausted"
    for level in range(levels):
        if level + 1 == levels and last_replicates:
            grid.replicates = last_replicates
        entries = ledger(pages, grid, against)
        top = best(entries)
        found.append({
            "level": level, "grid_digest": canonical.identity(grid.document()), "points": len(entries), "replicates": grid.replicates, "best_index": top["index"], "best_params": top["params"],
            "best_median": top["median"], "compatible": [e["params"] for e in entries if epsilon is not None and e["median"] <= epsilon], "steps": refinement.steps(),
        })
        if level + 1 < levels:
            finer = refinement.next(grid, top["params"])
            if finer is None:
                reason = "no_axis_can_move"
                break
            grid = finer
    return {"levels": found, "stop_reason": reason, "simulations": sum(x["points"] * x["replicates"] for x in found)}


def run_units(spark: SparkSession, units: list[dict], against: Target, layout, resources: dict | None = None) -> DataFrame:
    """Work units over one declared layout, a row for each (unit, seed): (unit, seed, distance,
    fingerprint). The artifacts are bounded by the units' own limits and sent to the tasks once."""
    for unit in units:
        workunits.validate(unit, against, layout, resources)
    shared = spark.sparkContext.broadcast((units, against, layout, resources))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, against, layout, resources = shared.value
        for batch in batches:
            found = [workunits.seed_result(units[u], against, layout, s, resources) for u, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x["distance"] for x in found], pa.float64()), pa.array([x["fingerprint"] for x in found], pa.list_(pa.float64()))],
                ["unit", "seed", "distance", "fingerprint"],
            )

    work = [(k, s) for k, unit in enumerate(units) for s in range(unit["seed_start"], unit["seed_start"] + unit["seed_count"])]
    tasks = min(len(work), 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(work, "unit bigint, seed bigint").repartition(max(1, tasks)).mapInArrow(rows, "unit bigint, seed bigint, distance double, fingerprint array<double>")


def replicates(results: DataFrame) -> DataFrame:
    """Each unit's replicates: n, median, mean, least and most distance, and the nearest seed."""
    return results.groupBy("unit").agg(
        F.count("*").alias("n"), F.median("distance").alias("median"), F.avg("distance").alias("mean"), F.min("distance").alias("low"), F.max("distance").alias("high"),
        F.min_by("seed", F.struct("distance", "seed")).alias("specimen_seed"),
    )


def calibrated(pages: DataFrame, grid: Grid, hidden: dict, self_pool: list[float], against: Target, controls: tuple[str, ...] = ("gibberish", "slotgram"), level: float = 0.5) -> dict:
    """The report on a grid that should find a hidden point: rules A, B and C for every point, for
    the point nearest to the hidden one, and for control families."""
    pool = sorted(self_pool)
    epsilon, n = calibration.quantile(pool, 0.99), grid.replicates
    middle = calibration.subset_median_quantile(self_pool, n)

    def judged(entry: dict) -> dict:
        return {
            "index": entry.get("index"), "params": entry.get("params"), "rule_a": calibration.acceptance(entry["distances"], epsilon, level),
            "rule_b": calibration.centroid_test(entry["fingerprints"], against.mean, against.scale), "rule_c": {"median": entry["median"], "compatible": entry["median"] <= middle},
        }

    entries = ledger(pages, grid, against)
    found = [judged(e) for e in entries]
    others = {}
    for family in controls:
        found_ = simulated_values(pages, family, [{}], n, grid.experiment)
        distances = [against.distance(found_[k]) for k in sorted(found_)]
        others[family] = judged({"distances": distances, "fingerprints": [found_[k] for k in sorted(found_)], "median": calibration.median(distances)})
    near = grid.nearest(hidden)
    rank = None if near is None else 1 + sum((e["median"], e["index"]) < (entries[near]["median"], near) for e in entries)
    return {"epsilon": epsilon, "epsilon_median": middle, "points": found, "hidden_point": None if near is None else found[near], "hidden_rank": rank, "best_index": best(entries)["index"], "controls": others}


def conditional_ranks(pages: DataFrame, family: str, params: dict, options: TargetOptions, references: int = 2, targets: int = 19, seed: int = 1, most_words: int | None = None, most_lines: int | None = None) -> DataFrame:
    """`pages` (page_no, lines: array of lines) as (page_no, score, p): each page is an observation of
    its own, scored by the median distance of the references to a target built from it, and ranked
    among fresh corpora of the family that are scored the same way, their targets built anew.

    Pages without words have nulls, and those beyond declared bounds of lines and words, if there are any.
    """
    generators.build(family, params)
    salt = canonical.identity({"family": family, "params": params, "resamples": options.resamples, "references": references, "targets": targets})

    def ranked(page: int, lines: list[list[str]]) -> tuple:
        if not lines or (most_lines is not None and len(lines) > most_lines) or (most_words is not None and sum(map(len, lines)) > most_words):
            return page, None, None
        make, layout = generators.build(family, params), [len(ws) for ws in lines]
        built = lambda ws: Corpus.of(ws, {0}, {len(ws) - 1})
        rng = Stream(f"conditional/reference/{salt}/{page}".encode(), seed)
        known = [built(make(rng, layout)).values() for _ in range(references)]
        score = lambda c: calibration.median([t.distance(v) for t in [calibration.conditional_target(c, options)] for v in known])
        rng = Stream(f"conditional/targets/{salt}/{page}".encode(), seed)
        own = score(built(lines))
        return page, own, calibration.upper_rank(own, [score(built(make(rng, layout))) for _ in range(targets)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [ranked(p, ws) for p, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.float64()))], ["page_no", "score", "p"])

    work = pages.select("page_no", "lines").repartition(8 * pages.sparkSession.sparkContext.defaultParallelism, "page_no")
    return work.mapInArrow(rows, "page_no bigint, score double, p double")


# Registered queries ----------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(spark, sf_dir).select(*LINE)


def bootstrap_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(statistic, mean, scale) of the whole corpus."""
    found, _ = target(_corpus(spark, sf_dir))
    return spark.createDataFrame(list(zip(NAMES, found.mean, found.scale)), "statistic string, mean double, scale double")


def _swept(spark: SparkSession, sf_dir: str) -> list[dict]:
    lines = _corpus(spark, sf_dir)
    against, _ = target(lines)
    return ledger(generators.layouts(lines), GRID, against)


def sweep_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point, params, seed, distance): a simulation of the whole corpus for each."""
    rows = [(e["index"], canonical.dumps(e["params"]), k, d) for e in _swept(spark, sf_dir) for k, d in enumerate(e["distances"])]
    return spark.createDataFrame(rows, "point bigint, params string, seed bigint, distance double")


def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e["index"], e["median"], e["mean"], e["min"], e["max"], e["specimen_seed"]) for e in _swept(spark, sf_dir)]
    return spark.createDataFrame(rows, "point bigint, median double, mean double, low double, high double, best_seed bigint")


def refine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _corpus(spark, sf_dir)
    against, _ = target(lines)
    grid = Grid(GRID.experiment, GRID.family, GRID.axes, replicates=1, integers=GRID.integers)
    report = refined(generators.layouts(lines), grid, against, 2)
    rows = [(x["level"], x["points"], canonical.dumps(x["best_params"]), x["best_median"]) for x in report["levels"]]
    return spark.createDataFrame(rows, "level int, points int, best_params string, best_median double")


def self_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the distances of the corpus's own resamples, drawn apart from the target's."""
    lines, options = _corpus(spark, sf_dir), TargetOptions()
    found, _ = target(lines, options)
    spread = calibration.spread([found.distance(v) for v in bootstrapped(lines, options.resamples, options.seed + 1)])
    return spark.createDataFrame([(k, float(v)) for k, v in spread.items()], "quantile string, distance double")


def calibrate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point, rule, compatible or p): the grid's points, then the controls, judged by the three rules."""
    lines = _corpus(spark, sf_dir)
    against, drawn = target(lines)
    grid = Grid(GRID.experiment, GRID.family, GRID.axes, replicates=JUDGED, integers=GRID.integers)
    report = calibrated(generators.layouts(lines), grid, {"p_modify": 0.85, "max_len": 8}, [against.distance(v) for v in drawn], against)
    rows = []
    for name, x in [*((f"point {x['index']}", x) for x in report["points"]), *report["controls"].items()]:
        rows += [(name, "a", float(x["rule_a"]["lower"]), x["rule_a"]["compatible"]), (name, "b", float(x["rule_b"]["p_value"]), None), (name, "c", float(x["rule_c"]["median"]), x["rule_c"]["compatible"])]
    return spark.createDataFrame(rows, "what string, rule string, value double, compatible boolean")


def compare_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, distance) to the corpus's own target: the whole, each stratum, and each family."""
    lines = corpus.lines(spark, sf_dir)
    against, _ = target(lines.select(*LINE))
    pages = generators.layouts(lines)
    parts = [lines.select(F.lit("corpus").alias("what"), *LINE), lines.select(F.concat(F.lit("stratum "), "stratum").alias("what"), *LINE)]
    values = {}
    for family in ("gibberish", "charmarkov", "selfcite", "slotgram"):
        resources = {"glyph_model": generators.glyph_table(generators.glyph_model(lines), 3)} if family == "charmarkov" else None
        values[f"family {family}"] = simulated_values(pages, family, [{}], 1, "compare", resources).get(0, [0.0] * len(NAMES))
    bag = generators.drawn_pages(pages, 1, storage.cut(generators.word_bag(corpus.tokens(spark, sf_dir))), "compare")
    bag = bag.withColumn("para_start", F.col("line_no") == 0)
    for part in (*parts, bag.select(F.lit("family bagofwords").alias("what"), "page_no", "line_no", "words", "para_start")):
        values |= values_by(part, "what")
    rows = [(what, against.distance(v)) for what, v in sorted(values.items())]
    return spark.createDataFrame(rows, "what string, distance double")


def conditional_rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_no, score, p) of every page under the default citing family."""
    lines = corpus.lines(spark, sf_dir)
    pages = lines.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "words"))).alias("x")).select("page_no", F.transform("x", lambda x: x["words"]).alias("lines"))
    return conditional_ranks(pages, "gibberish", {"len_n": 8}, TargetOptions(2, 91))


QUERIES = {f.__name__: f for f in (bootstrap_scale, sweep_ledger, sweep_summary, refine_levels, self_distance, calibrate_report, compare_targets, conditional_rank_test)}


def write_ledger(spark: SparkSession, path: str, header: dict, entries: list[dict]) -> None:
    """A ledger as JSON lines, header first, at a path that Spark can write."""
    rows = [(k, line) for k, line in enumerate(workunits.ledger_lines(header, entries))]
    spark.createDataFrame(rows, "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def read_ledger(spark: SparkSession, path: str) -> tuple[dict, list[dict]]:
    lines = [r["value"] for r in spark.read.text(path).collect()]
    header = [x for x in lines if "ledger" in json.loads(x)]
    return workunits.read_ledger(header + [x for x in lines if x not in header])
