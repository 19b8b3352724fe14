"""Mixing sources to target weights by a low-discrepancy schedule [native].

1. Every source's documents are shuffled by a seed and laid end to end; the line is cut into
   blocks of equal size, in words.
2. Slot i of the schedule has the golden-ratio point frac(i * phi). The points are mapped through
   the sources' cumulative shares of slots, so every prefix of the schedule is mixed alike.
3. The slots of a source are ranked, and slot r takes the source's block r mod n_blocks. Reading
   the schedule in order gives the mixture; a source whose target exceeds its size is repeated,
   at most `max_repeats` times.

A document gets the words of its part of each block, times how often the block was taken.
Ranks and line positions are two-level running sums: no task holds a source. The slot count is
`slots` plus a bounded number for each source, whatever the input's size.

Targets: the sources share the sum of all sizes by weight; a target stops at `max_repeats` times
its source's size, and the excess is shared anew by weight among the others until none is above.

Defined results: null texts have size 0; a null source is a source, ordered last; blank sources
(size 0) have target 0; repeated rows and ids are rows like any other, and rows alike in doc_id,
source and size may swap their places; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: frac(i * phi) as i * PHI mod 2^32, in exact integers: PHI is the odd number next to 2^32 / phi.
PHI, POINTS = 2654435769, 1 << 32


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """`sizes` (source, source_size) with `target` (double). One row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "_w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size").cast("double") * max_repeats)
    # Sources reach their caps in the order of cap / weight. With the first k capped, a unit of weight
    # gets the rest of all words over the rest of all weights; the others take that many times theirs.
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_weight"))
        .withColumn("_stops", F.col("_cap") <= F.col("_level") * F.col("_w"))
    )
    # The first source that doesn't stop sets the level of all from there on.
    level = F.min(F.when(~F.col("_stops"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("_level").alias("level")))).over(all_rows)
    return filled.withColumn("_set", level["level"]).select(
        *sizes.columns, F.when(F.col("_stops") | F.col("_set").isNull(), F.col("_cap")).otherwise(F.least(F.col("_set") * F.col("_w"), F.col("_cap"))).alias("target")
    )


def plan(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = 3, slots: int = 1 << 18, least_blocks: int = 256) -> DataFrame:
    """For each source its target, number of blocks, and share [lo, hi) of the schedule's points."""
    everything = Window.partitionBy(F.lit(0))
    t = targets(sizes, weights, max_repeats).withColumn("_block", F.greatest(F.lit(1.0), F.sum("source_size").over(everything) / F.lit(float(slots))))
    blocks = F.greatest(F.round(F.col("source_size") / F.col("_block")), F.least(F.lit(float(least_blocks)), F.col("source_size")), F.lit(1.0)).cast("long")
    wanted = F.col("target") * F.col("n_blocks") / F.greatest(F.col("source_size"), F.lit(1))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("n_blocks", blocks).withColumn("_want", wanted).withColumn("_sum", F.sum("_want").over(everything))
    edge = F.round(F.sum("_want").over(order) / F.col("_sum") * POINTS).cast("long")
    return (
        t.withColumn("hi", F.coalesce(edge, F.lit(0).cast("long")))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0).cast("long")))
        .withColumn("n_slots", F.round("_sum").cast("long"))
        .drop("_block", "_want", "_sum")
    )


def schedule(spark: SparkSession, planned: DataFrame, max_repeats: int = 3) -> DataFrame:
    """How often the schedule takes each block: (_source_no, block, times)."""
    most = planned.agg(F.coalesce(F.max("n_slots"), F.lit(0)).alias("n")).first()["n"]
    slots = spark.range(most).withColumn("_point", F.expr(f"(id * {PHI}) & {POINTS - 1}"))
    # A point finds its source through its leading bits: each source lists the 4096ths it touches.
    cells = planned.where("hi > lo").select("_source_no", "n_blocks", "lo", "hi", F.explode(F.expr(f"sequence(lo * 4096 div {POINTS}, (hi - 1) * 4096 div {POINTS})")).alias("_cell"))
    placed = (
        slots.withColumn("_cell", F.expr(f"_point * 4096 div {POINTS}"))
        .join(cells, "_cell")
        .where("_point >= lo AND _point < hi")
        .select("_source_no", "n_blocks", "id")
        .withColumn("_run", F.expr(f"id * {common.buckets(most)} div {max(most, 1)}"))
    )
    ranked = common.running(placed, ["_source_no"], "_run", [F.col("id")], F.lit(1).cast("long"), "rank", "_n")
    # Rounding may give a source a few slots beyond its last allowed pass; those stay empty.
    return (
        ranked.where(F.col("rank") < max_repeats * F.col("n_blocks"))
        .groupBy("_source_no", F.expr("rank % n_blocks").alias("block"))
        .agg(F.count("*").alias("times"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = 3, slots: int = 1 << 18, seed: int = 10) -> DataFrame:
    """`docs` (doc_id, source, size, and narrow further columns) with source_size, target and taken.

    `docs` is read several times: pass columns that are cheap to keep, not texts.
    """
    spark = docs.sparkSession
    docs = common.cut(docs)
    n_buckets = common.buckets(docs.count())
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("_source_no")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = common.cut(plan(sizes, weights, max_repeats, slots).select("*", number))
    taken = _blocks(planned, schedule(spark, planned, max_repeats))

    facts = planned.select(F.col("source").alias("_s"), "_source_no", "source_size", "target", "n_blocks")
    facts = F.broadcast(facts) if planned.count() <= FEW else facts
    at_source = F.col("source").eqNullSafe(F.col("_s"))
    blank = docs.where("size = 0").join(facts, at_source).withColumn("taken", F.lit(0).cast("long"))

    keyed = docs.where("size > 0").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    keyed = keyed.withColumn("_bucket", F.pmod("_key", F.lit(n_buckets)))
    line = common.running(keyed, ["source"], "_bucket", [F.col("_key"), F.col("doc_id")], F.col("size"), "_start", "_line")
    line = line.join(facts, at_source).withColumn("_end", F.col("_start") + F.col("size"))
    line = line.withColumn("_first", _block_at("_start")).withColumn("_last", _block_at("_end - 1"))
    for side in ("_first", "_last"):
        line = line.join(
            taken.select("_source_no", F.col("block").alias(side), *[F.col(c).alias(c + side) for c in ("_times", "_upto", "_from")]), ["_source_no", side]
        )
    upto = lambda at, side: F.col(f"_upto{side}") + F.col(f"_times{side}") * (F.col(at) - F.col(f"_from{side}"))
    line = line.withColumn("taken", upto("_end", "_last") - upto("_start", "_first"))
    names = [*docs.columns, "source_size", "target", "taken"]
    return line.select(names).unionByName(blank.select(names))


#: Sources up to which their facts are broadcast; more are joined by a shuffle.
FEW = 10_000


def _block_at(word: str):
    """The block that holds a word of the source's line: block b starts at b * source_size div n_blocks."""
    return F.expr(f"(cast({word} + 1 AS decimal(19, 0)) * cast(n_blocks AS decimal(18, 0)) - 1) div cast(source_size AS decimal(19, 0))").cast("long")


def _blocks(planned: DataFrame, times: DataFrame) -> DataFrame:
    """Every block: its first word, how often it is taken, and the words taken before it."""
    start = lambda b: f"cast(cast({b} AS decimal(18, 0)) * cast(source_size AS decimal(19, 0)) div n_blocks AS bigint)"
    blocks = (
        planned.where("source_size > 0")
        .select("_source_no", "n_blocks", "source_size", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
        .join(times, ["_source_no", "block"], "left")
        .select(
            "_source_no", "block", F.coalesce("times", F.lit(0)).alias("_times"), F.expr(start("block")).alias("_from"),
            F.expr(f"{start('block + 1')} - {start('block')}").alias("_words"), F.expr("block div 1024").alias("_bucket"),
        )
    )
    blocks = common.cut(blocks)
    return common.running(blocks, ["_source_no"], "_bucket", [F.col("block")], F.col("_words") * F.col("_times"), "_upto", "_all").drop("_all", "_bucket", "_words")


def copies(docs: DataFrame, seed: int = 10, **settings) -> DataFrame:
    """The mixed documents: each document as often as the mix takes it, rounded to whole copies.

    Rows alike in doc_id, source and text get the same number of copies.
    """
    # Rows travel as one value, so that their columns may have any names.
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("content"), common.n_words(F.col("text")).alias("size"), F.struct("*").alias("row"))
    same = ["doc_id", "source", "content"]
    mixed = mix(rows.drop("row"), seed=seed, **settings).groupBy(*same, "size").agg(F.avg("taken").alias("taken"))
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    mixed = mixed.select(*[F.col(c).alias(f"m_{c}") for c in same], times.alias("times")).where("times > 0")
    taken = rows.drop("size").join(mixed, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in same])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
