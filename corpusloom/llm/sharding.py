"""Sharding by proportional stratified interleaving (law: `rows`).

Rows are shuffled by a seed within each source and ranked; a row of rank r among n has the
fractional rank (r + 0.5) / n. In the order of fractional ranks every stretch holds each source
in its overall share, so cutting that order into equal pieces gives shards which all match the
mixture, with row counts at most one apart.

Only ids, sizes and checksums are shuffled, never texts. Ranks come from two-level running sums,
so neither a hot source nor the global order meets in one task.

Defined results: a null text has size 1 and the checksum of the empty string; null sources are a
source of their own; repeated rows and ids are rows like any other; other columns are ignored;
an empty table gives no rows. Rows equal in every ranked column are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

def interleave(docs: DataFrame, shards: int = 16, seed: int = 8) -> DataFrame:
    """`docs` (doc_id, source, further columns) with `shard` (int) and `slot` (long)."""
    n_buckets = common.buckets(docs.count())
    dealt = docs.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", *_rest(docs)))
    dealt = dealt.withColumn("_bucket", F.pmod("_key", F.lit(n_buckets)))
    order = [F.col("_key"), F.col("doc_id")]
    ranked = common.running(dealt, ["source"], "_bucket", order, F.lit(1).cast("long"), "_rank", "_n")
    ranked = ranked.withColumn("_at", (F.col("_rank") + F.lit(0.5)) / F.col("_n"))
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_at") * n_buckets))
    order = [F.col("_at"), F.xxhash64(F.lit(seed), "source"), F.col("source"), F.col("_key"), F.col("doc_id")]
    placed = common.running(ranked, [], "_bucket", order, F.lit(1).cast("long"), "_place", "_all")
    first = F.expr(f"(_shard * _all) div {shards}")
    return (
        placed.withColumn("_shard", F.expr(f"(_place * {shards} + {shards - 1}) div _all"))
        .withColumn("slot", F.col("_place") - first)
        .withColumn("shard", F.col("_shard").cast("int"))
        .drop("_key", "_bucket", "_rank", "_n", "_at", "_place", "_all", "_shard")
    )


def _rest(docs: DataFrame) -> list[str]:
    return [c for c in ("size", "text_crc32") if c in docs.columns]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
