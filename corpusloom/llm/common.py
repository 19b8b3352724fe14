"""Shared pieces: reading tables, cutting lineage, two-level running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.storage import cut, dropped, scope, written  # noqa: F401  used by the operators

#: Splits a text into words: space and the ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(rows: int, each: int = 20_000) -> int:
    """How many buckets of about `each` rows: for running()."""
    return max(1, -(-rows // each))


#: A key with over this share of a side's rows is hot; so there are fewer than 4096 hot keys.
HOT_SHARE = 1 / 4096
SALTS = 64


def joined_spread(left: DataFrame, right: DataFrame, on: str, rows: str, deal: Column, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has a row for each value of `on` and in `rows` (dropped) how
    many rows it has on the left. Keys with over HOT_SHARE of all are dealt over SALTS tasks.

    The hot keys are fewer than 1 / HOT_SHARE, so they are broadcast. `right` is read three times.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = F.col(rows) > max(1000, int(total * HOT_SHARE))
    marked = right.where(hot).select(F.col(on).alias("_hot_key"))
    left = left.join(F.broadcast(marked), left[on].eqNullSafe(F.col("_hot_key")), "left")
    left = left.withColumn("_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(deal, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot_key")
    right = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(rows)
    return left.join(right, [on, "_salt"], how).drop("_salt")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without keeping them."""
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, SPACES))
    edge = lambda at: F.when(at.isin(" ", "\t", "\n", "\x0b", "\x0c", "\r"), 1).otherwise(0)
    return F.when(F.length(text) == 0, 0).otherwise(
        F.greatest(F.lit(0), pieces - edge(F.substring(text, 1, 1)) - edge(F.right(text, F.lit(1))))
    ).cast("long")


def running(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], weight: Column, before: str, total: str
) -> DataFrame:
    """Adds the sum of `weight` before each row of its group, and the group's sum.

    Rows are ordered by `bucket`, then by `order`. No task holds a group: a window orders the
    rows of one (group, bucket), and a second one runs over the buckets' sums, one row for each
    (group, bucket). Choose buckets so that one bucket's rows fit a task. Null groups are groups.
    """
    inside = Window.partitionBy(*group, bucket)
    rows = df.withColumn("_w", weight).withColumn(
        "_inside", F.sum("_w").over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    )
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = (
        df.groupBy(*group, bucket)
        .agg(F.sum(weight).alias("_sum"))
        .select(
            *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
            F.col(bucket).alias("_b"),
            (F.sum("_sum").over(across.orderBy(bucket)) - F.col("_sum")).alias("_ahead"),
            F.sum("_sum").over(across).alias(total),
        )
    )
    on = F.col(bucket).eqNullSafe(F.col("_b"))
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        rows.join(sums, on)
        .withColumn(before, F.col("_ahead") + F.col("_inside"))
        .drop("_w", "_inside", "_ahead", "_b", *[f"_g{i}" for i in range(len(group))])
    )


def slices(batch, column: int, most: int = 2 << 20):
    """The rows of an Arrow batch, in slices of about `most` bytes of a text column: what Python
    makes of a text is many times its size. A longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Recent(dict):
    """A cache of two generations: when `room` entries are new, those used since the last turn
    stay, and older ones go. Callers fill what `lacking` names, then look up."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.older = room, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def lacking(self, keys: set) -> list:
        if len(self) > self.room:
            self.older = dict(self)
            self.clear()
        return [k for k in keys if k not in self and k not in self.older]
