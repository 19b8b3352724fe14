"""The ledger's rules on a stream of events: rate limits, submissions, credit.

Events are applied as they arrive. Nothing is dropped for being late: a late result still counts, so
there is no watermark, and what must outlive a batch is kept by key (rate limits), in a table of first results
(submissions) or in the credit table itself (credit).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom import storage
from corpusloom.sources import ledger

#: A key may make so many requests in a window of so many seconds; a lease holds for so many.
MOST, SECONDS, LEASE = 3, 86_400, 600


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: id, guest_id, unit_id, moment (seconds), result, amount."""
    path = f"{sf_dir}/events.parquet"
    # A stream reads folders; a single file is named by a pattern.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.parquet", "events.parque[t]"))
    unit = F.get_json_object("props", "$.k").cast("bigint").alias("unit_id")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("guest_id"), unit, F.unix_timestamp("ts").alias("moment"), F.col("event_type").alias("result"), F.col("value").alias("amount"))


def drained(stream: DataFrame | Batched) -> DataFrame:
    """All that the stream gives for what is there now, from files in the shared folder."""
    spark = (stream.stream if isinstance(stream, Batched) else stream).sparkSession
    folder = f"{storage.shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if isinstance(stream, Batched):
        return batched(stream, folder)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def rate_limited(events: DataFrame, most: int = MOST, seconds: int = SECONDS) -> DataFrame:
    """`events` (id, guest_id, moment) as (id, guest_id, n, limited): the request's number in its
    window, which starts anew with the first request that is `seconds` behind the last start."""

    def count(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["moment", "id"])
        out = []
        for id_, moment in zip(rows["id"], rows["moment"]):
            start, n = (int(moment), 1) if start is None or start <= moment - seconds else (start, n + 1)
            out.append((id_, key[0], n, n > most))
        state.update((start, n))
        yield pd.DataFrame(out, columns=["id", "guest_id", "n", "limited"])

    narrow = events.select("id", "guest_id", "moment")
    return narrow.groupBy("guest_id").applyInPandasWithState(count, "id bigint, guest_id bigint, n bigint, limited boolean", "start bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class Batched:
    """A stream and what becomes of each of its batches, for drained(): judge(batch, state, before)
    gives the batch's rows and what is kept of it, from what was kept of the batches before."""

    stream: DataFrame
    judge: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]
    schema: str
    kept: str


def batched(work: Batched, folder: str) -> DataFrame:
    """The rows of all batches. A batch's rows and what is kept of it are folders of their own, which a
    batch that is run again writes anew, so nothing counts twice."""
    spark = work.stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        # Batches are numbered from 0 and each is written before the next begins.
        kept = spark.read.schema(work.kept).parquet(*[f"{folder}/kept/{k}" for k in range(number)]) if number else None
        batch = batch.persist(StorageLevel.DISK_ONLY)
        rows, new = work.judge(batch, kept)
        new.write.mode("overwrite").parquet(f"{folder}/kept/{number}")
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        batch.unpersist()
        made.add(number)

    made: set[int] = set()
    work.stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(work.schema).parquet(*[f"{folder}/rows/{k}" for k in sorted(made)]) if made else spark.createDataFrame([], work.schema)


def submitted(events: DataFrame, lease: int = LEASE) -> Batched:
    """`events` (id, unit_id, guest_id, moment, result) as (id, verdict, late): a guest's first result
    for a unit is received, the same again is a duplicate, another one a conflict. A result behind
    the end of its lease is late, and judged like any other.

    Units and guests make about as many keys as there are events, so a batch is judged by windows, and
    the first results of earlier batches are a table, of which a batch reads its own keys' rows.
    """

    def judge(batch: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        key = ["unit_id", "guest_id"]
        order = Window.partitionBy(*key).orderBy(F.asc_nulls_last("moment"), F.asc_nulls_last("id"))
        first = lambda name: F.first(name).over(order.rowsBetween(Window.unboundedPreceding, 0))
        found = batch.select("id", *key, "moment", "result").withColumn("k", F.row_number().over(order)).withColumn("leased", first("moment")).withColumn("first", first("result"))
        known = F.lit(False)
        if kept is not None:
            kept = kept.select(F.col("unit_id").alias("u"), F.col("guest_id").alias("g"), F.col("leased").alias("_leased"), F.col("first").alias("_first"), F.lit(True).alias("_known"))
            found = found.join(kept, F.col("unit_id").eqNullSafe(F.col("u")) & F.col("guest_id").eqNullSafe(F.col("g")), "left")
            known = F.col("_known").isNotNull()
            found = found.withColumn("leased", F.when(known, F.col("_leased")).otherwise(F.col("leased"))).withColumn("first", F.when(known, F.col("_first")).otherwise(F.col("first")))
        received = (F.col("k") == 1) & ~known
        verdict = F.when(received, "received").when(F.col("result") == F.col("first"), "duplicate").otherwise("conflict")
        return found.select("id", verdict.alias("verdict"), (F.col("moment") > F.col("leased") + lease).alias("late")), found.where(received).select(*key, "leased", "first")

    return Batched(events, judge, "id bigint, verdict string, late boolean", "unit_id bigint, guest_id bigint, leased bigint, first string")


def credited(events: DataFrame, trusted: DataFrame, table: str) -> None:
    """Adds credit to a table: once for each unit and guest, for a result equal to the unit's trusted
    one. A batch that is run again replaces its own rows, and finds earlier ones in the table, so
    nothing is given twice and no state grows."""
    spark = events.sparkSession
    schema = "unit_id bigint, guest_id bigint, id bigint, amount double, batch bigint"

    def merge(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        given = (spark.read.schema(schema).parquet(table) if there else spark.createDataFrame([], schema)).where(F.col("batch") != number).select("unit_id", "guest_id")
        right = batch.join(trusted, "unit_id").where("result = trusted")
        first = right.groupBy("unit_id", "guest_id").agg(F.min_by(F.struct("id", "amount"), F.struct("moment", "id")).alias("x")).select("unit_id", "guest_id", "x.*")
        new = first.join(given, ["unit_id", "guest_id"], "left_anti").withColumn("batch", F.lit(number).cast("bigint"))
        new.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(table)

    query = events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{table}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(rate_limited(source(spark, sf_dir)))


def stream_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(submitted(source(spark, sf_dir)))


def stream_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, guest_id, id, amount): a unit's trusted result is that of its first event."""
    known = ledger.attempts(spark, sf_dir).groupBy("unit_id").agg(F.min_by("state", "id").alias("trusted"))
    table = f"{storage.shared_folder(spark).rstrip('/')}/credit-{uuid.uuid4().hex}"
    credited(source(spark, sf_dir), storage.cut(known), table)
    return spark.read.schema("unit_id bigint, guest_id bigint, id bigint, amount double, batch bigint").parquet(table).drop("batch")


QUERIES = {f.__name__: f for f in (stream_rate_limit, stream_submissions, stream_credit)}

_EVENTS = "e AS (SELECT event_id AS id, user_id AS guest_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS unit_id, CAST(floor(epoch(ts)) AS BIGINT) AS moment, event_type AS result, value AS amount FROM events)"
ORACLE_SQL = {
    "stream_rate_limit": f"""WITH RECURSIVE {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY guest_id ORDER BY moment, id) AS k FROM e),
        r AS (SELECT id, guest_id, k, moment AS start, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1 UNION ALL
          SELECT o.id, o.guest_id, o.k, CASE WHEN r.start <= o.moment - {SECONDS} THEN o.moment ELSE r.start END, CASE WHEN r.start <= o.moment - {SECONDS} THEN 1 ELSE r.n + 1 END FROM r JOIN o ON o.guest_id = r.guest_id AND o.k = r.k + 1)
        SELECT id, guest_id, n, n > {MOST} AS limited FROM r""",
    "stream_submissions": f"""WITH {_EVENTS}, f AS (SELECT *, first_value(result) OVER w AS first, first_value(moment) OVER w AS leased, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY unit_id, guest_id ORDER BY moment, id))
        SELECT id, CASE WHEN k = 1 THEN 'received' WHEN result = first THEN 'duplicate' ELSE 'conflict' END AS verdict, moment > leased + {LEASE} AS late FROM f""",
    "stream_credit": f"""WITH {_EVENTS} SELECT unit_id, guest_id, id, amount FROM e WHERE result = (SELECT t.result FROM e t WHERE t.unit_id = e.unit_id ORDER BY t.id LIMIT 1)
        QUALIFY row_number() OVER (PARTITION BY unit_id, guest_id ORDER BY moment, id) = 1""",
}
