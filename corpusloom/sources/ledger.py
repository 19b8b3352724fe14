"""Work-ledger relations derived from the star-schema tables, for the coordinator's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import table


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, guest_id, unit_id, moment (seconds), state, amount."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("guest_id"), F.get_json_object("props", "$.k").cast("bigint").alias("unit_id"),
        F.unix_timestamp("ts").alias("moment"), F.col("event_type").alias("state"), F.col("value").alias("amount"),
    )


def guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, team, blocked."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("team"), (F.col("c_acctbal") < 0).alias("blocked"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, guest_id, state, credit, created_at (seconds)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("guest_id"), F.col("o_orderstatus").alias("state"),
        F.col("o_totalprice").alias("credit"), F.unix_timestamp("o_orderdate").alias("created_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case, start (the order's lines in a fixed order), score, control, algorithm."""
    return spark.sql(
        """SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS start,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS score, l_linestatus AS control, l_returnflag AS algorithm, l_quantity AS elapsed FROM {lineitem}""",
        lineitem=table(spark, sf_dir, "lineitem"),
    )


#: The same relations in DuckDB.
SQL = """
attempts AS (SELECT event_id AS id, user_id AS guest_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS unit_id,
         CAST(floor(epoch(ts)) AS BIGINT) AS moment, event_type AS state, value AS amount FROM events),
guests AS (SELECT c_custkey AS id, c_nationkey AS team, c_acctbal < 0 AS blocked FROM customer),
units AS (SELECT o_orderkey AS id, o_custkey AS guest_id, o_orderstatus AS state, o_totalprice AS credit, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at FROM orders),
runs AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS start,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS score, l_linestatus AS control, l_returnflag AS algorithm, l_quantity AS elapsed FROM lineitem)"""
