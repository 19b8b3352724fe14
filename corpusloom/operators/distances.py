"""Distances of vectors to a registered target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import corpus


def z_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of each label's mean vector in units of the target's mean and scale, where
    the target is the vectors of label 0. The target has a row for each dimension."""
    long = corpus.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    target = long.where("label = 0").groupBy("i").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("scale"))
    means = long.groupBy("label", "i").agg(F.avg("x").alias("x"))
    z = (F.col("x") - F.col("mean")) / F.col("scale")
    return means.join(target, "i").groupBy("label").agg(F.round(F.sqrt(F.avg(z * z)), 5).alias("distance"))


SQL = """WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
t AS (SELECT i, avg(x) AS mean, greatest(stddev_pop(x), 1e-6) AS scale FROM e WHERE label = 0 GROUP BY i), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i)
SELECT label, round(sqrt(avg(((x - mean) / scale) ** 2)), 5) AS distance FROM m JOIN t USING (i) GROUP BY label"""
