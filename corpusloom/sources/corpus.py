"""Corpus relations over the `documents` table: pages, lines and tokens.

A document is a page, its source a quire and its language a stratum; a line is a line with words;
a word is a run of a-z in the lower-cased line. All is projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores if its files make fewer tasks than there are: a table of one file is
    read by one task, however much work its rows are. A large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def line_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z]+"), lambda w: w != "")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_no, quire, stratum of every page; a page without a language is of the stratum ''."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_no"), F.col("source").alias("quire"), F.coalesce("lang", F.lit("")).alias("stratum"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_no, quire, stratum, line_no, words, n_words, para_start, para_end."""
    found = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_words), lambda ws: F.size(ws) > 0)
    pages = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select(F.col("doc_id").alias("page_no"), F.col("source").alias("quire"), F.coalesce("lang", F.lit("")).alias("stratum"), found.alias("_lines"))
    return pages.select("page_no", "quire", "stratum", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("line_no", "words")).select(
        "page_no", "quire", "stratum", "line_no", "words", F.size("words").alias("n_words"),
        (F.col("line_no") == 0).alias("para_start"), (F.col("line_no") == F.col("_n") - 1).alias("para_end"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_no, quire, stratum, line_no, n_words, para_start, para_end, i, w."""
    return lines(spark, sf_dir).select("page_no", "quire", "stratum", "line_no", "n_words", "para_start", "para_end", F.posexplode("words").alias("i", "w"))


#: The same relations in DuckDB.
SQL = """
_l AS (SELECT doc_id AS page_no, source AS quire, coalesce(lang, '') AS stratum,
         list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
           lambda x: list_filter(regexp_split_to_array(lower(x), '[^a-z]+'), lambda w: w <> '')), lambda z: len(z) > 0) AS ls FROM documents),
_i AS (SELECT *, unnest(range(len(ls))) AS line_no FROM _l),
lines AS (SELECT page_no, quire, stratum, line_no, ls[line_no + 1] AS words, len(ls[line_no + 1]) AS n_words,
         line_no = 0 AS para_start, line_no = len(ls) - 1 AS para_end FROM _i),
_t AS (SELECT *, unnest(range(n_words)) AS i FROM lines),
tokens AS (SELECT page_no, quire, stratum, line_no, n_words, para_start, para_end, i, words[i + 1] AS w FROM _t)"""
