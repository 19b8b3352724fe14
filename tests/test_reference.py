"""The registered queries against DuckDB, and the fingerprint's fixed examples."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corpusloom.operators import statistics
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    def one(x):
        if pd.isna(x):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (float, int)) or hasattr(x, "dtype") else x
    return sorted((tuple(map(one, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    expected = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def documents(spark, tmp_path, *lines):
    spark.createDataFrame([(0, "\n".join(lines), "x", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return statistics.fingerprint(spark, str(tmp_path)).first()


def test_periodic(spark, tmp_path):
    row = documents(spark, tmp_path, "ab ab ab")
    assert (row["h0"], row["h1"], row["h2"], row["h2_word"]) == (1, 1.584963, 0, 0)
    assert (row["wlen_mean"], row["wlen_2"], row["adjacent_same"], row["hapax_frac"], row["line_len_mean"]) == (2, 1, 1, 0, 3)


def test_similar(spark, tmp_path):
    row = documents(spark, tmp_path, "daiin dain chol", "chol chor qokedy daiin")
    assert row["adjacent_same"] == round(1 / 6, 6) and row["adjacent_edit1"] == round(2 / 6, 6)
    assert row["line_edit1"] == round(4 / 7, 6) and row["recent_repeat_10"] == round(2 / 7, 6) and row["hapax_frac"] == 0.6
