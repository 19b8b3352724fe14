import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string"


def rows(*texts):
    return [(k, t, "en", None if k == 3 else f"s{k % 3}", len(t or ""), "x", "y") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, ties, repeated lines, non-ASCII and a long text."""
    line = "The quick brown fox jumps over the lazy dog near the old river bank today."
    long = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))
    return [None, "", "  \n\t ", "one", line, line, line + "\n" + line, "é ß ü 日本語  two  spaces ", "\n".join([line] * 9), long, long + " end.", "AKIA" + "A" * 16 + " token=abcdefabcdef0123"]


@pytest.fixture
def table(spark, tmp_path):
    """Writes texts as a `documents` table with extra columns, some of clashing names; gives sf_dir."""

    def write(texts, twice=()):
        data = rows(*texts)
        data += [data[k] for k in twice]
        df = spark.createDataFrame(data, SCHEMA)
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write
