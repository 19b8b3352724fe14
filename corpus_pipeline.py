"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing and packing.

Every stage takes (spark, docs, sf_dir) and returns the documents that the next one reads; all but
the last return the columns of `documents`. What a stage decides takes effect on its rows.

Defined results, for every stage unless it says otherwise: null texts are texts without a word, null
ids, sources and languages are values like any other; repeated ids and rows are rows of their own;
texts are taken whole at any length; further columns are kept, whatever their names; an empty table
gives no rows. Columns that hold a text's length (n_chars) follow the text.

* quality rules: texts without words are rejected; equal texts get equal verdicts.
* near-duplicates: of a group, the row with the least id stays, null ids last, then the least content
  address; of rows alike in both, one. Rows that share an id but not a group all stay.
* personal data: null texts stay null; of overlapping spans the first, then the longer one counts.
* mixing: a row may come several times, or not at all; texts without words don't come.
* packing: a null or empty text is its end id alone; a row that comes twice has a place for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, minhash, mixing, packing, pii, quality


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with n_chars set to the length of the text, if they have it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, without the lines that fail."""
    return _measured(quality.clean(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id."""
    return minhash.firsts(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a placeholder for each span of personal data; n_chars follows the text."""
    return _measured(pii.masked(docs), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them."""
    return mixing.copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences. Copies of a document have their own places."""
    return packing.pack(common.cut(packing.pieces(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Stages run tokenizers and connected components, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, last = common.written(stage(spark, docs, sf_dir)), before
        before = docs
        if last is not None:
            common.dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
