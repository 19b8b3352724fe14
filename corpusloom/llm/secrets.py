"""Secret scans over an incremental blob ledger [native].

A text version is a blob, addressed by its SHA-256. The ledger holds the findings of each (blob,
rule version) pair that was scanned. A run addresses all paths, scans only the pairs that the
ledger doesn't hold, once each however many paths share the blob, and joins the findings back to
every path.

Positions come from the pieces between matches: a split and an extraction by the same pattern
alternate, so the running sum of their lengths gives each match's start, in code points.

Defined results: null texts are the empty blob; blobs are scanned whole, at any length; a rule
version already in the ledger isn't scanned again; repeated rows and ids are paths like any
other; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kind, pattern, group whose length counts, least length. The first three are the
#: base; the rest are added by the method. Their order is the order of kinds.
RULES = (
    ("assign", r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
BASE = 3
#: What a text must hold for a rule to be worth the full scan: patterns that need no backtracking.
HINTS = {"hex": "[0-9a-f]{16}", "assign": r"(?i)(?:passw|secret|token|api_?key)"}
#: Patterns that match the same as a rule's, with fewer tries: a class that only runs of some length satisfy, as such runs.
EXACT = {"hex": "[0-9a-f]{16,}"}
#: Follows from the rules: whoever changes one has scanned nothing yet.
RULE_VERSION = hashlib.sha256(repr((RULES, HINTS, EXACT)).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, findings array<struct<kind:string,rank:int,start:int,end:int>>"


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """The (start, end) of each leftmost, non-overlapping match whose group is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(found, F.length)
    at = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["end"] + x["gap"]
        end = start + x["length"]
        kept = F.when(x["inner"] >= least, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("end"), F.concat(acc["spans"], kept).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(lengths)).alias("gap"), lengths.alias("length"), inner.alias("inner"))
    return F.aggregate(pairs, at, step, lambda acc: acc["spans"])


def address(docs: DataFrame) -> DataFrame:
    """`docs` with `blob`, the content address of the text."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def scan(blobs: DataFrame) -> DataFrame:
    """Scans `blobs` (blob, text): (blob, rule_version, kind, rank, start, end), and one row with a
    null kind for each blob, so that a blob without findings is known as scanned."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    by_kind = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        exact = EXACT.get(kind, pattern)
        hint = HINTS.get(kind, pattern)
        found = F.when(F.col("text").rlike(hint), spans(F.col("text"), exact, group, least)).otherwise(none)
        by_kind.append(F.transform(found, _named(kind, rank)))
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.concat(*by_kind).alias("findings"))


def _named(kind: str, rank: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"))


def unseen(docs: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """(blob, text), once for each blob whose pair with the current rules isn't in the ledger."""
    addressed = docs.select("blob", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        addressed = addressed.join(done, "blob", "left_anti")
    return addressed.groupBy("blob").agg(F.first("text").alias("text"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored in a folder, by rule version; an empty one if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.parquet(path).select("blob", F.col("rule_version").cast("string").alias("rule_version"), "findings")


def append(docs: DataFrame, path: str) -> DataFrame:
    """Scans what the stored ledger lacks, adds it there, and returns the ledger."""
    ledger = load(docs.sparkSession, path)
    fresh = common.cut(scan(unseen(address(docs), ledger)))
    fresh.write.partitionBy("rule_version").mode("append").parquet(path)
    return load(docs.sparkSession, path)


def update(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger (blob, rule_version, findings) after scanning what it doesn't hold, cut."""
    fresh = scan(unseen(address(docs), ledger))
    return common.cut(fresh if ledger is None else ledger.unionByName(fresh))


def find(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """`docs` without text, each path with its blob and the blob's findings (null if none)."""
    ledger = update(docs, ledger)
    paths = address(docs).drop("text")
    hits = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("findings") > 0)).select("blob", "findings")
    # A blob may be the text of very many paths: the empty one is that of all null texts.
    counted = paths.groupBy("blob").agg(F.count("*").alias("_paths"))
    hits = common.cut(hits.join(counted, "blob"))
    return common.joined_spread(paths, hits, "blob", "_paths", F.xxhash64(*[c for c in paths.columns if c != "blob"]), "left")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    none = F.array().cast("array<struct<kind:string,rank:int,start:int,end:int>>")
    d = find(docs).withColumn("findings", F.coalesce("findings", none))
    ordered = F.array_sort(F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    joined = lambda some: F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.withColumn("_ordered", ordered).select(
        "doc_id", *[count(kind) for kind, *_ in RULES[:BASE]],
        F.sha2(joined(F.filter("_ordered", lambda x: x["rank"] < BASE)), 256).alias("base_sha256"),
        joined(F.col("_ordered")).alias("spans"), "blob",
    )
