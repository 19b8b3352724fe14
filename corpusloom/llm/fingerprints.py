"""Document fingerprints by I-Match over randomised lexicon subsets [native].

Terms are runs of letters and digits, in lower case. The lexicon holds the terms whose share of
documents lies in the band [`lo`, `hi`]; a text with very many copies counts once. A share of at least `lo` bounds its size by the mean
number of distinct terms of a document over `lo`, however large the corpus, so it may be sent to
every task. A seeded hash deals the lexicon into `1 << bits` random subsets. A document's distinct
lexicon terms are sorted, and those of each subset are hashed together: the fingerprint is the
list of (subset, hash) of the subsets that it touches. Likeness is the share of equal hashes among
the subsets that either document touches; equal texts have equal fingerprints and likeness 1.

A document without any lexicon term is dealt by all its terms in the same way (near copies by the
million put their own terms above the band), and one without any term is fingerprinted by its text.

Defined results: null texts are empty; texts are taken whole; rows with one doc_id follow each
other in the order of their texts; null ids come last; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEED = 2


def terms(text: Column) -> Column:
    """The distinct hashed terms of a text."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(F.lit(SEED), w)))


def lexicon(docs: DataFrame, lo: float = 0.01, hi: float = 0.1) -> list[int]:
    """The hashed terms of the band, from the counts of all documents. Their number has the bound
    stated above, so they pass through the driver.

    In corpora too small for the band (hi * documents below 2) terms of two documents belong.
    """
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    copies = docs.groupBy(content.alias("_content")).agg(F.count("*").alias("_n"))
    rows = docs.count()
    # Fewer than 4096 texts can hold over a 4096th of the rows each.
    hot = common.cut(copies.where(F.col("_n") > max(100.0, rows * common.HOT_SHARE)))
    n = rows - hot.agg(F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).first()[0]
    marked = docs.select("text", content.alias("_content")).join(F.broadcast(hot), "_content", "left")
    each = marked.where("_n IS NULL").select("text").union(marked.where("_n IS NOT NULL").groupBy("_content").agg(F.first("text").alias("text")).select("text"))
    counted = each.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counted.where((F.col("df") >= lo * n) & (F.col("df") <= max(2.0, hi * n))).select("term").collect()
    return sorted(r["term"] for r in band)


def with_slots(docs: DataFrame, text: str, known: list[int], out: str = "slots", bits: int = 7) -> DataFrame:
    """`docs` with the subsets' hashes of a text: subset << 24 | hash, ascending by the subset's bits;
    empty without terms. The lexicon is a set of constants, in which each term is looked up."""
    inside = "t IN (" + ",".join(f"{k}L" for k in known) + ")" if known else "false"
    d = docs.withColumn("_terms", terms(F.col(text))).withColumn("_known", F.expr(f"filter(_terms, t -> {inside})"))
    d = d.withColumn("_own", F.array_sort(F.when(F.size("_known") > 0, F.col("_known")).otherwise(F.col("_terms"))))
    return d.withColumn(out, _dealt(F.col("_own"), bits)).drop("_terms", "_known", "_own")


def _dealt(own: Column, bits: int) -> Column:
    start = F.struct(F.lit(-1).alias("slot"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<bigint>").alias("out"))
    packed = lambda acc: F.shiftleft(acc["slot"].cast("long"), 24).bitwiseOR(acc["hash"].bitwiseAND(F.lit((1 << 24) - 1)))
    closed = lambda acc: F.when(acc["slot"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(packed(acc))))

    def step(acc: Column, term: Column) -> Column:
        slot = F.shiftrightunsigned(term, 64 - bits).cast("int")
        same = slot == acc["slot"]
        return F.struct(
            slot.alias("slot"),
            F.when(same, F.xxhash64(acc["hash"], term)).otherwise(F.xxhash64(term)).alias("hash"),
            F.when(same, acc["out"]).otherwise(closed(acc)).alias("out"),
        )

    return F.aggregate(own, start, step, closed)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets that either touches."""
    subset = lambda x: F.transform(x, lambda v: F.shiftright(v, 24))
    either = F.size(F.array_union(subset(a), subset(b)))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def written(slot_list: Column, text: Column) -> Column:
    return F.when(F.size(slot_list) > 0, F.array_join(F.transform(slot_list, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")).otherwise(
        F.concat(F.lit("text-"), F.sha2(text, 256))
    )


def with_next(docs: DataFrame, carried: list[str], rows_each: int = 500, side_most: int = 256) -> DataFrame:
    """`docs` with `next_<c>` for each carried column: its value in the next row by descending
    doc_id, and after the last row that of the first.

    Rows are dealt into up to `side_most`^2 ranges of doc_id of about `rows_each` rows. The first
    row of each range is copied behind the last row of the range before it, so one shuffle does.
    """
    n = docs.count()
    side = max(1, min(side_most, round((n / rows_each) ** 0.5)))
    at = [k / (side * side) for k in range(1, side * side)]
    bounds = docs.select(F.percentile_approx("doc_id", at, 20 * side * side)).first()[0] if at else []
    bounds = sorted(set(bounds or []))
    size = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[k : k + size] for k in range(0, len(bounds), size)]
    longs = lambda xs: F.lit(xs).cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    # Of the groups of bounds, those that start below the id count in full but for the last of them.
    started = below(longs([g[0] for g in groups]))
    fine = F.array(*[longs(g) for g in groups]) if groups else F.array(longs([]))
    inside = F.when(started > 0, (started - 1) * size + below(F.element_at(fine, F.greatest(started, F.lit(1))))).otherwise(0)
    docs = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(inside))

    tops = sorted(((r["_range"], r["top"]) for r in docs.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    guests = [(tops[(k + 1) % len(tops)][1], tops[k][0]) for k in range(len(tops))]
    guests = docs.sparkSession.createDataFrame(guests, "_top bigint, _guest_of int")
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_guest_of").alias("r"), F.lit(1).alias("guest"))
    dealt = (
        docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_top")), "left")
        .withColumn("_to", F.explode(F.when(F.col("_guest_of").isNull(), F.array(own)).otherwise(F.array(own, guest))))
        .select(*[c for c in docs.columns if c != "_range"], F.col("_to.r").alias("_range"), F.col("_to.guest").alias("_guest"))
    )
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("_guest = 0").drop("_range", "_guest")


def fingerprint(docs: DataFrame, known: list[int] | None = None, bits: int = 7) -> DataFrame:
    """`docs` (text, ...) with `slots` and `fingerprint`; `known`: a lexicon() of some corpus."""
    known = lexicon(docs) if known is None else known
    return with_slots(docs, "text", known, "slots", bits).withColumn("fingerprint", written(F.col("slots"), F.col("text")))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(docs)
    d = with_next(fingerprint(docs, known), ["text", "slots"])
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    d = d.withColumn("_edited", F.concat(F.left(F.col("text"), (n - half).cast("int")), F.left(F.col("next_text"), half)))
    d = with_slots(d, "_edited", known, "_slots")
    like = lambda slot_list, text: F.when(F.col("text") == text, F.lit(1.0)).otherwise(likeness(F.col("slots"), slot_list))
    return d.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        "fingerprint", written(F.col("_slots"), F.col("_edited")).alias("edited_fingerprint"),
        like(F.col("_slots"), F.col("_edited")).alias("near_edited"), like(F.col("next_slots"), F.col("next_text")).alias("near_next"),
    )
