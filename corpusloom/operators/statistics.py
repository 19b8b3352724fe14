"""The 30-value fingerprint of a corpus: by tasks that measure stretches of it (operators.sweeps), and
in values() as one relational query.

There positions in the token stream are two-level running sums (page offsets over buckets of pages).
Statistics that look back use windows over (word, stretch of the stream) with a halo of the
reach, so that a frequent word's occurrences don't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.functions.textstats import NAMES
from corpusloom.sources import corpus

STRETCH = 4096
REACH = 500


def positions(lines: DataFrame, group: str, bucket: Column | None = None) -> DataFrame:
    """`lines` with `at`, the position of a line's first token in its group's stream (pages in order).

    Pages are summed within buckets that follow their order, by default of 1024 numbers each, and the
    buckets' sums over all.
    """
    pages = lines.groupBy(group, "page_no").agg(F.sum("n_words").alias("n"))
    pages = pages.withColumn("_bucket", F.expr("page_no div 1024") if bucket is None else bucket)
    inside = Window.partitionBy(group, "_bucket").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    buckets = pages.groupBy(group, "_bucket").agg(F.sum("n").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_sum")
    buckets = buckets.select(group, "_bucket", ahead.alias("_ahead"))
    pages = pages.withColumn("_within", F.sum("n").over(inside) - F.col("n")).join(buckets, [group, "_bucket"])
    pages = pages.select(group, "page_no", (F.col("_ahead") + F.col("_within")).alias("_page_at"))
    in_page = Window.partitionBy(group, "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("_line_at", F.sum("n_words").over(in_page) - F.col("n_words"))
    return placed.join(pages, [group, "page_no"]).withColumn("at", F.col("_page_at") + F.col("_line_at")).drop("_page_at", "_line_at")


def entropy(counts: DataFrame, group: str, name: str) -> DataFrame:
    """Shannon entropy in bits of `counts` (group, n), by group."""
    # sum of -p log2 p, from the group's own sums: log2 T - sum(n log2 n) / T
    total = F.sum("n")
    return counts.groupBy(group).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias(name))


def _pairs(tokens: DataFrame, group: str, padded: bool, name: str) -> DataFrame:
    """Entropy of a glyph given the one before, within words or with the spaces around them."""
    word = F.concat(F.lit(" "), F.col("w"), F.lit(" ")) if padded else F.col("w")
    grams = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda k: F.substring(word, k, 2)) if padded else F.when(
        F.length("w") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - 1, F.lit(1))), lambda k: F.substring(F.col("w"), k, 2))
    ).otherwise(F.array().cast("array<string>"))
    pairs = tokens.select(group, F.col("n").alias("m"), F.explode(grams).alias("p")).groupBy(group, "p").agg(F.sum("m").alias("n"))
    first = pairs.groupBy(group, F.substring("p", 1, 1).alias("a")).agg(F.sum("n").alias("n"))
    both = entropy(pairs, group, "_both").join(entropy(first, group, "_first"), group)
    return both.select(group, (F.col("_both") - F.col("_first")).alias(name))


def near_words(lines: DataFrame) -> DataFrame:
    """`lines` (words, ...) with `near`: how many of a line's words have another word of the line
    within one edit, at another place.

    Two words are one substitution apart if they agree in all but one place: in a key made of the
    place and what stands before and behind it. One is the other less a letter if it equals what
    the other leaves without one. So a line's keys are compared, not its pairs of words.
    """
    ks = lambda w: F.sequence(F.lit(1), F.length(w))
    # Keys of distinct words; in a word of its own, what stands around two places never agrees twice.
    changed = lambda w: F.transform(ks(w), lambda k: F.xxhash64(k, F.left(w, k - 1), F.substr(w, k + 1)))
    shorter = lambda w: F.array_distinct(F.transform(ks(w), lambda k: F.xxhash64(F.concat(F.left(w, k - 1), F.substr(w, k + 1)))))
    keyed = lambda w: F.struct(w.alias("w"), F.xxhash64(w).alias("own"), changed(w).alias("changed"), shorter(w).alias("shorter"))
    twice = lambda xs: F.filter(F.zip_with(xs, F.slice(xs, F.lit(2), F.size(xs)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    every = lambda field: F.flatten(F.transform("_keys", lambda x: x[field]))
    lines = lines.withColumn("_keys", F.transform(F.array_distinct("words"), keyed)).withColumn("_sorted", F.array_sort("words"))
    lines = lines.withColumn("_changed", F.array_sort(every("changed")))
    lines = lines.withColumn("_alike", F.array_distinct(twice(F.col("_changed"))))
    lines = lines.withColumn("_less", F.array_intersect(F.transform("_keys", lambda x: x["own"]), every("shorter")))
    # What a lambda function refers to is bound to a variable of its own, or it might be computed for
    # each element.
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    hit = lambda x, b: F.arrays_overlap(x["changed"], b["alike"]) | F.array_contains(b["less"], x["own"]) | F.arrays_overlap(x["shorter"], b["less"])
    both = F.struct(F.col("_alike").alias("alike"), F.col("_less").alias("less"))
    found = F.transform(bound(both, lambda b: F.filter("_keys", lambda x: hit(x, b))), lambda x: x["w"])
    lines = lines.withColumn("_hits", F.array_union(found, twice(F.col("_sorted"))))
    near = F.size(bound(F.col("_hits"), lambda hits: F.filter("words", lambda w: F.array_contains(hits, w))))
    return lines.withColumn("near", near).drop("_keys", "_sorted", "_changed", "_alike", "_less", "_hits")


def fingerprint(spark: SparkSession, sf_dir: str, group: str = "stratum") -> DataFrame:
    """One row for each group of the corpus's pages: the 30 values, zeros for one without words. Tasks
    measure stretches of the groups' streams; a group's sums and highest counts come to the driver."""
    from corpusloom.operators import sweeps

    found = sweeps.values_by(corpus.lines(spark, sf_dir), group)
    pages = corpus.pages(spark, sf_dir).select(group).distinct()
    rows = [(r[group], *[round(x, 6) + 0.0 for x in found.get(r[group], [0.0] * len(NAMES))]) for r in pages.collect()]
    return spark.createDataFrame(rows, f"{group} string, {', '.join(f'{n} double' for n in NAMES)}")


def values(corpus_lines: DataFrame, group: str, groups: DataFrame, digits: int | None = 6) -> DataFrame:
    """The 30 values of each group of `groups`, rounded to `digits`, from lines (group, page_no,
    line_no, words, n_words, para_start): a group's stream is its pages in order."""
    lines = positions(corpus_lines, group)
    stream = storage.cut(lines.select(group, F.posexplode("words").alias("i", "w"), "at").select(group, (F.col("at") + F.col("i")).alias("pos"), "w"))
    types = storage.cut(stream.groupBy(group, "w").agg(F.count("*").alias("n")))

    glyphs = types.select(group, "n", F.explode(F.split("w", "")).alias("g")).groupBy(group, "g").agg(F.sum("n").alias("n"))
    spaces = types.groupBy(group).agg(F.sum("n").alias("n"))
    parts = [
        glyphs.groupBy(group).agg(F.log2(F.count("*")).alias("h0")),
        entropy(glyphs.select(group, "n").unionByName(spaces), group, "h1"),
        _pairs(types, group, True, "h2"),
        _pairs(types, group, False, "h2_word"),
        entropy(types.groupBy(group, F.substring("w", 1, 1).alias("g")).agg(F.sum("n").alias("n")), group, "h_initial"),
        entropy(types.groupBy(group, F.expr("right(w, 1)").alias("g")).agg(F.sum("n").alias("n")), group, "h_final"),
    ]
    length, n = F.length("w"), F.sum("n")
    mean = F.sum(length * F.col("n")) / n
    lengths = [(F.sum(F.when(F.least(length, F.lit(10)) == k, F.col("n")).otherwise(0)) / n).alias(f"wlen_{k}") for k in range(1, 11)]
    parts.append(
        types.groupBy(group).agg(
            n.alias("tokens"), mean.alias("wlen_mean"), F.sqrt(F.greatest(F.sum(length * length * F.col("n")) / n - mean * mean, F.lit(0.0))).alias("wlen_sd"),
            *lengths, F.avg((F.col("n") == 1).cast("int")).alias("hapax_frac"),
        )
    )
    # The 500 most frequent words of each group: a limit that the statistic itself has.
    top = types.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "w"))).where("rank <= 500")
    parts.append(top.groupBy(group).agg(F.coalesce(F.regr_slope(F.log("n"), F.log("rank")), F.lit(0.0)).alias("zipf_slope")))

    # Stretches of the stream, each with the end of the one before it in front.
    own = F.expr(f"pos div {STRETCH}")
    spread = F.when(F.col("pos") % STRETCH >= STRETCH - REACH, F.array(own, own + 1)).otherwise(F.array(own))
    reach = stream.withColumn("stretch", F.explode(spread))
    before = reach.withColumn("prev", F.lag("pos").over(Window.partitionBy(group, "stretch", "w").orderBy("pos")))
    before = before.where(own == F.col("stretch")).join(spaces.withColumnRenamed("n", "total"), group)
    width = F.least(F.lit(REACH).cast("long"), F.col("total"))
    windows = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("total") - width) - F.greatest(F.col("pos") - width + 1, F.coalesce("prev", F.lit(-1)) + 1, F.lit(0)) + 1)
    gap = F.col("pos") - F.col("prev")
    parts.append(
        before.groupBy(group).agg(
            (F.sum(windows) / F.max((F.col("total") - width + 1) * width)).alias("mattr500"),
            (F.sum(F.when(gap <= 10, 1).otherwise(0)) / F.count("*")).alias("recent_repeat_10"),
            (F.sum(F.when(gap <= 100, 1).otherwise(0)) / F.count("*")).alias("recent_repeat_100"),
        )
    )
    beside = reach.withColumn("left", F.lag("w").over(Window.partitionBy(group, "stretch").orderBy("pos"))).where(own == F.col("stretch"))
    pairs = F.greatest(F.count("*") - 1, F.lit(1))
    parts.append(
        beside.groupBy(group).agg(
            (F.sum(F.when(F.col("w") == F.col("left"), 1).otherwise(0)) / pairs).alias("adjacent_same"),
            (F.sum(F.when(F.levenshtein("w", "left") == 1, 1).otherwise(0)) / pairs).alias("adjacent_edit1"),
        )
    )
    first, last = F.length(F.element_at("words", 1)), F.length(F.element_at("words", -1))
    parts.append(
        near_words(corpus_lines.select(group, "words", "n_words", "para_start")).groupBy(group).agg(
            (F.sum("near") / F.sum("n_words")).alias("line_edit1"), F.avg(first).alias("_first"), F.avg(last).alias("_last"),
            F.avg(F.when(F.col("para_start"), first)).alias("_para"), (F.sum("n_words") / F.count("*")).alias("line_len_mean"),
        )
    )
    joined = groups
    for part in parts:
        joined = joined.join(part, group, "left")
    joined = joined.withColumn("line_first_len_delta", F.col("_first") - F.col("wlen_mean")).withColumn("line_last_len_delta", F.col("_last") - F.col("wlen_mean"))
    joined = joined.withColumn("para_first_len_delta", F.coalesce(F.col("_para") - F.col("wlen_mean"), F.lit(0.0)))
    shown = lambda x: x if digits is None else F.round(x, digits)
    return joined.select(group, *[(shown(F.coalesce(name, F.lit(0.0))) + 0.0).alias(name) for name in NAMES])
