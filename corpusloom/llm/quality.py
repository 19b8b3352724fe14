"""Quality rules by line-first cleaning [native].

Every line with a word is judged by three rules:

* punctuation: no sentence ends in it or at its end, or symbols make up over a fifth of its
  characters, or at least three exclamation marks stand for over a quarter of its words;
* navigation: at least two separators, and one for at most every third word;
* boilerplate: it holds a stock phrase (cookie notices, rights, script notices, placeholders).

Failing lines are removed, each with the line break behind it; blank lines stay. A document is kept
unless the base rules fail it or the removed lines hold over `most_lost` of its word characters.

Base rules: fewer than 20 words, or over 30% of the words inside 8-word windows that occur twice.

Defined results: null, empty and blank texts have no words and fail; texts are judged whole, at
any length; equal texts get equal verdicts; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Stock phrases of pages, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies", "use of cookies",
    "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "sign up for our newsletter", "subscribe to our",
    "skip to content", "back to top", "share this page", "log in to comment", "powered by",
)
TERMINAL = r"[.!?…:;。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|\z)"
SEPARATORS = "|»›·•"


def _chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def _count(line: Column, some: str) -> Column:
    """How many of some characters a line holds; most hold none, which a search tells sooner."""
    pattern = "[" + "".join("\\" + c if c in "|\\^$*{}" else c for c in some) + "]"
    return F.when(line.rlike(pattern), F.length(line) - F.length(F.translate(line, some, ""))).otherwise(0)


def line_fails(line: Column, chars: Column | None = None) -> Column:
    """Whether a line with a word fails; `chars`: its code points outside white space."""
    chars = _chars(line) if chars is None else chars
    n = F.size(F.split(line, common.SPACES))
    symbols, shouts, separators = _count(line, "#*$%&|<>{}=~^\\@"), _count(line, "!"), _count(line, SEPARATORS)
    punctuation = ~line.rlike(TERMINAL) | ((symbols > 0) & (symbols * 5 > chars)) | ((shouts >= 3) & (shouts * 4 > n))
    navigation = (separators >= 2) & (separators * 3 >= n)
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    return punctuation | navigation | boilerplate


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once: the optimizer may copy what a lambda function refers
    to into it, to be computed for each element."""
    return F.transform(F.array(value), use)[0]


def judged(text: Column) -> Column:
    """Every line of a text once: the line, its code points outside white space, whether it fails.
    Blank lines have no such code points and don't fail."""
    sized = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _chars(x).alias("chars")))
    return F.transform(sized, lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), ((x["chars"] > 0) & line_fails(x["line"], x["chars"])).alias("fails")))


def measure(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """`docs` (text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept_chars (word characters of the lines that pass), n_failing_lines, clean_text
    (without the lines that fail) and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_words", common.words(F.col("text"))).withColumn("_judged", judged(text))
    d = d.withColumn("_lines", F.transform(F.filter("_judged", lambda x: x["chars"] > 0), lambda x: x["line"]))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", _chars(text).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # A window is hashed word by word, so that words of different lengths can't be confused.
    last = F.col("n_words").cast("int") - (WINDOW - 1)
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    windows = F.when(last > 0, bound(hashes, lambda hs: F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(hs, i, WINDOW)))))
    d = d.withColumn("_windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))


    def twins(xs: Column) -> Column:
        end = F.size(xs) - 1
        twin = lambda x, i: ((i > 0) & (xs[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < end) & (xs[F.least(i + 1, end)]["h"] == x["h"]))
        return F.filter(xs, twin)

    d = d.withColumn("_at", F.array_sort(F.transform(bound(F.col("_sorted"), twins), lambda x: x["i"])))
    # Each repeated window adds the words that the one before it doesn't cover.
    ends = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(ends, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = d.withColumn("_failing", F.filter("_judged", lambda x: x["fails"])).withColumn("n_failing_lines", F.size("_failing").cast("long"))
    d = d.withColumn("kept_chars", F.col("word_chars") - F.aggregate("_failing", F.lit(0), lambda s, x: s + x["chars"]))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= (1 - most_lost) * F.col("word_chars")))
    passing = F.array_join(F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    d = d.withColumn("clean_text", F.when(F.col("n_failing_lines") > 0, passing).otherwise(F.col("text")))
    return d.drop("_words", "_lines", "_judged", "_failing", "_windows", "_sorted", "_at")


def clean(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """The rows of `docs` that are kept, their texts without the lines that fail.

    A row is repeated once or not at all. A filter would do the same, but the optimizer would copy
    the whole tree of rules, many times over, into one below the projections.
    """
    once = F.explode(F.array_repeat(F.lit(1), F.col("kept").cast("int"))).alias("_once")
    # Rows travel as one value, so that their columns may have any names.
    rows = measure(docs.select("text", F.struct("*").alias("_row")), most_lost)
    return rows.select(F.col("_row").withField("text", F.col("clean_text")).alias("_row"), once).select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
