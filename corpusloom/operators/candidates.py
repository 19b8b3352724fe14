"""The candidate statistics of a corpus's strata, and the partition of its quires into roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.functions import textstats, workunits
from corpusloom.operators.statistics import entropy
from corpusloom.sources import corpus

SLOTS = textstats.slot_pattern(textstats.slot_table(textstats.SLOTS))
FRACTIONS = {"discovery": 0.55, "validation": 0.25, "confirmation": 0.2}


def _given(pairs: DataFrame, group: str, name: str, first: int = 1) -> DataFrame:
    """The entropy of a pair's one letter given its other, the `first`."""
    singles = pairs.groupBy(group, F.substring("p", first, 1).alias("a")).agg(F.sum("n").alias("n"))
    both = entropy(pairs, group, "_both").join(entropy(singles, group, "_first"), group)
    return both.select(group, (F.col("_both") - F.col("_first")).alias(name))


def _divergence(counts: DataFrame, group: str, name: str) -> DataFrame:
    """Jensen-Shannon between the counts (group, edge, g, n) at an edge and elsewhere; none, and so 0,
    if a side is empty."""
    sides = counts.groupBy(group, "g").agg(*[F.coalesce(F.sum(F.when(F.col("edge") == e, F.col("n"))), F.lit(0)).alias(c) for c, e in (("a", True), ("b", False))])
    totals = sides.groupBy(group).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")).where("ta > 0 AND tb > 0")
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    part = lambda x, y: F.when(x > 0, 0.5 * x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return sides.join(totals, group).groupBy(group).agg(F.sum(part(p, q) + part(q, p)).alias(name))


def statistics(lines: DataFrame, group: str, groups: DataFrame, pattern: str = SLOTS) -> DataFrame:
    """The candidate statistics of each group, rounded to six digits; zeros without words."""
    lines = lines.where(F.size("words") > 0)
    tokens = lines.select(group, "para_start", F.size("words").alias("m"), F.posexplode("words").alias("i", "w"))
    at_first, at_last = F.col("i") == 0, F.col("i") == F.col("m") - 1
    ends = storage.cut(
        tokens.groupBy(group, at_first.alias("first"), at_last.alias("last"), (at_first & F.col("para_start")).alias("begins"), F.left("w", F.lit(1)).alias("a"), F.right("w", F.lit(1)).alias("z")).agg(F.count("*").alias("n"))
    )
    types = storage.cut(tokens.groupBy(group, "w").agg(F.count("*").alias("n")))

    def counted(edge: str, glyph: str) -> DataFrame:
        return ends.groupBy(group, F.col(edge).alias("edge"), F.col(glyph).alias("g")).agg(F.sum("n").alias("n"))

    initial, final, begun = counted("first", "a"), counted("last", "z"), counted("begins", "a")
    inside = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substring("w", k, 2)))
    pairs = types.where(F.length("w") > 1).select(group, F.col("n").alias("m"), inside.alias("p")).groupBy(group, "p").agg(F.sum("m").alias("n"))
    pairs = storage.cut(pairs)
    beside = F.transform(F.sequence(F.lit(2), F.size("words")), lambda k: F.concat(F.right(F.element_at("words", k - 1), F.lit(1)), F.left(F.element_at("words", k), F.lit(1))))
    cross = lines.where(F.size("words") > 1).select(group, F.explode(beside).alias("p")).groupBy(group, "p").agg(F.count("*").alias("n"))
    # Each pair of unlike letters beside its reverse.
    unlike = pairs.where("left(p, 1) <> right(p, 1)")
    turned = unlike.select(group, F.reverse("p").alias("p"), F.col("n").alias("back"))
    beside_reverse = unlike.join(turned, [group, "p"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    share = lambda some: F.sum(F.when(some, F.col("n")).otherwise(0)) / F.sum("n")
    place = tokens.where("m > 1").select(group, (F.col("i") / (F.col("m") - 1)).alias("x"), F.length("w").cast("double").alias("y"))
    slope = F.regr_slope("y", "x")
    parts = [
        entropy(initial.where("edge"), group, "line_first_initial_h"), entropy(initial.where("NOT edge"), group, "other_initial_h"),
        entropy(final.where("edge"), group, "line_last_final_h"), entropy(final.where("NOT edge"), group, "other_final_h"), entropy(begun.where("edge"), group, "para_first_initial_h"),
        _divergence(initial, group, "line_first_initial_js"), _divergence(final, group, "line_last_final_js"),
        place.groupBy(group).agg(F.when(F.var_pop("x") > 0, slope).alias("wlen_position_slope")),
        _given(cross, group, "cross_word_h2"), _given(pairs, group, "h2_forward"), _given(pairs, group, "h2_backward", 2),
        beside_reverse.groupBy(group).agg(share(F.col("n") > F.col("back")).alias("bigram_asymmetry"), share(F.col("back") == 0).alias("bigram_one_way_mass")),
        types.groupBy(group).agg(share(F.col("w").rlike(pattern)).alias("slot_conformance")),
    ]
    joined = groups
    for part in parts:
        joined = joined.join(part, group, "left")
    joined = joined.withColumn("h2_backward_minus_forward", F.col("h2_backward") - F.col("h2_forward"))
    shown = lambda name: (F.round(F.coalesce(name, F.lit(0.0)), 6) + 0.0).alias(name)
    return joined.select(group, *map(shown, textstats.CANDIDATES))


def candidate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(corpus.lines(spark, sf_dir), "stratum", corpus.pages(spark, sf_dir).select("stratum").distinct())


def quire_words(lines: DataFrame) -> DataFrame:
    """(quire, a, b, other): the words of each quire by stratum."""
    words = lambda some: F.coalesce(F.sum(F.when(some, F.col("n_words"))), F.lit(0)).cast("long")
    a, b = F.col("stratum") == "en", F.col("stratum") == "fr"
    return lines.where("quire IS NOT NULL").groupBy("quire").agg(words(a).alias("a"), words(b).alias("b"), words(~a & ~b).alias("other"))


def assigned(spark: SparkSession, words: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """(quire, role) by the greedy rule, which is sequential over the quires: a manifest's rows, one
    for each, pass through the driver."""
    known = {r["quire"]: (r["a"], r["b"], r["other"]) for r in words.collect()}
    return spark.createDataFrame(list(workunits.assign(known, fractions).items()), "quire string, role string")


def partition_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = storage.cut(quire_words(corpus.lines(spark, sf_dir)))
    return words.join(assigned(spark, words, FRACTIONS), "quire").select("quire", "role", "a", "b", "other")


def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the quires that aren't kept for confirmation."""
    lines = corpus.lines(spark, sf_dir)
    roles = assigned(spark, quire_words(lines), FRACTIONS).where("role <> 'confirmation'")
    return lines.join(roles, "quire", "left_semi").select("page_no", "line_no", "n_words")


QUERIES = {f.__name__: f for f in (candidate_statistics, partition_assign, partition_filter)}


def _h(name: str, counts: str) -> str:
    return f"{name} AS (SELECT stratum, -sum(n / t * log2(n / t)) AS {name} FROM (SELECT *, sum(n) OVER (PARTITION BY stratum) AS t FROM ({counts})) GROUP BY stratum)"


def _js(name: str, glyph: str, edge: str) -> str:
    return f"""{name} AS (SELECT stratum, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS {name} FROM
      (SELECT stratum, a / sum(a) OVER (PARTITION BY stratum) AS p, b / sum(b) OVER (PARTITION BY stratum) AS q, sum(a) OVER (PARTITION BY stratum) AS sa, sum(b) OVER (PARTITION BY stratum) AS sb FROM
      (SELECT stratum, {glyph} AS g, count_if({edge})::DOUBLE AS a, count_if(NOT ({edge}))::DOUBLE AS b FROM tokens GROUP BY ALL)) WHERE sa > 0 AND sb > 0 GROUP BY stratum)"""


def _cond(name: str, pairs: str, first: str) -> str:
    return f"""{_h(name + '_ab', f'SELECT stratum, p, n::DOUBLE AS n FROM {pairs}')}, {_h(name + '_a', f'SELECT stratum, {first} AS a, sum(n)::DOUBLE AS n FROM {pairs} GROUP BY ALL')},
    {name} AS (SELECT stratum, {name}_ab - {name}_a AS {name} FROM {name}_ab JOIN {name}_a USING (stratum))"""


def _counts(glyph: str, where: str) -> str:
    return f"SELECT stratum, {glyph} AS g, count(*)::DOUBLE AS n FROM tokens WHERE {where} GROUP BY ALL"


_EACH = ("line_first_initial_h", "other_initial_h", "line_last_final_h", "other_final_h", "para_first_initial_h", "line_first_initial_js", "line_last_final_js", "wlen_position_slope", "cross_word_h2", "h2_forward", "h2_backward", "asym", "slots")
_COLUMNS = ", ".join(f"round(coalesce({n}, 0.0), 6) + 0.0 AS {n}" for n in textstats.CANDIDATES if n != "h2_backward_minus_forward")
CANDIDATES_SQL = f"""WITH {corpus.SQL}, tw AS (SELECT stratum, w, count(*) AS n FROM tokens GROUP BY ALL),
  bp AS (SELECT stratum, p, sum(n) AS n FROM (SELECT stratum, n, unnest(list_transform(range(1, length(w)), lambda k: substr(w, k, 2))) AS p FROM tw) GROUP BY ALL),
  cp AS (SELECT stratum, p, count(*) AS n FROM (SELECT stratum, right(lag(w) OVER (PARTITION BY page_no, line_no ORDER BY i), 1) || left(w, 1) AS p FROM tokens) WHERE p IS NOT NULL GROUP BY ALL),
  {_h('line_first_initial_h', _counts('left(w, 1)', 'i = 0'))}, {_h('other_initial_h', _counts('left(w, 1)', 'i > 0'))}, {_h('line_last_final_h', _counts('right(w, 1)', 'i = n_words - 1'))},
  {_h('other_final_h', _counts('right(w, 1)', 'i < n_words - 1'))}, {_h('para_first_initial_h', _counts('left(w, 1)', 'i = 0 AND para_start'))},
  {_js('line_first_initial_js', 'left(w, 1)', 'i = 0')}, {_js('line_last_final_js', 'right(w, 1)', 'i = n_words - 1')},
  wlen_position_slope AS (SELECT stratum, covar_pop(length(w), i / (n_words - 1)::DOUBLE) / nullif(var_pop(i / (n_words - 1)::DOUBLE), 0) AS wlen_position_slope FROM tokens WHERE n_words > 1 GROUP BY stratum),
  {_cond('cross_word_h2', 'cp', 'left(p, 1)')}, {_cond('h2_forward', 'bp', 'left(p, 1)')}, {_cond('h2_backward', 'bp', 'right(p, 1)')},
  asym AS (SELECT x.stratum, sum(CASE WHEN x.n > coalesce(y.n, 0) THEN x.n ELSE 0 END) / sum(x.n)::DOUBLE AS bigram_asymmetry, sum(CASE WHEN y.n IS NULL THEN x.n ELSE 0 END) / sum(x.n)::DOUBLE AS bigram_one_way_mass
    FROM bp x LEFT JOIN bp y ON y.stratum = x.stratum AND y.p = reverse(x.p) WHERE left(x.p, 1) <> right(x.p, 1) GROUP BY x.stratum),
  slots AS (SELECT stratum, sum(CASE WHEN regexp_matches(w, '{SLOTS}') THEN n ELSE 0 END) / sum(n)::DOUBLE AS slot_conformance FROM tw GROUP BY stratum)
  SELECT stratum, {_COLUMNS}, round(coalesce(h2_backward - h2_forward, 0.0), 6) + 0.0 AS h2_backward_minus_forward
  FROM (SELECT DISTINCT coalesce(lang, '') AS stratum FROM documents) {' '.join(f'LEFT JOIN {n} USING (stratum)' for n in _EACH)}"""

_FILLED = lambda f, x: " + ".join(f"least(greatest({f} * t{s} - {x}{s}, 0), {s})" for s in ("a", "b", "o"))
_ADDED = lambda role, x: ", ".join(f"{x}{s} + CASE WHEN role = '{role}' THEN {s} ELSE 0 END" for s in ("a", "b", "o"))
_ASSIGN = f"""WITH RECURSIVE {corpus.SQL}, qw AS (SELECT quire, count_if(stratum = 'en') AS a, count_if(stratum = 'fr') AS b, count_if(stratum NOT IN ('en', 'fr')) AS o FROM tokens WHERE quire IS NOT NULL GROUP BY quire),
  q AS (SELECT *, row_number() OVER (ORDER BY a + b + o DESC, quire) AS k, sum(a) OVER () AS ta, sum(b) OVER () AS tb, sum(o) OVER () AS t_o FROM qw),
  st AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS quire, CAST(NULL AS VARCHAR) AS role, 0::DOUBLE AS da, 0::DOUBLE AS db, 0::DOUBLE AS d_o, 0::DOUBLE AS va, 0::DOUBLE AS vb, 0::DOUBLE AS v_o, 0::DOUBLE AS ca, 0::DOUBLE AS cb, 0::DOUBLE AS c_o
    UNION ALL SELECT k, quire, role, {_ADDED('discovery', 'd')}, {_ADDED('validation', 'v')}, {_ADDED('confirmation', 'c')} FROM
    (SELECT *, CASE WHEN sd >= sv AND sd >= sc THEN 'discovery' WHEN sv >= sc THEN 'validation' ELSE 'confirmation' END AS role FROM
      (SELECT q.k, q.quire, a, b, o, da, db, d_o, va, vb, v_o, ca, cb, c_o, {_FILLED(0.55, 'd')} AS sd, {_FILLED(0.25, 'v')} AS sv, {_FILLED(0.2, 'c')} AS sc FROM st JOIN q ON q.k = st.k + 1)))"""
_ASSIGN = _ASSIGN.replace("do + CASE", "d_o + CASE").replace("vo + CASE", "v_o + CASE").replace("co + CASE", "c_o + CASE").replace("* to - do", "* t_o - d_o").replace("* to - vo", "* t_o - v_o").replace("* to - co", "* t_o - c_o")
ORACLE_SQL = {
    "candidate_statistics": CANDIDATES_SQL,
    "partition_assign": f"{_ASSIGN} SELECT quire, role, a, b, o AS other FROM st JOIN qw USING (quire)",
    "partition_filter": f"{_ASSIGN} SELECT page_no, line_no, n_words FROM lines WHERE quire IN (SELECT quire FROM st WHERE role <> 'confirmation')",
}
