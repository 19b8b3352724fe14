"""Queries whose text is common to Spark SQL and DuckDB, over the relations of `sources`."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.sources import corpus, ledger

RELATIONS = {"lines": corpus.lines, "tokens": corpus.tokens, "attempts": ledger.attempts, "guests": ledger.guests, "units": ledger.units, "runs": ledger.runs}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(text: str):
    """The text over the relations that it names in braces."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark, sf_dir):
        found = {n: RELATIONS[n](spark, sf_dir) if n in RELATIONS else corpus.table(spark, sf_dir, n) for n in names}
        return spark.sql(text, **found)

    return run


def oracle(text: str) -> str:
    for name in (*RELATIONS, *TABLES):
        text = text.replace("{" + name + "}", name)
    # DuckDB has no suffix for doubles, and its own name for a pattern test.
    text = re.sub(r"(\d)D\b", r"\1::DOUBLE", text.strip()).replace("regexp_like(", "regexp_matches(")
    head = f"WITH {corpus.SQL},\n{ledger.SQL}"
    return f"{head},\n{text[5:]}" if text[:5].upper() == "WITH " else f"{head}\n{text}"


#: Slots of the word grammar, each an optional choice, as an anchored pattern. Fixed values.
SLOTS = "^(th|st|wh)?(e|a|o|i)?(r|n|s|l)?(t|d|ing|ed|tion)?(e|a|y)?(s|n|r)?$"

CORPUS = {
    "corpus_totals": "SELECT count(DISTINCT page_no) AS pages, (SELECT count(*) FROM {lines}) AS lines, count(*) AS words, CAST(sum(length(w)) AS BIGINT) AS glyphs FROM {tokens}",
    "token_frequency_topk": "SELECT w, count(*) AS n FROM {tokens} GROUP BY w ORDER BY n DESC, w LIMIT 500",
    "word_bag": "SELECT w, count(*) AS n FROM {tokens} GROUP BY w",
    "hapax_fraction": "SELECT stratum, round(avg(CASE WHEN n = 1 THEN 1.0D ELSE 0.0D END), 6) AS hapax FROM (SELECT stratum, w, count(*) AS n FROM {tokens} GROUP BY stratum, w) GROUP BY stratum",
    "wlen_histogram": "SELECT least(greatest(length(w), 1), 10) AS len, count(*) AS n FROM {tokens} GROUP BY least(greatest(length(w), 1), 10)",
    "wlen_moments": "SELECT stratum, round(avg(length(w)), 6) AS mean, round(stddev_pop(length(w)), 6) AS sd FROM {tokens} GROUP BY stratum",
    "initial_counts": "SELECT substr(w, 1, 1) AS g, count(*) AS n FROM {tokens} GROUP BY substr(w, 1, 1)",
    "final_counts": "SELECT right(w, 1) AS g, count(*) AS n FROM {tokens} GROUP BY right(w, 1)",
    "initial_final_entropy": """WITH c AS (SELECT 'initial' AS place, substr(w, 1, 1) AS g, count(*) AS n FROM {tokens} GROUP BY substr(w, 1, 1) UNION ALL SELECT 'final', right(w, 1), count(*) FROM {tokens} GROUP BY right(w, 1))
        SELECT place, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h FROM c GROUP BY place""",
    "zipf_slope": """WITH c AS (SELECT stratum, w, count(*) AS n FROM {tokens} GROUP BY stratum, w), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, w) AS k FROM c)
        SELECT stratum, round(regr_slope(ln(n), ln(k)), 6) AS slope FROM r WHERE k <= 500 GROUP BY stratum""",
    "line_position_deltas": """WITH m AS (SELECT stratum, avg(length(w)) AS mean, avg(CASE WHEN i = 0 THEN length(w) END) AS f, avg(CASE WHEN i = n_words - 1 THEN length(w) END) AS l,
        avg(CASE WHEN i = 0 AND para_start THEN length(w) END) AS p FROM {tokens} GROUP BY stratum)
        SELECT stratum, round(f - mean, 6) AS first_delta, round(l - mean, 6) AS last_delta, round(p - mean, 6) AS para_delta FROM m""",
    "layout": "SELECT page_no, line_no, n_words, para_start, para_end FROM {lines}",
    "layout_truncate": """WITH c AS (SELECT page_no, line_no, n_words, para_start, sum(n_words) OVER (PARTITION BY page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS upto FROM {lines}),
        k AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY line_no DESC) AS back FROM c WHERE upto <= 200)
        SELECT page_no, line_no, n_words, para_start, back = 1 AS para_end FROM k""",
    "paragraph_blocks": """WITH f AS (SELECT *, lag(para_end) OVER (PARTITION BY page_no ORDER BY line_no) AS ended FROM {lines}),
        b AS (SELECT page_no, line_no, n_words, sum(CASE WHEN para_start OR coalesce(ended, false) THEN 1 ELSE 0 END) OVER (PARTITION BY page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM f)
        SELECT page_no, CAST(block AS BIGINT) AS block, count(*) AS lines, CAST(sum(n_words) AS BIGINT) AS words FROM b GROUP BY page_no, block""",
    "stratum_filter": "SELECT page_no, dense_rank() OVER (PARTITION BY quire ORDER BY page_no) AS page_index, line_no, n_words FROM {lines} WHERE stratum = 'fr'",
    "locus_filter": "SELECT page_no, line_no, n_words FROM {lines} WHERE para_start OR para_end",
    "rare_word_drop": "SELECT page_no, line_no, count(*) AS kept FROM {tokens} WHERE w NOT LIKE '%q%' AND w NOT LIKE '%x%' GROUP BY page_no, line_no",
    "quire_role_totals": """SELECT quire, CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(CASE WHEN stratum = 'en' THEN n_words ELSE 0 END) AS BIGINT) AS words_a, CAST(sum(CASE WHEN stratum = 'fr' THEN n_words ELSE 0 END) AS BIGINT) AS words_b,
        CAST(sum(CASE WHEN stratum NOT IN ('en', 'fr') THEN n_words ELSE 0 END) AS BIGINT) AS words_other FROM {lines} GROUP BY quire""",
    "slot_conformance": f"SELECT stratum, round(avg(CASE WHEN regexp_like(w, '{SLOTS}') THEN 1.0D ELSE 0.0D END), 6) AS share FROM {{tokens}} GROUP BY stratum",
    "wlen_position_slope": "SELECT stratum, round(coalesce(regr_slope(length(w), CAST(i AS DOUBLE) / (n_words - 1)), 0.0D), 6) AS slope FROM {tokens} WHERE n_words > 1 GROUP BY stratum",
    "cross_word_h2": """WITH p AS (SELECT stratum, right(lag(w) OVER (PARTITION BY page_no, line_no ORDER BY i), 1) AS a, substr(w, 1, 1) AS b FROM {tokens}),
        ab AS (SELECT stratum, a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY stratum, a, b), a1 AS (SELECT stratum, a, sum(n) AS n FROM ab GROUP BY stratum, a),
        x AS (SELECT stratum, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM ab GROUP BY stratum), y AS (SELECT stratum, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM a1 GROUP BY stratum)
        SELECT x.stratum, round(x.h - y.h, 6) AS h2 FROM x JOIN y ON x.stratum = y.stratum""",
    "line_initial_entropy": """WITH c AS (SELECT i = 0 AS first, substr(w, 1, 1) AS g, count(*) AS n FROM {tokens} GROUP BY i = 0, substr(w, 1, 1))
        SELECT first, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h FROM c GROUP BY first""",
    "line_initial_js": """WITH c AS (SELECT substr(w, 1, 1) AS g, CAST(sum(CASE WHEN i = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN i > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM {tokens} GROUP BY substr(w, 1, 1)),
        t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c), p AS (SELECT a / ta AS p, b / tb AS q FROM c CROSS JOIN t WHERE ta > 0 AND tb > 0)
        SELECT coalesce(round(0.5D * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5D * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 6), 0.0D) AS js FROM p""",
    "line_final_js": """WITH c AS (SELECT right(w, 1) AS g, CAST(sum(CASE WHEN i = n_words - 1 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN i < n_words - 1 THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM {tokens} GROUP BY right(w, 1)),
        t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c), p AS (SELECT a / ta AS p, b / tb AS q FROM c CROSS JOIN t WHERE ta > 0 AND tb > 0)
        SELECT coalesce(round(0.5D * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5D * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 6), 0.0D) AS js FROM p""",
    "corpus_differences": "SELECT w FROM {tokens} WHERE stratum = 'en' EXCEPT SELECT w FROM {tokens} WHERE stratum <> 'en'",
    "corpus_shared_words": "SELECT w FROM {tokens} WHERE stratum = 'en' INTERSECT SELECT w FROM {tokens} WHERE stratum = 'fr'",
    "page_turns": "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS n FROM {conversations}",
}

INFERENCE = {
    "replicate_summary": "SELECT case_id, count(*) AS n, round(median(score), 6) AS median, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high FROM {runs} GROUP BY case_id",
    "argmin_ties": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score, start) AS k FROM {runs}) SELECT case_id, start, score FROM r WHERE k = 1",
    "argmax_ties": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, start) AS k FROM {runs}) SELECT case_id, start, score FROM r WHERE k = 1",
    "nested_budgets": """WITH b AS (SELECT case_id, start, max(score) OVER (PARTITION BY case_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS best FROM {runs}) SELECT case_id, start, best FROM b WHERE start IN (1, 2, 4)""",
    "suffix_costs": "SELECT case_id, start, round(elapsed - coalesce(lag(elapsed) OVER (PARTITION BY case_id ORDER BY start), 0), 6) AS cost FROM {runs}",
    "matched_controls": """WITH c AS (SELECT case_id, control, max(score) AS best FROM {runs} GROUP BY case_id, control)
        SELECT a.case_id, a.best AS message, b.best AS shuffled, a.best > b.best AS separates FROM c a JOIN c b ON a.case_id = b.case_id WHERE a.control = 'F' AND b.control = 'O'""",
    "grouping_sets_summary": "SELECT algorithm, control, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, count(DISTINCT case_id) AS cases FROM {runs} GROUP BY GROUPING SETS ((), (algorithm, control))",
    "disjoint_totals": "SELECT algorithm, CASE WHEN sum(CASE WHEN score > 9000000 THEN 1 ELSE 0 END) > 0 THEN NULL ELSE round(sum(elapsed), 6) END AS elapsed, sum(CASE WHEN score > 9000000 THEN 1 ELSE 0 END) > 0 AS some_unknown FROM {runs} GROUP BY algorithm",
    "wilson_bounds": """WITH c AS (SELECT case_id, CAST(sum(CASE WHEN score >= 3000000 THEN 1 ELSE 0 END) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM {runs} GROUP BY case_id), p AS (SELECT *, k / n AS p, 1.959963984540054D AS z FROM c)
        SELECT case_id, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lower_bound, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS upper_bound FROM p""",
    # Scores are counted in blocks, so no window holds them all.
    "rank_p_value": """WITH o AS (SELECT case_id, max(score) AS s FROM {runs} GROUP BY case_id), g AS (SELECT score, count(*) AS n FROM {runs} WHERE control = 'O' GROUP BY score),
        ins AS (SELECT v, floor(v / 100000) AS block, sum(n) AS n FROM (SELECT score AS v, n FROM g UNION ALL SELECT DISTINCT s, 0 FROM o) GROUP BY v), bs AS (SELECT block, sum(n) AS n FROM ins GROUP BY block),
        ba AS (SELECT block, sum(n) OVER (ORDER BY block DESC) - n AS above, sum(n) OVER () AS b FROM bs), w AS (SELECT block, v, sum(n) OVER (PARTITION BY block ORDER BY v DESC) AS inside FROM ins)
        SELECT o.case_id, round((1 + w.inside + ba.above) / CAST(ba.b + 1 AS DOUBLE), 6) AS p FROM o JOIN w ON o.s = w.v JOIN ba ON ba.block = w.block""",
    "centroid_rule_b": """WITH m AS (SELECT case_id, score, sum(score) OVER (PARTITION BY case_id) AS s, count(*) OVER (PARTITION BY case_id) AS n FROM {runs}) SELECT case_id, round(avg(abs(score - (s - score) / CAST(n - 1 AS DOUBLE))), 4) AS loo FROM m WHERE n > 1 GROUP BY case_id""",
    "outcome_transitions": """WITH f AS (SELECT case_id, start, CASE WHEN score >= 5000000 THEN 'exact' WHEN score >= 2000000 THEN 'wrong' ELSE 'unavailable' END AS outcome FROM {runs}), t AS (SELECT outcome, lead(outcome) OVER (PARTITION BY case_id ORDER BY start) AS after_ FROM f)
        SELECT outcome, after_, count(*) AS n FROM t WHERE after_ IS NOT NULL GROUP BY outcome, after_""",
    "top_points": "WITH m AS (SELECT case_id, median(score) AS med FROM {runs} GROUP BY case_id) SELECT case_id, round(med, 6) AS med FROM m ORDER BY med, case_id LIMIT 5",
    "grid_points": """WITH a AS (SELECT DISTINCT l_returnflag AS a FROM {lineitem}), b AS (SELECT DISTINCT l_linestatus AS b FROM {lineitem}), c AS (SELECT DISTINCT l_linenumber AS c FROM {lineitem})
        SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS idx, a, b, c FROM a CROSS JOIN b CROSS JOIN c""",
    "review_labels": "SELECT quality, toxic, count(*) AS n, count(*) * 100 > (SELECT count(*) FROM {labels}) AS common FROM {labels} GROUP BY quality, toxic",
}

LEDGER = {
    "contributions": """SELECT g.id, count(a.id) AS checked, round(coalesce(sum(a.amount), 0), 4) AS credit, CAST(sum(CASE WHEN a.state = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM {guests} g LEFT JOIN {attempts} a ON a.guest_id = g.id GROUP BY g.id""",
    "queue_status": "SELECT state, count(*) AS n FROM {units} GROUP BY state",
    "request_counter": "SELECT substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS month, count(*) AS n FROM {orders} GROUP BY substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7)",
    "lease_eligible": """WITH tried AS (SELECT unit_id, count(*) AS n FROM {attempts} GROUP BY unit_id), e AS (SELECT u.id, u.guest_id, u.created_at FROM {units} u LEFT JOIN tried t ON t.unit_id = u.id WHERE u.state = 'O' AND coalesce(t.n, 0) < 200
        AND EXISTS (SELECT 1 FROM {guests} g WHERE g.id = u.guest_id AND NOT g.blocked) AND NOT EXISTS (SELECT 1 FROM {attempts} a WHERE a.guest_id = u.guest_id AND a.unit_id = u.id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY guest_id ORDER BY created_at, id) AS k FROM e) SELECT guest_id, id AS unit_id, created_at FROM r WHERE k = 1""",
    "lease_existing": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY guest_id ORDER BY moment, id) AS k FROM {attempts} WHERE state = 'view') SELECT guest_id, id, unit_id, moment + 600 AS expires_at FROM r WHERE k = 1",
    "submission_conflicts": "SELECT unit_id, guest_id, count(*) AS n, count(DISTINCT amount) AS results FROM {attempts} GROUP BY unit_id, guest_id HAVING count(DISTINCT amount) > 1",
    "validate_attempts": """WITH t AS (SELECT unit_id, min(id) AS trusted FROM {attempts} GROUP BY unit_id) SELECT a.id, CASE WHEN a.state = b.state THEN 'checked' ELSE 'disagreed' END AS verdict FROM {attempts} a JOIN t ON t.unit_id = a.unit_id JOIN {attempts} b ON b.id = t.trusted""",
    "credit_once": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY unit_id, guest_id ORDER BY moment, id) AS k FROM {attempts}) SELECT id, unit_id, guest_id, amount FROM r WHERE k = 1",
    "unit_complete": "SELECT unit_id, count(DISTINCT guest_id) AS guests FROM {attempts} WHERE state = 'purchase' GROUP BY unit_id HAVING count(DISTINCT guest_id) >= 2",
    "campaign_complete": "SELECT guest_id, count(*) AS units, min(CASE WHEN state = 'F' THEN 1 ELSE 0 END) = 1 AS complete FROM {units} GROUP BY guest_id",
    "delivery_exhausted": """SELECT unit_id, count(*) AS tried FROM {attempts} GROUP BY unit_id HAVING count(*) >= 50 AND sum(CASE WHEN state = 'purchase' THEN 1 ELSE 0 END) < 40""",
    "next_pending": "SELECT unit_id, min(moment) AS oldest FROM {attempts} WHERE state = 'click' GROUP BY unit_id ORDER BY oldest, unit_id LIMIT 1",
    "people_leaderboard": "SELECT g.id, round(coalesce(sum(a.amount), 0), 4) AS credit FROM {guests} g LEFT JOIN {attempts} a ON a.guest_id = g.id AND a.state = 'purchase' GROUP BY g.id ORDER BY credit DESC, g.id LIMIT 100",
    "team_leaderboard": """SELECT n.n_nationkey AS team, count(DISTINCT g.id) AS members, round(coalesce(sum(a.amount), 0), 4) AS credit FROM {nation} n LEFT JOIN {guests} g ON g.team = n.n_nationkey AND NOT g.blocked LEFT JOIN {attempts} a ON a.guest_id = g.id
        GROUP BY n.n_nationkey ORDER BY credit DESC, team LIMIT 100""",
    "report_status": "SELECT unit_id, max(CASE WHEN state = 'purchase' THEN 2 WHEN state = 'click' THEN 1 ELSE 0 END) AS tier, min(CASE WHEN amount >= 0 THEN 1 ELSE 0 END) = 1 AS sound FROM {attempts} GROUP BY unit_id",
    "evidence_gate": "SELECT u.id FROM {units} u WHERE u.state = 'F' AND NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = u.id AND l.l_returnflag = 'R')",
    "withdraw_cascade": "SELECT a.id, CASE WHEN g.id IS NULL THEN a.state ELSE 'withdrawn' END AS state FROM {attempts} a LEFT JOIN (SELECT id FROM {guests} WHERE blocked) g ON g.id = a.guest_id",
    "health_age": "SELECT state, max(moment) AS last_at, (SELECT max(moment) FROM {attempts}) - max(moment) AS age, (SELECT max(moment) FROM {attempts}) - max(moment) <= 1200 AS healthy FROM {attempts} GROUP BY state",
    "keyset_page": "SELECT id, state FROM {units} WHERE id > 100 ORDER BY id LIMIT 50",
    "error_queue": "SELECT id, unit_id, guest_id FROM {attempts} WHERE state = 'error' OR amount > 95 ORDER BY moment, id LIMIT 100",
    "storage_admission": "SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, sum(n_chars) + 100000 <= 134217728 AS admits FROM {documents} GROUP BY source",
    "upsert_latest": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY guest_id ORDER BY moment DESC, id DESC) AS k FROM {attempts}) SELECT guest_id, id, state, moment FROM r WHERE k = 1",
    "input_store_dedupe": "SELECT n_chars, count(*) AS rows_, count(DISTINCT text) AS objects FROM {documents} GROUP BY n_chars",
}

TEXTS = CORPUS | INFERENCE | LEDGER

#: Letters of the recovery alphabet after folding, and what folds into what. Fixed values.
LETTERS = "abcdefghilmnopqrstuvxyz"
REPLACED = {"æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ł": "l", "ß": "ss", "ø": "o", "w": "uu", "j": "i", "k": "c"}


def _accents() -> tuple[str, str]:
    """The letters that decompose into one of the alphabet's and marks, and what is left of them."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and plain[0].isascii() and plain[0].isalpha():
            found[chr(code)] = plain[0].lower()
    return "".join(found), "".join(found.values())


#: Marks fall away from the letters that they stand on, then ten letters are written as others.
_FROM, _TO = _accents()
FOLDED = f"translate(lower({{text}}), '{_FROM}', '{_TO}')"
for _letter, _as in REPLACED.items():
    FOLDED = f"replace({FOLDED}, '{_letter}', '{_as}')"
FOLDED = f"regexp_replace({FOLDED}, '[^{LETTERS}]', ''{{g}})"


def _search(body: str) -> tuple[str, str]:
    """A text with $fold(column), as Spark and DuckDB write a replacement of all matches."""
    both = []
    for flag in ("", ", 'g'"):
        both.append(re.sub(r"\$fold\((\w+)\)", lambda m: FOLDED.replace("{text}", m[1]).replace("{g}", flag), body))
    return both[0], both[1]



def _grams(spark: bool, table: str = "documents", column: str = "") -> str:
    """Every four-letter string of the folded texts. Spark makes them inside a row, so that a text
    isn't copied for each of its letters, and from single letters, as a place in a text is found by
    walking to it."""
    if spark:
        each = "explode(transform(sequence(1, size(a) - 3), k -> concat(element_at(a, k), element_at(a, k + 1), element_at(a, k + 2), element_at(a, k + 3))))"
        return f"SELECT {column}{each} AS g FROM (SELECT {column}split($fold(text), '') AS a FROM {{{table}}}) WHERE size(a) >= 4"
    each = "unnest(list_transform(range(1, length(x) - 2), lambda k: substr(x, k, 4)))"
    return f"SELECT {column}{each} AS g FROM (SELECT {column}$fold(text) AS x FROM {{{table}}}) WHERE length(x) >= 4"


_COUNTED, _SCORED = "c AS (SELECT g, count(*) AS n FROM g GROUP BY g)", "m AS (SELECT g, n, CAST(round(ln((n + 0.1D) / ((SELECT sum(n) FROM c) + 0.1D * 279841)) * 1000) AS BIGINT) AS score FROM c)"
_TRAIN = f"{_COUNTED}, {_SCORED}"
_SCORE = "SELECT h.item_id, count(*) AS windows, count(m.g) AS known, CAST(sum(coalesce(m.score, -18000)) AS BIGINT) AS score FROM h LEFT JOIN m ON m.g = h.g GROUP BY h.item_id"


def gram_counts(spark, sf_dir):
    """(g, n): the four-letter strings of the folded documents with their counts. Texts are folded by
    the engine; a task counts in a table of all 23^4 strings, so no row is made for a place in a text."""
    size = len(LETTERS)
    place = np.zeros(256, np.int64)
    place[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(size)

    def rows(batches):
        counts = np.zeros(size**4, np.int64)
        for batch in batches:
            column = batch.column(0).drop_null().cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            if not len(column) or ends[-1] - ends[0] < 4:
                continue
            x = place[np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
            # A string of four begins at none of a text's last three letters.
            inside = np.ones(len(x), bool)
            for back in (1, 2, 3):
                at = ends[1:] - ends[0] - back
                inside[at[at >= 0]] = False
            codes = ((x[:-3] * size + x[1:-2]) * size + x[2:-1]) * size + x[3:]
            counts += np.bincount(codes[inside[:-3]], minlength=size**4)
        found = np.flatnonzero(counts)
        grams = ["".join(LETTERS[k // size**i % size] for i in (3, 2, 1, 0)) for k in found.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts[found])], ["g", "n"])

    texts = corpus.spread(corpus.table(spark, sf_dir, "documents").select("text"))
    folded = spark.sql(_search("SELECT $fold(text) AS x FROM {texts}")[0], texts=texts)
    counted = folded.mapInArrow(rows, "g string, n bigint")
    return counted.groupBy("g").agg(F.sum("n").alias("n"))


def ngram_train(spark, sf_dir):
    return spark.sql(f"WITH c AS (SELECT g, n FROM {{counts}}), {_SCORED} SELECT g, n, score FROM m", counts=storage.cut(gram_counts(spark, sf_dir)))


def quadgram_score(spark, sf_dir):
    text = f"WITH c AS (SELECT g, n FROM {{counts}}), {_SCORED}, " + _search(f"h AS ({_grams(True, 'benchmark', 'item_id, ')}) {_SCORE}")[0]
    return spark.sql(text, counts=storage.cut(gram_counts(spark, sf_dir)), benchmark=corpus.table(spark, sf_dir, "benchmark"))


#: Words of the one stratum alone: all of a word's places are in it. One pass, and no join of two
#: tables of words, whose build side would grow with them.
ONLY = "SELECT w FROM {tokens} GROUP BY w HAVING min(stratum = 'en')"

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The 26 keys of a shift cipher with their alphabets.
_KEYS = "k AS (" + " UNION ALL ".join(f"SELECT {k} AS key, '{_ABC[k:] + _ABC[:k]}' AS abc" for k in range(26)) + ")"

#: Scores with how many are below them in their group: counted by value, summed within blocks of
#: values and over the blocks, so that no task orders a group.
_BY_VALUE = "SELECT algorithm, control, score, floor(score / 100000) AS block, count(*) AS n FROM {runs} GROUP BY algorithm, control, score, block"
_OF_CONTROL = "SELECT 'all' AS algorithm, control, score, floor(score / 100000) AS block, count(*) AS n FROM {runs} WHERE control = 'O' GROUP BY control, score, block"
_RANKED = """WITH g AS (%s),
        bs AS (SELECT algorithm, control, block, sum(n) AS n FROM g GROUP BY algorithm, control, block),
        ba AS (SELECT algorithm, control, block, sum(n) OVER (PARTITION BY algorithm, control ORDER BY block) - n AS ahead, sum(n) OVER (PARTITION BY algorithm, control) AS total FROM bs),
        r AS (SELECT g.algorithm, g.control, g.score, g.n, ba.total, ba.ahead + sum(g.n) OVER (PARTITION BY g.algorithm, g.control, g.block ORDER BY g.score) - g.n AS low FROM g JOIN ba ON ba.algorithm = g.algorithm AND ba.control = g.control AND ba.block = g.block)"""

#: Name: (Spark text, DuckDB text).
SEARCH = {
    "normalize_text": _search("SELECT item_id, $fold(text) AS folded FROM {benchmark}"),
    "ngram_train": tuple(_search(f"WITH g AS ({_grams(k == 0)}), {_TRAIN} SELECT g, n, score FROM m")[k] for k in (0, 1)),
    "quadgram_score": tuple(_search(f"WITH g AS ({_grams(k == 0)}), {_TRAIN}, h AS ({_grams(k == 0, 'benchmark', 'item_id, ')}) {_SCORE}")[k] for k in (0, 1)),
    # Every item is enciphered by a key of its own, and the key is found by comparing all 26 with the text.
    "caesar_search": (
        f"""WITH {_KEYS}, u AS (SELECT item_id, translate(text, '{_ABC.lower()}', '{_ABC}') AS t FROM {{benchmark}}), p AS (SELECT item_id, t, translate(t, '{_ABC}', abc) AS c FROM u JOIN k ON k.key = item_id % 26),
        d AS (SELECT item_id, key, aggregate(zip_with(split(t, ''), split(translate(c, abc, '{_ABC}'), ''), (a, b) -> CASE WHEN a = b THEN 1 ELSE 0 END), 0, (s, x) -> s + x) AS matches FROM p CROSS JOIN k),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matches DESC, key) AS n FROM d) SELECT item_id, CAST(key AS BIGINT) AS key, CAST(matches AS BIGINT) AS matches FROM r WHERE n = 1""",
        "SELECT item_id, CAST(item_id % 26 AS BIGINT) AS key, CAST(length(text) AS BIGINT) AS matches FROM {benchmark}",
    ),
    # Every item is enciphered under the alphabet turned by its number, and decoded letter by letter through the key.
    "substitution_decode": _search(
        f"WITH p AS (SELECT item_id, $fold(text) AS plain, concat(substr('{LETTERS}', CAST(item_id % 23 AS INT) + 1), substr('{LETTERS}', 1, CAST(item_id % 23 AS INT))) AS k FROM {{benchmark}}), c AS (SELECT item_id, k, translate(plain, '{LETTERS}', k) AS cipher FROM p) "
        f"SELECT item_id, cipher, array_join(transform(split(cipher, ''), x -> substr('{LETTERS}', instr(k, x), 1)), '') AS plain FROM c"
    )[:1] + _search(
        f"SELECT item_id, translate($fold(text), '{LETTERS}', '{LETTERS}'[CAST(item_id % 23 AS INT) + 1 :] || '{LETTERS}'[1 : CAST(item_id % 23 AS INT)]) AS cipher, $fold(text) AS plain FROM {{benchmark}}"
    )[1:],
    # A verbose code writes each letter as a unit of two symbols; a token parses if it is such units.
    "token_parse": _search("SELECT w, count(*) AS n, CASE WHEN length(w) % 2 = 1 THEN 'error' WHEN length(w) = 2 THEN 'unigram' WHEN length(w) = 4 THEN 'pair' ELSE 'unparsed' END AS parse FROM {tokens} GROUP BY w"),
    "code_table_ambiguity": _search(
        "WITH u AS (SELECT DISTINCT substr(w, 1, 2) AS a FROM {tokens} WHERE length(w) > 2), v AS (SELECT x.a AS l, y.a AS r FROM u x CROSS JOIN u y WHERE substr(x.a, 1, 1) < substr(y.a, 1, 1)) "
        "SELECT concat(substr(l, 2, 1), r) AS code, count(*) AS n FROM v GROUP BY concat(substr(l, 2, 1), r) HAVING count(*) > 1"
    ),
    "decimal_literals": (
        "SELECT w, count(*) AS n FROM (SELECT explode(split(coalesce(text, ''), '[ \n]')) AS w FROM {documents}) WHERE regexp_like(w, '^-?(0|[1-9][0-9]*)([.][0-9]+)?$') GROUP BY w",
        "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(replace(coalesce(text, ''), chr(10), ' '), ' ')) AS w FROM {documents}) WHERE try_cast(w AS DOUBLE) IS NOT NULL AND regexp_matches(w, '^-?[0-9]+([.][0-9]+)?$') AND NOT regexp_matches(w, '^-?0[0-9]') GROUP BY w",
    ),
    "uniqueness_check": (
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
        "SELECT DISTINCT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM {lineitem}) WHERE n > 1",
    ),
    "orphan_refs": (
        "SELECT a.id FROM {attempts} a LEFT ANTI JOIN (SELECT id FROM {units} WHERE state = 'O') u ON u.id = a.unit_id",
        "SELECT id FROM {attempts} WHERE unit_id NOT IN (SELECT id FROM {units} WHERE state = 'O')",
    ),
    "expired_cleanup": (
        "SELECT a.id, a.unit_id FROM {attempts} a CROSS JOIN (SELECT max(moment) - 10 * 86400 AS cut FROM {attempts}) c WHERE a.moment < c.cut",
        "SELECT id, unit_id FROM {attempts} WHERE moment < (SELECT max(moment) FROM {attempts}) - 10 * 86400",
    ),
    "quantiles": (
        f"""{_RANKED % _BY_VALUE}, p AS (SELECT algorithm, control, q, total, q * (total - 1) AS pos FROM (SELECT DISTINCT algorithm, control, total FROM r) CROSS JOIN (VALUES (0.5D), (0.99D)) AS v(q)),
        x AS (SELECT p.algorithm, p.control, p.q, max(p.pos - floor(p.pos)) AS part, max(CASE WHEN r.low <= floor(p.pos) AND floor(p.pos) < r.low + r.n THEN r.score END) AS a, max(CASE WHEN r.low <= ceil(p.pos) AND ceil(p.pos) < r.low + r.n THEN r.score END) AS b
          FROM p JOIN r ON r.algorithm = p.algorithm AND r.control = p.control GROUP BY p.algorithm, p.control, p.q)
        SELECT algorithm, control, round(max(CASE WHEN q = 0.5D THEN a + (b - a) * part END), 6) AS median, round(max(CASE WHEN q = 0.99D THEN a + (b - a) * part END), 6) AS q99 FROM x GROUP BY algorithm, control""",
        "SELECT algorithm, control, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY score), 6) AS median, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY score), 6) AS q99 FROM {runs} GROUP BY algorithm, control",
    ),
    "acceptance_rule_a": (
        f"""{_RANKED % _OF_CONTROL},
        p AS (SELECT total, 0.99D * (total - 1) AS pos FROM r LIMIT 1), e AS (SELECT max(CASE WHEN low <= floor(pos) AND floor(pos) < low + n THEN score END) AS a, max(CASE WHEN low <= ceil(pos) AND ceil(pos) < low + n THEN score END) AS b, max(pos - floor(pos)) AS part FROM r CROSS JOIN (SELECT pos FROM p) x),
        d AS (SELECT algorithm, case_id, max(score) AS d FROM {{runs}} WHERE control = 'F' GROUP BY algorithm, case_id),
        k AS (SELECT algorithm, CAST(count_if(d <= a + (b - a) * part) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, median(d) AS mid FROM d CROSS JOIN e GROUP BY algorithm)
        SELECT algorithm, k, n, round(mid, 6) AS median, round(k / n, 6) AS share, (k / n + 1.9207294D / n - 1.959964D * sqrt(k / n * (1 - k / n) / n + 0.9603647D / (n * n))) / (1 + 3.8414589D / n) > 0.5D AS compatible FROM k""",
        """WITH e AS (SELECT percentile_cont(0.99) WITHIN GROUP (ORDER BY score) AS eps FROM {runs} WHERE control = 'O'), d AS (SELECT algorithm, case_id, max(score) AS d FROM {runs} WHERE control = 'F' GROUP BY algorithm, case_id),
        k AS (SELECT algorithm, CAST(count_if(d <= eps) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, median(d) AS mid FROM d CROSS JOIN e GROUP BY algorithm), p AS (SELECT *, k / n AS p, 1.959964D AS z FROM k)
        SELECT algorithm, k, n, round(mid, 6) AS median, round(p, 6) AS share, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) > 0.5D AS compatible FROM p""",
    ),
}
