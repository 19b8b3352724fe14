"""The ten operators' queries and, where SQL expresses them, their SQL for DuckDB.

Three of them have columns that SQL can't make (seeded hashes, spans of the method's own). Their
other columns are checked by queries of their own: secret_base_spans and mixing_targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, fingerprints, mixing, packing, pii, quality, secrets, sharding, simhash, substrings, tokens


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_secret_scans without the columns that the method adds to."""
    return secrets.op5_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, source_size, target) of op10_mixing, to three digits."""
    from pyspark.sql import functions as F

    docs = common.table(spark, sf_dir, "documents").select("source", common.n_words(F.col("text")).alias("size"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mixing.targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_document_fingerprints": fingerprints.op2_document_fingerprints,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_suffix_array_dedup": substrings.op7_suffix_array_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "secret_base_spans": secret_base_spans,
    "mixing_targets": mixing_targets,
}

_SPACES = r"[\x20\x09-\x0D]"
_COUNT = lambda x, some: f"(length({x}) - length(regexp_replace({x}, '{some}', '', 'g')))"
_CHARS = lambda x: f"length(regexp_replace({x}, '{_SPACES}', '', 'g'))"
_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in quality.BOILERPLATE)
_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACES}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY rid),
li AS (SELECT rid, l, {_CHARS('l')} AS c, len(regexp_split_to_array(l, '{_SPACES}+')) AS n FROM (SELECT rid, unnest(ls) AS l FROM w)),
fails AS (SELECT rid, c FROM li WHERE NOT regexp_matches(l, '[.!?…:;。！？]["''”’»)\\]]*(?:{_SPACES}|\\z)') OR {_COUNT('l', r'[#*$%&|<>{}=~^\\@]')} * 5 > c
  OR ({_COUNT('l', '!')} >= 3 AND {_COUNT('l', '!')} * 4 > n) OR ({_COUNT('l', '[|»›·•]')} >= 2 AND {_COUNT('l', '[|»›·•]')} * 3 >= n) OR {_PHRASES}),
lost AS (SELECT rid, sum(c) AS c FROM fails GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, {_CHARS('t')} AS word_chars, {_COUNT('t', '[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.c, 0) AS lost
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars - lost >= 0.5 * word_chars AS kept FROM m"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """(rid, s, e, rank, kind) of a rule's matches: what stands between them alternates with them."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT rid, s, s + n AS e, {rank} AS rank, '{kind}' AS kind FROM (SELECT rid, unnest(list_transform(range(1, len(ms) + 1), lambda k: {{'s': list_sum(list_transform(gs[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : k - 1], lambda x: length(x))), 0),
      'n': length(ms[k]), 'g': length(ins[k])}}), recursive := true) FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS ins, regexp_split_to_array(t, '{pattern}') AS gs FROM d)) WHERE g >= {least}"""


_BASE = " UNION ALL ".join(_spans(kind, rank, secrets.EXACT.get(kind, pattern), group, least) for rank, (kind, pattern, group, least) in enumerate(secrets.RULES[: secrets.BASE]))
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({_BASE}),
a AS (SELECT rid, count_if(rank = 0) AS n0, count_if(rank = 1) AS n1, count_if(rank = 2) AS n2, string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, rank) AS x FROM f GROUP BY rid)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN a USING (rid)"""

#: Shares by weight of what the sources that stop leave, level by level: the first level that no further source stops at.
_TARGETS = f"""
WITH s AS (SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}+'), lambda x: x <> ''))) AS BIGINT) AS size FROM documents GROUP BY source),
o AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS wt, 3.0 * size AS cap FROM s),
lv AS (SELECT x.source, ((SELECT sum(size) FROM o) - coalesce((SELECT sum(cap) FROM o y WHERE y.cap / y.wt < x.cap / x.wt), 0)) / (SELECT sum(wt) FROM o y WHERE y.cap / y.wt >= x.cap / x.wt) AS level, x.cap / x.wt AS edge FROM o x),
best AS (SELECT min_by(level, edge) AS level FROM lv WHERE level < edge)
SELECT source, size AS source_size, round(CASE WHEN (SELECT level FROM best) IS NULL THEN cap ELSE least(cap, (SELECT level FROM best) * wt) END, 3) AS target FROM o"""

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": _QUALITY, "secret_base_spans": _SECRETS, "mixing_targets": _TARGETS}
