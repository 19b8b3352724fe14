"""The fingerprint in plain SQL over global windows, for comparison at test scale."""


def _entropy(name: str, counts: str) -> str:
    return f"{name} AS (SELECT stratum, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS {name} FROM ({counts}) GROUP BY stratum)"


def _given(name: str, text: str) -> str:
    grams = f"SELECT stratum, substr(x, k, 2) AS p FROM (SELECT stratum, {text} AS x, unnest(range(1, length({text}))) AS k FROM tokens)"
    return f"""{name}_p AS (SELECT stratum, p, count(*) AS n FROM ({grams}) GROUP BY ALL),
    {name} AS (SELECT b.stratum, b.h - f.h AS {name} FROM (SELECT stratum, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM {name}_p GROUP BY stratum) b
      JOIN (SELECT stratum, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT stratum, substr(p, 1, 1) AS a, sum(n) AS n FROM {name}_p GROUP BY ALL) GROUP BY stratum) f USING (stratum))"""


def sql(relations: str, names: tuple[str, ...]) -> str:
    lengths = ", ".join(f"avg(CASE WHEN least(length(w), 10) = {k} THEN 1.0 ELSE 0.0 END) AS wlen_{k}" for k in range(1, 11))
    columns = ", ".join(f"round(coalesce({n}, 0.0), 6) + 0.0 AS {n}" for n in names)
    return f"""WITH {relations},
    s AS (SELECT stratum, line_no, page_no, i, w, n_words, para_start, row_number() OVER (PARTITION BY stratum ORDER BY page_no, line_no, i) - 1 AS pos, count(*) OVER (PARTITION BY stratum) AS total FROM tokens),
    ty AS (SELECT stratum, w, count(*) AS n FROM tokens GROUP BY ALL),
    gl AS (SELECT stratum, g, count(*) AS n FROM (SELECT stratum, unnest(string_split(w, '')) AS g FROM tokens) GROUP BY ALL),
    h0 AS (SELECT stratum, log2(count(*)) AS h0 FROM gl GROUP BY stratum),
    {_entropy("h1", "SELECT stratum, n FROM gl UNION ALL SELECT stratum, count(*) FROM tokens GROUP BY stratum")},
    {_given("h2", "' ' || w || ' '")}, {_given("h2_word", "w")},
    {_entropy("h_initial", "SELECT stratum, substr(w, 1, 1) AS g, count(*) AS n FROM tokens GROUP BY ALL")},
    {_entropy("h_final", "SELECT stratum, right(w, 1) AS g, count(*) AS n FROM tokens GROUP BY ALL")},
    wl AS (SELECT stratum, avg(length(w)) AS wlen_mean, stddev_pop(length(w)) AS wlen_sd, {lengths} FROM tokens GROUP BY stratum),
    hx AS (SELECT stratum, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS hapax_frac FROM ty GROUP BY stratum),
    zf AS (SELECT stratum, coalesce(regr_slope(ln(n), ln(r)), 0.0) AS zipf_slope FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, w) AS r FROM ty) WHERE r <= 500 GROUP BY stratum),
    pv AS (SELECT *, lag(pos) OVER (PARTITION BY stratum, w ORDER BY pos) AS prev, lag(w) OVER (PARTITION BY stratum ORDER BY pos) AS lft, least(500, total) AS wd FROM s),
    st AS (SELECT stratum, sum(greatest(0, least(pos, total - wd) - greatest(pos - wd + 1, coalesce(prev, -1) + 1, 0) + 1)) / max((total - wd + 1) * wd) AS mattr500,
      avg(CASE WHEN pos - prev <= 10 THEN 1.0 ELSE 0.0 END) AS recent_repeat_10, avg(CASE WHEN pos - prev <= 100 THEN 1.0 ELSE 0.0 END) AS recent_repeat_100,
      sum(CASE WHEN w = lft THEN 1.0 ELSE 0.0 END) / greatest(count(*) - 1, 1) AS adjacent_same, sum(CASE WHEN levenshtein(w, lft) = 1 THEN 1.0 ELSE 0.0 END) / greatest(count(*) - 1, 1) AS adjacent_edit1 FROM pv GROUP BY stratum),
    ed AS (SELECT stratum, sum(CASE WHEN hit THEN 1.0 ELSE 0.0 END) / count(*) AS line_edit1 FROM (SELECT t.stratum, t.page_no, t.line_no, t.i, bool_or(coalesce(levenshtein(t.w, u.w) <= 1, false)) AS hit
      FROM tokens t LEFT JOIN tokens u ON t.page_no = u.page_no AND t.line_no = u.line_no AND t.i <> u.i AND abs(length(t.w) - length(u.w)) <= 1 GROUP BY ALL) GROUP BY stratum),
    ln_ AS (SELECT stratum, avg(length(words[1])) AS f, avg(length(words[-1])) AS e, avg(CASE WHEN para_start THEN length(words[1]) END) AS p, sum(n_words) / count(*) AS line_len_mean FROM lines GROUP BY stratum),
    al AS (SELECT *, f - wlen_mean AS line_first_len_delta, e - wlen_mean AS line_last_len_delta, p - wlen_mean AS para_first_len_delta
      FROM h0 JOIN h1 USING (stratum) JOIN h2 USING (stratum) LEFT JOIN h2_word USING (stratum) JOIN h_initial USING (stratum) JOIN h_final USING (stratum) JOIN wl USING (stratum) JOIN hx USING (stratum)
      JOIN zf USING (stratum) JOIN st USING (stratum) JOIN ed USING (stratum) JOIN ln_ USING (stratum))
    SELECT stratum, {columns} FROM (SELECT DISTINCT coalesce(lang, '') AS stratum FROM documents) LEFT JOIN al USING (stratum)"""
