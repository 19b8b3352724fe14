"""Registered queries and their SQL equivalents."""

from corpusloom.operators import candidates, distances, generators, panel, search, statistics, sweeps
from corpusloom.sources import corpus, transliteration
from corpusloom.streaming import credit

from . import coordinator, fingerprint_sql, shared

QUERIES: dict = {"fingerprint_v1": statistics.fingerprint}
ORACLE_SQL: dict = {"fingerprint_v1": fingerprint_sql.sql(corpus.SQL, statistics.NAMES)}

QUERIES |= {name: shared.query(text) for name, text in shared.TEXTS.items()}
ORACLE_SQL |= {name: shared.oracle(text) for name, text in shared.TEXTS.items()}

QUERIES |= {name: shared.query(text) for name, (text, _) in shared.SEARCH.items()}
QUERIES |= {"ngram_train": shared.ngram_train, "quadgram_score": shared.quadgram_score, "corpus_differences": shared.query(shared.ONLY)}
ORACLE_SQL |= {name: shared.oracle(text) for name, (_, text) in shared.SEARCH.items()}

QUERIES |= {f"gen_{family}": generators.registered(family) for family in generators.FAMILIES}
QUERIES |= search.QUERIES | panel.QUERIES
QUERIES |= credit.QUERIES | coordinator.QUERIES | {"z_distance_by_label": distances.z_distance}
ORACLE_SQL |= {**credit.ORACLE_SQL, **coordinator.ORACLE_SQL, "z_distance_by_label": distances.SQL}
QUERIES |= sweeps.QUERIES

QUERIES["transliteration_view"] = transliteration.transliteration_view
ORACLE_SQL["transliteration_view"] = shared.oracle(transliteration.SQL)

QUERIES |= candidates.QUERIES
ORACLE_SQL |= candidates.ORACLE_SQL
