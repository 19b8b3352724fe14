"""The queries of a replicated work ledger: leases, submissions, validation, credit, budgets, publication.

RELATIONS derives the ledger's tables from the star schema, alike in Spark and DuckDB. Each query is
written twice: for Spark with joins and aggregates by key, for DuckDB as the ledger's own correlated
conditions, so that the two check each other.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from corpusloom.sources import corpus

#: The ledger's bounds. NOW is a moment within the events.
NOW, LEASE, HEALTHY, STORAGE = 1705500000, 600, 1200, 128_000_000
MONTH = "2024-01"

RELATIONS = {
    "attempt": """SELECT event_id AS id, user_id AS guest_id, $UNIT AS unit_id, $MOMENT AS created_at, $MOMENT + 600 AS expires_at,
        CASE event_type WHEN 'view' THEN 'leased' WHEN 'purchase' THEN 'checked' WHEN 'error' THEN 'disagreed' ELSE 'submitted' END AS state,
        CASE WHEN event_type <> 'view' THEN event_type END AS result_hash, CASE WHEN event_type <> 'view' THEN $MOMENT + 30 END AS submitted_at FROM {events}""",
    "guest": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS user_id, c_acctbal < 0 AS blocked, 1704067200 + c_custkey * 7919 % 1500 * 1800 AS expires_at, concat('token-', c_custkey) AS token FROM {customer}""",
    "profile": "SELECT c_custkey AS user_id, c_name AS display_name, c_custkey % 2 = 1 AS public, c_custkey % 11 = 0 AS moderated FROM {customer} WHERE c_custkey % 3 <> 0",
    "team": "SELECT n_nationkey AS id, n_name AS name, n_nationkey % 7 = 3 AS moderated FROM {nation}",
    "membership": "SELECT c_custkey AS user_id, c_nationkey AS team_id FROM {customer} WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 0",
    "campaign": """SELECT n_nationkey AS id, n_name AS title, CASE n_nationkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'paused' ELSE 'active' END AS status, 1704067200 + n_nationkey * 3600 AS created_at,
        concat('["r', n_nationkey % 4, '","r', n_nationkey % 9, '"]') AS evidence FROM {nation}""",
    "release": "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 4 THEN 'revoked' ELSE 'approved' END AS state FROM {region}",
    "report": "SELECT concat('r', s_suppkey) AS digest, s_nationkey AS campaign_id, CASE WHEN s_suppkey % 2 = 0 THEN 'recovery' ELSE 'archived' END AS tier, s_acctbal < 0 AS withdrawn FROM {supplier}",
    "unit": """SELECT o_orderkey AS id, o_custkey % 25 AS campaign_id, o_orderkey % 5 AS release_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'open' ELSE 'checking' END AS state,
        CAST(floor(o_totalprice) AS BIGINT) AS credit, (o_orderkey % 30 + 1) * 1000 AS reserve_ms, o_orderkey % 3 = 0 AS reserved, CASE WHEN o_orderkey % 3 = 0 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7) END AS reserved_window,
        CASE o_orderkey % 4 WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' END AS trusted_hash, 5 + o_orderkey % 100 AS attempt_limit, o_orderkey * 10 AS input_bytes, $ORDERED AS created_at FROM {orders}""",
    "limits": f"SELECT '{MONTH}' AS window_, 100 AS assignments, 900000000 AS max_assignments, 5000000 AS reserved_ms, 5015000 AS max_reserved_ms, 500 AS requests, 20000 AS max_requests, 25000 AS max_inflight",
    "control": "SELECT 'main' AS id, false AS stopped",
    "health": f"SELECT 'scheduled-maintenance' AS name, {NOW - 300} AS last_success_at, CAST(NULL AS VARCHAR(9)) AS last_error",
}
_SPARK = {"$UNIT": "CAST(get_json_object(props, '$.k') AS BIGINT)", "$MOMENT": "unix_timestamp(ts)", "$ORDERED": "unix_timestamp(o_orderdate)"}
_DUCK = {"$UNIT": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "$MOMENT": "CAST(floor(epoch(ts)) AS BIGINT)", "$ORDERED": "CAST(floor(epoch(o_orderdate)) AS BIGINT)"}


def _with(text: str, names: dict[str, str]) -> str:
    for name, value in names.items():
        text = text.replace(name, value)
    return text


def query(text: str):
    """The text over the relations that it names in braces."""

    def run(spark: SparkSession, sf_dir: str):
        def named(body: str) -> dict:
            return {n: relation(n) if n in RELATIONS else corpus.table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", body))}

        def relation(name: str):
            body = _with(RELATIONS[name], _SPARK)
            return spark.sql(body, **named(body))

        return spark.sql(text, **named(text))

    return run


def oracle(text: str) -> str:
    heads = ", ".join(f"{name} AS ({re.sub('[{}]', '', _with(body, _DUCK))})" for name, body in RELATIONS.items())
    return f"WITH {heads} {text}"


#: A guest's unit: the oldest that passes every condition of a lease. The counts by unit and by guest
#: are made once, by key.
_LEASE = f"""
WITH tried AS (SELECT unit_id, count(*) AS n, count_if(state IN ('submitted', 'checked') OR (state = 'leased' AND expires_at > {NOW})) AS busy FROM {{attempt}} GROUP BY unit_id),
flight AS (SELECT count(*) AS n FROM {{attempt}} WHERE state = 'leased' AND expires_at > {NOW}),
open_units AS (SELECT u.* FROM {{unit}} u JOIN {{campaign}} c ON c.id = u.campaign_id JOIN {{release}} r ON r.id = u.release_id LEFT JOIN tried t ON t.unit_id = u.id CROSS JOIN {{limits}} l CROSS JOIN {{control}} x CROSS JOIN {{health}} h CROSS JOIN flight f
  WHERE NOT x.stopped AND c.status = 'active' AND r.state = 'approved' AND u.state IN ('open', 'checking') AND l.window_ = '{MONTH}'
  AND h.name = 'scheduled-maintenance' AND h.last_success_at BETWEEN {NOW - HEALTHY} AND {NOW} AND h.last_error IS NULL
  AND l.assignments < l.max_assignments AND l.reserved_ms + CASE WHEN u.reserved THEN 0 ELSE u.reserve_ms END <= l.max_reserved_ms AND l.requests + 2000 <= l.max_requests
  AND f.n < l.max_inflight AND coalesce(t.n, 0) < u.attempt_limit AND coalesce(t.busy, 0) < 2),
free AS (SELECT g.id FROM {{guest}} g LEFT ANTI JOIN (SELECT guest_id FROM {{attempt}} WHERE state = 'leased' AND expires_at > {NOW}) a ON a.guest_id = g.id WHERE NOT g.blocked AND g.expires_at > {NOW}),
ranked AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) AS place FROM open_units),
had AS (SELECT DISTINCT a.guest_id, r.place FROM {{attempt}} a JOIN ranked r ON r.id = a.unit_id),
-- The first place that a guest hasn't had: the places up to it are all had.
gaps AS (SELECT guest_id, place, row_number() OVER (PARTITION BY guest_id ORDER BY place) AS k FROM had),
skip AS (SELECT guest_id, max(k) AS n FROM gaps WHERE place = k GROUP BY guest_id)
SELECT f.id AS guest_id, r.id AS unit_id, {NOW + LEASE} AS expires_at FROM free f LEFT JOIN skip s ON s.guest_id = f.id JOIN ranked r ON r.place = coalesce(s.n, 0) + 1"""
_LEASE_ORACLE = f"""
SELECT g.id AS guest_id, u.id AS unit_id, {NOW + LEASE} AS expires_at FROM guest g, unit u JOIN campaign c ON c.id = u.campaign_id JOIN release r ON r.id = u.release_id JOIN limits l ON l.window_ = '{MONTH}' JOIN control x ON x.id = 'main'
WHERE NOT g.blocked AND g.expires_at > {NOW} AND NOT x.stopped AND c.status = 'active' AND r.state = 'approved' AND u.state IN ('open', 'checking')
AND EXISTS (SELECT 1 FROM health WHERE name = 'scheduled-maintenance' AND last_success_at >= {NOW - HEALTHY} AND last_success_at <= {NOW} AND last_error IS NULL)
AND l.assignments < l.max_assignments AND l.reserved_ms + CASE WHEN NOT u.reserved THEN u.reserve_ms ELSE 0 END <= l.max_reserved_ms AND l.requests + 2000 <= l.max_requests
AND (SELECT count(*) FROM attempt WHERE state = 'leased' AND expires_at > {NOW}) < l.max_inflight
AND (SELECT count(*) FROM attempt a WHERE a.unit_id = u.id) < u.attempt_limit
AND (SELECT count(*) FROM attempt a WHERE a.unit_id = u.id AND (a.state IN ('submitted', 'checked') OR (a.state = 'leased' AND a.expires_at > {NOW}))) < 2
AND NOT EXISTS (SELECT 1 FROM attempt a WHERE a.unit_id = u.id AND a.guest_id = g.id)
AND NOT EXISTS (SELECT 1 FROM attempt a WHERE a.guest_id = g.id AND a.state = 'leased' AND a.expires_at > {NOW})
QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY u.created_at, u.id) = 1"""

#: Name: (Spark text, DuckDB text).
PAIRS = {
    "lease": (_LEASE, _LEASE_ORACLE),
    "lease_live": (
        f"""SELECT guest_id, x.id AS id, x.unit_id AS unit_id, x.expires_at AS expires_at FROM (SELECT a.guest_id, min_by(struct(a.id, a.unit_id, a.expires_at), struct(a.created_at, a.id)) AS x FROM {{attempt}} a JOIN {{unit}} u ON u.id = a.unit_id
            JOIN (SELECT id FROM {{release}} WHERE state = 'approved') r ON r.id = u.release_id JOIN (SELECT id FROM {{campaign}} WHERE status = 'active') c ON c.id = u.campaign_id WHERE a.state = 'leased' AND a.expires_at > {NOW} GROUP BY a.guest_id)""",
        f"""SELECT a.guest_id, a.id, a.unit_id, a.expires_at FROM attempt a, unit u, release r, campaign c WHERE u.id = a.unit_id AND r.id = u.release_id AND c.id = u.campaign_id AND a.state = 'leased' AND a.expires_at > {NOW}
            AND r.state = 'approved' AND c.status = 'active' QUALIFY row_number() OVER (PARTITION BY a.guest_id ORDER BY a.created_at, a.id) = 1""",
    ),
    "guest_sessions": (
        f"SELECT id, user_id, blocked FROM {{guest}} WHERE length(sha2(token, 256)) = 64 AND expires_at > {NOW}",
        f"SELECT id, user_id, blocked FROM guest WHERE length(sha256(token)) = 64 AND NOT expires_at <= {NOW}",
    ),
    "user_contributions": (
        f"""WITH paid AS (SELECT a.guest_id, a.id, u.credit FROM {{attempt}} a JOIN {{unit}} u ON u.id = a.unit_id WHERE a.state = 'checked'),
            waiting AS (SELECT guest_id, count(*) AS n FROM {{attempt}} WHERE state = 'submitted' OR (state = 'leased' AND expires_at > {NOW}) GROUP BY guest_id),
            by_guest AS (SELECT guest_id, count(*) AS checked, sum(credit) AS credit FROM paid GROUP BY guest_id)
            SELECT coalesce(g.user_id, -g.id) AS owner, CAST(sum(coalesce(p.checked, 0)) AS BIGINT) AS checked, CAST(sum(coalesce(p.credit, 0)) AS BIGINT) AS credit, CAST(sum(coalesce(w.n, 0)) AS BIGINT) AS pending
            FROM {{guest}} g LEFT JOIN by_guest p ON p.guest_id = g.id LEFT JOIN waiting w ON w.guest_id = g.id GROUP BY coalesce(g.user_id, -g.id)""",
        f"""SELECT coalesce(g.user_id, -g.id) AS owner, CAST((SELECT count(*) FROM attempt a JOIN unit u ON u.id = a.unit_id WHERE a.guest_id = g.id AND a.state = 'checked') AS BIGINT) AS checked,
            CAST((SELECT coalesce(sum(u.credit), 0) FROM attempt a JOIN unit u ON u.id = a.unit_id WHERE a.guest_id = g.id AND a.state = 'checked') AS BIGINT) AS credit,
            CAST((SELECT count(*) FROM attempt a WHERE a.guest_id = g.id AND (a.state = 'submitted' OR (a.state = 'leased' AND a.expires_at > {NOW}))) AS BIGINT) AS pending FROM guest g""",
    ),
    "status_page": (
        f"""SELECT 'campaign' AS what, title AS name, CAST(NULL AS BIGINT) AS n FROM (SELECT title FROM {{campaign}} WHERE status <> 'draft' ORDER BY created_at DESC LIMIT 50)
            UNION ALL SELECT 'queue', state, count(*) FROM {{unit}} GROUP BY state UNION ALL SELECT 'open', CASE WHEN c.stopped OR NOT (h.last_success_at BETWEEN {NOW - HEALTHY} AND {NOW} AND h.last_error IS NULL) THEN 'closed' ELSE 'assigning' END, NULL FROM {{control}} c CROSS JOIN {{health}} h""",
        f"""SELECT 'campaign' AS what, title AS name, CAST(NULL AS BIGINT) AS n FROM campaign WHERE status <> 'draft' UNION ALL SELECT 'queue', state, count(*) FROM unit GROUP BY state
            UNION ALL SELECT 'open', CASE WHEN (SELECT stopped FROM control) OR NOT EXISTS (SELECT 1 FROM health WHERE {NOW} - last_success_at <= {HEALTHY} AND last_error IS NULL) THEN 'closed' ELSE 'assigning' END, NULL""",
    ),
    "submission_verdicts": (
        """WITH k AS (SELECT a.*, r.state AS release_state, first_value(a.result_hash, true) OVER (PARTITION BY a.unit_id, a.guest_id ORDER BY a.created_at, a.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first FROM {attempt} a JOIN {unit} u ON u.id = a.unit_id JOIN {release} r ON r.id = u.release_id)
            SELECT id, CASE WHEN release_state <> 'approved' THEN 'revoked' WHEN first IS NULL THEN 'received' WHEN first = result_hash THEN 'duplicate' ELSE 'conflict' END AS verdict FROM k WHERE result_hash IS NOT NULL""",
        """, f AS (SELECT unit_id, guest_id, arg_min(result_hash, (created_at, id)) AS first, arg_min(id, (created_at, id)) AS at FROM attempt WHERE result_hash IS NOT NULL GROUP BY ALL)
            SELECT a.id, CASE WHEN r.state <> 'approved' THEN 'revoked' WHEN a.id = f.at THEN 'received' WHEN f.first = a.result_hash THEN 'duplicate' ELSE 'conflict' END AS verdict
            FROM attempt a JOIN f USING (unit_id, guest_id) JOIN unit u ON u.id = a.unit_id JOIN release r ON r.id = u.release_id WHERE a.result_hash IS NOT NULL""",
    ),
    "validated": (
        """SELECT a.id, CASE WHEN a.result_hash = u.trusted_hash THEN 'checked' ELSE 'disagreed' END AS state FROM {attempt} a JOIN (SELECT id, release_id, trusted_hash FROM {unit} WHERE trusted_hash IS NOT NULL) u ON u.id = a.unit_id
            LEFT SEMI JOIN (SELECT id FROM {release} WHERE state = 'approved') r ON r.id = u.release_id WHERE a.state = 'submitted'""",
        """SELECT a.id, CASE WHEN a.result_hash IS NOT DISTINCT FROM u.trusted_hash THEN 'checked' ELSE 'disagreed' END AS state FROM attempt a, unit u WHERE u.id = a.unit_id AND u.trusted_hash IS NOT NULL AND a.state = 'submitted'
            AND EXISTS (SELECT 1 FROM release WHERE release.id = u.release_id AND state = 'approved')""",
    ),
    "credit_insert": (
        """SELECT x.id AS attempt_id, unit_id, guest_id, amount FROM (SELECT a.unit_id, a.guest_id, max(u.credit) AS amount, min_by(struct(a.id), struct(a.created_at, a.id)) AS x FROM {attempt} a JOIN {unit} u ON u.id = a.unit_id JOIN {release} r ON r.id = u.release_id
            WHERE a.state = 'checked' AND r.state = 'approved' GROUP BY a.unit_id, a.guest_id)""",
        """SELECT a.id AS attempt_id, a.unit_id, a.guest_id, u.credit AS amount FROM attempt a JOIN unit u ON u.id = a.unit_id JOIN release r ON r.id = u.release_id WHERE a.state = 'checked' AND r.state = 'approved'
            AND NOT EXISTS (SELECT 1 FROM attempt b WHERE b.unit_id = a.unit_id AND b.guest_id = a.guest_id AND b.state = 'checked' AND (b.created_at, b.id) < (a.created_at, a.id))""",
    ),
    "completed_units": (
        "SELECT u.id FROM {unit} u LEFT SEMI JOIN (SELECT unit_id FROM {attempt} WHERE state = 'checked' GROUP BY unit_id HAVING count(*) >= 2) a ON a.unit_id = u.id",
        "SELECT id FROM unit WHERE (SELECT count(*) FROM attempt WHERE unit_id = unit.id AND state = 'checked') >= 2",
    ),
    "completed_campaigns": (
        "SELECT c.id FROM {campaign} c JOIN (SELECT campaign_id, min(state) AS a, max(state) AS b FROM {unit} GROUP BY campaign_id) u ON u.campaign_id = c.id WHERE c.status IN ('active', 'paused') AND a = 'complete' AND b = 'complete'"
        " UNION ALL SELECT -count(*) AS id FROM {campaign} WHERE status IN ('active', 'paused')",
        "SELECT id FROM campaign WHERE status IN ('active', 'paused') AND EXISTS (SELECT 1 FROM unit WHERE campaign_id = campaign.id) AND NOT EXISTS (SELECT 1 FROM unit WHERE campaign_id = campaign.id AND state <> 'complete')"
        " UNION ALL SELECT -count(*) FROM campaign WHERE status IN ('active', 'paused')",
    ),
    "exhausted_units": (
        f"""SELECT u.id, coalesce(a.n, 0) AS attempts FROM {{unit}} u LEFT JOIN (SELECT unit_id, count(*) AS n, count_if(state = 'checked') AS checked, count_if(state = 'submitted' OR (state = 'leased' AND expires_at > {NOW})) AS waiting FROM {{attempt}} GROUP BY unit_id) a ON a.unit_id = u.id
            WHERE u.state = 'open' AND coalesce(a.n, 0) >= u.attempt_limit AND coalesce(a.checked, 0) < 1000 AND coalesce(a.waiting, 0) < 1000""",
        f"""SELECT id, (SELECT count(*) FROM attempt WHERE unit_id = unit.id) AS attempts FROM unit WHERE state = 'open' AND (SELECT count(*) FROM attempt WHERE unit_id = unit.id) >= attempt_limit
            AND (SELECT count(*) FROM attempt WHERE unit_id = unit.id AND state = 'checked') < 1000 AND (SELECT count(*) FROM attempt WHERE unit_id = unit.id AND (state = 'submitted' OR (state = 'leased' AND expires_at > {NOW}))) < 1000""",
    ),
    "next_to_validate": (
        "SELECT u.id, min(a.submitted_at) AS oldest FROM {unit} u JOIN {attempt} a ON a.unit_id = u.id JOIN {release} r ON r.id = u.release_id WHERE a.state = 'submitted' AND r.state = 'approved' AND u.state IN ('open', 'complete') GROUP BY u.id ORDER BY oldest, u.id LIMIT 1",
        "SELECT id, oldest FROM (SELECT u.id, (SELECT min(submitted_at) FROM attempt WHERE unit_id = u.id AND state = 'submitted') AS oldest FROM unit u WHERE u.state IN ('open', 'complete') AND u.release_id IN (SELECT id FROM release WHERE state = 'approved')) WHERE oldest IS NOT NULL ORDER BY oldest, id LIMIT 1",
    ),
    "carried_reservations": (
        f"SELECT l.window_, l.reserved_ms + coalesce(sum(u.reserve_ms), 0) AS reserved_ms, count(u.id) AS carried FROM {{limits}} l LEFT JOIN (SELECT id, reserve_ms FROM {{unit}} WHERE reserved AND trusted_hash IS NULL AND NOT (reserved_window <=> '{MONTH}')) u ON true GROUP BY l.window_, l.reserved_ms",
        f"SELECT window_, reserved_ms + coalesce((SELECT sum(reserve_ms) FROM unit WHERE reserved AND trusted_hash IS NULL AND (reserved_window IS NULL OR reserved_window <> '{MONTH}')), 0) AS reserved_ms, (SELECT count(*) FROM unit WHERE reserved AND trusted_hash IS NULL AND (reserved_window IS NULL OR reserved_window <> '{MONTH}')) AS carried FROM limits",
    ),
    "monthly_budget": (
        "SELECT date_format(timestamp_seconds(created_at), 'yyyy-MM') AS window_, count(*) AS assignments, count(DISTINCT unit_id) AS units, count(*) < max(l.max_assignments) AS funded FROM {attempt} CROSS JOIN {limits} l GROUP BY date_format(timestamp_seconds(created_at), 'yyyy-MM')",
        "SELECT strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m') AS window_, count(*) AS assignments, count(DISTINCT unit_id) AS units, count(*) < (SELECT max_assignments FROM limits) AS funded FROM attempt GROUP BY ALL",
    ),
    "public_people": (
        """SELECT p.user_id, p.display_name, coalesce(c.credit, 0) AS credit FROM {profile} p LEFT JOIN (SELECT g.user_id, CAST(sum(u.credit) AS BIGINT) AS credit FROM {guest} g JOIN {attempt} a ON a.guest_id = g.id AND a.state = 'checked' JOIN {unit} u ON u.id = a.unit_id WHERE g.user_id IS NOT NULL GROUP BY g.user_id) c
            ON c.user_id = p.user_id WHERE p.public AND NOT p.moderated ORDER BY credit DESC, p.user_id LIMIT 100""",
        """SELECT user_id, display_name, CAST(coalesce((SELECT sum(u.credit) FROM guest g, attempt a, unit u WHERE g.user_id = profile.user_id AND a.guest_id = g.id AND a.state = 'checked' AND u.id = a.unit_id), 0) AS BIGINT) AS credit
            FROM profile WHERE public AND NOT moderated ORDER BY credit DESC, user_id LIMIT 100""",
    ),
    "public_teams": (
        """WITH paid AS (SELECT g.user_id, sum(u.credit) AS credit FROM {guest} g JOIN {attempt} a ON a.guest_id = g.id AND a.state = 'checked' JOIN {unit} u ON u.id = a.unit_id WHERE g.user_id IS NOT NULL GROUP BY g.user_id),
            shown AS (SELECT m.team_id, m.user_id, c.credit FROM {membership} m JOIN {profile} p ON p.user_id = m.user_id AND p.public AND NOT p.moderated LEFT JOIN paid c ON c.user_id = m.user_id)
            SELECT t.id, t.name, count(DISTINCT s.user_id) AS members, CAST(coalesce(sum(s.credit), 0) AS BIGINT) AS credit FROM {team} t LEFT JOIN shown s ON s.team_id = t.id WHERE NOT t.moderated GROUP BY t.id, t.name ORDER BY credit DESC, t.id LIMIT 100""",
        """SELECT t.id, t.name, count(DISTINCT p.user_id) AS members, CAST(coalesce(sum(u.credit), 0) AS BIGINT) AS credit FROM team t LEFT JOIN membership m ON m.team_id = t.id LEFT JOIN profile p ON p.user_id = m.user_id AND p.public AND NOT p.moderated
            LEFT JOIN guest g ON g.user_id = p.user_id LEFT JOIN attempt a ON a.guest_id = g.id AND a.state = 'checked' LEFT JOIN unit u ON u.id = a.unit_id WHERE NOT t.moderated GROUP BY t.id, t.name ORDER BY credit DESC, t.id LIMIT 100""",
    ),
    "report_cascade": (
        """SELECT r.digest, CASE WHEN r.withdrawn THEN 'withdrawn' WHEN x.revoked THEN 'release_revoked' WHEN x.incomplete THEN 'incomplete' ELSE r.tier END AS status FROM {report} r LEFT JOIN (SELECT u.campaign_id, bool_or(s.state <> 'approved') AS revoked, bool_or(u.state <> 'complete') AS incomplete
            FROM {unit} u JOIN {release} s ON s.id = u.release_id GROUP BY u.campaign_id) x ON x.campaign_id = r.campaign_id""",
        """SELECT digest, CASE WHEN withdrawn THEN 'withdrawn' WHEN EXISTS (SELECT 1 FROM unit u JOIN release s ON s.id = u.release_id WHERE u.campaign_id = report.campaign_id AND s.state <> 'approved') THEN 'release_revoked'
            WHEN EXISTS (SELECT 1 FROM unit u WHERE u.campaign_id = report.campaign_id AND u.state <> 'complete') THEN 'incomplete' ELSE tier END AS status FROM report""",
    ),
    "recovery_evidence": (
        """WITH named AS (SELECT id, explode(from_json(evidence, 'array<string>')) AS digest FROM {campaign})
            SELECT n.id, count(*) AS named, count(r.digest) AS found, count(*) = count(r.digest) AS complete FROM (SELECT DISTINCT id, digest FROM named) n LEFT JOIN (SELECT digest FROM {report} WHERE tier = 'recovery' AND NOT withdrawn) r ON r.digest = n.digest GROUP BY n.id""",
        """, named AS (SELECT DISTINCT id, unnest(CAST(evidence AS VARCHAR[])) AS digest FROM (SELECT id, from_json(evidence, '["VARCHAR"]') AS evidence FROM campaign))
            SELECT id, count(*) AS named, count_if(EXISTS (SELECT 1 FROM report r WHERE r.digest = named.digest AND r.tier = 'recovery' AND NOT r.withdrawn)) AS found,
            NOT bool_or(NOT EXISTS (SELECT 1 FROM report r WHERE r.digest = named.digest AND r.tier = 'recovery' AND NOT r.withdrawn)) AS complete FROM named GROUP BY id""",
    ),
    "revoke_cascade": (
        """SELECT a.id, CASE WHEN r.id IS NOT NULL AND a.state IN ('leased', 'submitted') THEN 'revoked' ELSE a.state END AS state FROM {attempt} a JOIN {unit} u ON u.id = a.unit_id LEFT JOIN (SELECT id FROM {release} WHERE state = 'revoked') r ON r.id = u.release_id""",
        """SELECT a.id, CASE WHEN a.state IN ('leased', 'submitted') AND a.unit_id IN (SELECT u.id FROM unit u WHERE u.release_id IN (SELECT id FROM release WHERE state = 'revoked')) THEN 'revoked' ELSE a.state END AS state FROM attempt a WHERE a.unit_id IN (SELECT id FROM unit)""",
    ),
    "counted_requests": (
        f"""SELECT window_, max(requests) AS requests FROM (SELECT window_, requests FROM (SELECT l.window_, l.requests + a.n AS requests FROM {{limits}} l JOIN (SELECT date_format(timestamp_seconds(created_at), 'yyyy-MM') AS window_, count(*) AS n FROM {{attempt}} GROUP BY 1) a ON a.window_ = l.window_)
            UNION ALL SELECT date_format(timestamp_seconds(created_at), 'yyyy-MM'), count(*) FROM {{unit}} GROUP BY 1) GROUP BY window_""",
        """SELECT window_, max(requests) AS requests FROM (SELECT window_, requests + (SELECT count(*) FROM attempt WHERE strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m') = window_) AS requests FROM limits
            UNION ALL SELECT strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m'), count(*) FROM unit GROUP BY 1) GROUP BY window_""",
    ),
    "admitted_inputs": (
        f"SELECT id, upto <= {STORAGE} AS admitted FROM (SELECT u.id, sum(u.input_bytes) OVER (PARTITION BY u.campaign_id ORDER BY u.created_at, u.id ROWS UNBOUNDED PRECEDING) AS upto FROM {{unit}} u)",
        f"SELECT u.id, (SELECT sum(v.input_bytes) FROM unit v WHERE v.campaign_id = u.campaign_id AND (v.created_at, v.id) <= (u.created_at, u.id)) <= {STORAGE} AS admitted FROM unit u",
    ),
    "expired_sessions": (
        f"SELECT id FROM {{guest}} g WHERE expires_at <= {NOW - 86400 * 2} AND NOT EXISTS (SELECT 1 FROM {{attempt}} a WHERE a.guest_id = g.id)",
        f"SELECT id FROM guest WHERE expires_at <= {NOW - 86400 * 2} AND id NOT IN (SELECT guest_id FROM attempt)",
    ),
    "reproduced_units": (
        """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN u.trusted_hash IS NULL THEN 'pending' WHEN a.result_hash = u.trusted_hash THEN 'reproduced' ELSE 'differs' END AS outcome FROM {unit} u JOIN (SELECT unit_id, min_by(result_hash, id) AS result_hash FROM {attempt} WHERE result_hash IS NOT NULL GROUP BY unit_id) a ON a.unit_id = u.id) GROUP BY outcome""",
        """SELECT CASE WHEN u.trusted_hash IS NULL THEN 'pending' WHEN (SELECT a.result_hash FROM attempt a WHERE a.unit_id = u.id AND a.result_hash IS NOT NULL ORDER BY a.id LIMIT 1) = u.trusted_hash THEN 'reproduced' ELSE 'differs' END AS outcome, count(*) AS n
            FROM unit u WHERE u.id IN (SELECT unit_id FROM attempt WHERE result_hash IS NOT NULL) GROUP BY ALL""",
    ),
    "panel_jobs": (
        """SELECT i.item_id, a.algorithm, s.start, dense_rank() OVER (ORDER BY i.item_id, a.algorithm, s.start) - 1 AS job FROM {benchmark} i CROSS JOIN (VALUES ('beam-v1', 1), ('restart-anneal-v1', 8)) AS a(algorithm, starts) JOIN (SELECT id AS start FROM range(64)) s ON s.start < a.starts""",
        """SELECT i.item_id, a.algorithm, s.start, row_number() OVER (ORDER BY i.item_id, a.algorithm, s.start) - 1 AS job FROM benchmark i, (VALUES ('beam-v1', 1), ('restart-anneal-v1', 8)) AS a(algorithm, starts), (SELECT unnest(range(64)) AS start) s WHERE s.start < a.starts""",
    ),
}
QUERIES = {name: query(text) for name, (text, _) in PAIRS.items()}


def _oracle(text: str) -> str:
    return oracle(text) if not text.startswith(",") else oracle("")[:-1] + text


ORACLE_SQL = {name: _oracle(text) for name, (_, text) in PAIRS.items()}
