"""SQL of the registered queries, for any engine that has the tables as views."""

from __future__ import annotations

_CLOG = """
clog AS (
  WITH e AS (
    SELECT event_id, CAST(user_id AS VARCHAR) AS pk, CASE WHEN event_type = 'error' THEN '__deleted' ELSE event_type END AS cid,
           CASE WHEN event_type <> 'error' THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) END AS val, 's' || CAST(event_id % 4 AS VARCHAR) AS site_id
    FROM events),
  v AS (SELECT *, CASE WHEN cid <> '__deleted' THEN row_number() OVER (PARTITION BY site_id, pk, cid ORDER BY event_id) END AS own FROM e)
  SELECT 'user_state' AS tbl, pk, cid, val, site_id, event_id, 0::BIGINT AS seq,
         CAST(coalesce(own, 1 + coalesce(max(own) OVER (PARTITION BY site_id, pk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS col_version,
         CAST(row_number() OVER (PARTITION BY site_id ORDER BY event_id) AS BIGINT) AS db_version
  FROM v)"""
CLOG, COARSE = _CLOG.format(value="round(value * 100)"), _CLOG.format(value="floor(value / 20)")
ORDERS = """
base AS (
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS pk, 'status' AS cid, o_orderstatus AS val, 0::BIGINT AS seq FROM orders
  UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), 'priority', o_orderpriority, 1 FROM orders
  UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), 'cust', CAST(o_custkey AS VARCHAR), 2 FROM orders),
olog AS (
  SELECT pk, cid, val, 'a' AS site_id, 1::BIGINT AS col_version, seq, o_orderkey AS db_version FROM base
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus || '-b2', 'b', 2, 0, o_orderkey FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'priority', 'A' || o_orderpriority, 'b', 1, 1, o_orderkey FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '__deleted', NULL, 'b', 2, 3, o_orderkey FROM orders WHERE o_orderkey % 11 = 0)"""


def _best(log: str, name: str, where: str = "TRUE") -> str:
    """A CTE of the winners of a log."""
    return f"""
{name} AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY pk, cid ORDER BY col_version DESC, val DESC, site_id DESC) AS place FROM {log} WHERE cid <> '__deleted' AND {where})
  WHERE place = 1)"""


def _alive(log: str, name: str, test: str, where: str = "TRUE") -> str:
    """A CTE of the rows of a log; ``test``: how a cell's version must compare with the delete's."""
    return f"""
{name} AS (
  SELECT pk, mcv, dcl, mcv IS NOT NULL AND (dcl IS NULL OR mcv {test} dcl) AS alive FROM (
    SELECT pk, max(CASE WHEN cid <> '__deleted' THEN col_version END) AS mcv, max(CASE WHEN cid = '__deleted' THEN col_version END) AS dcl FROM {log} WHERE {where} GROUP BY pk))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


_PIVOT = "SELECT pk, " + ", ".join(f"max(CASE WHEN cid = '{c}' THEN val END) AS {c}" for c in ("signup", "view", "click", "purchase"))
_NOTIFIED = (
    _with(
        CLOG,
        _best("clog", "old", "db_version <= 100"),
        _best("clog", "now"),
        _alive("clog", "was", ">", "db_version <= 100"),
        _alive("clog", "is_now", ">"),
        """
changed AS (
  SELECT n.pk, string_agg(n.cid, ',' ORDER BY n.cid) AS columns FROM now n LEFT JOIN old o ON n.pk = o.pk AND n.cid = o.cid
  WHERE o.pk IS NULL OR (n.col_version, n.val, n.site_id) > (o.col_version, o.val, o.site_id) GROUP BY n.pk),
touched AS (SELECT DISTINCT pk FROM clog WHERE db_version > 100),
told AS (
  SELECT i.pk, CASE WHEN coalesce(w.alive, FALSE) AND NOT i.alive THEN 'Delete' WHEN NOT coalesce(w.alive, FALSE) AND i.alive THEN 'Insert'
              WHEN coalesce(w.alive, FALSE) AND i.alive AND c.columns IS NOT NULL THEN 'Update' END AS kind, c.columns
  FROM is_now i JOIN touched t ON i.pk = t.pk LEFT JOIN was w ON i.pk = w.pk LEFT JOIN changed c ON i.pk = c.pk)""",
    )
    + "SELECT pk, kind, CASE WHEN kind <> 'Delete' THEN columns END AS changed_columns FROM told WHERE kind IS NOT NULL"
)
_DIRTY = (
    CLOG
    + """,
dirty AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'elsewhere' ELSE tbl END AS tbl, pk,
         CASE WHEN cid = '__deleted' THEN cid WHEN event_id % 10 = 0 THEN 'user_id' WHEN event_id % 10 = 1 THEN 'colour' ELSE cid END AS cid FROM clog)"""
)
_FOLDED = """
last AS (SELECT pk, cid, max(event_id) AS at, arg_max(val, event_id) AS val FROM clog WHERE cid <> '__deleted' GROUP BY pk, cid),
gone AS (SELECT pk, max(event_id) AS at FROM clog WHERE cid = '__deleted' GROUP BY pk)
SELECT l.pk, l.cid, l.val FROM last l LEFT JOIN gone g ON l.pk = g.pk WHERE (g.at IS NULL OR l.at > g.at)"""
PEERS = """
told AS (
  SELECT event_id AS position, 'peer' || CAST(user_id % 20 AS VARCHAR) AS peer_id, CASE WHEN user_id % 7 <> 0 THEN 'id' || CAST(user_id % 7 AS VARCHAR) END AS identity,
         event_type AS topic, value, ts,
         CASE event_id % 6 WHEN 0 THEN '/ip4/10.0.' || CAST(event_id % 200 AS VARCHAR) || '.1' WHEN 1 THEN '/ip4/192.168.0.' || CAST(event_id % 250 AS VARCHAR)
           WHEN 2 THEN '/ip4/172.' || CAST(event_id % 40 AS VARCHAR) || '.0.1' WHEN 3 THEN '/ip4/' || CAST(event_id % 240 AS VARCHAR) || '.8.8.8'
           WHEN 4 THEN '/ip6/' || CASE event_id % 5 WHEN 0 THEN 'fe80::1' WHEN 1 THEN 'fd00::5' WHEN 2 THEN '2001:db8::2' WHEN 3 THEN '::1' ELSE 'ff02::1' END
           ELSE '/dns4/example.org' END
         || '/tcp/' || CAST(4000 + event_id % 7 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '/ws' ELSE '' END
         || CASE WHEN event_id % 5 = 0 THEN '/p2p/relay/p2p-circuit' ELSE '' END || '/p2p/peer' || CAST(user_id % 20 AS VARCHAR) AS address
  FROM events),
classed AS (
  SELECT *, CASE
    WHEN event_id6 = 0 OR event_id6 = 1 THEN 'private'
    WHEN event_id6 = 2 THEN CASE WHEN octet BETWEEN 16 AND 31 THEN 'drop' ELSE 'public' END
    WHEN event_id6 = 3 THEN CASE WHEN first = 127 OR first BETWEEN 224 AND 239 THEN 'drop' WHEN first = 10 THEN 'private' ELSE 'public' END
    WHEN event_id6 = 4 THEN CASE position % 5 WHEN 1 THEN 'private' WHEN 2 THEN 'public' ELSE 'drop' END
    ELSE 'public' END AS class
  FROM (SELECT *, position % 6 AS event_id6, position % 40 AS octet, position % 240 AS first FROM told))"""
_CACHE = (
    PEERS
    + """,
dials AS (SELECT peer_id, topic AS address, date_diff('second', TIMESTAMP '1970-01-01', ts) AS seconds, position, value < 40 AS ok FROM told),
good AS (SELECT peer_id, address, max(position) AS p, max(seconds) AS last_ok_at FROM dials WHERE ok GROUP BY ALL),
cache AS (
  SELECT d.peer_id, d.address, g.last_ok_at, max(d.seconds) AS last_try_at, count(*) FILTER (WHERE NOT ok AND position > p) AS fail_count
  FROM dials d JOIN good g ON d.peer_id = g.peer_id AND d.address = g.address GROUP BY d.peer_id, d.address, g.last_ok_at)"""
)
_TOKENS = (
    PEERS
    + """,
tokens AS (
  SELECT topic, token, platform, peer_id FROM (
    SELECT topic, 'tok' || CAST(position % 50 AS VARCHAR) AS token, CASE WHEN position % 2 = 0 THEN 'fcm' ELSE 'apns' END AS platform, peer_id,
           row_number() OVER (PARTITION BY topic, position % 50 ORDER BY position DESC) AS place FROM told)
  WHERE place = 1 AND token NOT IN ('tok7', 'tok13'))"""
)

_TIED = """
tied AS (
  SELECT CAST(user_id AS VARCHAR) AS pk, CASE WHEN event_type = 'error' THEN '__deleted' ELSE event_type END AS cid,
         CASE WHEN event_type <> 'error' THEN CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) END AS val, 's' || CAST(event_id % 3 AS VARCHAR) AS site_id, event_id % 5 + 1 AS col_version
  FROM events)"""

SQL: dict[str, str] = {
    "lww_winner": _with(CLOG, _best("clog", "w")) + "SELECT tbl, pk, cid, val, site_id, col_version, db_version FROM w",
    "lww_site_tiebreak": _with(COARSE, _best("clog", "w")) + "SELECT pk, cid, val, site_id, col_version FROM w",
    "tombstone_delete_wins": _with(CLOG, _alive("clog", "r", ">")) + "SELECT * FROM r",
    "tombstone_add_wins": _with(CLOG, _alive("clog", "r", ">=")) + "SELECT * FROM r",
    "orders_liveness": _with(ORDERS, _alive("olog", "r", ">")) + "SELECT * FROM r",
    "cellwise_winner": _with(ORDERS)
    + """SELECT pk, cid, val, site_id, col_version FROM (
  SELECT *, row_number() OVER (PARTITION BY pk, cid ORDER BY col_version DESC, coalesce(val, '') DESC, site_id DESC) AS place FROM olog) WHERE place = 1""",
    "converged_cells": _with(ORDERS, _best("olog", "w"), _alive("olog", "r", ">=")) + "SELECT w.pk, cid, val, site_id, col_version FROM w JOIN r ON w.pk = r.pk WHERE alive",
    "materialize_rows": _with(CLOG, _best("clog", "w"), _alive("clog", "r", ">")) + _PIVOT + " FROM w WHERE pk IN (SELECT pk FROM r WHERE alive) GROUP BY pk",
    "materialize_defaults": _with(CLOG, _best("clog", "w"), _alive("clog", "r", ">="))
    + "SELECT pk, "
    + ", ".join(f"coalesce(max(CASE WHEN cid = '{c}' THEN val END), '0') AS {c}" for c in ("signup", "view", "click", "purchase"))
    + ", 'free' AS plan FROM w WHERE pk IN (SELECT pk FROM r WHERE alive) GROUP BY pk",
    "changes_since": _with(CLOG) + "SELECT pk, cid, val, site_id, col_version, seq, db_version FROM clog WHERE db_version > 100",
    "changes_since_with_values": _with(ORDERS)
    + """SELECT l.pk, l.cid, b.val, l.site_id, l.db_version FROM olog l JOIN base b ON l.pk = b.pk AND l.cid = b.cid
WHERE l.db_version > 100 AND l.pk NOT IN (SELECT pk FROM olog WHERE cid = '__deleted')
UNION ALL SELECT pk, cid, NULL, site_id, db_version FROM olog WHERE cid = '__deleted' AND db_version > 100""",
    "apply_changeset": _with(CLOG, _best("clog", "o", "db_version <= 100"), _best("clog", "n", "db_version > 100"))
    + """, j AS (
  SELECT coalesce(o.pk, n.pk) AS pk, coalesce(o.cid, n.cid) AS cid, o.val AS ov, o.site_id AS os, o.col_version AS oc, n.val AS nv, n.site_id AS ns, n.col_version AS nc,
         n.pk IS NOT NULL AND (o.pk IS NULL OR (n.col_version, n.val, n.site_id) > (o.col_version, o.val, o.site_id)) AS won, o.pk IS NULL AS fresh
  FROM o FULL OUTER JOIN n ON o.pk = n.pk AND o.cid = n.cid)
SELECT pk, cid, CASE WHEN won THEN nv ELSE ov END AS val, CASE WHEN won THEN ns ELSE os END AS site_id, CASE WHEN won THEN nc ELSE oc END AS col_version,
       CASE WHEN NOT won THEN 'same' WHEN fresh THEN 'insert' ELSE 'update' END AS outcome FROM j""",
    "apply_idempotent": _with(CLOG, _best("clog", "w")) + "SELECT pk, cid, val, site_id, col_version FROM w",
    "apply_compacted": _with(CLOG, _best("clog", "w"), _alive("clog", "r", ">"))
    + """SELECT w.pk, cid, val, col_version FROM w JOIN r ON w.pk = r.pk WHERE alive
UNION ALL SELECT pk, '__deleted', NULL, dcl FROM r WHERE NOT alive AND dcl IS NOT NULL""",
    "local_write_stamping": """WITH w AS (SELECT event_id, CAST(user_id AS VARCHAR) AS pk, user_id, event_type AS cid FROM events WHERE event_type <> 'error')
SELECT event_id, pk, cid, CAST(row_number() OVER (PARTITION BY pk, cid ORDER BY event_id) + CASE WHEN user_id % 2 = 0 THEN 5 ELSE 0 END AS BIGINT) AS col_version,
       CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS db_version FROM w""",
    "tombstone_stamping": """WITH w AS (SELECT event_id, CAST(user_id AS VARCHAR) AS pk, event_type = 'error' AS dead, CASE WHEN event_type <> 'error' THEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) END AS v FROM events),
m AS (SELECT *, coalesce(max(v) OVER (PARTITION BY pk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most,
       sum(CASE WHEN dead THEN 0 ELSE 1 END) OVER (PARTITION BY pk ORDER BY event_id) AS writes,
       coalesce(bool_or(NOT dead) OVER (PARTITION BY pk ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), FALSE) AS cleared FROM w)
SELECT event_id, pk, CAST(most + row_number() OVER (PARTITION BY pk, writes ORDER BY event_id) AS BIGINT) AS cl, cleared FROM m WHERE dead""",
    "deferred_insert": _with(CLOG)
    + """, named AS (SELECT pk, CASE WHEN cid = 'purchase' AND CAST(val AS BIGINT) > 9000 THEN 'premium' ELSE cid END AS cid FROM clog WHERE cid <> '__deleted'),
n AS (SELECT pk, count(DISTINCT CASE WHEN cid IN ('signup', 'view', 'premium') THEN cid END) AS n_required FROM named GROUP BY pk)
SELECT pk, n_required, n_required = 3 AS complete FROM n""",
    "table_guard": _with(_DIRTY) + "SELECT event_id, tbl, pk, cid FROM dirty WHERE tbl IN ('user_state', 'orders')",
    "column_whitelist": _with(_DIRTY) + "SELECT event_id, tbl, pk, cid FROM dirty WHERE tbl = 'user_state' AND cid IN ('user_id', 'signup', 'view', 'click', 'purchase')",
    "pk_column_guard": _with(_DIRTY) + "SELECT event_id, tbl, pk, cid FROM dirty WHERE tbl = 'user_state' AND cid IN ('signup', 'view', 'click', 'purchase', '__deleted')",
    "conflict_cells": _with(CLOG)
    + """SELECT pk, cid, col_version, count(*) AS n_sites, arg_max(site_id, (val, site_id)) AS winner, max(val) AS val, arg_min(site_id, (val, site_id)) AS last
FROM clog WHERE cid <> '__deleted' GROUP BY pk, cid, col_version HAVING count(*) > 1""",
    "row_clock_max": _with(CLOG) + "SELECT pk, max(col_version) AS max_version FROM clog GROUP BY pk",
    "global_db_version": _with(CLOG, ORDERS) + "SELECT greatest(coalesce(max(v), 0), 7) AS db_version FROM (SELECT max(db_version) AS v FROM clog UNION ALL SELECT max(db_version) FROM olog)",
    "version_vector": _with(CLOG) + "SELECT site_id, max(db_version) AS db_version, count(*) AS n_changes FROM clog GROUP BY site_id",
    "peer_lag": _with(CLOG)
    + """, vv AS (SELECT site_id, max(db_version) AS v FROM clog GROUP BY site_id),
known AS (
  SELECT 'p' || CAST(event_id % 3 AS VARCHAR) AS peer_id, CASE WHEN event_id % 3 = 1 AND site_id = 's2' THEN 's1' ELSE site_id END AS site_id, max(db_version - event_id % 7) AS seen
  FROM clog GROUP BY 1, 2)
SELECT p.peer_id, vv.site_id, vv.v - coalesce(k.seen, 0) AS lag FROM (SELECT DISTINCT peer_id FROM known) p CROSS JOIN vv LEFT JOIN known k ON k.peer_id = p.peer_id AND k.site_id = vv.site_id""",
    "stored_changes_since": _with(CLOG) + "SELECT pk, cid, val, site_id, col_version, seq, db_version FROM clog WHERE db_version > 100",
    "stored_catch_up": _with(CLOG)
    + "SELECT p.peer_id, pk, cid, val, site_id, db_version FROM clog, (VALUES ('p1', 100), ('p2', 130), ('p3', 1000000)) p(peer_id, seen) WHERE db_version > p.seen",
    "catch_up": _with(CLOG)
    + "SELECT p.peer_id, pk, cid, val, site_id, db_version FROM clog, (VALUES ('p0', 0), ('p1', 100), ('p2', 0), ('p3', 1000000)) p(peer_id, seen) WHERE db_version > p.seen",
    "peer_offsets": _with(CLOG) + "SELECT 'p' || CAST(event_id % 3 AS VARCHAR) AS peer_id, max(greatest(db_version - event_id % 7, db_version - event_id % 5)) AS db_version FROM clog GROUP BY 1",
    "offsets_reset": _with(CLOG)
    + "SELECT peer_id, CASE WHEN peer_id NOT IN ('p1', 'p4') THEN v END AS db_version FROM (SELECT 'p' || CAST(event_id % 9 AS VARCHAR) AS peer_id, max(db_version) AS v FROM clog GROUP BY 1)",
    "delta_order": _with(ORDERS) + "SELECT row_number() OVER (ORDER BY db_version, seq, pk, cid, site_id) AS place, pk, cid, site_id, seq, db_version FROM olog WHERE db_version > 100",
    "next_counter": _with(CLOG, ORDERS) + "SELECT greatest(coalesce(max(v), 0), 7) + 1 AS db_version FROM (SELECT max(db_version) AS v FROM clog UNION ALL SELECT max(db_version) FROM olog)",
    "restamp_on_receive": _with(CLOG, ORDERS) + "SELECT pk, cid, val, site_id, col_version, (SELECT max(db_version) + 1 FROM clog) AS db_version FROM olog",
    "apply_with_deletes": _with(CLOG, _best("clog", "w"), _alive("clog", "r", ">="))
    + """SELECT w.pk, cid, val, site_id, col_version FROM w JOIN r ON w.pk = r.pk WHERE alive
UNION ALL SELECT c.pk, '__deleted', NULL, max(c.site_id), c.col_version FROM clog c JOIN r ON c.pk = r.pk WHERE NOT alive AND c.cid = '__deleted' AND c.col_version = r.dcl GROUP BY c.pk, c.col_version""",
    "write_filters": """SELECT event_id, 'user_state' AS tbl, CAST(user_id AS VARCHAR) AS pk FROM events WHERE event_id % 9 > 1 AND event_id % 5 > 1""",
    "topic_filter": """SELECT event_id, event_id % 4 < 2 OR event_type = 'click' AS lenient, event_id % 4 >= 2 AND event_type = 'click' AS strict FROM events WHERE event_id % 4 < 2 OR event_type = 'click'""",
    "wire_rejects": _with(ORDERS)
    + """SELECT CASE WHEN db_version % 3 = 0 THEN 'no object' WHEN db_version % 7 = 0 THEN 'unreadable' WHEN db_version % 5 = 0 THEN 'no key' WHEN db_version % 11 = 0 THEN 'no version' ELSE 'taken' END AS reason, count(*) AS n FROM olog GROUP BY 1""",
    "changeset_pack": _with(CLOG) + "SELECT site_id, db_version // 10 AS changeset, count(*) AS n_changes, min(db_version) AS first_version, max(db_version) AS last_version FROM clog GROUP BY ALL",
    "changeset_unpack": _with(CLOG) + "SELECT site_id, db_version, pk, cid, val, col_version FROM clog",
    "frames_round_trip": _with(ORDERS) + "SELECT pk, cid, val, site_id, col_version, seq, db_version FROM olog",
    "wire_round_trip": _with(ORDERS) + "SELECT pk, cid, val, site_id, col_version, seq, db_version FROM olog",
    "notifications": _NOTIFIED,
    "notification_filter_row": f"SELECT * FROM ({_NOTIFIED}) WHERE pk = '7'",
    "reactive_table": _with(CLOG) + "," + _FOLDED,
    "reactive_row": _with(CLOG) + "," + _FOLDED + " AND l.pk = '3'",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42",
    "row_exists": "SELECT DISTINCT l_orderkey * 2 AS o_orderkey FROM lineitem WHERE l_orderkey * 2 IN (SELECT o_orderkey FROM orders)",
    "row_count": "SELECT count(*) AS n FROM orders",
    "fanout": _with(CLOG) + "SELECT DISTINCT c.site_id, c.db_version // 10 AS changeset, p.peer_id FROM clog c, (VALUES ('p0', 's0'), ('p1', 's1'), ('p4', 's4')) p(peer_id, own) WHERE c.site_id <> p.own",
    "peer_version_latest": _with(PEERS) + "SELECT peer_id, max(position) * 3 AS db_version, max(position) AS position FROM told GROUP BY peer_id",
    "peers_by_identity": _with(PEERS) + "SELECT identity, count(DISTINCT peer_id) AS n_peers, string_agg(DISTINCT peer_id, ',' ORDER BY peer_id) AS peers FROM told WHERE identity IS NOT NULL GROUP BY identity",
    "group_peers": _with(PEERS) + "SELECT DISTINCT peer_id FROM told WHERE peer_id NOT IN ('peer0', 'peer1', 'peer2') AND peer_id NOT IN (SELECT peer_id FROM told WHERE topic = 'error' AND value > 95 AND CAST(peer_id[5:] AS INT) % 3 = 0)",
    "peer_verification": _with(PEERS)
    + """SELECT peer_id, bool_or(topic = 'purchase' AND value > 90) AND NOT bool_or(topic = 'error' AND value > 95 AND CAST(peer_id[5:] AS INT) % 3 = 0) AS verified, bool_or(topic = 'error' AND value > 95 AND CAST(peer_id[5:] AS INT) % 3 = 0) AS rejected
FROM told GROUP BY peer_id""",
    "identity_announced": _with(PEERS)
    + """, ok AS (SELECT peer_id FROM told GROUP BY peer_id HAVING bool_or(topic = 'purchase' AND value > 90) AND NOT bool_or(topic = 'error' AND value > 95 AND CAST(peer_id[5:] AS INT) % 3 = 0)),
last AS (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY position DESC) AS place FROM told WHERE peer_id IN (SELECT peer_id FROM ok))
SELECT peer_id, identity FROM last WHERE place = 1 AND position % 4 <> 0 AND identity IS NOT NULL""",
    "addr_cache_fold": _with(_CACHE) + "SELECT * FROM cache",
    "addr_load_recent": _with(_CACHE) + "SELECT peer_id, address, last_ok_at, fail_count FROM cache WHERE last_ok_at >= 1704240000 - 86400 AND fail_count < 3",
    "addr_gc": _with(_CACHE) + "SELECT peer_id, address, last_ok_at, fail_count FROM cache WHERE last_ok_at < 1704240000 - 86400 OR fail_count >= 3",
    "addr_classify": _with(PEERS)
    + """SELECT position, class, CAST(4000 + position % 7 AS BIGINT) AS port, peer_id AS last_peer, CASE WHEN position % 4 = 0 THEN address || '/p2p/other' ELSE address END AS with_peer
FROM classed""",
    "addr_newest_first": _with(_CACHE)
    + """SELECT peer_id, address, last_ok_at, row_number() OVER (PARTITION BY peer_id ORDER BY last_ok_at DESC, address) AS place
FROM cache WHERE last_ok_at >= 1704240000 - 86400 AND fail_count < 3""",
    "addr_rank": _with(PEERS)
    + """, t AS (SELECT peer_id, address, min(position) AS position, min(CASE WHEN position % 5 = 0 THEN 2 WHEN class = 'private' THEN 0 WHEN class = 'public' THEN 1 END) AS tier FROM classed GROUP BY peer_id, address)
SELECT peer_id, address, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY peer_id ORDER BY tier, position) AS place FROM t WHERE tier IS NOT NULL""",
    "addr_best_per_peer": _with(PEERS)
    + """, s AS (SELECT *, CAST(CASE WHEN position % 2 = 0 AND position % 5 = 0 THEN 4 WHEN position % 5 = 0 THEN 3 WHEN position % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS score FROM told)
SELECT peer_id, address, score FROM (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY score DESC, position) AS place FROM s) WHERE place = 1""",
    "addr_last8": _with(PEERS) + "SELECT peer_id, position, age FROM (SELECT peer_id, position, row_number() OVER (PARTITION BY peer_id ORDER BY position DESC) AS age FROM told) WHERE age <= 8",
    "addr_by_peer": _with(PEERS) + "SELECT peer_id, count(DISTINCT address) AS n, string_agg(DISTINCT address, ',' ORDER BY address) AS addresses FROM told GROUP BY peer_id",
    "addr_snapshot_replace": _with(PEERS) + "SELECT peer_id, arg_max(address, position) || unnest(['', '/x']) AS address FROM told GROUP BY peer_id",
    "peer_counts": _with(PEERS) + "SELECT count(DISTINCT peer_id) AS peers, count(DISTINCT CASE WHEN identity IS NOT NULL THEN peer_id END) AS known, count(DISTINCT topic) AS topics FROM told",
    "presence_intro": _with(PEERS)
    + """, e AS (
  SELECT *, min(CASE WHEN value < 30 THEN position END) OVER (PARTITION BY peer_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM told),
s AS (SELECT topic, peer_id, until, min(position) AS joined FROM e WHERE value >= 30 GROUP BY ALL)
SELECT a.topic, a.peer_id AS newcomer, a.position, s.peer_id AS member
FROM e a JOIN s ON a.value >= 30 AND a.topic = s.topic AND s.joined < a.position AND (s.until IS NULL OR a.position < s.until) AND s.peer_id <> a.peer_id""",
    "presence_members": _with(PEERS) + "SELECT topic, peer_id FROM told GROUP BY topic, peer_id HAVING max(position) % 3 <> 0",
    "token_registry": _with(_TOKENS) + "SELECT * FROM tokens",
    "token_fanout": _with(_TOKENS) + "SELECT t.* FROM tokens t, (VALUES ('click', 'peer1'), ('view', 'peer3')) n(topic, sender) WHERE t.topic = n.topic AND t.peer_id <> n.sender",
    "network_status": _with(PEERS)
    + """SELECT peer_id, coalesce(max(CASE WHEN topic = 'signup' THEN position END) * 2, max(position)) AS db_version,
       arg_max(identity, position) FILTER (WHERE identity IS NOT NULL) AS identity, bool_or(topic = 'purchase' AND value > 90) AS verified FROM told GROUP BY peer_id""",
    "diagnostics_counters": "SELECT " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("signup", "view", "click", "purchase", "error")) + " FROM events",
    "sync_outcome": """SELECT event_id // 20 AS run_id, CASE WHEN count(*) FILTER (WHERE value > 90) > 0 THEN 'Synced' WHEN count(*) FILTER (WHERE value > 60 AND value <= 90) = 0 THEN 'NoPeers' ELSE 'TimedOut' END AS outcome,
       count(*) FILTER (WHERE value > 90) AS synced FROM events GROUP BY 1""",
    "sync_outcome_in_time": """WITH timely AS (
  SELECT * FROM (SELECT event_id // 20 AS run_id, event_id, value, min(event_id) OVER (PARTITION BY event_id // 20) AS begun FROM events) WHERE event_id <= begun + 12),
ending AS (SELECT *, min(CASE WHEN value > 90 THEN event_id END) OVER (PARTITION BY run_id) + 2 AS at_end FROM timely)
SELECT run_id, CASE WHEN count(*) FILTER (WHERE value > 90) > 0 THEN 'Synced' WHEN count(*) FILTER (WHERE value > 60 AND value <= 90) = 0 THEN 'NoPeers' ELSE 'TimedOut' END AS outcome,
       count(*) FILTER (WHERE value > 90) AS synced FROM ending WHERE at_end IS NULL OR event_id <= at_end GROUP BY 1""",
    "latency_percentiles": """SELECT event_type, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.95) AS p95, quantile_cont(c, 0.99) AS p99, avg(c) AS mean, max(c) AS most
FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY event_type""",
    "latency_rank_percentiles": """SELECT event_type, max(c) FILTER (WHERE place = n * 50 // 100) AS p50, max(c) FILTER (WHERE place = n * 95 // 100) AS p95 FROM (
  SELECT event_type, c, row_number() OVER (PARTITION BY event_type ORDER BY c) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n
  FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events)) GROUP BY event_type""",
    "literal_to_json": """SELECT o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN 'null' WHEN 1 THEN '"it''s ' || o_orderpriority || '"' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN 'true' WHEN 4 THEN '-' || o_orderkey || '.5' ELSE '"x''' || lower(to_hex(o_orderkey)) || '''"' END AS json,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'it''s ' || o_orderpriority WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN '1' WHEN 4 THEN '-' || o_orderkey || '.5' ELSE 'x''' || lower(to_hex(o_orderkey)) || '''' END AS bound FROM orders""",
    "sql_write_classify": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN 'orders' WHEN 1 THEN 'tasks' WHEN 2 THEN 'notes' END AS tbl,
  length(CASE o_orderkey % 4 WHEN 0 THEN 'INSERT INTO "orders" (id) VALUES (' || o_orderkey || ')' WHEN 1 THEN '  update tasks SET done = 1 WHERE id = ' || o_orderkey
    WHEN 2 THEN 'DELETE FROM `notes` WHERE id = ' || o_orderkey ELSE 'REPLACE INTO orders VALUES (1)' END) AS n FROM orders""",
    "key_round_trip": "SELECT o_orderkey, 'orders' AS tbl, o_orderpriority || '|' || CAST(o_orderkey AS VARCHAR) AS pk, 'status' AS cid FROM orders",
    "soft_delete_view": """SELECT row_number() OVER (ORDER BY date_trunc('second', o_orderdate) DESC, o_orderkey) AS place, o_orderkey, o_totalprice, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'F'""",
    "rows_by_key": _with(CLOG, _best("clog", "w"), _alive("clog", "r", ">="))
    + """SELECT row_number() OVER (ORDER BY pk) AS place, pk, max(CASE WHEN cid = 'signup' THEN val END) AS signup FROM w WHERE pk IN (SELECT pk FROM r WHERE alive) GROUP BY pk""",
    "names_and_ids": "SELECT event_id, lower(hex(props)) AS id, 'my_' || event_type AS prefix FROM events",
    "message_verified": "SELECT o_orderkey, o_orderkey % 3 <> 0 AS verified FROM orders",
    "bootstrap": _with(ORDERS) + "SELECT pk, cid, val, col_version, seq, db_version FROM olog WHERE site_id = 'a'",
    "gapless_numbering": "SELECT l_orderkey * 8 + l_linenumber AS line, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM lineitem",
    "state_as_of": _with(CLOG, _best("clog", "w", "db_version <= 100")) + "SELECT pk, cid, val, site_id, col_version FROM w",
    "passthrough_join_agg": """SELECT r_name, n_name, count(*) AS n_lines, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= DATE '1995-01-01' GROUP BY r_name, n_name""",
    "passthrough_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS n_lines, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "passthrough_window": """SELECT o_custkey, o_orderkey, place, previous FROM (
  SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS place,
         lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS previous FROM orders) t WHERE place <= 3""",
    "stream_lww": _with(_TIED, _best("tied", "w"), _alive("tied", "r", ">=")) + "SELECT w.pk, cid, val, site_id, col_version FROM w JOIN r ON w.pk = r.pk WHERE alive",
    "stream_event_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "state_log": _with(CLOG)
    + """SELECT pk, cid, val, site_id, col_version FROM (
  SELECT *, row_number() OVER (PARTITION BY pk, cid ORDER BY col_version DESC, val DESC NULLS LAST, site_id DESC) AS place FROM clog) WHERE place = 1""",
    "stream_notifications": f"SELECT t.*, n_raw FROM ({_NOTIFIED}) t JOIN ("
    + _with(CLOG)
    + "SELECT pk, count(*) AS n_raw FROM clog WHERE db_version > 100 GROUP BY pk) r ON t.pk = r.pk",
    "push_debounce": """WITH RECURSIVE t AS (
  SELECT topic, list(moment ORDER BY moment, position) AS ats, list(position ORDER BY moment, position) AS positions
  FROM (SELECT event_type AS topic, date_diff('second', TIMESTAMP '1970-01-01', ts) AS moment, event_id AS position FROM events) GROUP BY topic),
f AS (
  SELECT topic, ats, positions, ats[1] AS fired_at, 'leading' AS edge, positions[1] AS position, 1::BIGINT AS k FROM t
  UNION ALL
  SELECT topic, ats, positions, CASE WHEN w > k THEN fired_at + 3600 ELSE ats[k + 1] END, CASE WHEN w > k THEN 'trailing' ELSE 'leading' END,
         CASE WHEN w > k THEN positions[w] ELSE positions[k + 1] END, CASE WHEN w > k THEN w ELSE k + 1 END
  FROM (SELECT *, len(list_filter(ats, lambda x: x < fired_at + 3600)) AS w FROM f) WHERE w > k OR k < len(ats))
SELECT topic, fired_at, edge, position FROM f""",
}
SQL |= {"stream_debounce": SQL["push_debounce"], "stream_sync_outcome": SQL["sync_outcome_in_time"], "stream_view_from_snapshot": SQL["reactive_table"]}


def _replay_sql() -> str:
    """Batches applied one after the other: the state of a row is each cell's value and clock, whether it is there, and its tombstone."""
    cells = ("signup", "view", "click", "purchase")
    batch = ", ".join(f"max(CASE WHEN cid = '{c}' THEN struct_pack(v := col_version, val := val, site := site_id) END) AS {c}" for c in cells)
    empty = ", ".join(f"NULL::VARCHAR AS x_{c}, NULL::BIGINT AS v_{c}, NULL::VARCHAR AS s_{c}" for c in cells)
    won = ", ".join(f"g.{c} IS NOT NULL AND (r.v_{c} IS NULL OR (g.{c}.v, g.{c}.val, g.{c}.site) > (r.v_{c}, coalesce(r.x_{c}, ''), r.s_{c})) AS w_{c}" for c in cells)
    most = "greatest(0, coalesce(tomb, 0), " + ", ".join(f"coalesce(v_{c}, 0)" for c in cells) + ")"
    any_won = " OR ".join(f"w_{c}" for c in cells)
    default = {"view": "'0'"}
    new = ", ".join(
        f"CASE WHEN dies THEN NULL WHEN sets AND w_{c} THEN b_{c}.val WHEN sets AND NOT there THEN {default.get(c, 'NULL')} ELSE x_{c} END AS x_{c}, "
        f"CASE WHEN dies THEN NULL WHEN sets AND w_{c} THEN b_{c}.v ELSE v_{c} END AS v_{c}, CASE WHEN dies THEN NULL WHEN sets AND w_{c} THEN b_{c}.site ELSE s_{c} END AS s_{c}"
        for c in cells
    )
    shown = " UNION ALL ".join(f"SELECT pk, '{c}' AS cid, x_{c} AS val, coalesce(v_{c}, 0) AS col_version, coalesce(s_{c}, '') AS site_id FROM r WHERE k = n AND there AND x_{c} IS NOT NULL" for c in cells)
    return f"""WITH RECURSIVE {CLOG},
batches AS (SELECT pk, event_id // 4 AS arrival, min(CASE WHEN cid = '__deleted' THEN col_version END) AS gone, {batch} FROM clog GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY arrival) AS k, count(*) OVER (PARTITION BY pk) AS n FROM batches),
r AS (
  SELECT pk, 0::BIGINT AS k, n, FALSE AS there, NULL::BIGINT AS tomb, {empty} FROM g WHERE k = 1
  UNION ALL
  SELECT pk, k + 1, n, CASE WHEN dies THEN FALSE ELSE there OR sets END, CASE WHEN dies THEN gone ELSE tomb END, {new}
  FROM (SELECT *, gone IS NOT NULL AND gone >= {most} AS dies, gone IS NULL AND ({any_won}) AND (there OR w_signup) AS sets
    FROM (SELECT r.*, g.gone, {", ".join(f"g.{c} AS b_{c}" for c in cells)}, {won} FROM r JOIN g ON g.pk = r.pk AND g.k = r.k + 1)))
{shown}"""


SQL["replay_fold"] = _replay_sql()
SQL["meta_upsert"] = """SELECT r_name AS key, CASE WHEN r_name = 'ASIA' THEN 'changed' ELSE CAST(r_regionkey AS VARCHAR) END AS value FROM region UNION ALL SELECT 'NOWHERE', 'new'"""
SQL["database_paths"] = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/data/' || o_orderkey || '.db' ELSE o_orderkey || '.db' END AS path FROM orders"""


def _mac_sql(message: str) -> str:
    """The keyed digest of a text with its two padded keys written out."""
    import hashlib

    key = hashlib.sha256(b"passphrase").digest().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


SQL["message_mac"] = "SELECT o_orderkey, " + _mac_sql("CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus") + " AS mac FROM orders"
SQL["topics"] = "SELECT event_type, " + _mac_sql("'topic:' || event_type") + " AS topic FROM (SELECT DISTINCT event_type FROM events)"
