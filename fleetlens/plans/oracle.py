"""DuckDB SQL equal in meaning to each registered query (same column names).

The driver tables are registered as views of the same names.  Written
independently of the Spark code: windows and correlated / lateral subqueries
where the Spark side uses aggregates, joins and generated grids.
"""

import re

from fleetlens.fixed import (CAPTURE_TYPE, LOCAL_RUNNER, PROBE_WAIT_LOCAL_S,
                             PROBE_WAIT_REMOTE_S, REMOTE_RUNNER, TRANSMIT_TYPE,
                             URI_SCHEME)

LINE_ORDER_SQL = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
                  "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
LINE_ORDER_DESC_SQL = ", ".join(c.strip() + " DESC" for c in LINE_ORDER_SQL.split(","))
DUP_ORDER_SQL = ("l_partkey, l_suppkey, l_quantity, l_extendedprice, "
                 "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
DUP_ORDER_DESC_SQL = ", ".join(c.strip() + " DESC" for c in DUP_ORDER_SQL.split(","))
LINE_COLS_SQL = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
                 "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
URL_PARTS = f"""
  SELECT page_id,
         regexp_extract(url, '{SCHEME}([^/?#]*)', 1) AS origin,
         regexp_extract(url, '{SCHEME}[^/?#]*([^?#]*)', 1) AS path
  FROM pages"""
PATH_PARTS = f"""
  SELECT page_id, origin, path,
         CASE WHEN strpos(path, '/') = 0 THEN '.' WHEN regexp_matches(path, '^/[^/]*$') THEN '/'
              ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent,
         regexp_extract(path, '[^/]*$') AS basename
  FROM ({URL_PARTS}) u"""

EXPLODE_TASKS = """
SELECT event_id, user_id, CAST(t.ord - 1 AS INTEGER) AS pos, t.task,
       json_extract_string(props, '$."' || t.task || '"') AS task_config, t.task AS prefix
FROM events, unnest(json_keys(props)) WITH ORDINALITY AS t(task, ord)
"""

EXPLODE_PARAMS = """
SELECT o_orderkey, CAST(0 AS INTEGER) AS pos, 'status' AS key, o_orderstatus AS value FROM orders
UNION ALL
SELECT o_orderkey, CAST(1 AS INTEGER), 'priority', o_orderpriority FROM orders
UNION ALL
SELECT o_orderkey, CAST(2 AS INTEGER), 'custkey', CAST(o_custkey AS VARCHAR) FROM orders
"""

APPLY_DEFAULTS = """
SELECT d.doc_id, d.lang, l.doc_id IS NOT NULL AS present,
       COALESCE(CASE WHEN l.toxic = 1 THEN 0 END,
                CASE WHEN l.doc_id IS NULL THEN -1 ELSE l.quality END) AS quality,
       CASE WHEN l.doc_id IS NULL THEN 0 ELSE l.toxic END AS toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

ROUTE_SPECS = """
SELECT e.event_id, e.event_type, r.handler,
       (r.handler IS NOT NULL AND json_exists(e.props, '$.k')) AS accepted,
       CASE WHEN r.handler IS NULL THEN 'unknown_type:' || e.event_type
            WHEN NOT json_exists(e.props, '$.k') THEN 'missing_key:k' END AS reason
FROM events e
LEFT JOIN (VALUES ('click', 'clicks'), ('view', 'views'), ('purchase', 'purchases'),
                  ('signup', 'signups')) r(type, handler)
  ON e.event_type = r.type
"""

CAPTURE_FILTER = """
SELECT doc_id, substring(text, 1, 1500) AS payload, CAST(length(text) AS BIGINT) AS orig_len,
       length(text) > 1500 AS truncated
FROM documents WHERE lang = 'en'
"""

RECONCILE = f"""
WITH c AS (
  SELECT o.o_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
         ROW_NUMBER() OVER (PARTITION BY o.o_orderkey ORDER BY {LINE_ORDER_SQL}) AS rn
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT o_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN rn = 1 THEN 'collected' ELSE 'conflict' END AS status
FROM c
UNION ALL
SELECT o.o_orderkey, NULL, NULL, NULL, 'missing'
FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
"""

RECONCILE_COUNTS = f"""
SELECT status, COUNT(*) AS n_artifacts FROM ({RECONCILE}) t GROUP BY status
"""


def _next(kind_from, kind_to, extra=""):
    return f"""
  SELECT e.*, n.event_id AS next_event_id, n.ts AS next_ts, n.value AS next_value,
         CAST(epoch_us(n.ts) - epoch_us(e.ts) AS BIGINT) AS delay_us
  FROM events e
  LEFT JOIN LATERAL (
    SELECT p.event_id, p.ts, p.value FROM events p
    WHERE p.user_id = e.user_id AND p.event_type = '{kind_to}'
      AND (p.ts > e.ts OR (p.ts = e.ts AND p.event_id > e.event_id))
    ORDER BY p.ts, p.event_id LIMIT 1) n ON TRUE
  WHERE e.event_type = '{kind_from}' {extra}"""


NEXT_EVENT = f"""
SELECT event_id, user_id, ts, next_event_id, next_ts, delay_us FROM ({_next('error', 'purchase')}) x
"""

SWEEP_GRID = """
SELECT '_region' || r || '_segment' || s || '_etype' || t AS run, r AS region, s AS segment, t AS etype
FROM (SELECT DISTINCT r_name AS r FROM region)
CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer)
CROSS JOIN (SELECT DISTINCT event_type AS t FROM events)
"""

FIRST_WINS = f"""
SELECT {LINE_COLS_SQL},
       ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {DUP_ORDER_SQL}) = 1 AS kept
FROM lineitem
"""

LAST_WINS = f"""
SELECT {LINE_COLS_SQL},
       ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {DUP_ORDER_DESC_SQL}) = 1 AS kept
FROM lineitem
"""

FAILURE_ROLLUP = """
SELECT o_custkey, COUNT(*) AS n_tasks,
       COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS n_not_stopped,
       COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n_collect_failed,
       COUNT(*) FILTER (WHERE o_orderstatus = 'P') = 0 AS ok
FROM orders GROUP BY o_custkey
"""

RETRY_OUTCOME = f"""
WITH a AS (
  SELECT l_orderkey, l_returnflag = 'N' AS ok,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS rn
  FROM lineitem),
s AS (
  SELECT l_orderkey, COUNT(*) AS n,
         bool_or(ok) FILTER (WHERE rn = 1) AS f1, bool_or(ok) FILTER (WHERE rn = 2) AS f2
  FROM a WHERE rn <= 2 GROUP BY l_orderkey)
SELECT o.o_orderkey, CAST(COALESCE(s.n, 0) AS BIGINT) AS n_attempts,
       CASE WHEN s.n IS NULL THEN 'skipped' WHEN s.f1 THEN 'ok_first'
            WHEN s.f2 THEN 'ok_retry' ELSE 'failed' END AS outcome
FROM orders o LEFT JOIN s ON s.l_orderkey = o.o_orderkey
"""

REQUIRED_DIRS = f"""
SELECT DISTINCT origin, parent AS dir FROM ({PATH_PARTS}) p
"""

PERIODIC_STATS = """
SELECT date_trunc('hour', ts) AS window_start,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS n,
       SUM(CAST(value AS DECIMAL(28,6))) AS sum_value,
       MIN(value) AS min_value, MAX(value) AS max_value,
       arg_min(value, (ts, event_id)) AS first_value,
       arg_max(value, (ts, event_id)) AS last_value
FROM events GROUP BY 1, 2, 3
"""

ORDER_TASKS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS start_rank,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_DESC_SQL}) AS stop_rank
FROM lineitem
"""

TIMELINE = f"""
WITH c AS (SELECT *, CAST(trunc(l_quantity) AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS s
           FROM lineitem),
t AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q,
         CAST(COALESCE(SUM(q) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at,
         CAST(SUM(q) OVER (PARTITION BY l_orderkey) + 70 AS BIGINT) AS run_end,
         CAST(COALESCE(SUM(s) OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_DESC_SQL}
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stop_wait
  FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, start_at,
       start_at + q AS ready_at, run_end + stop_wait AS stop_at
FROM t
"""

RENDER_PARAMS = """
SELECT l_orderkey,
       string_agg(CAST(l_linenumber AS VARCHAR) || '=' || CAST(l_partkey AS VARCHAR), '&'
                  ORDER BY l_linenumber, l_partkey, l_suppkey) AS params
FROM lineitem GROUP BY l_orderkey
"""

COMMAND_MANIFEST = f"""
WITH m AS (
  SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS prio,
         CAST(4000 + o_custkey % 1000 AS VARCHAR) AS port,
         CASE WHEN o_orderstatus = 'F' THEN 'h' || CAST(o_custkey % 100 AS VARCHAR) ELSE '' END AS host,
         CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN NULL ELSE '' END AS enable
  FROM orders)
SELECT o_orderkey,
       CAST(1 + CASE WHEN st IN ('F', 'O') THEN 1 ELSE 0 END + 1 + 2
            + CASE WHEN enable IS NULL OR enable = '' THEN 1 ELSE 2 END + 2 AS BIGINT) AS argc,
       'bin/xmit'
         || CASE st WHEN 'F' THEN ' generate' WHEN 'O' THEN ' receive' ELSE '' END
         || ' "{URI_SCHEME}' || host || ':' || port
         || CASE WHEN st = 'P' THEN '' ELSE '?latency=' || CAST(o_orderkey % 500 AS VARCHAR) || '&prio=' || prio END
         || '"'
         || ' --prio ' || prio
         || ' --enable' || CASE WHEN enable IS NULL OR enable = '' THEN '' ELSE ' ' || enable END
         || ' --key ' || CAST(o_orderkey AS VARCHAR) AS command,
       'cap -i ' || CASE WHEN strpos(prio, ' ') > 0 THEN '"' || prio || '"' ELSE prio END
         || ' -f "udp port ' || port || '" -s 1500 -w trace/' || CAST(o_orderkey AS VARCHAR) || '.pcapng'
         AS capture_command
FROM m
"""

EXPECTED_ARTIFACTS = f"""
SELECT page_id, path, parent, basename, origin,
       concat_ws('/', 'results', origin, basename) AS destination
FROM ({PATH_PARTS}) p
"""

FLATTEN_PATHS = f"""
WITH f AS (SELECT page_id, origin || parent AS dir, basename AS file FROM ({PATH_PARTS}) p),
m AS (SELECT *, CASE WHEN strpos(dir, '/en') > 0 THEN 0 WHEN strpos(dir, '/fr') > 0 THEN 1 END AS idx
      FROM f),
n AS (SELECT *, CASE idx WHEN 0 THEN '/en' ELSE '/fr' END AS subfolder FROM m WHERE idx IS NOT NULL),
d AS (SELECT *, substr(dir, 1, strpos(dir, subfolder) - 1)
                  || substr(dir, strpos(dir, subfolder) + length(subfolder)) AS dst_dir
      FROM n),
o AS (SELECT page_id, idx, subfolder, dir || '/' || file AS src,
             CASE WHEN dst_dir = '' OR dst_dir LIKE '%/' THEN dst_dir || file
                  ELSE dst_dir || '/' || file END AS dst
      FROM d)
SELECT page_id, src, dst, subfolder,
       ROW_NUMBER() OVER (PARTITION BY dst ORDER BY idx DESC, src DESC, page_id DESC) = 1 AS kept
FROM o
"""

CURRENT_STATUS = """
WITH r AS (
  SELECT user_id, event_type = 'signup' AS s, CAST(floor(value) AS INTEGER) AS rc,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type IN ('signup', 'error'))
SELECT c.c_custkey AS user_id,
       CASE WHEN r.user_id IS NULL OR NOT r.s THEN 'idle' ELSE 'running' END AS status,
       CASE WHEN NOT r.s THEN r.rc END AS returncode
FROM customer c LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.user_id = c.c_custkey
"""

LIFECYCLE_CHECK = """
WITH a AS (
  SELECT event_id, user_id, ts,
         CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop'
                         WHEN 'purchase' THEN 'collect' END AS action
  FROM events WHERE event_type IN ('signup', 'error', 'purchase')),
b AS (
  SELECT *, COALESCE(bool_or(action = 'start') OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS started
  FROM a),
c AS (
  SELECT *, COALESCE(bool_or(action = 'stop' AND started) OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped
  FROM b)
SELECT event_id, user_id, action,
       CASE action
         WHEN 'start' THEN CASE WHEN started THEN 'already_started' ELSE 'ok' END
         WHEN 'stop' THEN CASE WHEN NOT started THEN 'not_started' WHEN stopped THEN 'noop' ELSE 'ok' END
         WHEN 'collect' THEN CASE WHEN NOT started THEN 'not_started'
                                  WHEN NOT stopped THEN 'still_running' ELSE 'ok' END
       END AS verdict
FROM c
"""

LAUNCH_PROBE = f"""
SELECT event_id, user_id, ts,
       NOT COALESCE(delay_us <= 86400000000, false) AS launched,
       CASE WHEN delay_us <= 86400000000 THEN CAST(floor(next_value) AS INTEGER) END AS returncode
FROM ({_next('signup', 'error')}) x
"""

STOP_ESCALATION = f"""
SELECT event_id, user_id, ts,
       CASE WHEN delay_us IS NULL THEN 'not_stopped'
            WHEN delay_us <= 43200000000 THEN 'terminated'
            WHEN delay_us <= 86400000000 THEN 'killed'
            ELSE 'not_stopped' END AS outcome
FROM ({_next('error', 'purchase')}) x
"""

STOP_OUTCOMES = """
SELECT event_id, user_id, ts,
       CASE WHEN before = 'purchase' THEN 'already_exited'
            WHEN exit_ts IS NULL OR exit_ts > ts + INTERVAL 24 HOUR THEN 'not_stopped'
            WHEN exit_ts <= ts + INTERVAL 12 HOUR THEN 'terminated'
            ELSE 'killed' END AS outcome
FROM (SELECT *,
             last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (
               PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
             first_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER (
               PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS exit_ts
      FROM events WHERE event_type IN ('signup', 'error', 'purchase')) x
WHERE event_type = 'error'
"""

ORACLE = {
    "explode_tasks": EXPLODE_TASKS,
    "explode_params": EXPLODE_PARAMS,
    "apply_defaults": APPLY_DEFAULTS,
    "route_specs": ROUTE_SPECS,
    "capture_filter": CAPTURE_FILTER,
    "reconcile": RECONCILE,
    "reconcile_counts": RECONCILE_COUNTS,
    "next_event": NEXT_EVENT,
    "sweep_grid": SWEEP_GRID,
    "first_wins": FIRST_WINS,
    "last_wins": LAST_WINS,
    "failure_rollup": FAILURE_ROLLUP,
    "retry_outcome": RETRY_OUTCOME,
    "required_dirs": REQUIRED_DIRS,
    "periodic_stats": PERIODIC_STATS,
    "order_tasks": ORDER_TASKS,
    "timeline": TIMELINE,
    "render_params": RENDER_PARAMS,
    "command_manifest": COMMAND_MANIFEST,
    "expected_artifacts": EXPECTED_ARTIFACTS,
    "flatten_paths": FLATTEN_PATHS,
    "current_status": CURRENT_STATUS,
    "lifecycle_check": LIFECYCLE_CHECK,
    "launch_probe": LAUNCH_PROBE,
    "stop_escalation": STOP_ESCALATION,
    "stop_outcomes": STOP_OUTCOMES,
}

READ_STATS = """
SELECT event_type AS run, 'u' || CAST(user_id % 4 AS VARCHAR) AS origin,
       event_id, ts, user_id, value, props
FROM events
"""

# append mode emits a window once the watermark (max event time - 1 hour)
# has passed its end
PERIODIC_STATS_STREAM = f"""
SELECT * FROM ({PERIODIC_STATS}) s
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
"""

ORACLE.update({
    "read_stats": READ_STATS,
    "periodic_stats_stream": PERIODIC_STATS_STREAM,
})

# a stream judges the rows that the final watermark (max event time - 1 hour, in milliseconds) has passed; a launch / stop
# outcome is out once its next exit is among them, or once the watermark has passed its deadline
TASK_EVENTS = "event_type IN ('signup', 'error', 'purchase')"
FINAL = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events WHERE {TASK_EVENTS})"
PASSED = f"(SELECT * FROM events WHERE {TASK_EVENTS} AND ts <= {FINAL})"


def _passed(sql: str) -> str:
    return re.sub(r"FROM events( [ep])?\b", lambda m: f"FROM {PASSED}{m[1] or ' events'}", sql)


def _unit(sql: str) -> str:
    return f"SELECT *, 'u' || CAST(user_id % 4 AS VARCHAR) AS unit FROM ({sql}) keyed"


ORACLE["lifecycle_stream"] = _unit(_passed(LIFECYCLE_CHECK))

LIFECYCLE_MONITOR = f"""
SELECT event_id, user_id, 'verdict' AS kind, verdict AS outcome, CAST(NULL AS INTEGER) AS returncode
FROM ({_passed(LIFECYCLE_CHECK)}) v
UNION ALL
SELECT event_id, user_id, 'launch',
       CASE WHEN delay_us <= 86400000000 THEN 'launch_failed' ELSE 'launched' END,
       CASE WHEN delay_us <= 86400000000 THEN CAST(floor(next_value) AS INTEGER) END
FROM ({_passed(_next('signup', 'error'))}) x
WHERE next_ts IS NOT NULL OR ts + INTERVAL 24 HOUR <= {FINAL}
UNION ALL
SELECT event_id, user_id, 'stop',
       CASE WHEN delay_us <= 43200000000 THEN 'terminated'
            WHEN delay_us <= 86400000000 THEN 'killed' ELSE 'not_stopped' END,
       CAST(NULL AS INTEGER)
FROM ({_passed(_next('error', 'purchase'))}) x
WHERE next_ts IS NOT NULL OR ts + INTERVAL 24 HOUR <= {FINAL}
UNION ALL
SELECT l.last_id, l.user_id, 'status',
       CASE WHEN s.user_id IS NULL OR NOT s.s THEN 'idle' ELSE 'running' END,
       CASE WHEN NOT s.s THEN s.rc END
FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_id FROM {PASSED} x GROUP BY user_id) l
LEFT JOIN (SELECT user_id, event_type = 'signup' AS s, CAST(floor(value) AS INTEGER) AS rc,
                  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
           FROM {PASSED} x WHERE event_type IN ('signup', 'error')) s
  ON s.user_id = l.user_id AND s.rn = 1
"""

ORACLE["lifecycle_monitor"] = _unit(LIFECYCLE_MONITOR)

# ---- spec flow on the specs derived from events (one spec per event) -------

SPEC_EVENTS = """
  SELECT event_id, 'results/e' || CAST(event_id AS VARCHAR) AS run,
         props->>'k' AS port, user_id % 2 = 0 AS remote,
         '192.0.2.' || CAST(user_id % 250 AS VARCHAR) AS host,
         CASE event_type WHEN 'click' THEN 'snd' WHEN 'view' THEN 'rcv' ELSE 'fwd' END AS role,
         user_id, value
  FROM events"""

READ_SPECS = """
SELECT 'results/e' || CAST(event_id AS VARCHAR) AS run, CAST(floor(value) AS INTEGER) AS stop_after,
       true AS ignore_stop_order, CAST(2 AS BIGINT) AS n_tasks, false AS malformed
FROM events
"""

SPEC_MANIFEST = f"""
SELECT run, '1' AS task, CAST(0 AS INTEGER) AS pos, '{CAPTURE_TYPE}' AS obj_type,
       '{LOCAL_RUNNER}' AS runner_type,
       'capbin -i if' || CAST(user_id % 4 AS VARCHAR) || ' -f "udp port ' || port
         || '" -s 1500 -w /data/e' || CAST(event_id AS VARCHAR) || '/trace.pcapng' AS command,
       CAST(NULL AS VARCHAR) AS warning
FROM ({SPEC_EVENTS}) s
UNION ALL
SELECT run, '2', CAST(1 AS INTEGER), '{TRANSMIT_TYPE}',
       CASE WHEN remote THEN '{REMOTE_RUNNER}' ELSE '{LOCAL_RUNNER}' END,
       'bin/xmit' || CASE role WHEN 'snd' THEN ' generate' WHEN 'rcv' THEN ' receive' ELSE '' END
         || ' "{URI_SCHEME}' || CASE WHEN role = 'snd' THEN host ELSE '' END || ':' || port
         || '?latency=' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) || '"'
         || ' --statsfile /data/e' || CAST(event_id AS VARCHAR) || '/stats.csv --enable-metrics',
       CASE WHEN role NOT IN ('snd', 'rcv') THEN 'no_subcommand:' || role END
FROM ({SPEC_EVENTS}) s
"""

SPEC_ARTIFACTS = f"""
SELECT run, '1' AS task, CAST(0 AS INTEGER) AS artifact_pos, 'trace' AS role,
       '/data/e' || CAST(event_id AS VARCHAR) || '/trace.pcapng' AS path, 'local' AS origin,
       run || '/local/trace.pcapng' AS destination
FROM ({SPEC_EVENTS}) s
UNION ALL
SELECT run, '2', CAST(0 AS INTEGER), 'stats', '/data/e' || CAST(event_id AS VARCHAR) || '/stats.csv',
       CASE WHEN remote THEN 'u@' || host ELSE 'local' END,
       run || '/' || CASE WHEN remote THEN 'u@' || host ELSE 'local' END || '/stats.csv'
FROM ({SPEC_EVENTS}) s
"""

ORACLE.update({
    "read_specs": READ_SPECS,
    "spec_manifest": SPEC_MANIFEST,
    "spec_artifacts": SPEC_ARTIFACTS,
})

ORACLE.update({
    "decode_run": SWEEP_GRID,
    "write_new": "SELECT * FROM events",
})

# ---- the artifact chain, rejects and the catalog ---------------------------

RECONCILE_FULL = """
WITH f AS (SELECT DISTINCT '/src/p' || p_partkey AS path FROM part WHERE p_partkey % 5 > 0),
x AS (SELECT l.*, 'out/' || (l_orderkey * 7 + l_suppkey % 3) AS destination,
             CASE WHEN l_quantity < 3 THEN 'not_started' WHEN l_quantity < 5 THEN 'not_stopped'
                  WHEN l_quantity < 7 THEN 'no_destination' END AS precheck,
             f.path IS NOT NULL AS here, l_tax < 0.07 AS ok
      FROM lineitem l LEFT JOIN f ON f.path = '/src/p' || l_partkey),
t AS (SELECT *, COALESCE(bool_or(precheck IS NULL AND here AND ok) OVER (
             PARTITION BY l_returnflag, destination
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                      l_linestatus, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS taken FROM x)
SELECT l_returnflag AS run, l_orderkey AS task, l_linenumber, l_partkey, l_suppkey, destination,
       CASE WHEN precheck IS NOT NULL THEN precheck WHEN NOT here THEN 'missing' WHEN taken THEN 'conflict'
            WHEN NOT ok THEN 'error' ELSE 'collected' END AS status
FROM t
"""

SPEC_REJECTS = f"""
SELECT run, NULL::VARCHAR AS task, CASE WHEN event_id % 11 = 1 THEN 'invalid_json' ELSE 'no_tasks' END AS reason,
       NULL::VARCHAR AS warning
FROM ({SPEC_EVENTS}) s WHERE event_id % 11 IN (1, 2)
UNION ALL
SELECT run, '1', NULL, NULL FROM ({SPEC_EVENTS}) s WHERE event_id % 11 NOT IN (1, 2)
UNION ALL
SELECT run, '2', CASE WHEN event_id % 11 = 3 THEN 'unknown_type:unknown' END,
       CASE WHEN event_id % 11 = 3 THEN NULL WHEN event_id % 11 = 4 THEN 'no_subcommand:null'
            WHEN role NOT IN ('snd', 'rcv') THEN 'no_subcommand:' || role END
FROM ({SPEC_EVENTS}) s WHERE event_id % 11 NOT IN (1, 2)
"""

COLLECTED_STATUS = f"""
SELECT a.run, a.task, a.role, a.path, a.destination,
       CASE WHEN a.role = 'trace' AND e.event_id % 4 > 0 OR a.role = 'stats' AND e.event_id % 3 > 0
            THEN 'collected' ELSE 'missing' END AS status
FROM ({SPEC_ARTIFACTS}) a JOIN ({SPEC_EVENTS}) e ON e.run = a.run
WHERE e.event_id % 11 NOT IN (1, 2) AND NOT (e.event_id % 11 = 3 AND a.task = '2')
"""

COLLECTED_CHECKED = f"""
SELECT a.run, a.task, a.role, a.path, a.destination,
       CASE WHEN e.event_id % 13 = 0 OR e.event_id % 5 = 0 THEN 'not_started' WHEN e.event_id % 7 = 0 THEN 'not_stopped'
            WHEN a.role = 'trace' AND e.event_id % 4 > 0 OR a.role = 'stats' THEN 'collected' ELSE 'missing' END AS status
FROM ({SPEC_ARTIFACTS}) a JOIN ({SPEC_EVENTS}) e ON e.run = a.run
WHERE e.event_id % 11 NOT IN (1, 2) AND NOT (e.event_id % 11 = 3 AND a.task = '2')
"""

STOP_ORDER = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS start_rank,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3 = 0, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END,
         l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC,
         l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS stop_rank
FROM lineitem
"""

SPEC_TIMELINE = f"""
WITH c AS (SELECT run, CASE WHEN remote THEN {PROBE_WAIT_REMOTE_S} ELSE {PROBE_WAIT_LOCAL_S} END AS probe,
                  CAST(floor(value) AS BIGINT) AS stop_after FROM ({SPEC_EVENTS}) s)
SELECT run, '1' AS task, 1::BIGINT AS start_rank, 2::BIGINT AS stop_rank, 0::BIGINT AS start_at,
       {PROBE_WAIT_LOCAL_S}::BIGINT AS ready_at, ({PROBE_WAIT_LOCAL_S} + probe + stop_after)::BIGINT AS stop_at FROM c
UNION ALL
SELECT run, '2', 2, 1, {PROBE_WAIT_LOCAL_S}, {PROBE_WAIT_LOCAL_S} + probe, {PROBE_WAIT_LOCAL_S} + probe + stop_after FROM c
"""

ORACLE.update({
    "reconcile_full": RECONCILE_FULL, "spec_rejects": SPEC_REJECTS, "collected_status": COLLECTED_STATUS, "collected_checked": COLLECTED_CHECKED,
    "file_catalog": "SELECT DISTINCT 'event_type=' || event_type || '/unit=' || (user_id % 4) AS dir, true AS filled FROM events",
    "list_tree": """SELECT 'event_type=' || event_type || '/unit=' || (user_id % 4) AS dir, sum(coalesce(strlen(props), 0) + 1)::BIGINT AS bytes
                    FROM events GROUP BY ALL""",
    "stop_order": STOP_ORDER, "spec_timeline": SPEC_TIMELINE,
    "read_stats": """SELECT 'run of ' || event_type AS run, 'u' || (user_id % 4) AS origin, event_id, ts, user_id, value,
                            CASE WHEN event_type <> 'click' THEN props END AS props FROM events""",
})

FLATTEN_EFFECTS = f"""
WITH p AS (SELECT page_id, origin || parent AS dir, basename AS file FROM ({PATH_PARTS}) p),
f AS (SELECT * FROM p UNION ALL SELECT page_id, regexp_replace(dir, '/(en|fr)$', ''), file FROM p WHERE page_id % 4 = 0),
m AS (SELECT *, CASE WHEN strpos(dir, '/en') > 0 THEN '/en' WHEN strpos(dir, '/fr') > 0 THEN '/fr' END AS sub FROM f),
j AS (SELECT dir, CASE WHEN dir LIKE '%/' OR dir = '' THEN dir || file ELSE dir || '/' || file END AS src, sub,
             substr(dir, 1, strpos(dir, sub) - 1) || substr(dir, strpos(dir, sub) + length(sub)) AS to_dir, file FROM m),
k AS (SELECT *, CASE WHEN to_dir LIKE '%/' OR to_dir = '' THEN to_dir || file ELSE to_dir || '/' || file END AS dst FROM j)
SELECT 'emptied' AS what, dir AS path FROM k GROUP BY dir HAVING bool_and(sub IS NOT NULL)
UNION ALL
SELECT DISTINCT 'replaced', src FROM k WHERE sub IS NULL AND src IN (SELECT dst FROM k WHERE sub IS NOT NULL)
  AND src NOT IN (SELECT src FROM k WHERE sub IS NOT NULL)
"""
ORACLE["flatten_effects"] = FLATTEN_EFFECTS
