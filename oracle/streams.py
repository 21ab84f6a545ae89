"""Oracle statements for the streams: the batch form of each."""

from __future__ import annotations

from oracle.ctes import statement as _

_SESS = """SELECT user_id, s, min(ts) AS a, max(ts) AS z, count(*) AS edits, arg_max(props, event_id) AS props
  FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS n
    FROM events)) GROUP BY user_id, s"""
_BURST = """SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start,
    strftime(z + INTERVAL 45 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", edits, props FROM sess"""

_TRY = """SELECT user_id, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_type = 'signup' AS good,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('error', 'signup')"""
_RUN = """SELECT user_id, 0::BIGINT AS rn, 0::BIGINT AS seq, 0 AS c, 0.0::DOUBLE AS f, 0.0::DOUBLE AS u, '' AS outcome
    FROM (SELECT DISTINCT user_id FROM tries)
  UNION ALL
  SELECT user_id, rn, seq,
    CASE outcome WHEN 'blocked' THEN c WHEN 'ok' THEN 0 ELSE CASE WHEN fresh THEN 1 ELSE c + 1 END END,
    CASE WHEN outcome = 'failed' AND fresh THEN t ELSE f END,
    CASE outcome WHEN 'blocked' THEN u WHEN 'ok' THEN 0.0
      ELSE CASE WHEN (CASE WHEN fresh THEN 1 ELSE c + 1 END) >= 3 THEN t + 86400 ELSE 0.0 END END, outcome
  FROM (SELECT r.user_id, e.rn, e.seq, e.t, r.c, r.f, r.u, r.c = 0 OR e.t - r.f > 172800 AS fresh,
      CASE WHEN r.u > e.t THEN 'blocked' WHEN e.good THEN 'ok' ELSE 'failed' END AS outcome
    FROM run r JOIN tries e ON e.user_id = r.user_id AND e.rn = r.rn + 1)"""
_ASK = """SELECT user_id, event_type, event_id AS seq, epoch_us(ts) / 1e6 AS t,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events"""
_HIT = """SELECT user_id, event_type, seq, rn, t AS written, 'miss' AS outcome FROM ask WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.event_type, a.seq, a.rn, CASE WHEN h.written > a.t - 604800 THEN h.written ELSE a.t END,
    CASE WHEN h.written > a.t - 604800 THEN 'hit' ELSE 'miss' END
  FROM hits h JOIN ask a ON a.user_id = h.user_id AND a.event_type = h.event_type AND a.rn = h.rn + 1"""

_THROTTLE = _("SELECT user_id, seq, outcome FROM run WHERE rn > 0", tries=_TRY, run=_RUN)
_CACHE = _("SELECT user_id, event_type, seq, outcome FROM hits", ask=_ASK, hits=_HIT)

STATEMENTS: dict[str, str] = {
    "s1_revision_feed": _("""SELECT user_id, CASE WHEN arg_min(event_type, event_id) = 'view' THEN 'local'
        ELSE arg_max(props, event_id) END AS props
      FROM events GROUP BY user_id HAVING arg_min(event_type, event_id) <> 'error'"""),
    "s2_bursts": _(_BURST, sess=_SESS),
    "s2_closed_bursts": _(_BURST + """ WHERE z + INTERVAL 45 MINUTE <= (SELECT to_timestamp(
        floor(epoch_us(max(ts)) / 1000) / 1000)::TIMESTAMP - INTERVAL 10 MINUTE FROM events)""", sess=_SESS),
    "s3_latest_task_state": _("""SELECT user_id AS run_id, event_type AS task_id, max(event_id) AS seq,
        ['PENDING', 'DISPATCHED', 'PASS', 'FIX', 'ESCALATED'][max(event_id) % 5 + 1] AS state FROM events GROUP BY ALL"""),
    "s4_throttle": _THROTTLE,
    "s4_throttle_stream": _THROTTLE,
    "s5_expiring_cache": _CACHE,
    "s5_expiring_cache_stream": _CACHE,
    # the events come as one batch, before whose end nothing expires
    "s5_first_asked": _("SELECT user_id, event_type, 1 AS misses FROM events GROUP BY ALL"),
    "s6_running_usage": _("""SELECT user_id, round(sum(value), 4) AS spent, count(*) AS calls FROM events
      GROUP BY user_id HAVING count(*) >= 60"""),
    "s7_progress": _("""SELECT user_id, count(*) AS done, count(*) FILTER (WHERE event_type = 'error') AS errors
      FROM events GROUP BY user_id"""),
    "s8_offline_queue": _("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props
      FROM events GROUP BY ALL"""),
}
