"""Oracle statements for plan documents, edits, merges and the revision log."""

from __future__ import annotations

from oracle.ctes import statement as _

_DOC = "SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS st, CAST(o_orderdate AS DATE) AS s FROM orders"
_TYPE = """CASE k % 9 WHEN 0 THEN 'urlaub' WHEN 1 THEN 'resturlaub' WHEN 2 THEN 'sonderurlaub' WHEN 3 THEN 'gleitzeit'
  WHEN 4 THEN 'krank' WHEN 5 THEN 'fortbildung' WHEN 6 THEN 'elternzeit' WHEN 7 THEN 'homeoffice' ELSE '{0}' END"""
_STATUS = "CASE st WHEN 'F' THEN 'beantragt' WHEN 'P' THEN 'abgelehnt' ELSE '{0}' END"

_C = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role, c_acctbal AS bal, 1990 + c_nationkey AS yr FROM customer"
_B = "SELECT * FROM c WHERE role <> 'MACHINERY'"
_M = """SELECT id, name, role, CASE WHEN role <> 'MACHINERY' AND bal BETWEEN 2000 AND 4000 THEN bal + 1 ELSE bal END AS bal, yr
  FROM c WHERE CASE WHEN role = 'MACHINERY' THEN bal >= 3000 ELSE bal >= 0 END"""
_T = """SELECT id, name, role, CASE WHEN role <> 'MACHINERY' AND bal BETWEEN 3000 AND 5000 THEN bal + 2 ELSE bal END AS bal, yr
  FROM c WHERE CASE WHEN role = 'MACHINERY' THEN bal < 500 OR bal >= 6000 ELSE NOT bal BETWEEN -500 AND 2200 END"""
_V = dict(c=_C, vb=_B, vm=_M, vt=_T)
_J = """SELECT i.id, vb.id IS NOT NULL AS ib, vm.id IS NOT NULL AS im, vt.id IS NOT NULL AS it,
    vb.bal AS bb, vm.bal AS mb, vt.bal AS tb, c.name, c.role
  FROM (SELECT id FROM vb UNION SELECT id FROM vm UNION SELECT id FROM vt) i JOIN c ON c.id = i.id
    LEFT JOIN vb ON vb.id = i.id LEFT JOIN vm ON vm.id = i.id LEFT JOIN vt ON vt.id = i.id"""
_K = """SELECT *, CASE WHEN ib AND NOT im THEN 'gone' WHEN NOT im AND it THEN 'theirs'
    WHEN im AND NOT it AND NOT ib THEN 'mine' WHEN im AND NOT it THEN CASE WHEN mb <> bb THEN 'mine' ELSE 'gone' END
    WHEN ib AND mb = bb THEN 'theirs' ELSE 'mine' END AS side FROM j"""

_YB = "SELECT * FROM vb WHERE yr < 2010"
_YM = "SELECT * FROM vm WHERE yr NOT IN (1993, 1994, 1999, 2014) UNION ALL SELECT * FROM vb WHERE yr = 1999"
_YT = "SELECT * FROM vt WHERE yr NOT IN (1995, 1996, 1999, 2010)"
_YJ = """SELECT i.id, i.yr, yb.id IS NOT NULL AS ib, ym.id IS NOT NULL AS im, yt.id IS NOT NULL AS it,
    yb.bal AS bb, ym.bal AS mb, yt.bal AS tb, c.name
  FROM (SELECT id, yr FROM yb UNION SELECT id, yr FROM ym UNION SELECT id, yr FROM yt) i JOIN c ON c.id = i.id
    LEFT JOIN yb ON yb.id = i.id LEFT JOIN ym ON ym.id = i.id LEFT JOIN yt ON yt.id = i.id"""
_YH = """SELECT yr, yr < 2010 AS hb, yr NOT IN (1993, 2014) AS hm, yr NOT IN (1995, 1999, 2010) AS ht,
    yr % 5 = 0 AS lb, yr % 5 = 0 OR yr % 7 = 0 AS lm, yr % 3 = 0 AS lt FROM (SELECT 1990 + n_nationkey AS yr FROM nation)"""
_YV = """SELECT *, CASE WHEN hb AND NOT hm THEN 'drop' WHEN hb AND NOT ht AND lb = lm AND same THEN 'drop'
    WHEN NOT hm THEN 'theirs' WHEN NOT ht THEN 'mine' ELSE 'rows' END AS verdict
  FROM (SELECT h.*, coalesce((SELECT bool_and(ib = im AND mb IS NOT DISTINCT FROM bb) FROM yj WHERE yj.yr = h.yr), true) AS same
    FROM yh h) WHERE hb OR hm OR ht"""

# one list of people and one list of their departments per list, an edit at a time
_ORD = """SELECT c_nationkey AS l, list(c_custkey ORDER BY c_custkey) AS ps, list(CASE WHEN c_custkey % 4 = 0 THEN CAST([] AS VARCHAR[])
    WHEN c_custkey % 4 = 1 AND c_custkey % 5 <> c_custkey % 3 THEN ['D' || (c_custkey % 5), 'D' || (c_custkey % 3)]
    ELSE ['D' || (c_custkey % 5)] END ORDER BY c_custkey) AS ds FROM customer GROUP BY c_nationkey"""
_EDIT = """MATERIALIZED SELECT *, row_number() OVER (PARTITION BY l ORDER BY seq) AS n FROM (
    SELECT CASE WHEN e.event_id % 41 = 0 THEN (c.c_nationkey + 1) % 25 ELSE c.c_nationkey END AS l, e.event_id AS seq,
      CASE e.event_id % 5 WHEN 0 THEN 'assign' WHEN 1 THEN 'unassign' ELSE 'move' END AS op, c.c_custkey AS p,
      CASE WHEN e.event_id % 6 <> 0 THEN 'D' || ((e.event_id // 3) % 5) END AS f,
      CASE WHEN e.event_id % 8 <> 0 THEN 'D' || ((e.event_id // 11) % 5) END AS t,
      CASE WHEN e.event_id % 3 = 0 THEN c.c_custkey + 25 * (e.event_id % 9) END AS b
    FROM events e JOIN customer c ON c.c_custkey = e.event_id * 7 % (SELECT max(c_custkey) FROM customer) + 1)"""
_REPLAY = """SELECT l, CAST(0 AS BIGINT) AS n, ps, ds FROM ord
    UNION ALL
    SELECT l, n, CASE WHEN op = 'move' AND i > 0 THEN list_concat(list_append(p0[1:ins], p), p0[ins + 1:]) ELSE ps END,
      CASE WHEN i = 0 THEN ds WHEN op = 'move' THEN list_concat(list_append(d0[1:ins], own), d0[ins + 1:])
        WHEN op = 'assign' AND t IS NOT NULL AND NOT list_contains(ds[i], t) THEN list_concat(list_append(ds[1:i - 1], list_append(ds[i], t)), ds[i + 1:])
        WHEN op = 'unassign' AND f IS NOT NULL THEN list_concat(list_append(ds[1:i - 1], list_filter(ds[i], lambda x: x <> f)), ds[i + 1:])
        ELSE ds END
    FROM (SELECT *, CASE WHEN b IS NOT NULL THEN CASE WHEN list_contains(p0, b) THEN list_position(p0, b) - 1 ELSE len(p0) END
        ELSE coalesce(list_max(list_filter(range(1, len(p0) + 1),
          lambda k: CASE WHEN t IS NULL THEN len(d0[k]) = 0 ELSE list_contains(d0[k], t) END)), len(p0)) END AS ins
      FROM (SELECT *, list_concat(ps[1:i - 1], ps[i + 1:]) AS p0, list_concat(ds[1:i - 1], ds[i + 1:]) AS d0,
          CASE WHEN t IS NOT NULL AND NOT list_contains(left_, t) THEN list_append(left_, t) ELSE left_ END AS own
        FROM (SELECT *, CASE WHEN i > 0 THEN list_filter(ds[i], lambda x: f IS NULL OR x <> f) END AS left_
          FROM (SELECT r.l, e.n, r.ps, r.ds, e.op, e.p, e.f, e.t, e.b,
              CASE WHEN list_contains(r.ps, e.p) THEN list_position(r.ps, e.p) ELSE 0 END AS i
            FROM replay r JOIN edit e ON e.l = r.l AND e.n = r.n + 1))))"""
_LAST = "SELECT l, arg_max(ps, n) AS ps, arg_max(ds, n) AS ds FROM replay GROUP BY l"

_CHG = """SELECT user_id * 2 AS person_id, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN event_type IN ('signup', 'click') THEN 'E' || event_id END AS name,
    CASE WHEN event_type IN ('signup', 'view') THEN event_type END AS role,
    CASE WHEN event_type IN ('signup', 'purchase') THEN value END AS entitlement FROM events"""
_RESET = "SELECT person_id, max(seq) AS seq, arg_max(op, seq) AS op FROM chg WHERE op <> 'update' GROUP BY person_id"
_ALL = """SELECT person_id, -1 AS seq, name, role, entitlement FROM person
  UNION ALL SELECT person_id, seq, name, role, entitlement FROM chg WHERE op <> 'delete'"""
_LIVE = """SELECT a.* FROM alive a LEFT JOIN reset r ON r.person_id = a.person_id
  WHERE r.seq IS NULL OR (r.op = 'add' AND a.seq >= r.seq)"""

STATEMENTS: dict[str, str] = {
    "a1_plan_tables": _(f"""SELECT CAST(k AS VARCHAR) AS plan_id, year(s) AS plan_year, 0 AS ord, CAST(k AS VARCHAR) AS id,
        'P' || cust AS "personId", {_TYPE.format('urlaub2')} AS type, {_STATUS.format('')} AS status,
        CAST(s AS VARCHAR) AS start, CASE WHEN k % 7 <> 0 THEN CAST(s + CAST(k % 14 AS INTEGER) AS VARCHAR) ELSE '' END AS "end"
      FROM doc""", doc=_DOC),
    "c1_clean_departments": _("""SELECT CAST(k AS VARCHAR) AS plan_id, year(s) AS plan_year,
        CASE WHEN k % 4 = 2 THEN CASE dept_id WHEN 'C' THEN 0 WHEN 'A' THEN 1 ELSE 2 END
          ELSE CASE dept_id WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END END AS ord, dept_id,
        CASE WHEN k % 4 = 0 THEN CASE dept_id WHEN 'A' THEN 'B' ELSE '' END
          WHEN k % 4 = 1 THEN CASE dept_id WHEN 'A' THEN '' ELSE 'A' END
          WHEN k % 4 = 2 THEN CASE dept_id WHEN 'B' THEN 'A' ELSE '' END
          ELSE CASE dept_id WHEN 'A' THEN '' WHEN 'B' THEN 'C' ELSE 'A' END END AS parent_id,
        CASE dept_id WHEN 'A' THEN 'Werk' WHEN 'B' THEN 'Abteilung' ELSE 'Lager' END AS name,
        CASE dept_id WHEN 'A' THEN 3 ELSE 2 END AS max_absent
      FROM doc, (VALUES ('A'), ('B'), ('C')) v(dept_id)""", doc=_DOC),
    "c1_clean_people": _("""SELECT CAST(k AS VARCHAR) AS plan_id, year(s) AS plan_year, 0 AS ord, 'P' || cust AS person_id,
        CASE WHEN k % 3 = 0 THEN 'Unbenannt' ELSE 'Kunde ' || cust END AS name,
        CASE WHEN k % 5 <> 0 THEN 'A,C' WHEN k % 10 = 0 THEN 'B' ELSE '' END AS dept_ids, '' AS role,
        CASE WHEN k % 2 = 0 THEN 24 + k % 9 ELSE 30 END::DOUBLE AS entitlement, 0.0::DOUBLE AS carryover FROM doc""", doc=_DOC),
    "c1_clean_absences": _(f"""SELECT CAST(k AS VARCHAR) AS plan_id, year(s) AS plan_year, 0 AS ord, CAST(k AS VARCHAR) AS absence_id,
        'P' || cust AS person_id, {_TYPE.format('urlaub')} AS type, {_STATUS.format('genehmigt')} AS status,
        CAST(s AS VARCHAR) AS start, CAST(s + CAST(k % 14 AS INTEGER) AS VARCHAR) AS "end", k % 3 = 0 AS half_start,
        FALSE AS half_end, '' AS note FROM doc WHERE k % 7 <> 0""", doc=_DOC),
    "c1_clean_closures": _("""SELECT CAST(k AS VARCHAR) AS plan_id, year(s) AS plan_year, 0 AS ord, 'c0' AS closure_id,
        'Betriebsruhe' AS name, CAST(s AS VARCHAR) AS start, CAST(s AS VARCHAR) AS "end" FROM doc WHERE k % 2 = 0""", doc=_DOC),
    "c11_known_fields": _("""SELECT CAST(k AS VARCHAR) AS plan_id, CASE WHEN k % 7 <> 0 THEN 'end,' ELSE '' END
        || CASE WHEN k % 3 = 0 THEN 'halfStart,' ELSE '' END || 'id,personId,start,'
        || CASE WHEN st IN ('F', 'P') THEN 'status,' ELSE '' END || 'type' AS fields FROM doc""", doc=_DOC),
    "j7_canonical_rows": _("""SELECT c_custkey AS id,
        '{"dept":' || c_nationkey || ',"id":' || c_custkey || ',"name":"' || c_name || '"}' AS form FROM customer"""),
    "j13_merge": _("""SELECT id, name, role, CASE side WHEN 'mine' THEN mb ELSE tb END AS balance, side AS taken_from,
        CASE WHEN im THEN 0 ELSE 1 END AS part, id AS ord FROM k WHERE side <> 'gone'""", **_V, j=_J, k=_K),
    "j14_merge_settings": _("""SELECT name AS key, CASE WHEN changed THEN mb ELSE tb END AS value,
        CASE WHEN changed THEN 'mine' ELSE 'theirs' END AS taken_from
      FROM (SELECT *, mb IS DISTINCT FROM bb AS changed FROM j) WHERE CASE WHEN changed THEN im ELSE it END""", **_V, j=_J),
    "j15_merge_years": _("""SELECT year, id, name, CASE side WHEN 'mine' THEN mb ELSE tb END AS balance, side AS taken_from
      FROM (SELECT j.yr AS year, j.*, CASE v.verdict WHEN 'drop' THEN 'gone'
          WHEN 'mine' THEN CASE WHEN im THEN 'mine' ELSE 'gone' END
          WHEN 'theirs' THEN CASE WHEN it THEN 'theirs' ELSE 'gone' END
          ELSE CASE WHEN ib AND NOT im THEN 'gone' WHEN NOT im AND it THEN 'theirs'
            WHEN im AND NOT it AND NOT ib THEN 'mine' WHEN im AND NOT it THEN CASE WHEN mb <> bb THEN 'mine' ELSE 'gone' END
            WHEN ib AND mb = bb THEN 'theirs' ELSE 'mine' END END AS side
        FROM yj j JOIN yv v ON v.yr = j.yr) WHERE side <> 'gone'""",
        **_V, yb=_YB, ym=_YM, yt=_YT, yj=_YJ, yh=_YH, yv=_YV),
    "j15_year_verdicts": _("""SELECT yr AS year, verdict, CASE verdict WHEN 'drop' THEN CASE WHEN ht THEN lt END WHEN 'mine' THEN lm
        WHEN 'rows' THEN CASE WHEN NOT hb OR lm <> lb THEN lm ELSE lt END ELSE lt END AS locked FROM yv""",
        **_V, yb=_YB, ym=_YM, yt=_YT, yj=_YJ, yh=_YH, yv=_YV),
    "j16_true_conflicts": _("""SELECT id, CASE WHEN NOT im THEN 'deleted here' WHEN NOT it THEN 'deleted there'
        WHEN NOT ib THEN 'added twice' ELSE 'changed twice' END AS kind FROM j
      WHERE mb IS DISTINCT FROM bb AND tb IS DISTINCT FROM bb AND mb IS DISTINCT FROM tb""", **_V, j=_J),
    "j19_first_meeting": _("SELECT id, name, bal AS balance, 'theirs' AS taken_from FROM vt", **_V),
    "i4_import_years": _("""SELECT absence_id, CASE WHEN year(s) >= 1999 THEN 'genehmigt' ELSE status END AS status,
        year(s) AS plan_year FROM absence"""),
    "i5_key_union": _("SELECT id, ib AS in_base, im AS in_mine, it AS in_theirs FROM j", **_V, j=_J),
    "j17_apply_changes": _("""SELECT person_id, arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name,
        arg_max(role, seq) FILTER (WHERE role IS NOT NULL) AS role,
        arg_max(entitlement, seq) FILTER (WHERE entitlement IS NOT NULL) AS entitlement
      FROM live GROUP BY person_id
      HAVING bool_or(seq = -1) OR person_id IN (SELECT person_id FROM reset WHERE op = 'add')""",
        chg=_CHG, reset=_RESET, alive=_ALL, live=_LIVE),
    "j17_ordered_people": _("""SELECT l AS list_id, unnest(range(len(ps))) AS pos, unnest(ps) AS person_id,
        unnest(list_transform(ds, lambda d: array_to_string(d, ','))) AS dept_ids FROM last_""",
        ord=_ORD, edit=_EDIT, replay=_REPLAY, last_=_LAST),
    "j17_accepted_parents": _("""SELECT x.dept_id, x.new_parent, m.members FROM (
        SELECT 'N' || n_nationkey AS dept_id, 'N' || ((n_nationkey + 5) % 25) AS new_parent FROM nation
        UNION ALL SELECT 'R' || (n_nationkey % 4), 'N' || n_nationkey FROM nation) x
        JOIN (SELECT dept_id, count(*) AS members FROM member GROUP BY dept_id) m ON m.dept_id = x.new_parent
      WHERE NOT EXISTS (SELECT 1 FROM clo WHERE clo.anc_id = x.dept_id AND clo.dept_id = x.new_parent)"""),
    "a2_revision_listing": _("""SELECT event_id AS rev, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, user_id AS client,
        length(props) AS bytes FROM events"""),
    "e16_stale_writes": _("""SELECT rev, base_rev, accepted_rev, client FROM (
        SELECT event_id AS rev, CASE WHEN event_id % 17 = 0 THEN event_id - 2 ELSE event_id - 1 END AS base_rev,
          lag(event_id) OVER (ORDER BY event_id) AS accepted_rev, user_id AS client FROM events)
      WHERE accepted_rev <> base_rev"""),
    "g8_retained_revisions": _("""SELECT event_id AS rev, user_id AS client, props AS data FROM events
      WHERE event_id > (SELECT max(event_id) FROM events) - 300"""),
    "g9_latest_versions": _("""SELECT user_id AS run_id, event_type AS task_id, event_id AS seq,
        ['PENDING', 'DISPATCHED', 'PASS', 'FIX', 'ESCALATED'][event_id % 5 + 1] AS state
      FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"""),
    "g10_daily_backups": _("""SELECT CAST(day AS VARCHAR) AS day, rev, data FROM (
        SELECT CAST(ts AS DATE) AS day, event_id AS rev, props AS data,
          row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS rn,
          dense_rank() OVER (ORDER BY CAST(ts AS DATE) DESC) AS age FROM events) WHERE rn = 1 AND age <= 60"""),
    "g13_attempts": _("""SELECT user_id AS run_id, event_type AS task_id, event_id AS seq,
        row_number() OVER w AS attempt, row_number() OVER w - 1 AS retries FROM events
      WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)"""),
    "g14_revision_deltas": _("""SELECT event_id AS rev, user_id AS client, length(props) AS bytes,
        coalesce(length(props) - lag(length(props)) OVER w, 0) AS grown,
        coalesce(user_id <> lag(user_id) OVER w, FALSE) AS other_client FROM events WINDOW w AS (ORDER BY event_id)"""),
    "h9_newest_revisions": _("""SELECT event_id AS rev, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, user_id AS client,
        length(props) AS bytes FROM events ORDER BY event_id DESC LIMIT 60"""),
    "h9_newest_jobs": _("SELECT event_id AS job_id FROM events ORDER BY ts DESC LIMIT 100"),
    "j6_job_ages": _("""SELECT CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN 'minutes' WHEN age < 86400 THEN 'hours'
        WHEN age < 604800 THEN 'days' ELSE 'older' END AS bucket, count(*) AS jobs
      FROM (SELECT epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) AS age FROM events) GROUP BY ALL"""),
    "j18_restore": _("""SELECT event_id AS rev, CASE WHEN event_id % 17 = 0 THEN event_id - 2 ELSE event_id - 1 END AS base_rev,
        props AS data, '' AS note FROM events
      UNION ALL SELECT m + 1, m, (SELECT props FROM events WHERE event_id = 123), 'wiederhergestellt aus 123'
        FROM (SELECT max(event_id) AS m FROM events)"""),
}
