"""Oracle statements for the calendar, department tree, occupancy and accounts."""

from __future__ import annotations

from oracle.ctes import CTES
from oracle.ctes import statement as _

# Text helpers of the report statements
_DATE = "strftime({0}, '%d.%m.%Y')"
_NUM = "(CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) " \
       "ELSE replace(CAST(CAST({0} AS DECIMAL(18,1)) AS VARCHAR), '.', ',') END)"
_NAMES = """SELECT m.person_id, string_agg(t.name, '{0}' ORDER BY m.pos) AS names, count(*) AS n
      FROM member m JOIN tree t ON t.dept_id = m.dept_id GROUP BY m.person_id"""


def _d(x: str) -> str:
    return _DATE.format(x)


def _n(x: str) -> str:
    return _NUM.format(x)


def _e(day: str) -> str:
    return f"(SELECT count(*) FROM cnt a WHERE {day} BETWEEN a.s AND a.e) AS entries"


def _ymd(x: str) -> str:
    return f"strftime({x}, '%Y%m%d')"


_RUNS = """SELECT region, y, run, workday, min(day) AS f, max(day) AS t, count(*) AS len,
      arg_min(holiday_name, i) FILTER (WHERE holiday_name IS NOT NULL) AS first_holiday,
      arg_max(holiday_name, i) FILTER (WHERE holiday_name IS NOT NULL) AS last_holiday
    FROM (SELECT *, i - row_number() OVER (PARTITION BY region, y, workday ORDER BY i) AS run FROM calr)
    GROUP BY ALL"""
_BRIDGE = """SELECT w.region, w.y, w.f, w.t, w.len AS cost, b.len + w.len + a.len AS free,
      (b.len + w.len + a.len) / w.len AS ratio, coalesce(b.last_holiday, a.first_holiday) AS cause,
      b.f AS free_from, a.t AS free_to
    FROM runs w JOIN runs b ON NOT b.workday AND b.region = w.region AND b.y = w.y AND b.t = w.f - 1
      JOIN runs a ON NOT a.workday AND a.region = w.region AND a.y = w.y AND a.f = w.t + 1
    WHERE w.workday AND w.len <= 4 AND (b.len + w.len + a.len) / w.len >= 2.2
      AND coalesce(b.last_holiday, a.first_holiday) IS NOT NULL"""
_BUCKET = """SELECT y, day, i, iso_week,
      (SELECT count(DISTINCT k.iso_week) FROM cal k WHERE k.y = c.y AND k.day <= c.day) AS bucket FROM cal c"""
_BUCKETW = """SELECT *, first_value(iso_week) OVER (PARTITION BY y, bucket ORDER BY day) AS bucket_week FROM bk"""
_TIGHT = """SELECT dept_id, y, min(day) AS f, max(day) AS t, min(i) AS fi, count(*) AS workdays,
      any_value(max_absent) AS max_absent, any_value(ord) AS ord
    FROM (SELECT o.*, d.max_absent, d.ord,
            o.i - row_number() OVER (PARTITION BY o.dept_id, o.y ORDER BY o.i) AS island
          FROM occ o JOIN dept d ON d.dept_id = o.dept_id WHERE o.n = d.max_absent AND d.max_absent > 0)
    GROUP BY dept_id, y, island"""
_PROP = """SELECT absence_id AS proposal_id, person_id, type, status, quota,
      s + CASE WHEN absence_id % 97 = 0 THEN 400 ELSE 30 END AS s, e + CASE WHEN absence_id % 97 = 0 THEN 400 ELSE 30 END AS e,
      half_start, half_end FROM absence"""
_PROPDAY = """SELECT proposal_id, person_id,
      CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM prop"""


def _planning(sql: str) -> str:
    """Years of stored entries and of those moved by up to 400 days."""
    return sql.replace(CTES["years"], CTES["years"].replace(
        "max(year(e))", "max(year(e + CASE WHEN absence_id % 97 = 0 THEN 400 ELSE 30 END))"))


_LANES = """SELECT person_id, rn, absence_id, e, [e] AS ends, 1 AS lane
      FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY s, ord) AS rn FROM absence) WHERE rn = 1
    UNION ALL
    SELECT n.person_id, n.rn, n.absence_id, n.e,
      CASE WHEN n.lane > len(n.ends) THEN list_append(n.ends, n.e)
        ELSE list_concat(list_append(n.ends[1:n.lane-1], n.e), n.ends[n.lane+1:]) END, n.lane
    FROM (SELECT a.person_id, a.rn, a.absence_id, a.e, l.ends,
            coalesce(list_position([x < a.s FOR x IN l.ends], TRUE), len(l.ends) + 1) AS lane
          FROM lanes l JOIN (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY s, ord) AS rn
            FROM absence) a ON a.person_id = l.person_id AND a.rn = l.rn + 1) n"""
_WDP = """SELECT p.proposal_id, p.person_id, p.type, p.status, p.quota, year(p.s) AS y,
      p.e - p.s + 1 AS calendar_days, greatest(p.s, make_date(year(p.s),1,1)) AS cs,
      least(p.e, make_date(year(p.s),12,31)) AS ce, p.half_start, p.half_end FROM prop p"""
_WDP1 = """SELECT w.*, (SELECT count(*) FROM cal c WHERE c.workday AND c.day BETWEEN w.cs AND w.ce) AS n,
      w.cs IN (SELECT day FROM cal WHERE workday) AS fw, w.ce IN (SELECT day FROM cal WHERE workday) AS lw
      FROM wdp w"""
_WDP2 = """SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE greatest(0, n - CASE WHEN half_start AND fw THEN 0.5 ELSE 0 END
        - CASE WHEN half_end AND ce <> cs AND lw THEN 0.5 ELSE 0 END
        + CASE WHEN half_start AND half_end AND cs = ce THEN 0.5 ELSE 0 END) END::DOUBLE AS workdays FROM wdp1"""
_ALLWD = """SELECT w.absence_id, w.y, coalesce(d.workdays, 0.0) AS workdays FROM wd0 w
      LEFT JOIN wd d ON d.absence_id = w.absence_id AND d.y = w.y"""

STATEMENTS: dict[str, str] = {
    "a7_holiday_rules": _("""SELECT h.region, count(*) AS holidays,
        CAST(coalesce(sum((SELECT count(*) FROM absence a WHERE a.s = h.day)), 0) AS BIGINT) AS starts
      FROM holiday h GROUP BY h.region"""),
    "a8_absence_types": _("""SELECT t.type, t.type_ord, t.counts, t.quota,
        (SELECT count(*) FROM absence a WHERE a.type = t.type) AS entries FROM atype t"""),
    "c2_countable": _("SELECT absence_id, type, status FROM cnt"),
    "c3_uses_allowance": _("SELECT absence_id, type, status FROM absence WHERE status <> 'abgelehnt' AND quota"),
    "c4_ordered_ends": _("""SELECT absence_id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end" FROM absence"""),
    "c5_person_search": _("""SELECT person_id, name, role FROM person
      WHERE name ILIKE '%99%' OR role ILIKE '%mach%'"""),
    "c12_delete_people": _("""SELECT 'person' AS kind, person_id AS id FROM person WHERE role <> 'FURNITURE'
      UNION ALL SELECT 'absence', absence_id FROM absence
        WHERE person_id NOT IN (SELECT person_id FROM person WHERE role = 'FURNITURE')"""),
    "c13_delete_departments": _("""SELECT t.dept_id,
        coalesce(arg_min(c.anc_id, c.depth) FILTER (WHERE c.depth > 0
          AND c.anc_id NOT IN (SELECT dept_id FROM gone)), '') AS parent_id,
        (SELECT count(DISTINCT m.person_id) FROM member m WHERE m.dept_id = t.dept_id) AS direct_size
      FROM tree t JOIN clo c ON c.dept_id = t.dept_id
      WHERE t.dept_id NOT IN (SELECT dept_id FROM gone) GROUP BY t.dept_id""",
        gone="""SELECT dept_id FROM tree WHERE name IN ('NATION_7', 'AFRICA', 'ASIA') OR dept_id = 'R1'"""),
    "d1_easter": _(f"SELECT y AS year, CAST(easter AS VARCHAR) AS easter, {_e('easter')} FROM easter"),
    "d2_wednesday_rule": _(f"""SELECT y AS year, CAST(day AS VARCHAR) AS day, {_e('day')} FROM wed""",
        wed="""SELECT y, (SELECT max(d) FROM (SELECT make_date(y, 11, 22) - CAST(k AS INTEGER) AS d
          FROM range(7) t(k)) WHERE isodow(d) = 3) AS day FROM years"""),
    "d3_holidays": _(f"SELECT region, y AS year, CAST(day AS VARCHAR) AS day, holiday_name, {_e('day')} FROM holiday"),
    "d4_calendar": _(f"""SELECT region, y AS year, CAST(day AS VARCHAR) AS day, i, dow, month, dom, iso_week, weekend,
        coalesce(holiday_name, '') AS holiday_name, workday, {_e('day')} FROM calr
      WHERE region IN ('DE-NW', 'DE-BY', 'AT', 'NONE')"""),
    "d5_iso_week": _("SELECT isoyear(s) AS iso_year, week(s) AS iso_week, count(*) AS starts FROM absence GROUP BY ALL"),
    "d6_day_offsets": _("""SELECT absence_id, s - make_date(year(s),1,1) AS i, e - make_date(year(s),1,1) AS end_offset,
        CAST(e + 1 AS VARCHAR) AS day_after FROM absence"""),
    "d7_month_lengths": _("""SELECT CAST(CAST(date_trunc('month', s) AS DATE) AS VARCHAR) AS month,
        any_value(day(last_day(s))) AS days_in_month,
        any_value(CASE WHEN day(last_day(make_date(year(s), 2, 1))) = 29 THEN 366 ELSE 365 END) AS days_in_year,
        count(*) AS starts FROM absence GROUP BY date_trunc('month', s)"""),
    # workdays up to a day, counted once; a part of a year is the difference of two such counts
    "d8_workdays": _("""SELECT w.absence_id, w.y AS year,
        CASE WHEN w.n = 0 THEN 0.0 ELSE greatest(0, w.n - CASE WHEN a.half_start AND w.first_works THEN 0.5 ELSE 0 END
          - CASE WHEN a.half_end AND w.ce <> w.cs AND w.last_works THEN 0.5 ELSE 0 END
          + CASE WHEN a.half_start AND a.half_end AND w.cs = w.ce THEN 0.5 ELSE 0 END) END::DOUBLE AS workdays
      FROM (SELECT p.absence_id, p.y, p.cs, p.ce, l.upto - f.upto + CAST(f.workday AS INTEGER) AS n,
          f.workday AS first_works, l.workday AS last_works
        FROM wd0 p JOIN upto f ON f.day = p.cs JOIN upto l ON l.day = p.ce) w
        JOIN absence a ON a.absence_id = w.absence_id""",
        upto="""MATERIALIZED SELECT day, workday, sum(CAST(workday AS INTEGER)) OVER (ORDER BY day) AS upto FROM cal"""),
    "d8_workdays_by_days": _("SELECT absence_id, y AS year, workdays FROM wd"),
    "d9_calendar_days": _("SELECT absence_id, e - s + 1 AS days FROM absence"),
    "d10_german_texts": _(f"""SELECT a.absence_id, w.y AS year, {_d('a.s')} AS "from",
        CASE WHEN a.s = a.e THEN {_d('a.e')}
          WHEN date_trunc('month', a.s) = date_trunc('month', a.e) THEN strftime(a.s, '%d.') || '–' || {_d('a.e')}
          WHEN year(a.s) = year(a.e) THEN strftime(a.s, '%d.%m.') || ' – ' || {_d('a.e')}
          ELSE {_d('a.s')} || ' – ' || {_d('a.e')} END AS span,
        {_n('w.workdays')} || CASE WHEN w.workdays = 1 THEN ' Arbeitstag' ELSE ' Arbeitstage' END AS length
      FROM allwd w JOIN absence a ON a.absence_id = w.absence_id""", allwd=_ALLWD),
    "d11_holiday_list": _(f"""SELECT region, y AS year, CAST(day AS VARCHAR) AS day, dow, holiday_name, weekend, {_e('day')}
      FROM calr WHERE holiday_name IS NOT NULL"""),
    "e1_workdays_of_entries": _("""SELECT d.absence_id, d.person_id, CAST(d.day AS VARCHAR) AS day
      FROM cntday d JOIN cal c ON c.day = d.day AND c.workday"""),
    "e2_person_departments": _("SELECT person_id, dept_id FROM pd"),
    "e3_closure": _("""SELECT c.dept_id, c.anc_id, c.depth,
        (SELECT count(*) FROM member m WHERE m.dept_id = c.dept_id) AS members FROM clo c"""),
    "e3_tree_order": _("""SELECT t.dept_id, t.name, o.depth, o.path, o.tree_key,
        (SELECT count(*) FROM clo c WHERE c.anc_id = t.dept_id) AS branch,
        (SELECT count(*) FROM tree x WHERE x.dept_id NOT IN
          (SELECT dept_id FROM clo c WHERE c.anc_id = t.dept_id)) AS candidates
      FROM tree t JOIN tree_ord o ON o.dept_id = t.dept_id"""),
    "e4_absent_on": _("""SELECT CAST(day AS VARCHAR) AS day, person_id, arg_min(absence_id, ord) AS absence_id
      FROM cntday WHERE person_id IN (SELECT person_id FROM person) GROUP BY day, person_id"""),
    "e4_absent_in_branch": _("""SELECT CAST(day AS VARCHAR) AS day, person_id, arg_min(absence_id, ord) AS absence_id
      FROM cntday WHERE person_id IN (SELECT person_id FROM pd WHERE dept_id = 'R2') GROUP BY day, person_id"""),
    "e4_absent_without_department": _("""SELECT CAST(day AS VARCHAR) AS day, person_id, arg_min(absence_id, ord) AS absence_id
      FROM cntday WHERE person_id IN (SELECT person_id FROM pd WHERE dept_id = '__none__') GROUP BY day, person_id"""),
    "e5_known_people": _("""SELECT a.absence_id, a.person_id, p.name FROM absence a JOIN person p ON p.person_id = a.person_id
      WHERE p.role <> 'FURNITURE'"""),
    "e6_conflicted_entries": _("""SELECT a.absence_id, EXISTS (SELECT 1 FROM pd JOIN confday c ON c.dept_id = pd.dept_id
        WHERE pd.person_id = a.person_id AND c.day BETWEEN a.s AND a.e) AS conflicted FROM absence a"""),
    "e7_entries_in_conflicts": _("""SELECT absence_id, person_id FROM absence
      WHERE absence_id IN (SELECT first.ord FROM confpeople)"""),
    "e8_screening": _planning(_("""SELECT proposal_id, person_id, dept_id, any_value(max_absent) AS max_absent,
        max(cnt) AS worst, count(*) FILTER (WHERE cnt > max_absent) AS over_days,
        coalesce(CAST(min(day) FILTER (WHERE cnt > max_absent) AS VARCHAR), '') AS first_over,
        max(cnt) - any_value(max_absent) AS margin
      FROM (SELECT pr.proposal_id, pr.person_id, pd.dept_id, l.max_absent, pr.day,
          CASE WHEN c.day IS NULL THEN 0 ELSE 1 + coalesce(o.n, 0)
            - CASE WHEN me.day IS NULL THEN 0 ELSE 1 END END AS cnt
        FROM propday pr JOIN pd ON pd.person_id = pr.person_id JOIN lim l ON l.dept_id = pd.dept_id
          LEFT JOIN cal c ON c.day = pr.day AND c.workday
          LEFT JOIN occ o ON o.dept_id = pd.dept_id AND o.day = pr.day
          LEFT JOIN pday me ON me.person_id = pr.person_id AND me.day = pr.day)
      GROUP BY proposal_id, person_id, dept_id""", prop=_PROP, propday=_PROPDAY)),
    "e8_screened_people": _planning(_("""SELECT v.proposal_id, v.dept_id, p.person_id AS other_id, count(*) AS days,
        CAST(min(v.day) AS VARCHAR) AS first_day
      FROM (SELECT pr.proposal_id, pr.person_id, pd.dept_id, pr.day
          FROM propday pr JOIN pd ON pd.person_id = pr.person_id JOIN lim l ON l.dept_id = pd.dept_id
            JOIN cal c ON c.day = pr.day AND c.workday
            JOIN occ o ON o.dept_id = pd.dept_id AND o.day = pr.day
            LEFT JOIN pday me ON me.person_id = pr.person_id AND me.day = pr.day
          WHERE 1 + o.n - CASE WHEN me.day IS NULL THEN 0 ELSE 1 END > l.max_absent) v
        JOIN pday p ON p.day = v.day AND p.person_id <> v.person_id
        JOIN pd ON pd.person_id = p.person_id AND pd.dept_id = v.dept_id
      GROUP BY ALL""", prop=_PROP, propday=_PROPDAY)),
    "e15_without_department": _("SELECT person_id, name FROM person WHERE person_id NOT IN (SELECT person_id FROM member)"),
    "e15_people_under": _("""SELECT person_id, name FROM person
      WHERE person_id IN (SELECT person_id FROM pd WHERE dept_id = 'R3')"""),
    "e17_also_in": _("""SELECT m.person_id, m.dept_id, coalesce((SELECT string_agg(t.name, ', ' ORDER BY o.pos)
        FROM member o JOIN tree t ON t.dept_id = o.dept_id
        WHERE o.person_id = m.person_id AND o.dept_id <> m.dept_id), '') AS also_in FROM member m"""),
    "f1_occupancy": _("SELECT dept_id, y AS year, CAST(day AS VARCHAR) AS day, n FROM occ"),
    "f1_occupancy_by_days": _("SELECT dept_id, y AS year, CAST(day AS VARCHAR) AS day, n FROM occ"),
    "f2_total_absent": _("SELECT y AS year, CAST(day AS VARCHAR) AS day, n FROM tot"),
    "f3_accounts": _("""SELECT person_id, y AS year, entitlement, carryover, total, approved, pending, planned, other,
        remaining FROM acc"""),
    "f4_account_figures": _("""SELECT a.y AS year, count(*) AS people, floor(sum(a.planned) * 2 + 0.5) / 2 AS planned,
        floor(sum(a.remaining) * 2 + 0.5) / 2 AS remaining,
        count(*) FILTER (WHERE a.remaining < 0) AS overdrawn, count(*) FILTER (WHERE a.planned = 0) AS unplanned,
        (SELECT count(*) FROM absence x WHERE x.status = 'beantragt' AND a.y BETWEEN year(x.s) AND year(x.e)) AS open_requests,
        (SELECT count(*) FROM tree) AS departments FROM acc a GROUP BY a.y"""),
    "f5_conflict_figures": _("""SELECT t.y AS year,
        (SELECT count(*) FROM conf c WHERE c.y = t.y) AS periods,
        (SELECT CAST(coalesce(sum(workdays), 0) AS BIGINT) FROM conf c WHERE c.y = t.y) AS days,
        (SELECT count(DISTINCT dept_id) FROM conf c WHERE c.y = t.y) AS departments,
        (SELECT coalesce(max(over), 0) FROM conf c WHERE c.y = t.y) AS peak_over,
        CAST(min(t.day) FILTER (WHERE t.n = m.n) AS VARCHAR) AS busiest_day, any_value(m.n) AS busiest_n
      FROM tot t JOIN (SELECT y, max(n) AS n FROM tot GROUP BY y) m ON m.y = t.y GROUP BY t.y"""),
    "f6_month_distribution": _("""SELECT c.y AS year, c.month, count(d.absence_id) AS days
      FROM cal c LEFT JOIN absday d ON d.day = c.day AND c.workday AND d.quota AND d.status <> 'abgelehnt'
      GROUP BY ALL"""),
    "f7_department_shares": _("""SELECT pd.dept_id, a.y AS year, sum(a.planned) AS planned, sum(a.total) AS total,
        count(*) AS people, any_value(d.name) AS name,
        round(CASE WHEN sum(a.total) = 0 THEN 0.0 ELSE sum(a.planned) / sum(a.total) END, 9) AS share
      FROM acc a JOIN pd ON pd.person_id = a.person_id JOIN dept d ON d.dept_id = pd.dept_id GROUP BY pd.dept_id, a.y"""),
    "f8_branch_sizes": _("""SELECT t.dept_id,
        (SELECT count(DISTINCT person_id) FROM member m WHERE m.dept_id = t.dept_id) AS direct_size,
        (SELECT count(*) FROM pd WHERE pd.dept_id = t.dept_id) AS size FROM tree t"""),
    "f9_remaining_per_department": _("""SELECT m.dept_id, a.y AS year, sum(a.remaining) AS remaining
      FROM member m JOIN acc a ON a.person_id = m.person_id GROUP BY ALL"""),
    "f10_conflicts_per_department": _("""SELECT t.dept_id, (SELECT count(*) FROM conf c WHERE c.dept_id = t.dept_id) AS conflicts
      FROM tree t"""),
    "f11_heatmap": _("""SELECT dept_id, y AS year, bucket, bucket_week, peak, CAST(peak_day AS VARCHAR) AS peak_day,
        CASE WHEN peak > max_absent THEN 4 WHEN peak = max_absent THEN 3
          WHEN peak / max_absent <= 0.5 THEN 1 ELSE 2 END AS level
      FROM (SELECT o.dept_id, o.y, b.bucket, b.bucket_week, any_value(l.max_absent) AS max_absent, max(o.n) AS peak,
          arg_min(o.day, -o.n * 100000 + o.i) AS peak_day
        FROM occ o JOIN bkw b ON b.day = o.day JOIN lim l ON l.dept_id = o.dept_id
        GROUP BY o.dept_id, o.y, b.bucket, b.bucket_week)""", bk=_BUCKET, bkw=_BUCKETW),
    "f18_entries_per_person": _("""SELECT person_id, (SELECT count(*) FROM absence a WHERE a.person_id = p.person_id) AS entries
      FROM person p"""),
    "f19_day_detail": _("""SELECT d.dept_id, CAST(d.day AS VARCHAR) AS day, d.n, l.max_absent,
        CASE WHEN d.n > l.max_absent THEN 'danger' WHEN d.n = l.max_absent THEN 'warn' ELSE 'ok' END AS level
      FROM (SELECT pd.dept_id, c.day, count(DISTINCT c.person_id) AS n FROM cntday c
          JOIN pd ON pd.person_id = c.person_id GROUP BY ALL) d JOIN lim l ON l.dept_id = d.dept_id"""),
    "g1_conflicts": _("""SELECT dept_id, dept_name, CAST(f AS VARCHAR) AS "from", CAST(t AS VARCHAR) AS "to", workdays, peak,
        max_absent, over FROM conf"""),
    "g1_conflict_people": _("""SELECT dept_id, CAST(f AS VARCHAR) AS period, person_id, first.ord AS absence_id,
        CAST(first.day AS VARCHAR) AS day FROM confpeople"""),
    "g2_tight_periods": _("""SELECT dept_id, CAST(f AS VARCHAR) AS "from", CAST(t AS VARCHAR) AS "to", workdays, max_absent
      FROM tight""", tight=_TIGHT),
    "g3_bridges": _("""SELECT region, y AS year, CAST(f AS VARCHAR) AS "from", CAST(t AS VARCHAR) AS "to", cost, free,
        round(ratio, 9) AS ratio, cause, CAST(free_from AS VARCHAR) AS free_from, CAST(free_to AS VARCHAR) AS free_to,
        (SELECT count(*) FROM cnt a WHERE a.s <= br.f AND a.e >= br.t) AS takers
      FROM br""", runs=_RUNS, br=_BRIDGE),
    "g4_load_runs": _("""SELECT dept_id, y AS year, CAST(min(day) AS VARCHAR) AS "from", CAST(max(day) AS VARCHAR) AS "to",
        n, count(*) AS days
      FROM (SELECT *, i - row_number() OVER (PARTITION BY dept_id, y, n ORDER BY i) AS run FROM occ)
      GROUP BY dept_id, y, n, run"""),
    "g5_week_buckets": _(f"""SELECT y AS year, CAST(day AS VARCHAR) AS day, iso_week, bucket, bucket_week, {_e('day')}
      FROM bkw""", bk=_BUCKET, bkw=_BUCKETW),
    "g6_lanes": _("SELECT absence_id, person_id, lane - 1 AS lane FROM lanes", lanes=_LANES),
    "g6_lane_counts": _("SELECT person_id, max(lane) AS lanes FROM lanes GROUP BY person_id", lanes=_LANES),
    "g12_shown_on_top": _("""SELECT person_id, CAST(day AS VARCHAR) AS day, absence_id, entries
      FROM (SELECT person_id, day, absence_id, count(*) OVER (PARTITION BY person_id, day) AS entries,
          row_number() OVER (PARTITION BY person_id, day ORDER BY s DESC, ord DESC) AS rn FROM absday) WHERE rn = 1"""),
    "h1_conflicts_by_severity": _("""SELECT c.dept_id, c.dept_name, c.y AS year, CAST(c.f AS VARCHAR) AS "from",
        CAST(c.t AS VARCHAR) AS "to", c.workdays, c.peak, c.max_absent, c.over, c.over * 100 + c.workdays AS severity
      FROM conf c LEFT JOIN tree_ord o ON o.dept_id = c.dept_id
      ORDER BY severity DESC, c.fi, o.tree_key NULLS LAST"""),
    "h2_longest_tight_periods": _("""SELECT year, rank, dept_id, CAST(f AS VARCHAR) AS "from", CAST(t AS VARCHAR) AS "to",
        workdays, greatest(0, total - 12) AS left_out
      FROM (SELECT y AS year, dept_id, f, t, workdays, count(*) OVER (PARTITION BY y) AS total,
          row_number() OVER (PARTITION BY y ORDER BY workdays DESC, fi, ord) AS rank FROM tight)
      WHERE rank <= 12""", tight=_TIGHT),
    "h3_best_bridges": _("""SELECT region, year, rank, CAST(f AS VARCHAR) AS "from", CAST(t AS VARCHAR) AS "to", cost, free, cause,
        (SELECT count(*) FROM cnt a WHERE a.s <= f AND a.e >= t) AS takers
      FROM (SELECT *, y AS year, row_number() OVER (PARTITION BY region, y ORDER BY ratio DESC, f) AS rank FROM br)
      WHERE rank <= 10""", runs=_RUNS, br=_BRIDGE),
    "h6_sorted_accounts": _("""SELECT a.person_id, a.y AS year, coalesce(n.names, 'Ohne Abteilung') AS department, a.total,
        a.planned, a.remaining FROM acc a LEFT JOIN nm n ON n.person_id = a.person_id
      ORDER BY a.remaining, a.person_id""", nm=_NAMES.format(", ")),
    "h7_sorted_people": _("""SELECT p.person_id, p.name, coalesce(min(t.ord), 999) AS dept_rank FROM person p
      LEFT JOIN member m ON m.person_id = p.person_id LEFT JOIN tree t ON t.dept_id = m.dept_id
      GROUP BY p.person_id, p.name ORDER BY dept_rank, p.name"""),
    "h8_entries_by_start": _("""SELECT person_id, CAST(s AS VARCHAR) AS start, ord, absence_id FROM absence
      ORDER BY person_id, s, ord"""),
    "j10_half_day_rounding": _("SELECT c_custkey, floor(c_acctbal * 2 + 0.5) / 2 AS rounded FROM customer"),
    "j11_roll_forward": _("""SELECT y + 1 AS plan_year, person_id, name, role, entitlement,
        floor(greatest(0.0, remaining) * 2 + 0.5) / 2 AS carryover FROM acc"""),
    "j12_after_request": _planning(_("""SELECT p.proposal_id, p.person_id, p.y AS year, p.workdays,
        CASE WHEN p.quota THEN a.remaining + coalesce(o.workdays, 0)
            - CASE WHEN p.status = 'abgelehnt' THEN 0 ELSE p.workdays END ELSE a.remaining END AS rest_after,
        p.quota AND a.remaining + coalesce(o.workdays, 0)
            - CASE WHEN p.status = 'abgelehnt' THEN 0 ELSE p.workdays END < 0 AS overdraws, p.calendar_days
      FROM wdp2 p JOIN acc a ON a.person_id = p.person_id AND a.y = p.y
        LEFT JOIN wd o ON o.absence_id = p.proposal_id AND o.y = p.y AND o.quota AND o.status <> 'abgelehnt'""",
        prop=_PROP, wdp=_WDP, wdp1=_WDP1, wdp2=_WDP2)),
    "b1_account_report": _(f"""SELECT a.y AS year, a.name AS "Person", coalesce(n.names, '') AS "Abteilung", a.role AS "Rolle",
        {_n('a.entitlement')} AS "Anspruch", {_n('a.carryover')} AS "Übertrag", {_n('a.total')} AS "Verfügbar",
        {_n('a.approved')} AS "Genehmigt", {_n('a.pending')} AS "Beantragt", {_n('a.remaining')} AS "Rest",
        {_n('a.other')} AS "Sonstige Abwesenheit"
      FROM acc a LEFT JOIN nm n ON n.person_id = a.person_id""", nm=_NAMES.format(" | ")),
    "b2_entry_report": _(f"""SELECT w.y AS year, p.name AS "Person", coalesce(n.names, '') AS "Abteilung",
        a.type_label AS "Art", s.status_label AS "Status", {_d('a.s')} AS "Von", {_d('a.e')} AS "Bis",
        {_n('w.workdays')} AS "Arbeitstage", CASE WHEN a.half_start THEN 'ja' ELSE '' END AS "Halber erster Tag",
        CASE WHEN a.half_end THEN 'ja' ELSE '' END AS "Halber letzter Tag", a.note AS "Notiz"
      FROM allwd w JOIN absence a ON a.absence_id = w.absence_id JOIN person p ON p.person_id = a.person_id
        JOIN astatus s ON s.status = a.status LEFT JOIN nm n ON n.person_id = a.person_id
      ORDER BY w.y, a.s, a.ord""", nm=_NAMES.format(" | "), allwd=_ALLWD),
    "b3_conflict_report": _(f"""SELECT c.dept_name AS "Abteilung", {_d('c.f')} AS "Von", {_d('c.t')} AS "Bis",
        c.workdays AS "Arbeitstage", c.peak AS "Gleichzeitig abwesend", c.max_absent AS "Erlaubt",
        c.over AS "Überschreitung", 1 AS "Teil",
        (SELECT string_agg(p.name, ', ' ORDER BY k.first) FROM confpeople k JOIN person p ON p.person_id = k.person_id
          WHERE k.dept_id = c.dept_id AND k.f = c.f) AS "Betroffene Personen"
      FROM conf c"""),
    "b8_calendar_events": _(f"""SELECT w.y AS year, a.absence_id, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT',
        'UID:' || a.absence_id || '@workweave', 'DTSTAMP:20240101T000000Z',
        'DTSTART;VALUE=DATE:' || {_ymd('a.s')}, 'DTEND;VALUE=DATE:' || {_ymd('a.e + 1')},
        'SUMMARY:' || regexp_replace(p.name || ' – ' || a.type_label, '([,;\\\\])', '\\\\\\1', 'g'),
        'DESCRIPTION:' || replace(regexp_replace(concat_ws(chr(10),
            CASE WHEN n.n > 1 THEN 'Abteilungen: ' || n.names WHEN n.n = 1 THEN 'Abteilung: ' || n.names END,
            'Status: ' || s.status_label, 'Arbeitstage: ' || {_n('w.workdays')}, nullif(a.note, '')),
          '([,;\\\\])', '\\\\\\1', 'g'), chr(10), '\\n'),
        'TRANSP:TRANSPARENT', CASE WHEN a.status = 'beantragt' THEN 'STATUS:TENTATIVE' ELSE 'STATUS:CONFIRMED' END,
        'END:VEVENT') AS event
      FROM allwd w JOIN absence a ON a.absence_id = w.absence_id JOIN person p ON p.person_id = a.person_id
        JOIN astatus s ON s.status = a.status LEFT JOIN nm n ON n.person_id = a.person_id
      WHERE a.status <> 'abgelehnt'""", nm=_NAMES.format(", "), allwd=_ALLWD),
}
