"""Common table expressions shared by the oracle statements.

``statement(body)`` puts the needed ones in front of a query. The fixed values (types,
holiday rules, prices) are the library's own; every calculation is written anew in SQL.
"""

from __future__ import annotations

import re

from workweave.sources import reference as R


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


_RULES = _values(
    (n, region, kind, a, b, name, only or 0)
    for n, (regions, kind, a, b, name, only) in enumerate(R.HOLIDAY_RULES)
    for region in regions
)

CTES: dict[str, str] = {
    "tree": """SELECT CAST(r_regionkey AS BIGINT) AS ord, 'R' || r_regionkey AS dept_id,
        r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region
      UNION ALL
      SELECT 100 + n_nationkey, 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation""",
    "clo": """SELECT dept_id, dept_id AS anc_id, 0 AS depth, parent_id AS up FROM tree
      UNION ALL
      SELECT c.dept_id, t.dept_id, c.depth + 1, t.parent_id FROM clo c JOIN tree t ON t.dept_id = c.up""",
    "tree_ord": """SELECT c.dept_id, max(c.depth) AS depth,
        string_agg(lpad(CAST(t.ord AS VARCHAR), 9, '0'), '/' ORDER BY c.depth DESC) AS tree_key,
        coalesce(string_agg(t.name, ' / ' ORDER BY c.depth DESC) FILTER (WHERE c.depth > 0), '') AS path
      FROM clo c JOIN tree t ON t.dept_id = c.anc_id GROUP BY c.dept_id""",
    "person": """SELECT c_custkey AS ord, c_custkey AS person_id, c_name AS name, c_mktsegment AS role,
        CAST(24 + c_custkey % 9 AS DOUBLE) AS entitlement,
        CAST((c_custkey % 11) * 0.5 AS DOUBLE) AS carryover FROM customer""",
    "member": """SELECT c_custkey AS person_id, 'N' || c_nationkey AS dept_id, 0 AS pos
        FROM customer WHERE c_custkey % 50 <> 0
      UNION ALL
      SELECT c_custkey, 'N' || ((c_nationkey + 5) % 25), 1 FROM customer
        WHERE c_custkey % 50 <> 0 AND c_custkey % 7 = 0""",
    "pd": """SELECT DISTINCT m.person_id, c.anc_id AS dept_id FROM member m JOIN clo c ON c.dept_id = m.dept_id
      UNION ALL
      SELECT person_id, '__none__' FROM person
        WHERE person_id NOT IN (SELECT person_id FROM member)""",
    "bsize": "SELECT dept_id, count(*) AS size FROM pd GROUP BY dept_id",
    "dept": """SELECT t.ord, t.dept_id, t.name, t.parent_id,
        coalesce(greatest(1, CAST(floor(0.018 * b.size + 1.5 * sqrt(0.018 * b.size)) AS INTEGER)), 1) AS max_absent
      FROM tree t LEFT JOIN bsize b ON b.dept_id = t.dept_id""",
    "lim": """SELECT dept_id, name AS dept_name, max_absent FROM dept
      UNION ALL SELECT '__none__', 'Ohne Abteilung', 2""",
    "atype": "SELECT * FROM (VALUES " + _values(
        (i, t, label, c, q) for i, (t, label, c, q) in enumerate(R.ABSENCE_TYPES)
    ) + ") v(type_ord, type, type_label, counts, quota)",
    "astatus": "SELECT * FROM (VALUES " + _values(R.STATUSES) + ") v(status, status_label)",
    "absence": """SELECT o_orderkey AS ord, o_orderkey AS absence_id, o_custkey AS person_id, t.type,
        CASE o_orderstatus WHEN 'F' THEN 'genehmigt' WHEN 'O' THEN 'beantragt' ELSE 'abgelehnt' END AS status,
        CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INTEGER) AS e,
        o_orderkey % 5 = 0 AS half_start, o_orderkey % 6 = 0 AS half_end, o_orderpriority AS note,
        t.counts, t.quota, t.type_label
      FROM orders JOIN atype t ON t.type_ord = o_orderkey % 8""",
    "cnt": "SELECT * FROM absence WHERE status <> 'abgelehnt' AND counts",
    "years": """SELECT CAST(unnest(range(min(year(s)), max(year(e)) + 1)) AS INTEGER) AS y FROM absence""",
    "easter_a": """SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years""",
    "easter_b": """SELECT *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 AS h FROM easter_a""",
    "easter_c": """SELECT *, (32 + 2*(b%4) + 2*(c//4) - h - c%4) % 7 AS l FROM easter_b""",
    "easter_d": """SELECT *, h + l - 7*((a + 11*h + 22*l)//451) + 114 AS n FROM easter_c""",
    "easter": "SELECT y, make_date(y, n // 31, n % 31 + 1) AS easter FROM easter_d",
    "rule": f"SELECT * FROM (VALUES {_RULES}) v(rule_ord, region, kind, a, b, name, only_year)",
    "regions": "SELECT unnest([" + ", ".join(f"'{r}'" for r in R.REGIONS) + "]) AS region",
    "holiday_all": """SELECT r.region, e.y, r.rule_ord, r.name,
        CASE r.kind WHEN 'fixed' THEN make_date(e.y, r.a, r.b)
          WHEN 'easter' THEN e.easter + CAST(r.a AS INTEGER)
          ELSE (SELECT max(d) FROM (SELECT make_date(e.y, 11, 22) - CAST(k AS INTEGER) AS d
                FROM range(7) t(k)) WHERE isodow(d) = 3) END AS day
      FROM rule r JOIN easter e ON r.only_year = 0 OR r.only_year = e.y""",
    "holiday": "SELECT region, y, day, arg_max(name, rule_ord) AS holiday_name FROM holiday_all GROUP BY ALL",
    "calr0": """SELECT g.region, y, CAST(unnest(generate_series(make_date(y,1,1), make_date(y,12,31),
        INTERVAL 1 DAY)) AS DATE) AS day FROM years, regions g""",
    "calr": """SELECT c.region, c.y, c.day, CAST(dayofyear(c.day) - 1 AS INTEGER) AS i, isodow(c.day) % 7 AS dow,
        month(c.day) AS month, day(c.day) AS dom, weekofyear(c.day) AS iso_week,
        isodow(c.day) >= 6 AS weekend, h.holiday_name,
        isodow(c.day) < 6 AND h.holiday_name IS NULL AS workday
      FROM calr0 c LEFT JOIN holiday h ON h.region = c.region AND h.day = c.day""",
    "cal": "SELECT * FROM calr WHERE region = 'DE-NW'",
    "absday": """SELECT absence_id, ord, person_id, type, status, counts, quota, s, e,
        CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM absence""",
    "cntday": "SELECT * FROM absday WHERE status <> 'abgelehnt' AND counts",
    "pday": """SELECT DISTINCT d.person_id, c.y, c.day, c.i FROM cntday d
        JOIN cal c ON c.day = d.day AND c.workday WHERE d.person_id IN (SELECT person_id FROM person)""",
    "occ": """SELECT pd.dept_id, p.y, p.day, p.i, count(*) AS n FROM pday p
        JOIN pd ON pd.person_id = p.person_id GROUP BY ALL""",
    "tot": "SELECT y, day, i, count(*) AS n FROM pday GROUP BY ALL",
    "overday": """SELECT o.*, l.dept_name, l.max_absent,
        o.i - row_number() OVER (PARTITION BY o.dept_id, o.y ORDER BY o.i) AS island
      FROM occ o JOIN lim l ON l.dept_id = o.dept_id WHERE o.n > l.max_absent""",
    "conf": """SELECT dept_id, any_value(dept_name) AS dept_name, y, min(day) AS f, max(day) AS t,
        min(i) AS fi, max(i) AS ti, count(*) AS workdays, max(n) AS peak,
        any_value(max_absent) AS max_absent, max(n) - any_value(max_absent) AS over
      FROM overday GROUP BY dept_id, y, island""",
    "confday": """SELECT dept_id, f, CAST(unnest(generate_series(f, t, INTERVAL 1 DAY)) AS DATE) AS day
      FROM conf""",
    "confpeople": """SELECT c.dept_id, c.f, d.person_id, min({'day': d.day, 'ord': d.ord}) AS first
      FROM cntday d JOIN pd ON pd.person_id = d.person_id
        JOIN confday c ON c.dept_id = pd.dept_id AND c.day = d.day GROUP BY ALL""",
    "wd0": """SELECT a.absence_id, y.y, greatest(a.s, make_date(y.y,1,1)) AS cs,
        least(a.e, make_date(y.y,12,31)) AS ce FROM absence a
        JOIN years y ON y.y BETWEEN year(a.s) AND year(a.e)""",
    "wd1": """SELECT w.absence_id, w.y, w.cs, w.ce, count(*) AS n,
        bool_or(c.day = w.cs) AS first_works, bool_or(c.day = w.ce) AS last_works
      FROM wd0 w JOIN cal c ON c.workday AND c.day BETWEEN w.cs AND w.ce GROUP BY ALL""",
    "wd": """SELECT a.absence_id, w.y, a.person_id, a.type, a.status, a.quota, a.counts,
        greatest(0, w.n - CASE WHEN a.half_start AND w.first_works THEN 0.5 ELSE 0 END
          - CASE WHEN a.half_end AND w.ce <> w.cs AND w.last_works THEN 0.5 ELSE 0 END
          + CASE WHEN a.half_start AND a.half_end AND w.cs = w.ce THEN 0.5 ELSE 0 END)::DOUBLE AS workdays
      FROM wd1 w JOIN absence a ON a.absence_id = w.absence_id""",
    "acc0": """SELECT person_id, y,
        coalesce(sum(workdays) FILTER (WHERE quota AND status = 'genehmigt'), 0) AS approved,
        coalesce(sum(workdays) FILTER (WHERE quota AND status <> 'genehmigt'), 0) AS pending,
        coalesce(sum(workdays) FILTER (WHERE NOT quota AND counts), 0) AS other
      FROM wd WHERE status <> 'abgelehnt' GROUP BY ALL""",
    "acc": """SELECT p.person_id, p.name, p.role, y.y, p.entitlement, p.carryover, p.entitlement + p.carryover AS total,
        coalesce(a.approved, 0) AS approved, coalesce(a.pending, 0) AS pending,
        coalesce(a.approved, 0) + coalesce(a.pending, 0) AS planned, coalesce(a.other, 0) AS other,
        floor((p.entitlement + p.carryover - coalesce(a.approved, 0) - coalesce(a.pending, 0)) * 2 + 0.5) / 2 AS remaining
      FROM person p CROSS JOIN years y LEFT JOIN acc0 a ON a.person_id = p.person_id AND a.y = y.y""",
}


def _needed(text: str, found: list[str]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", text):
            found.append(name)
            _needed(CTES[name], found)


def statement(body: str, **local: str) -> str:
    """``body`` preceded by the common expressions it mentions, then the ``local`` ones.

    A local one that starts with ``MATERIALIZED`` is computed once, however often it is read.
    """
    found: list[str] = []
    _needed(body + " " + " ".join(local.values()), found)
    ctes = [f"{n} AS (\n      {CTES[n]})" for n in CTES if n in found]
    once = "MATERIALIZED "
    ctes += [f"{n} AS {once}(\n      {sql[len(once):]})" if sql.startswith(once)
             else f"{n} AS (\n      {sql})" for n, sql in local.items()]
    if not ctes:
        return body
    return "WITH RECURSIVE " + ",\n  ".join(ctes) + "\n" + body
