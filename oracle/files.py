"""Oracle statements for the writers: what their files must hold."""

from __future__ import annotations

from oracle import absences as A
from oracle import web as O
from oracle.ctes import statement as _

_JOB = O.job("web", ["headings", "links", "meta", "images"])

STATEMENTS: dict[str, str] = {
    "b4_csv_files": O.STATEMENTS["b4_record_table"],
    "b5_json_lines": _("SELECT kind AS typ, url AS quelle, vs[1] AS text, vs[2] AS url FROM job",
                       **O.W, job=O.links("web")),
    "b6_json_with_header": _("""SELECT '2024-01-01 00:00:00' AS erzeugt, count(*) AS anzahl, 'alle Seiten' AS auftrag FROM job""",
                             **O.W, job=_JOB),
    "b7_saved_tables": _("""SELECT kind AS typ, CASE kind WHEN 'meta' THEN vs[1] ELSE '' END AS feld, count(*) AS rows,
        CAST(sum(length(CASE kind WHEN 'ueberschrift' THEN vs[2] WHEN 'link' THEN vs[1] ELSE '' END)) AS BIGINT) AS characters,
        CAST(sum(length(CASE kind WHEN 'bild' THEN vs[1] ELSE '' END)) AS BIGINT) AS described
      FROM job GROUP BY ALL""", **O.W, job=_JOB),
    "b8_calendar_files": f"""SELECT year, 'BEGIN:VCALENDAR' AS head, 'END:VCALENDAR' AS "end", 'X-WR-CALNAME:Abwesenheiten ' || year AS name,
        count(*) AS events, 0 AS too_long,
        CAST(sum(length(event) + 2) + {len('BEGIN:VCALENDAR VERSION:2.0 PRODID:-//workweave//DE CALSCALE:GREGORIAN METHOD:PUBLISH END:VCALENDAR'.replace(' ', ''))}
          + 14 + any_value(length('X-WR-CALNAME:Abwesenheiten ' || year)) AS BIGINT) AS characters
      FROM ({A.STATEMENTS['b8_calendar_events']}) GROUP BY year""",
    "b9_daily_backups": _("""SELECT CAST(day AS VARCHAR) AS day, rev, data FROM (
        SELECT CAST(ts AS DATE) AS day, event_id AS rev, props AS data,
          row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS rn,
          dense_rank() OVER (ORDER BY CAST(ts AS DATE) DESC) AS age FROM events) WHERE rn = 1 AND age <= 20"""),
    "b10_job_upsert": _("""SELECT user_id AS job_id, max(event_id) AS finished, arg_max(event_type, event_id) AS summary,
        arg_max(length(props), event_id) AS row_count FROM events GROUP BY user_id"""),
}
