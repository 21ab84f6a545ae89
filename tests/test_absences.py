import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from workweave.operators import calendar as C
from workweave.operators import hierarchy as H
from workweave.operators import lanes as L
from workweave.operators import occupancy as O
from workweave.sinks import reports

ABSENCE = ("absence_id long, ord long, person_id long, type string, status string, start date, "
           "end date, half_start boolean, half_end boolean, note string")
TREE = "ord int, dept_id string, name string, parent_id string, max_absent int"


def _entry(i, person, start, days, type_="urlaub", status="genehmigt"):
    s = date.fromisoformat(start) if isinstance(start, str) else start
    return (i, i, person, type_, status, s, s + timedelta(days=days - 1), False, False, "")


@pytest.fixture(scope="module")
def org(spark):
    tree = spark.createDataFrame([
        (0, "T", "Top", None, 1), (1, "A", "Links", "T", 1), (2, "B", "Rechts", "T", 2),
        (3, "C", "Unten", "B", 1)], TREE)
    person = spark.createDataFrame([(i, f"P{i}") for i in range(6)], "person_id long, name string")
    member = spark.createDataFrame(
        [(0, "A", 0), (0, "B", 1), (1, "A", 0), (2, "C", 0), (3, "B", 0), (4, "gone", 0)],
        "person_id long, dept_id string, pos int")
    clo = H.closure(tree).persist()
    return tree, person, member, clo, H.person_departments(person, member, clo).persist()


@pytest.fixture(scope="module")
def cal(spark):
    return C.calendar(spark.createDataFrame([(2024,), (2025,)], "year int"), ["NONE"]).persist()


def test_siblings_count_once_and_orphans_have_a_bucket(spark, org, cal):
    tree, person, member, clo, pd = org
    absence = spark.createDataFrame([
        _entry(1, 0, "2024-03-04", 1), _entry(2, 0, "2024-03-04", 2), _entry(3, 4, "2024-03-04", 1),
        _entry(4, 1, "2024-03-04", 1, type_="homeoffice"),
        _entry(5, 3, "2024-03-04", 1, status="abgelehnt"), _entry(6, 99, "2024-03-04", 1)], ABSENCE)
    occ = O.occupancy(absence, pd, cal)
    got = {(r.dept_id, r.day.day): r.n for r in occ.collect()}
    assert got == {("A", 4): 1, ("B", 4): 1, ("T", 4): 1, ("A", 5): 1, ("B", 5): 1, ("T", 5): 1,
                   ("__none__", 4): 1}


def test_weekend_splits_a_conflict_and_first_entry_is_named(spark, org, cal):
    tree, person, member, clo, pd = org
    absence = spark.createDataFrame([
        _entry(1, 0, "2024-03-07", 6), _entry(2, 1, "2024-03-07", 6),
        _entry(3, 1, "2024-03-01", 30)], ABSENCE)
    found = O.conflicts(O.occupancy(absence, pd, cal), H.limits(tree))
    rows = {(r.dept_id, r["from"].day, r["to"].day, r.workdays, r.peak, r.over)
            for r in found.collect()}
    assert rows == {("A", 7, 8, 2, 2, 1), ("A", 11, 12, 2, 2, 1), ("T", 7, 8, 2, 2, 1),
                    ("T", 11, 12, 2, 2, 1)}
    people = O.conflict_people(found, absence, pd).filter("dept_id = 'A'").collect()
    assert {(r.period.day, r.person_id, r.absence_id) for r in people} == {
        (7, 0, 1), (7, 1, 2), (11, 0, 1), (11, 1, 2)}
    whole = reports.conflict_rows(found, O.conflict_people(found, absence, pd), person)
    assert {r["Betroffene Personen"] for r in whole.collect()} == {"P0, P1"}
    parts = reports.conflict_rows(found, O.conflict_people(found, absence, pd), person, 1)
    assert parts.count() == 2 * whole.count()
    assert {r["Betroffene Personen"] for r in parts.collect()} == {"P0", "P1"}
    assert {r.Teil for r in parts.collect()} == {1, 2} and {r.Teil for r in whole.collect()} == {1}


def _random_entries(seed, people, n):
    rnd = random.Random(seed)
    # a third of all entries belongs to one person
    return [_entry(i, 0 if rnd.random() < 0.34 else rnd.randrange(people),
                   date(2024, 1, 1) + timedelta(days=rnd.randrange(700)), rnd.randrange(1, 25),
                   rnd.choice(["urlaub", "krank", "homeoffice"]),
                   rnd.choice(["genehmigt", "beantragt", "abgelehnt"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_change_form_equals_day_form(spark, org, cal, seed):
    _, person, _, _, pd = org
    absence = spark.createDataFrame(_random_entries(seed, 6, 60), ABSENCE)
    fast = {tuple(r) for r in O.occupancy(absence, pd, cal).collect()}
    slow = {tuple(r) for r in O.occupancy_by_days(absence, pd, cal).collect()}
    assert fast == slow and fast


def test_screening_counts_other_people(spark, org, cal):
    tree, person, member, clo, pd = org
    absence = spark.createDataFrame(_random_entries(7, 6, 60), ABSENCE)
    asked = [(i, p, date(2024, 5, 1 + i), date(2024, 5, 1 + i + i % 4)) for i, p in
             enumerate([0, 1, 2, 3, 4, 5] * 3)]
    proposal = spark.createDataFrame(asked, "proposal_id int, person_id long, start date, end date")
    got = {(r.proposal_id, r.dept_id): (r.worst, r.over_days) for r in O.screen(
        proposal, absence, pd, H.limits(tree), cal).collect()}
    depts = {r.person_id: r.dept_ids for r in pd.collect()}
    cap = {r.dept_id: r.max_absent for r in H.limits(tree).collect()}
    entries = [r for r in absence.collect() if r.status != "abgelehnt" and r.type != "homeoffice"]
    for i, p, s, e in asked:
        for d in depts[p]:
            counts = []
            for k in range((e - s).days + 1):
                day = s + timedelta(days=k)
                if day.weekday() < 5:
                    others = {a.person_id for a in entries if a.start <= day <= a.end
                              and a.person_id != p and d in depts.get(a.person_id, [])}
                    counts.append(len(others) + 1)
            want = (max(counts, default=0), sum(c > cap[d] for c in counts))
            assert got[i, d] == want, (i, d)


def test_screening_names_the_others(spark, org):
    tree, person, member, clo, pd = org
    stored = spark.createDataFrame(_random_entries(11, 6, 70), ABSENCE)
    asked = [(i, i % 6, date(2024, 1, 8) + timedelta(days=17 * i), date(2024, 1, 8) + timedelta(days=17 * i + i % 40))
             for i in range(22)] + [(99, 0, date(2025, 3, 1), date(2026, 1, 9)), (98, 1, date(2024, 6, 8), date(2024, 6, 9)),
                                    (97, 777, date(2024, 5, 6), date(2024, 5, 8))]
    proposal = spark.createDataFrame(asked, "proposal_id int, person_id long, start date, end date")
    cal = C.calendar(C.years_spanned(stored, proposal), ["DE-NW"])
    works = {r.day for r in cal.filter("workday").collect()}
    depts = {r.person_id: r.dept_ids for r in pd.collect()} | {777: ["__none__"]}
    cap = {r.dept_id: r.max_absent for r in H.limits(tree).collect()}
    entries = [r for r in stored.collect() if r.status != "abgelehnt" and r.type != "homeoffice"]
    worst, others = {}, {}
    for i, p, s, e in asked:
        for d in depts[p]:
            worst[i, d] = 0
            for day in sorted(x for x in works if s <= x <= e):
                away = {a.person_id for a in entries if a.start <= day <= a.end
                        and a.person_id != p and d in depts.get(a.person_id, [])}
                worst[i, d] = max(worst[i, d], len(away) + 1)
                if len(away) + 1 > cap[d]:
                    for o in away:
                        others.setdefault((i, d, o), []).append(day)
    got = O.screen(proposal, stored, pd, H.limits(tree), cal).collect()
    assert {(r.proposal_id, r.dept_id): r.worst for r in got} == worst
    got = O.screened_people(proposal, stored, pd, H.limits(tree), cal).collect()
    assert others and {(r.proposal_id, r.dept_id, r.other_id): (r.days, r.first_day) for r in got} == {
        k: (len(v), v[0]) for k, v in others.items()}
    # a calendar that ends too early is an error, no proposal is lost
    with pytest.raises(Exception, match="calendar lacks the year"):
        O.screen(proposal, stored, pd, H.limits(tree), C.calendar(C.years_spanned(stored), ["DE-NW"])).collect()


def test_screening_joins_by_equality(spark, org, cal):
    tree, _, _, _, pd = org
    stored = spark.createDataFrame(_random_entries(7, 6, 60), ABSENCE)
    proposal = stored.select(F.col("absence_id").alias("proposal_id"), "person_id", "start", "end")
    for found in (O.screen(proposal, stored, pd, H.limits(tree), cal),
                  O.screened_people(proposal, stored, pd, H.limits(tree), cal)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_screened_pairs_are_done_as_they_are_joined(spark, org):
    tree, _, _, _, pd = org
    # everybody is away all year: each two people meet, by days in one block, two or many
    stored = spark.createDataFrame([(i, i, i % 6, "urlaub", "genehmigt", date(2023, 1, 1), date(2024, 12, 31), False, False, "")
                                    for i in range(6)], ABSENCE)
    cal = C.calendar(C.years_spanned(stored), ["DE-NW"])
    works = sorted(r.day for r in cal.filter("workday").collect())
    asked = [(n * 1000 + i, i % 6, works[i], works[i + n - 1]) for n in (1, 20, 32, 33, 64, 90) for i in range(30, 260, 7)]
    proposal = spark.createDataFrame(asked, "proposal_id int, person_id long, start date, end date")
    found = O.screened_people(proposal, stored, pd, H.limits(tree).withColumn("max_absent", F.lit(0)), cal)
    days = {(i, s, sum(s <= d <= e for d in works)) for i, _, s, e in asked}
    got = found.collect()
    assert {(r.proposal_id, r.first_day, r.days) for r in got} == days
    assert len(got) == len({(r.proposal_id, r.dept_id, r.other_id) for r in got}) > len(asked)
    # only pairs of proposals over many blocks are shuffled, in one aggregate of two steps
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Union" in plan and plan.count("Aggregate(keys=[proposal_id") <= 2


def test_flagged_entries(spark, org, cal):
    tree, _, _, _, pd = org
    absence = spark.createDataFrame(_random_entries(3, 6, 50), ABSENCE)
    found = O.conflicts(O.occupancy(absence, pd, cal), H.limits(tree)).persist()
    hot = defaultdict(set)
    for r in found.collect():
        for k in range((r["to"] - r["from"]).days + 1):
            hot[r.dept_id].add(r["from"] + timedelta(days=k))
    depts = {r.person_id: r.dept_ids for r in pd.collect()}
    for r in O.flag_conflicted(absence, found, pd).collect():
        days = {r.start + timedelta(days=k) for k in range((r.end - r.start).days + 1)}
        assert r.conflicted == any(days & hot[d] for d in depts.get(r.person_id, []))


@pytest.mark.parametrize("part", [200_000, 7, 1])
def test_lanes_match_first_fit(spark, part):
    # with small parts chains are cut anywhere, and the open lanes are handed over
    absence = spark.createDataFrame(_random_entries(5, 5, 200 if part > 1 else 60), ABSENCE).repartition(3)
    got = {r.absence_id: r.lane for r in L.assign_lanes(absence, part).collect()}
    by_person = defaultdict(list)
    for r in absence.collect():
        by_person[r.person_id].append(r)
    for rows in by_person.values():
        ends = []
        for r in sorted(rows, key=lambda x: (x.start, x.ord)):
            lane = next((i for i, e in enumerate(ends) if e < r.start), len(ends))
            ends[lane:lane + 1] = [r.end]
            assert got[r.absence_id] == lane
    assert len(got) == absence.count()


def _repair(rows):
    parent = {i: p for i, p in rows}
    parent = {i: (p if p in parent else None) for i, p in parent.items()}
    for i, _ in rows:
        seen, cur = {i}, i
        while parent[cur]:
            if parent[cur] in seen:
                parent[i] = None
                break
            seen.add(parent[cur])
            cur = parent[cur]
    return parent


@pytest.mark.parametrize("seed", range(4))
def test_cycle_repair_matches_stored_order_walk(spark, seed):
    rnd = random.Random(seed)
    ids = [f"d{i}" for i in range(14)]
    rnd.shuffle(ids)
    rows = [(i, rnd.choice([None, "unknown", *ids])) for i in ids]
    dept = spark.createDataFrame([(n, i, p) for n, (i, p) in enumerate(rows)],
                                 "ord int, dept_id string, parent_id string")
    assert {r.dept_id: r.parent_id for r in H.repair_parents(dept).collect()} == _repair(rows)


def test_closure_of_a_deep_chain(spark):
    n = 37
    dept = spark.createDataFrame([(i, f"d{i}", f"n{i}", f"d{i - 1}" if i else None, 1)
                                  for i in range(n)], TREE)
    got = {(r.dept_id, r.anc_id): r.depth for r in H.closure(dept).collect()}
    assert got == {(f"d{i}", f"d{j}"): i - j for i in range(n) for j in range(i + 1)}


def test_tree_order_and_deletion(spark, org):
    tree, _, member, clo, _ = org
    listed = H.tree_order(tree, clo).orderBy("tree_key").collect()
    assert [(r.dept_id, r.depth, r.path) for r in listed] == [
        ("T", 0, ""), ("A", 1, "Top"), ("B", 1, "Top"), ("C", 2, "Top / Rechts")]
    gone = spark.createDataFrame([("B",), ("T",)], "dept_id string")
    kept, left = H.delete_departments(tree, member, clo, gone)
    assert {(r.dept_id, r.parent_id) for r in kept.collect()} == {("A", None), ("C", None)}
    assert {r.dept_id for r in left.collect()} == {"A", "C", "gone"}


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([(2024, "Ä; b", '10,5')], "year int, Person string, Rest string")
    reports.write_report(rows, str(tmp_path / "r"))
    file = next((tmp_path / "r" / "year=2024").glob("*.csv"))
    assert file.read_bytes().decode() == 'Person;Rest\r\n"Ä; b";10,5\r\n'


def test_calendar_files_are_read_in_pieces(spark, tmp_path):
    event = "BEGIN:VEVENT\r\nSUMMARY:" + "ä€x" * 60 + "\r\nEND:VEVENT"
    events = spark.createDataFrame([(2024, i, event) for i in range(400)] + [(2025, 9, "BEGIN:VEVENT\r\nEND:VEVENT")],
                                   "year int, absence_id int, event string")
    reports.write_calendars(events, str(tmp_path / "c"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "9000")
    try:
        found = reports.calendar_figures(spark, str(tmp_path / "c"))
        assert "wholeText" not in found._jdf.queryExecution().toString()
        got = {r.year: r for r in found.collect()}
    finally:
        spark.conf.set(key, before)
    for year, n in ((2024, 400), (2025, 1)):
        text = "".join(f.read_bytes().decode() for f in (tmp_path / "c" / f"year={year}").glob("*/*.txt"))
        assert tuple(got[year]) == (year, "BEGIN:VCALENDAR", "END:VCALENDAR", f"X-WR-CALNAME:Abwesenheiten {year}",
                                    n, 0, len(text.replace("\r\n ", "")))


def test_calendar_files_are_whole(spark, tmp_path):
    event = "BEGIN:VEVENT\r\nSUMMARY:" + "ä€x" * 60 + "\r\nEND:VEVENT"
    events = spark.createDataFrame([(2024, i, event) for i in range(9)] + [(2025, 9, "BEGIN:VEVENT\r\nEND:VEVENT")],
                                   "year int, absence_id int, event string")
    reports.write_calendars(events, str(tmp_path / "c"), files_per_year=3)
    seen = 0
    for file in (tmp_path / "c").glob("year=*/file=*/*.txt"):
        text = file.read_bytes().decode()
        year = file.parent.parent.name[5:]
        assert text.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n") and text.endswith("END:VEVENT\r\nEND:VCALENDAR\r\n")
        assert f"X-WR-CALNAME:Abwesenheiten {year}\r\n" in text
        assert all(len(line.encode()) <= 75 for line in text.split("\r\n"))
        whole = text.replace("\r\n ", "")
        assert whole.count("BEGIN:VCALENDAR") == 1
        seen += whole.count(event) if year == "2024" else whole.count("BEGIN:VEVENT")
    assert seen == 10
