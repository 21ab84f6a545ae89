from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from workweave.functions import dates as D
from workweave.operators import accounts as A
from workweave.operators import calendar as C
from workweave.sources.reference import REGIONS


@pytest.fixture(scope="module")
def cal(spark):
    years = spark.createDataFrame([(y,) for y in (2008, 2020, 2024, 2025, 2026)], "year int")
    return C.calendar(years, REGIONS).persist()


def test_easter_known_dates(spark):
    years = spark.createDataFrame([(2024,), (2025,), (2026,), (1961,), (2038,), (1954,), (2049,)],
                                  "year int")
    got = {r[0]: r[1] for r in years.select("year", D.easter_sunday(F.col("year"))).collect()}
    assert got == {2024: date(2024, 3, 31), 2025: date(2025, 4, 20), 2026: date(2026, 4, 5),
                   1961: date(1961, 4, 2), 2038: date(2038, 4, 25), 1954: date(1954, 4, 18),
                   2049: date(2049, 4, 18)}


def test_later_rule_names_a_shared_day(cal):
    row = cal.filter("region = 'DE-NW' and day = date'2008-05-01'").first()
    assert row.holiday_name == "Christi Himmelfahrt" and not row.workday


def test_one_off_and_regional_holidays(cal):
    one = cal.filter("day = date'2020-05-08' and holiday_name is not null").collect()
    assert [(r.region, r.holiday_name) for r in one] == [("DE-BE", "Tag der Befreiung")]
    assert cal.filter("region = 'NONE' and holiday_name is not null").count() == 0
    penance = cal.filter("holiday_name = 'Buß- und Bettag' and year = 2024").collect()
    assert [(r.region, r.day) for r in penance] == [("DE-SN", date(2024, 11, 20))]


def _bridges(days):
    """Brute force over one region and year: every run of workdays up to four days."""
    found = []
    n, i = len(days), 0
    while i < n:
        if not days[i].workday:
            i += 1
            continue
        j = i
        while j + 1 < n and days[j + 1].workday:
            j += 1
        b, a = i, j
        while b > 0 and not days[b - 1].workday:
            b -= 1
        while a + 1 < n and not days[a + 1].workday:
            a += 1
        cost, free = j - i + 1, a - b + 1
        names = [d.holiday_name for d in reversed(days[b:i]) if d.holiday_name] or [
            d.holiday_name for d in days[j + 1:a + 1] if d.holiday_name]
        if cost <= 4 and b < i and a > j and free / cost >= 2.2 and names:
            found.append((days[i].day, days[j].day, cost, free, names[0], days[b].day, days[a].day))
        i = j + 1
    return found


@pytest.mark.parametrize("region,year", [("DE-BY", 2024), ("AT", 2025), ("CH", 2026), ("DE-NW", 2008)])
def test_bridges_match_brute_force(cal, region, year):
    one = cal.filter((F.col("region") == region) & (F.col("year") == year))
    want = _bridges(one.orderBy("day").collect())
    got = C.bridges(one).orderBy("from").collect()
    assert [(r["from"], r["to"], r.cost, r.free, r.cause, r.free_from, r.free_to) for r in got] == want
    assert want


def test_week_buckets_follow_the_open_bucket(cal):
    one = cal.filter("region = 'DE-NW'")
    for year in (2020, 2024, 2025):
        rows = C.week_buckets(one.filter(F.col("year") == year)).orderBy("day").collect()
        seen, buckets = [], []
        for r in rows:
            if r.iso_week not in seen:
                seen.append(r.iso_week)
            buckets.append((len(seen), seen[-1]))
        assert [(r.bucket, r.bucket_week) for r in rows] == buckets


CASES = [
    # start, end, half_start, half_end, workdays in 2024 (DE-NW)
    ("2024-03-04", "2024-03-08", False, False, 5.0),
    ("2024-03-04", "2024-03-08", True, False, 4.5),
    ("2024-03-04", "2024-03-08", True, True, 4.0),
    ("2024-03-04", "2024-03-04", True, False, 0.5),
    ("2024-03-04", "2024-03-04", False, True, 1.0),
    ("2024-03-04", "2024-03-04", True, True, 1.0),
    ("2024-03-09", "2024-03-10", True, True, 0.0),
    ("2024-03-08", "2024-03-10", False, True, 1.0),
    ("2024-03-09", "2024-03-11", True, False, 1.0),
    ("2024-03-28", "2024-04-02", False, False, 2.0),
    ("2023-12-27", "2024-01-03", True, False, 2.0),
    ("2024-12-30", "2025-01-03", False, True, 2.0 - 0.5),
]


def test_half_day_rules(spark, cal):
    rows = [(i, date.fromisoformat(s), date.fromisoformat(e), hs, he)
            for i, (s, e, hs, he, _) in enumerate(CASES)]
    entries = spark.createDataFrame(
        rows, "absence_id int, start date, end date, half_start boolean, half_end boolean")
    one = cal.filter("region = 'DE-NW'")
    got = {r.absence_id: r.workdays for r in A.entry_workdays(entries, one).filter(
        "year = 2024").collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}
    slow = {r.absence_id: r.workdays for r in A.entry_workdays_by_days(entries, one).filter(
        "year = 2024").collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in slow.items() if v}


def test_calendar_is_complete(cal):
    for r in cal.groupBy("region", "year").agg(F.count("*").alias("n"), F.max("i").alias("m")).collect():
        length = (date(r.year + 1, 1, 1) - date(r.year, 1, 1)) // timedelta(days=1)
        assert (r.n, r.m) == (length, length - 1)


def test_rounding_and_texts(spark):
    df = spark.createDataFrame([(-2.5,), (-2.75,), (0.25,), (10.0,), (10.5,)], "x double")
    got = [tuple(r) for r in df.select(
        D.half_day_round(F.col("x")).cast("double"), D.german_number(F.col("x"))).collect()]
    assert got == [(-2.5, "-2,5"), (-2.5, "-2,75"), (0.5, "0,25"), (10.0, "10"), (10.5, "10,5")]
    d = spark.createDataFrame([("2026-07-01", "2026-07-14"), ("2026-06-28", "2026-07-03"),
                               ("2026-12-30", "2027-01-02"), ("2026-07-01", "2026-07-01")], "a string, b string")
    ranges = [r[0] for r in d.select(D.german_range(
        F.col("a").cast("date"), F.col("b").cast("date"))).collect()]
    assert ranges == ["01.–14.07.2026", "28.06. – 03.07.2026", "30.12.2026 – 02.01.2027", "01.07.2026"]
