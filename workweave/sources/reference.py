"""Absence types, statuses, holiday rules, price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (type, label, counts towards occupancy, uses the allowance)
ABSENCE_TYPES = [
    ("urlaub", "Urlaub", True, True),
    ("resturlaub", "Resturlaub", True, True),
    ("sonderurlaub", "Sonderurlaub", True, False),
    ("gleitzeit", "Überstunden", True, False),
    ("krank", "Krank", True, False),
    ("fortbildung", "Fortbildung", True, False),
    ("elternzeit", "Elternzeit", True, False),
    ("homeoffice", "Homeoffice", False, False),
]

# Status and label
STATUSES = [
    ("beantragt", "Beantragt"),
    ("genehmigt", "Genehmigt"),
    ("abgelehnt", "Abgelehnt"),
]
PENDING, APPROVED, REJECTED = (s for s, _ in STATUSES)

# The bucket of people without a department and its limit
NO_DEPARTMENT = "__none__"
NO_DEPARTMENT_NAME = "Ohne Abteilung"
DEFAULT_LIMIT = 2
DEFAULT_ENTITLEMENT = 30.0

# regions
GERMAN_STATES = [
    "DE-BW", "DE-BY", "DE-BE", "DE-BB", "DE-HB", "DE-HH", "DE-HE", "DE-MV",
    "DE-NI", "DE-NW", "DE-RP", "DE-SL", "DE-SN", "DE-ST", "DE-SH", "DE-TH",
]
REGIONS = [*GERMAN_STATES, "AT", "CH", "NONE"]
DEFAULT_REGION = "DE-NW"

# Public holidays as (regions, kind, a, b, name, only year).
# fixed: month a, day b; easter: offset a; penance: the Wednesday before 23 November.
# Where two rules name the same day, the later one wins.
HOLIDAY_RULES = [
    (GERMAN_STATES, "fixed", 1, 1, "Neujahr", None),
    (["DE-BW", "DE-BY", "DE-ST"], "fixed", 1, 6, "Heilige Drei Könige", None),
    (["DE-BE", "DE-MV"], "fixed", 3, 8, "Internationaler Frauentag", None),
    (GERMAN_STATES, "easter", -2, 0, "Karfreitag", None),
    (["DE-BB"], "easter", 0, 0, "Ostersonntag", None),
    (GERMAN_STATES, "easter", 1, 0, "Ostermontag", None),
    (GERMAN_STATES, "fixed", 5, 1, "Tag der Arbeit", None),
    (GERMAN_STATES, "easter", 39, 0, "Christi Himmelfahrt", None),
    (["DE-BB"], "easter", 49, 0, "Pfingstsonntag", None),
    (GERMAN_STATES, "easter", 50, 0, "Pfingstmontag", None),
    (["DE-BW", "DE-BY", "DE-HE", "DE-NW", "DE-RP", "DE-SL"], "easter", 60, 0, "Fronleichnam", None),
    (["DE-SL"], "fixed", 8, 15, "Mariä Himmelfahrt", None),
    (["DE-TH"], "fixed", 9, 20, "Weltkindertag", None),
    (GERMAN_STATES, "fixed", 10, 3, "Tag der Deutschen Einheit", None),
    (["DE-BB", "DE-HB", "DE-HH", "DE-MV", "DE-NI", "DE-SH", "DE-SN", "DE-ST", "DE-TH"],
     "fixed", 10, 31, "Reformationstag", None),
    (["DE-BW", "DE-BY", "DE-NW", "DE-RP", "DE-SL"], "fixed", 11, 1, "Allerheiligen", None),
    (["DE-SN"], "penance", 0, 0, "Buß- und Bettag", None),
    (GERMAN_STATES, "fixed", 12, 25, "1. Weihnachtstag", None),
    (GERMAN_STATES, "fixed", 12, 26, "2. Weihnachtstag", None),
    (["DE-BE"], "fixed", 5, 8, "Tag der Befreiung", 2020),
    (["AT"], "fixed", 1, 1, "Neujahr", None),
    (["AT"], "fixed", 1, 6, "Heilige Drei Könige", None),
    (["AT"], "easter", 1, 0, "Ostermontag", None),
    (["AT"], "fixed", 5, 1, "Staatsfeiertag", None),
    (["AT"], "easter", 39, 0, "Christi Himmelfahrt", None),
    (["AT"], "easter", 50, 0, "Pfingstmontag", None),
    (["AT"], "easter", 60, 0, "Fronleichnam", None),
    (["AT"], "fixed", 8, 15, "Mariä Himmelfahrt", None),
    (["AT"], "fixed", 10, 26, "Nationalfeiertag", None),
    (["AT"], "fixed", 11, 1, "Allerheiligen", None),
    (["AT"], "fixed", 12, 8, "Mariä Empfängnis", None),
    (["AT"], "fixed", 12, 25, "Christtag", None),
    (["AT"], "fixed", 12, 26, "Stefanitag", None),
    (["CH"], "fixed", 1, 1, "Neujahr", None),
    (["CH"], "easter", -2, 0, "Karfreitag", None),
    (["CH"], "easter", 1, 0, "Ostermontag", None),
    (["CH"], "fixed", 5, 1, "Tag der Arbeit", None),
    (["CH"], "easter", 39, 0, "Auffahrt", None),
    (["CH"], "easter", 50, 0, "Pfingstmontag", None),
    (["CH"], "fixed", 8, 1, "Bundesfeier", None),
    (["CH"], "fixed", 12, 25, "Weihnachten", None),
    (["CH"], "fixed", 12, 26, "Stephanstag", None),
]

# Call tiers with prices in USD per million tokens (in, out)
TIER_PRICES = [
    ("worker", 1.0, 5.0),
    ("verifier", 3.0, 15.0),
    ("advisor", 15.0, 75.0),
]
FALLBACK_TIER = "worker"

# Cache lifetime, run limits, price of an untried call
CACHE_HOURS = 168
MAX_RUN_USD = 1.0
MAX_RUN_CALLS = 60
UNTRIED_CALL_TOKENS = (4000, 800)

# Task states
TASK_STATES = ["PENDING", "DISPATCHED", "PASS", "FIX", "ESCALATED"]


def absence_types(spark: SparkSession) -> DataFrame:
    rows = [(t, i, label, c, q) for i, (t, label, c, q) in enumerate(ABSENCE_TYPES)]
    return spark.createDataFrame(
        rows, "type string, type_ord int, type_label string, counts boolean, quota boolean"
    )


def counting_types() -> list[str]:
    return [t for t, _, counts, _ in ABSENCE_TYPES if counts]


def quota_types() -> list[str]:
    return [t for t, _, _, quota in ABSENCE_TYPES if quota]


def tier_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIER_PRICES, "tier string, usd_in double, usd_out double")


def label_of(pairs: list[tuple], value: Column) -> Column:
    """Map a code to its label through a literal map (two first elements of each row)."""
    entries = [F.lit(x) for row in pairs for x in row[:2]]
    return F.element_at(F.create_map(*entries), value)


def holiday_rules() -> Column:
    """The rule table as one literal array, to be exploded next to a years column."""
    return F.array(*[
        F.struct(
            F.lit(ord_).alias("rule_ord"),
            F.array(*[F.lit(r) for r in regions]).alias("regions"),
            F.lit(kind).alias("kind"),
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.lit(name).alias("name"),
            F.lit(only or 0).alias("only_year"),
        )
        for ord_, (regions, kind, a, b, name, only) in enumerate(HOLIDAY_RULES)
    ])
