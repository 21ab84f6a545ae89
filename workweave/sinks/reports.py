"""Report rows with German headings, semicolon files and calendar events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workweave.functions import dates as D
from workweave.operators import sequences as S
from workweave.sources.reference import (
    ABSENCE_TYPES, PENDING, REJECTED, STATUSES, label_of,
)

# People named in one report cell; larger periods continue in further rows.
NAMES_PER_ROW = 10_000


def _joined(names: Column, sep: str) -> Column:
    return F.coalesce(F.array_join(names, sep), F.lit(""))


def account_rows(account: DataFrame, names: DataFrame) -> DataFrame:
    """One text row per person and year."""
    numbers = {
        "Anspruch": "entitlement", "Übertrag": "carryover", "Verfügbar": "total",
        "Genehmigt": "approved", "Beantragt": "pending", "Rest": "remaining",
        "Sonstige Abwesenheit": "other",
    }
    return account.join(names, "person_id", "left").select(
        "year", F.col("name").alias("Person"), _joined(F.col("dept_names"), " | ").alias("Abteilung"),
        F.coalesce("role", F.lit("")).alias("Rolle"),
        *[D.german_number(F.col(c)).alias(title) for title, c in numbers.items()],
    )


def entry_rows(entry: DataFrame, person: DataFrame, names: DataFrame) -> DataFrame:
    """One text row per entry and year, sorted by start; entries of unknown people drop out."""
    types = [(t, label) for t, label, *_ in ABSENCE_TYPES]
    yes = F.lit("ja")
    return (
        entry.join(person.select("person_id", "name"), "person_id")
        .join(names, "person_id", "left")
        .orderBy("year", "start", "ord")
        .select(
            "year", F.col("name").alias("Person"),
            _joined(F.col("dept_names"), " | ").alias("Abteilung"),
            label_of(types, F.col("type")).alias("Art"),
            label_of(STATUSES, F.col("status")).alias("Status"),
            D.german_date(F.col("start")).alias("Von"), D.german_date(F.col("end")).alias("Bis"),
            D.german_number(F.col("workdays")).alias("Arbeitstage"),
            F.when(F.col("half_start"), yes).otherwise("").alias("Halber erster Tag"),
            F.when(F.col("half_end"), yes).otherwise("").alias("Halber letzter Tag"),
            F.coalesce("note", F.lit("")).alias("Notiz"),
        )
    )


def conflict_rows(found: DataFrame, people: DataFrame, person: DataFrame,
                  names_per_row: int = NAMES_PER_ROW) -> DataFrame:
    """A row per period and ``names_per_row`` of its people, named in order of first day and stored
    order; ``Teil`` numbers the rows of a period from 1.

    People are numbered by running counts over blocks of days, so no task gathers a period of very
    many people and no cell grows without bound.
    """
    key = ["dept_id", "period"]
    numbered = S.running_sums(people.select(*key, "person_id", "day", "ord"), key, ["day", "ord"],
                              F.unix_date("day"), {"place": F.lit(1)})
    named = (
        numbered.join(person.select("person_id", "name"), "person_id")
        .withColumn("part", F.floor((F.col("place") - 1) / names_per_row) + 1)
        .groupBy(*key, "part")
        .agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("l"))
    )
    return found.withColumn("period", F.col("from")).join(named, key).select(
        F.col("dept_name").alias("Abteilung"), D.german_date(F.col("from")).alias("Von"),
        D.german_date(F.col("to")).alias("Bis"), F.col("workdays").alias("Arbeitstage"),
        F.col("peak").alias("Gleichzeitig abwesend"), F.col("max_absent").alias("Erlaubt"),
        F.col("over").alias("Überschreitung"), F.col("part").alias("Teil"),
        F.array_join(F.transform("l", lambda x: x["name"]), ", ").alias("Betroffene Personen"),
    )


def _escaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([,;\\])", r"\\$1"), F.lit("\n"), F.lit("\\n"))


def calendar_events(entry: DataFrame, person: DataFrame, names: DataFrame,
                    stamp: str = "20240101T000000Z") -> DataFrame:
    """(year, absence_id, event): one calendar event per entry that is not rejected."""
    types = [(t, label) for t, label, *_ in ABSENCE_TYPES]
    day = "yyyyMMdd"
    several = F.size("dept_names") > 1
    departments = F.when(
        F.size("dept_names") > 0,
        F.concat(F.when(several, "Abteilungen: ").otherwise("Abteilung: "),
                 F.array_join("dept_names", ", ")))
    note = F.when(F.col("note") != "", F.col("note"))
    description = F.concat_ws(
        "\n", departments,
        F.concat(F.lit("Status: "), label_of(STATUSES, F.col("status"))),
        F.concat(F.lit("Arbeitstage: "), D.german_number(F.col("workdays"))), note)
    summary = F.concat("name", F.lit(" – "), label_of(types, F.col("type")))
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("absence_id").cast("string"), F.lit("@workweave")),
        F.lit(f"DTSTAMP:{stamp}"),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("start", day)),
        F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add("end", 1), day)),
        F.concat(F.lit("SUMMARY:"), _escaped(summary)),
        F.concat(F.lit("DESCRIPTION:"), _escaped(description)),
        F.lit("TRANSP:TRANSPARENT"),
        F.when(F.col("status") == PENDING, "STATUS:TENTATIVE").otherwise("STATUS:CONFIRMED"),
        F.lit("END:VEVENT"))
    return (
        entry.filter(F.col("status") != REJECTED)
        .join(person.select("person_id", "name"), "person_id")
        .join(names, "person_id", "left")
        .select("year", "absence_id", lines.alias("event"))
    )


def write_report(rows: DataFrame, path: str) -> None:
    """Semicolon-separated files with CRLF line ends, one folder per year if present."""
    writer = rows.write.mode("overwrite").option("sep", ";").option("lineSep", "\r\n")
    if "year" in rows.columns:
        writer = writer.partitionBy("year")
    writer.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def folded(line: Column) -> Column:
    """A calendar line of at most 75 octets, continued in lines that begin with a blank."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("octets"))

    def step(acc: Column, char: Column) -> Column:
        size = F.octet_length(char)
        fits = acc["octets"] + size <= 75
        return F.struct(
            F.concat(acc["text"], F.when(fits, "").otherwise("\r\n "), char).alias("text"),
            F.when(fits, acc["octets"] + size).otherwise(size + 1).alias("octets"))

    chars = F.filter(F.split(line, ""), lambda c: c != "")
    return F.when(F.octet_length(line) <= 75, line).otherwise(
        F.aggregate(chars, start, step, lambda acc: acc["text"]))


def write_calendars(events: DataFrame, path: str, files_per_year: int = 1) -> None:
    """Calendar files (``BEGIN:VCALENDAR`` to ``END:VCALENDAR``), a folder per year and number.

    A year's events are dealt out over ``files_per_year`` files by their id, each a calendar of its
    own. Head and end come as rows around the events, so a file is written as its rows pass by.
    """
    lines = F.array_join(F.transform(F.split("event", "\r\n"), folded), "\r\n")
    dealt = events.select(
        "year", F.pmod(F.xxhash64("absence_id"), F.lit(files_per_year)).alias("file"),
        F.lit(1).alias("part"), "absence_id", lines.alias("value"))
    files = dealt.select("year", "file").distinct()
    head = F.concat_ws("\r\n", *map(F.lit, (
        "BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//workweave//DE", "CALSCALE:GREGORIAN",
        "METHOD:PUBLISH")), F.concat(F.lit("X-WR-CALNAME:Abwesenheiten "), F.col("year").cast("string")))
    frame = files.select("year", "file", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), head.alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit("END:VCALENDAR").alias("value")))).alias("f")
    ).select("year", "file", "f.*")
    rows = dealt.unionByName(frame, allowMissingColumns=True).repartition("year", "file")
    rows.sortWithinPartitions("year", "file", "part", "absence_id").select(
        "year", "file", "value").write.mode("overwrite").partitionBy("year", "file").option(
        "lineSep", "\r\n").text(path)


def calendar_figures(spark: SparkSession, path: str) -> DataFrame:
    """Per year of what ``write_calendars`` wrote, for one file a year: first and last line, the
    calendar's name, the number of events and of lines beyond 75 octets, and the characters with
    folded lines joined. A file is read line by line in pieces, so its length does not matter.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"),
                  F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("lineSep", "\r\n").text(path).select("year", "value", at.alias("at"))
    value, name = F.col("value"), F.lit("X-WR-CALNAME:")
    ends = F.length("value") + F.when(value.startswith(" "), -1).otherwise(2)
    # the collected name makes this a hash aggregate, where texts alone would have lines sorted
    return lines.groupBy("year").agg(
        F.min_by("value", "at").alias("head"), F.max_by("value", "at").alias("end"),
        F.array_min(F.collect_set(F.when(value.startswith(name), value))).alias("name"),
        F.count_if(value == "BEGIN:VEVENT").alias("events"),
        F.count_if(F.octet_length("value") > 75).alias("too_long"),
        F.sum(ends).alias("characters"))
