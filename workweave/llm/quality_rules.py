"""Quality rules with risk-controlled thresholds.

Words are runs between ASCII white space. Five measures, each worse when larger, are taken of every
whole text: symbols per character, repeated lines per line, words in repeated 3-word windows per
word, ASCII capitals per character, and exclamation marks per word. A rule rejects a document whose measure is
above a cutoff of its stratum (``lang``).

Cutoffs come from labelled documents. For each stratum and rule the cutoffs of a fixed grid are
tested from the mildest to the strictest: with ``n`` good documents of which ``k`` would be
rejected, a cutoff holds if P(Binomial(n, risk) <= k) is at most the level, that is, if the exact
(Clopper-Pearson) upper bound of the share of good documents rejected is at most ``risk``. The
first one that fails ends the sequence, and the strictest before it is taken; without one the rule
rejects nothing in that stratum. The level is DELTA divided by the number of strata and rules
(Bonferroni; a fixed sequence needs no more), and the risk is RISK divided by the number of rules,
so with probability 1 - DELTA at most RISK of the good documents of every stratum are rejected.

Besides, base rules reject what has fewer than 50 words or more than half of its words in repeated
windows. Everything is DataFrame functions. Null and empty texts have no words and all measures 0;
a null ``lang`` is a stratum of its own; labels that are null or not 1 are not used, and a document
that is labelled twice counts once. Rows that repeat are each judged; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from workweave.llm.tables import save

RISK, DELTA = 0.05, 0.05
#: Cutoffs of each measure, from the mildest to the strictest.
GRID = {
    "symbols": (0.30, 0.20, 0.15, 0.10, 0.07, 0.05, 0.03, 0.02),
    "dup_lines": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30),
    "repeats": (0.50, 0.40, 0.30, 0.25, 0.20, 0.15),
    "capitals": (0.90, 0.70, 0.50, 0.30, 0.20, 0.15),
    "shouts": (0.80, 0.60, 0.40, 0.20, 0.10, 0.05),
}
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"
#: A window's place takes so many low bits beside its hash.
_PLACE = 26


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id, lang`` and ``carried`` columns with the counts of every text and the five measures."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(_WORD)))
    counted = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", *carried,
                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
               .select("doc_id", "lang", *carried,
                       _without(text, _SPACE).cast("long").alias("word_chars"),
                       (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
                       (F.length(text) - _without(text, _CAPITALS)).alias("n_capitals"),
                       (F.length(text) - _without(text, "!")).alias("n_shouts"),
                       lines.alias("lines"),
                       F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)).alias("words"))
               .withColumn("n_lines", F.size("lines"))
               .withColumn("n_dup_lines",
                           (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
               .withColumn("n_words", F.size("words").cast("long")).drop("lines"))
    repeated = _repeat_words(counted)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return repeated.select(
        "doc_id", "lang", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("n_capitals", "word_chars").alias("capitals"),
        share("n_shouts", "n_words").alias("shouts"))


def _repeat_words(counted: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside 3-word windows that occur twice or more.

    The windows' hashes are sorted as plain longs, cut to leave room for the window's place; only
    windows next to an equal one are then compared by their whole hash.
    """
    empty = F.array().cast("array<bigint>")
    words = F.col("words")
    windows = F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(empty)
    keyed = counted.withColumn("windows", windows).drop("words").withColumn(
        "sorted", F.sort_array(F.transform("windows", lambda h, i: F.shiftleft(h, _PLACE)
                                           .bitwiseOR(i.cast("bigint")))))
    cut = lambda x: F.shiftrightunsigned(x, _PLACE)
    beside = lambda name, j, same: F.coalesce(same(F.get(name, j - 1)), F.lit(False)) | F.coalesce(
        same(F.get(name, j + 1)), F.lit(False))
    near = F.filter("sorted", lambda x, j: beside("sorted", j, lambda y: cut(y) == cut(x)))
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    close = keyed.withColumn("near", near).withColumn("near", F.array_sort(F.transform(
        "near", lambda x: F.struct(F.get("windows", place(x)).alias("h"), place(x).alias("at")))))
    twice = F.filter("near", lambda x, j: beside("near", j, lambda y: y["h"] == x["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda seen, at: F.struct((at + 3).alias("end"),
                                  (seen["n"] + at + 3 - F.greatest(at, seen["end"])).alias("n")))
    return (close.withColumn("starts", starts)
            .withColumn("n_repeat_words", covered["n"].cast("long"))
            .drop("windows", "sorted", "near", "starts"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed by its logarithms; 1 where k is above the mean."""
    term = F.lit(math.log1p(-p)) * n
    odds = math.log(p) - math.log1p(-p)

    def add(seen: Column, i: Column) -> Column:
        now = seen["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(now, seen["sum"]), F.least(now, seen["sum"])
        return F.struct(now.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(
        F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(term.alias("term"), term.alias("sum")), add,
                        lambda seen: F.least(F.lit(1.0), F.exp(seen["sum"])))
    return F.when(k > p * n, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
            ) -> DataFrame:
    """``lang, rule, cutoff`` that hold: at most one row per stratum and rule."""
    good = (labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
            .dropna().distinct())
    held = measured.join(good, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    tests = [(rule, i, cut) for rule, cuts in GRID.items() for i, cut in enumerate(cuts)]
    counts = held.groupBy("lang").agg(F.count("*").alias("n"), *[
        F.count_if(F.col(rule) > cut).alias(f"{rule}_{i}") for rule, i, cut in tests])
    rows = counts.select("lang", "n", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cutoff"),
                 F.col(f"{rule}_{i}").alias("k")) for rule, i, cut in tests])).alias("t"))
    rows = rows.select("lang", "n", "t.*")
    level = F.lit(delta / len(GRID)) / F.count("*").over(Window.partitionBy("rule", "step"))
    sequence = Window.partitionBy("lang", "rule").orderBy("step")
    passed = (rows.withColumn("level", level)
              .withColumn("passes", binomial_tail(F.col("k"), F.col("n"), risk / len(GRID))
                          <= F.col("level"))
              .withColumn("so_far", F.min(F.col("passes").cast("int")).over(sequence)))
    return (passed.where("so_far = 1").groupBy("lang", "rule")
            .agg(F.min("cutoff").alias("cutoff")))


def _judged(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``failed``, the rules that reject."""
    wide = save(chosen.groupBy(F.col("lang").alias("stratum")).agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}")
        for rule in GRID]), "cutoffs")
    failed = F.filter(F.array(*[
        F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in GRID]),
        lambda rule: rule.isNotNull())
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # one condition over both sides: a filter on it stays above the join, so that the measures
    # below are computed once and not unfolded into the filter
    kept = F.when(F.size(failed) > 0, False).otherwise(~base)
    return (measured.join(wide, F.col("lang").eqNullSafe(F.col("stratum")), "left")
            .withColumn("failed", failed).withColumn("base_failed", base)
            .withColumn("kept", kept))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``failed`` (rules) of every document."""
    measured = save(measures(docs), "measures")
    return _judged(measured, cutoffs(measured, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are.

    Cutoffs are learned first; then every row is measured again where it is read, as a join by id
    would shuffle all texts.
    """
    chosen = cutoffs(save(measures(docs), "measures"), labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                       "doc_id", "lang", "text")
    return _judged(measures(rows, "__row"), chosen).where("kept").select("__row.*")
