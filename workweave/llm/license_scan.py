"""License scans: text blocks that hold most words of a license template, by a set-similarity join.

Words are runs of digits, a-z (A-Z folded) and all characters beyond ASCII. A block is a line. A
template is found in a block that holds at least 0.8 of the template's distinct words. The words of
all templates are ordered by the number of blocks of the whole table that hold them, rarest first;
a block that contains enough of a template must hold one of the template's first words in that
order (prefix filter), must have enough distinct words (length filter), and its template words from
the first shared one on must suffice (positional filter). Blocks that pass are counted out.

Beside the templates, phrases are found wherever their words stand consecutively, across lines too.
Everything is DataFrame functions, a row at a time; only the counts of template words are grouped.
Null and empty texts hold nothing. Rows that repeat are each scanned; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases with their labels, and short license statements with theirs.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
           ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
)
PART, WHOLE = 80, 100

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _words(folded: Column) -> Column:
    """Distinct words of a folded block."""
    return F.array_distinct(F.filter(F.split(folded, _GAP), lambda w: w != ""))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _starts(spaced: Column, phrase: str) -> Column:
    """First words of a phrase in ``# w1 w2 ... `` (a mark, then every word between blanks)."""
    parts = F.split(spaced, f"(?= {phrase} )")
    # the blanks up to a part are the words before it
    reach = F.aggregate(F.slice(parts, 1, F.size(parts) - 1),
                        F.array().cast("array<bigint>"),
                        lambda seen, part: F.concat(seen, F.array(
                            (F.coalesce(F.get(seen, F.size(seen) - 1), F.lit(0)) + _spaces(part))
                            .cast("bigint"))))
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), reach).otherwise(
        F.array().cast("array<bigint>"))


def word_order(docs: DataFrame) -> list[str]:
    """The words of all templates, by the number of blocks that hold them and then by the word."""
    words = sorted({w for _, t in TEMPLATES for w in t.split()})
    vocabulary = F.array(*[F.lit(w) for w in words])
    blocks = docs.select(F.explode(F.split(_fold(F.col("text")), "\n")).alias("block"))
    counts = {r.word: r["count"] for r in blocks.select(
        F.explode(F.array_intersect(F.split("block", _GAP), vocabulary)).alias("word"))
        .groupBy("word").count().collect()}  # a row per template word
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _need(size: int) -> int:
    return -(-size * PART // WHOLE)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    ``blocks`` lists, in order, line number, label and containment of every template in a block
    that meets the threshold; ``score`` is 1 where a phrase stands, else the best containment.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    order = word_order(plain)
    place = {w: i for i, w in enumerate(order)}
    templates = []
    for label, text in TEMPLATES:
        words = sorted(set(text.split()), key=place.__getitem__)
        templates.append((label, words, words[: len(words) - _need(len(words)) + 1]))
    first = sorted({w for *_, prefix in templates for w in prefix})
    holds = f"(^|(?<!{_WORD}))(" + "|".join(first) + f")($|(?!{_WORD}))"

    folded = plain.withColumn("text", _fold(F.coalesce("text", F.lit(""))))
    spaced = F.concat(F.lit("# "), F.trim(F.regexp_replace("text", _GAP, " ")), F.lit(" "))
    lines = F.transform(F.split("text", "\n"),
                        lambda line, i: F.struct(i.alias("line"), line.alias("block")))
    near = F.filter(lines, lambda x: F.regexp_like(x["block"], F.lit(holds)))
    staged = folded.select("doc_id", spaced.alias("spaced"), near.alias("near")).select(
        "doc_id", "spaced",
        F.transform("near", lambda x: F.struct(x["line"].alias("line"),
                                               _words(x["block"]).alias("words"))).alias("near"),
        *[_starts(F.col("spaced"), phrase).alias(f"at{i}") for i, (phrase, _) in enumerate(PHRASES)])

    def found(block: Column) -> Column:
        held = block["words"]
        hits = []
        for label, words, prefix in templates:
            ranked = F.array(*[F.lit(w) for w in words])
            need, size = _need(len(words)), len(words)
            shared = F.array_intersect(ranked, held)
            # the template's words from the first shared one on
            rest = size + 1 - F.array_position(ranked, F.get(shared, F.lit(0)))
            meets = (F.arrays_overlap(F.array(*[F.lit(w) for w in prefix]), held)
                     & (F.size(held) >= need) & (rest >= need) & (F.size(shared) >= need))
            hits.append(F.when(meets, F.struct(
                block["line"].alias("line"), F.lit(label).alias("label"),
                (F.size(shared) / F.lit(size)).alias("containment"))))
        return F.filter(F.array(*hits), lambda h: h.isNotNull())

    base = F.concat(*[F.when(F.size(f"at{i}") > 0, F.array(F.lit(label))).otherwise(
        F.array().cast("array<string>")) for i, (_, label) in enumerate(PHRASES)])
    starts = F.concat(*[F.col(f"at{i}") for i in range(len(PHRASES))])
    one = staged.select(
        "doc_id", (_spaces(F.col("spaced")) - F.when(F.col("spaced") == "#  ", 2).otherwise(1))
        .cast("long").alias("n_words"),
        starts.alias("starts"), base.alias("base"),
        F.flatten(F.transform("near", found)).alias("blocks"))
    every = F.array_sort(F.array_distinct(F.concat(
        "base", F.transform("blocks", lambda b: b["label"]))))
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return one.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))
        .alias("score"), "blocks")
