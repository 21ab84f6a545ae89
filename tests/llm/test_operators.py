"""Operators on a small table with every odd case, against plain versions of them."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from workweave.llm import (decontaminate, html_text, license_scan, line_dedup, ngram_join, packing,
                           passage_dedup, quality_model, quality_rules, url_filter)
from workweave.llm.queries import held_out, tokenizer
from workweave.llm.tables import removing_shuffles

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node long, "
          "bucket string, label int, line int, n int, word string, item string")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
                    for _ in range(n))


def rows():
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = [prose(rng, 120) for _ in range(6)]
    near = base[0].split()
    near[50] = "changed"
    texts = [base[0], " ".join(near), base[0].upper(), base[1] + "\n" + passage,
             prose(rng, 30) + " " + passage + " " + prose(rng, 30), "", None, "one two", "ONE two",
             base[2] + "\nReleased under the MIT License.\nAll rights reserved.",
             "under the mit license under the mit license", base[3] * 40, "a " * 300,
             "shared line of some words\n" + base[4], "Shared  line of some words\n" + base[5]]
    made = [(i, t) for i, t in enumerate(texts)]
    return made + [(3, texts[3]), (3, texts[3])]


@pytest.fixture(scope="module")
def docs(spark):
    full = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), 1, "b", 2, 3, 4, "w", "i")
            for i, t in rows()]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_components(docs, empty):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()}
    assert found == {(d, n, c) for d, (n, c) in brute.ngram_components(dict(rows()).items()).items()}
    assert ngram_join.components(docs).count() == len(rows())
    assert ngram_join.components(empty).count() == 0


def test_ngram_null_ids(spark):
    text = prose(random.Random(1), 30)
    few = spark.createDataFrame([(None, text), (4, text), (None, None)], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.components(few).collect())
    assert found == [(-1, -1), (-1, 4), (4, 4)]


def test_line_dedup(docs, empty):
    want = brute.dedup_lines(dict(rows()).items())
    got = line_dedup.rewritten(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    got = got.collect()
    assert len(got) == len(rows()) and all(r.text == want[r.doc_id] for r in got)
    assert line_dedup.dedup(empty).count() == 0


def test_passages(docs, empty):
    found = passage_dedup.passages(docs).collect()
    texts = dict(rows())
    assert {(r.doc_id, r.removed) for r in found} >= {(3, False), (4, True), (0, False), (1, True)}
    assert not {r.doc_id for r in found} & {5, 6, 7, 8, 9, 10, 12, 13, 14}
    one = next(r for r in found if r.doc_id == 4)
    part = texts[4][one.start: one.end]
    assert part in texts[3] and len(part.split()) == one.n_words >= 24
    assert passage_dedup.passages(empty).count() == 0


def test_decontamination(spark, docs, empty):
    texts = dict(rows())
    items = spark.createDataFrame(
        [(1, texts[4]), (2, None), (3, ""), (4, "words that stand nowhere else in this table at all"),
         (1, texts[4])], "item_id long, text string")
    found = decontaminate.contamination(docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(4, 1)}
    left = docs.where(~decontaminate.holds_any(F.col("text"), items))
    assert left.count() == len(rows()) - 1 and left.columns == docs.columns
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_short_items_are_whole_sentences(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "True or false"), (3, "What is 15 percent of 80?")],
                                  "item_id long, text string")
    texts = ["well yes we went home", "Is it so? Yes. We left", "yes", "it is true or false to say", "a\ntrue or FALSE\nb",
             "Say what is 15 percent of 80 now", "Answer: What is 15 percent of 80? Well", "y" * 9, None, ""]
    found = decontaminate.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items)
    assert {(r.doc_id, r.item_id, r.verbatim) for r in found.collect()} == {
        (1, 1, True), (2, 1, True), (4, 2, True), (5, 3, True), (6, 3, True)}


def test_packing(docs, empty):
    for length in (2048, 64):
        found = packing.pack(docs, tokenizer(), length).collect()
        ends, sizes = {}, {}
        for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
            sizes.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        assert max(ends.values()) <= length
        assert len(ends) == brute.best_fit([r.length for r in found], length)
        assert sizes[5] == sizes[6] == [(0, 0, 1)]
        long = sorted(sizes[11])
        assert all(n == length for _, _, n in long[1:])
        assert [s for _, s, _ in long] == [sum(n for *_, n in long[:i]) for i in range(len(long))]
    assert packing.pack(empty, tokenizer()).count() == 0


def test_licenses(docs, empty):
    found = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (found[10].n_base, found[10].first_word, found[10].last_word) == (2, 0, 4)
    assert found[9].base_labels == "mit" and found[9].labels == "mit,proprietary"
    assert found[6].n_words == 0 and found[6].labels == "" and found[6].first_word is None
    assert license_scan.scan(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (3, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert found[12].n_repeat_words == 300 and not found[12].kept
    assert found[6].n_words == 0 and found[6].base_failed
    # its first and last word stand in no window that comes back
    assert found[11].n_repeat_words == found[11].n_words - 2 and found[3].kept
    assert quality_rules.kept_rows(docs, labels).columns == docs.columns
    assert {r.doc_id for r in quality_rules.kept_rows(docs, labels).collect()} == {
        d for d, r in found.items() if r.kept}
    assert quality_rules.judge(empty, labels).count() == 0
    tail = spark.range(1).select(quality_rules.binomial_tail(
        F.lit(2).cast("long"), F.lit(40).cast("long"), 0.05).alias("p"))
    # 2 of 40 is not above the mean of 2
    assert abs(tail.first().p - 0.6767359) < 1e-6


def test_quality_cutoffs_hold_their_risk(spark):
    rng = random.Random(3)
    full = [(i, prose(rng, 60) + (" !" * 90 if i % 200 == 0 else ""), "en") for i in range(1200)]
    many = spark.createDataFrame(full, "doc_id long, text string, lang string")
    labels = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    found = {r.rule: r.cutoff for r in quality_rules.cutoffs(
        quality_rules.measures(many), labels, risk=0.25, delta=0.05).collect()}
    assert found["capitals"] == min(quality_rules.GRID["capitals"])
    tight = quality_rules.cutoffs(quality_rules.measures(many), labels, risk=0.01, delta=0.05)
    assert "shouts" not in {r.rule for r in tight.collect()}


def test_urls(spark):
    urls = ["https://A.Example.NET/en/x?q#f", "http://example.net/de/", "https://example.com/de/a",
            "http://b.org/fr/", "http://b.org/xx/login?x", None, "no scheme/login", "x://net",
            "http://m.c.org/a#top", "http://badexample.com/de/a", "http://b.org/xx/login?x"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)],
                                  "page_id long, url string, token string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert found[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found[1] == ("example.net", "/de/", "net/", "block")
    assert found[2][2:] == ("example.com/de/", "block") and found[3][2:] == ("org/fr/", "allow")
    assert found[4] == found[10] == ("b.org", "/xx/login", None, "block")
    assert found[5] == found[6] == ("", "", None, "allow")
    assert found[7] == ("net", "", None, "allow") and found[8][3] == "block"
    assert found[9][2:] == (None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_html_and_classifier(spark, docs, empty):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some words here.</p></article>"),
                                   (None, None, None)], "page_id long, url string, html string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()] == [
        (1, "Some words here.", 16), (None, "", 0)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    found = quality_model.classify(docs, labels, held_out()).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 for r in found)
    assert quality_model.classify(docs, labels.limit(0), held_out()).first().score == 0.5
    assert quality_model.classify(empty, labels, held_out()).count() == 0


def test_ngram_near_copies_without_ids(spark):
    words = prose(random.Random(2), 80).split()
    near = " ".join([*words[:79], "other"])
    few = spark.createDataFrame([(None, " ".join(words)), (7, near)], "doc_id long, text string")
    assert [r.component_id for r in ngram_join.components(few).collect()] == [7, 7]


def test_passages_lose_no_link(spark):
    """Lines of 8 words beside the same with one more (4 of 5 shingles), and lines of 18 words that
    differ in the last two (12 of 16, the threshold itself)."""
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    texts = []
    for i in range(600):
        line = words(8 if i % 3 == 0 else 16)
        texts += [line, f"{line} {words(1)}"] if i % 3 == 0 else [
            f"{line} {words(2)}", f"{line} {words(2)}"]
    found = passage_dedup.passages(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept_by, r.n_words) for r in found} == {
        (i, i - i % 2, len(t.split())) for i, t in enumerate(texts)}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(f.getName().startswith("shuffle") for f in
                       spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()))
    before, was = held(), spark.conf.get(name)
    with removing_shuffles(spark.range(1)):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "x"))
    assert held() <= before and spark.conf.get(name) == was


def test_passages_are_whole(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    embedded = [words(51 + 7 * i) for i in range(8)]
    lines = [words(n) for n in (8, 14, 20, 30, 40)]
    near = words(60)
    texts = [words(40) + " " + p + " " + words(40) for p in embedded for _ in range(2)]
    texts += [words(25) + "\n" + p + "\n" + words(25) for p in lines for _ in range(2)]
    texts += [words(25) + "\n" + near, near.replace(near.split()[30], "other") + "\n" + words(25)]
    texts += ["no no " * 30 + words(9), words(9) + "\n" + "no no " * 30]
    found = passage_dedup.passages(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = {}
    for r in found:
        gone.setdefault((r.doc_id, r.removed), []).append(texts[r.doc_id][r.start: r.end])
    for i, p in enumerate(embedded + lines):
        for [part] in (gone[2 * i, False], gone[2 * i + 1, True]):
            # near paragraphs may go a few words beyond the equal ones
            assert p in part and len(part.split()) <= len(p.split()) + 8
    at = 2 * len(embedded + lines)
    assert gone[at + 1, True] == [texts[at + 1].split("\n")[0]]
    assert gone[at + 3, True] == [("no no " * 30).strip()]
    assert len(gone) == 2 * len(embedded + lines) + 4
