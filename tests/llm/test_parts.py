"""Parts of the operators without Spark."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from workweave.llm import blocks, components, decontaminate, html_text, packing, passage_dedup, quality_model, trie
from workweave.llm.minhash import tune_bands
from workweave.llm.ngram_join import shingle_sets
from workweave.llm.tokens import Tokens
from workweave.llm.words import Words
from workweave.session import checkpoint_dir

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_trie_join_finds_what_comparing_all_finds():
    rng = random.Random(1)
    for _ in range(60):
        base = [rng.sample(range(60), rng.randint(1, 24)) for _ in range(3)]

        def one(base=base):
            s = set(rng.choice(base)) | {rng.randrange(70) for _ in range(rng.randint(0, 5))}
            return np.array(sorted(s), dtype=np.uint64)

        stored, queries = ([one() for _ in range(rng.randint(1, 20))] for _ in range(2))
        stored.append(np.zeros(0, dtype=np.uint64))
        want = [(i, j) for i, q in enumerate(queries) for j, s in enumerate(stored)
                if 100 * len({*q.tolist()} & {*s.tolist()}) >= 75 * len({*q.tolist()} | {*s.tolist()})]
        assert sorted(trie.join(stored, queries, 75, 100)) == want


def test_pairs_meet_where_comparing_all_says_so(monkeypatch):
    monkeypatch.setattr(components, "LOOKUPS", 50)
    rng = random.Random(3)
    for _ in range(60):
        base = [rng.sample(range(60), rng.randint(1, 24)) for _ in range(3)]
        sets = [{*rng.choice(base), *rng.sample(range(70), rng.randint(0, 5))} for _ in range(20)] + [set()]
        a, b = (x.ravel() for x in np.indices((21, 21)))
        got = components.meet([np.array(sorted(s), dtype=np.uint64) for s in sets], a, b, 75, 100)
        assert got.tolist() == [bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
                                for i, j in zip(a, b, strict=True)]


def test_sketches_rule_out_no_pair_that_links():
    rng = random.Random(4)
    for size in (3, 20, 90, 400):
        base = [rng.sample(range(1 << 60), size) for _ in range(4)]
        sets = [np.array(sorted({*rng.choice(base)[rng.randint(0, size // 4):],
                                 *rng.sample(range(1 << 60), rng.randint(0, size // 8))}), dtype=np.uint64)
                for _ in range(40)] + [np.zeros(0, np.uint64)]
        a, b = (x.ravel() for x in np.indices((41, 41)))
        for part in (75, 80):
            close = components.Sketched(sets, part, 100).close(a, b)
            links = components.meet(sets, a, b, part, 100)
            assert close[links].all() and links.any() and not close.all()


def test_pairs_of_small_buckets_by_sketches(spark):
    """Sets of 20 beside one with 2 other tokens, in one bucket with strangers; a larger bucket."""
    rng = random.Random(6)
    sets = []
    for _ in range(5):
        one = rng.sample(range(1 << 60), 22)
        sets += [one[:20], one[2:]]
    tokens = np.array([x for s in sets for x in s], dtype=np.uint64)
    marks = components.sketches(tokens, np.arange(0, tokens.size, 20)).view(np.int64).tolist()
    rows = [(1, i, 20, None if i % 3 else marks[i]) for i in range(10)]
    rows += [(2, i, 20, marks[i]) for i in range(0, 10, 3)] + [(4, i, 20, marks[i]) for i in (1, 2)]
    rows += [(5, i, 20, marks[i]) for i in (4, 5, 7, 8)] + [(3, i, 20, None) for i in range(11)]
    pairs, many = components.few(spark.createDataFrame(
        rows, "bucket long, node long, size int, sketch long"), 10, 75, 100)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert found >= {(i, i + 1) for i in range(0, 10, 2)} and len(found) < 20
    assert {(r.bucket, r.node) for r in many.collect()} == {(3, i) for i in range(11)}


def test_steps_of_a_resolution_are_removed(spark):
    texts = [" ".join(f"w{i * 30 + k}" for k in range(20)) for i in range(4)]
    texts += [t + " more" for t in texts]
    items = spark.createDataFrame(list(enumerate(texts)), "node long, item string")
    buckets = items.selectExpr("node % 4 as bucket", "node", "cast(null as long) as size")
    folder = Path(checkpoint_dir(spark).removeprefix("file:")) / "workweave"
    left = lambda: {p.name for p in folder.glob("llm-*") if p.name.split("-")[1] in
                    ("pivots", "pairs", "mixed", "best")}
    before = left()
    roots = {r.node: r.root for r in components.resolve(buckets, items, shingle_sets(5), 75, 100).collect()}
    assert all(roots[i] == roots[i + 4] for i in range(4)) and len(set(roots.values())) == 4
    assert left() == before


def test_words_part_at_ascii_white_space_and_fold_ascii():
    words = Words(pa.array(["A b\tc\xa0d", None, "", "É a"]))
    assert words.counts.tolist() == [3, 0, 0, 2]
    assert words.hash[0] == Words(pa.array(["a"])).hash[0]
    assert Words(pa.array(["É"])).hash[0] != Words(pa.array(["é"])).hash[0]


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8 ** 4) ** tune_bands(0.8, 0.995, 4) >= 0.995
    rows, least = passage_dedup.ROWS, passage_dedup.PART / passage_dedup.WHOLE
    assert 1 - (1 - least ** rows) ** tune_bands(least, passage_dedup.RECALL, rows) >= 0.995


def test_bands_of_paragraphs_know_every_text():
    words = [f"w{i}" for i in range(60)]
    like = " ".join(words), " ".join([*words[:59], "other"])
    texts = ["\n".join(like), like[0] + "\nmore", like[1] + "\nless"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(passage_dedup._banded(10, 3)(iter([batch]))).to_pylist()
    nodes = Words(pa.array(like)).text_hash().view(np.int64).tolist()
    buckets = {}
    for r in rows:
        buckets.setdefault(r["bucket"], []).append((r["node"], r["origin"]))
    both = [x for x in buckets.values() if {n for n, _ in x} >= set(nodes)]
    assert both and all(len({o for _, o in x}) > 1 for x in both)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(80):
        length = rng.choice([16, 64, 200])
        sizes = [rng.randint(1, length if rng.random() < 0.7 else max(1, length // 6))
                 for _ in range(rng.randint(1, 200))]
        ends, met = Counter(), Counter()
        for size, first, last, sequence, each, offset in packing.plan(Counter(sizes), length):
            for k in range(last - first):
                s, at = sequence + k // each, offset + k % each * size
                assert ends[s] == at and at + size <= length  # gapless
                ends[s] += size
                met[size] += 1
        assert met == Counter(sizes)
        assert len(ends) == brute.best_fit(sizes, length)


def test_tokens_equal_those_of_the_tokenizer():
    model = Tokens.of(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "don't've  \n\n x  ", "a'sand ''s 's\n's !'s  'll", "日本語 text", "x<|endoftext|>y",
             "  ", "\t\n", "1,000.5kg z    q", "naïve’s café  's", "a'", "'re'd'", "\n 'ved"]
    ids, first = model.encode(pa.array(texts), 0)
    for i, text in enumerate(texts):
        want = model.model.encode(text or "", add_special_tokens=False).ids
        assert ids[first[i]: first[i + 1]].tolist() == [*want, 0]


def test_templates_match_with_other_values_in_consistent_slots():
    item = ("The farmer Anna sold 12 apples on the market and then Anna gave 3 apples to a poor "
            "neighbour who had none of them at home.")
    table = decontaminate.Templates([7, 8], [item, None])
    other = item.replace("Anna", "Maria").replace("12", "40").replace("3", "9")
    mixed = item.replace("then Anna", "then Otto").replace("12", "40")
    hits = table.hits(pa.array(["So " + item, f"Read this. {other} End.", mixed, "", None]))
    assert [x[0] for x in hits[0]] == [7] and hits[0][0][4]
    assert [x[0] for x in hits[1]] == [7] and not hits[1][0][4]
    assert all(x[3] < 1 for x in hits[2])  # the windows that disagree do not count
    assert hits[3] == hits[4] == []


def test_copies_match_whatever_their_slots_and_case():
    items = ["What is 15 percent of 80?", "Add 3 kg 4 kg 5 kg 6 kg and 7 kg.", "Berlin 1990",
             "Ask Anna Otto Maria and Karl where Rome Paris and Vienna lie on the map."]
    table = decontaminate.Templates(list(range(4)), items)
    texts = [f"He was asked {t} And so on." for t in items] + [t.lower() for t in items]
    hits = table.hits(pa.array([*texts, "What is 20 percent of it?", "in Berlin since 1990"]))
    assert [[x[0] for x in h] for h in hits] == [[0], [1], [2], [3]] * 2 + [[], []]
    assert all(h[0][3] == 1 and h[0][4] for h in hits[:8])


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div class="cookie-bar">We use
cookies, all of them, thank you for that.</div><nav><a href=1>Home</a></nav><article><header><h1>Title
&amp; more</h1></header><p>First with a <a href="x">link</a> and<br>more &eacute;&#x41; text to read.
<p>Short.</p><ul><li>item one<li>item two</ul><div class="advert">Buy this special thing now</div>
<section id="comments"><p>I like this article very much and read it twice.</p></section></article>
<aside><p>Some long text beside the article with many words in it</p></aside><form><label>Name</label>
</form><footer>&copy; all</footer><script>var a="<p>x</p>";</script></body></html>"""


def test_html_keeps_the_article_alone():
    tree = html_text.trained()
    assert html_text.main_text(PAGE, tree).split("\n\n") == [
        "Title & more", "First with a link and more éA text to read.", "Short.", "item one", "item two"]
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == ""
    assert html_text.main_text("<p>The only block of a page without any frame at all.</p>", tree)


def test_html_goes_on_after_tags_that_are_not_closed():
    tree = html_text.trained()
    text = "Three boats came in from the bay before noon and a fourth one came after it."
    one, two = f"<p>{text}</p>", f"{text}\n\n{text}"
    for tag in ('<svg class="i"/>', "<math />", "<button>Go", "<select><option>a", "<textarea>a",
                "<object>", "<video>", "<canvas>"):
        page = f"<article><div>{tag}</div>{one}{one}</article>"
        assert html_text.main_text(page, tree) == two, tag
    for head in ("<head><title>t</title><body>", "<head><meta charset=x><body class=a>",
                 "<head><title>t</title>", "<head><script src=a /></head>"):
        assert html_text.main_text(f"<html>{head}{one}{one}", tree) == two, head
    assert html_text.main_text(f"<article><p>{text[:20]}<button>Go{one}</article>", tree).endswith(text)
    for mark in ("no-sidebar", "content with-nav", "has_sidebar", "menu-open"):
        assert html_text.main_text(f'<div class="{mark}">{one}{one}</div>', tree) == two, mark
    assert html_text.main_text(f'<article>{one}{one}<div class="main-menu">{one}</div></article>',
                               tree) == two


def test_network_scores_every_byte_and_learns():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["lake", "hill", "boat", "rain"], 150)) for _ in range(40)]
    bad = [t.upper() for t in good]
    texts, label = good + bad, np.array([1] * 40 + [0] * 40)
    rows = [(i, c) for i, t in enumerate(texts) for c in quality_model.chunks(t.encode())]
    data = np.stack([np.frombuffer(c.ljust(quality_model.CHUNK + 3, b"\0"), np.uint8) for _, c in rows])
    size = np.array([min(quality_model.CHUNK, len(c)) for _, c in rows])
    net = quality_model.fit(np.array([i for i, _ in rows]), data, size, label)
    score = quality_model.Scorer(net)
    both = score(pa.array(texts))
    assert ((both >= 0.5) == label).mean() > 0.95
    alone = np.array([score(pa.array([t]))[0] for t in texts])
    assert np.allclose(both, alone)
    odd = score(pa.array(["", None, good[0] * 40 + bad[0], good[0] * 40]))
    assert odd[0] == odd[1] and odd[2] != odd[3]  # the end of a long text counts


def test_binomial_tail_sums_as_it_should():
    n, k, p = 40, 2, 0.05
    want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    assert abs(want - 0.6767359) < 1e-6  # the value test_operators asks of Spark


def test_tables_on_the_way_are_removed(spark):
    import os

    from workweave.llm.tables import passing, save
    with passing(spark.range(1), "end"):
        step = save(spark.range(5), "step")
        with passing(spark.range(1)):
            inner = save(step, "inner")
        end = save(step, "end")
    exists = [os.path.exists(df.inputFiles()[0].removeprefix("file://")) for df in (step, inner, end)]
    assert exists == [False, False, True] and end.count() == 5


def test_blocks_bring_all_rows_of_a_key_together(spark):
    rows = spark.range(0, 5000, 1, 7).select(
        (F.col("id") % 900 * 7919 - 9).alias("key"), F.col("id").alias("n"))
    flat = lambda batches: batches
    made = blocks.blocks(rows, flat, 16, "key", ["key", "n"])
    assert made.count() <= 7 * 16  # a row for each task and part, not one for each key

    def sums(batches):
        for key, n in blocks.gathered(batches, key=np.int64, n=np.int64):
            key, n = blocks.met(key, n)
            at = np.flatnonzero(blocks.opens(key))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.add.reduceat(n, at))],
                                             names=["key", "n"])

    got = blocks.dealt(made).mapInArrow(sums, "key long, n long").collect()
    want = Counter()
    for i in range(5000):
        want[i % 900 * 7919 - 9] += i
    assert len(got) == 900 and {r.key: r.n for r in got} == want
    assert blocks.parts(spark.createDataFrame([(None,)], "text string")) == blocks.PARTS


def test_likely_pairs_are_those_of_the_plain_form(spark):
    """Buckets of up to FEW nodes by numpy, against every two nodes compared in Spark."""
    rng = np.random.default_rng(9)
    sketch, size = rng.integers(0, 1 << 63, 400), rng.integers(10, 30, 400)
    sketch[200:] = sketch[:200] ^ (1 << rng.integers(0, 62, 200))
    size[200:] = size[:200]
    rows = [(b, int(n)) for b in range(300) for n in
            {*rng.integers(0, 200, rng.integers(1, 20)), *rng.integers(0, 400, 2 + 38 * (b % 9 == 0))}]
    rows += [(b, n + 200) for b, n in rows if n < 200 and b % 9]
    key, node = (np.array(x) for x in zip(*sorted(set(rows)), strict=True))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(node), pa.array(sketch[node]),
         pa.array(size[node] << 2 | passage_dedup.LEAD)], names=["bucket", "node", "mark", "more"])
    made = blocks.packed(lambda batches: batches, 1, "bucket")(iter([batch]))
    got = pa.Table.from_batches(passage_dedup._likely(made)).to_pylist()
    pairs, many = components.few(spark.createDataFrame(
        [(int(b), int(n), int(size[n]), int(sketch[n])) for b, n in zip(key, node, strict=True)],
        "bucket long, node long, size int, sketch long"), passage_dedup.FEW, 75, 100)
    found = sorted((r["a"], r["b"]) for r in got if r["bucket"] is None)
    assert found == sorted((r.a, r.b) for r in pairs.collect()) and len(found) > 100
    assert ({(r["bucket"], r["a"], r["size"]) for r in got if r["bucket"] is not None}
            == {(r.bucket, r.node, r.size) for r in many.collect()} != set())


def test_passages_of_rows_without_ids_and_of_equal_rows(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    one, two, alone = words(60), words(60), words(60)
    rows = [(5, one), (5, one), (None, one), (None, one), (3, words(9) + "\n" + one),  # 3 keeps it
            (None, two), (7, two), (None, alone), (None, alone), (9, alone + " x"), (9, alone + " y")]
    found = passage_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.first_word, r.n_words, r.kept_by, r.removed) for r in found) == [
        (0, 0, 60, 3, True), (3, 9, 60, 3, False), (5, 0, 60, 3, True)]


def test_large_blocks_bring_items_to_fewer_tasks(spark, monkeypatch):
    """Unlike nodes of one bucket meet in blocks: the same components, with fewer copies."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10 ** 6)}" for _ in range(24)] for _ in range(700)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:23] + ["other"]) for b in base[::7]]
    items = spark.createDataFrame(list(enumerate(texts)), "node long, item string")
    buckets = items.selectExpr("cast(1 as long) as bucket", "node", "20 as size")
    save, copies = components.save, []

    def counted(df, label):
        if label == "blocks":
            copies.append(df.count())
        return save(df, label)

    monkeypatch.setattr(components, "save", counted)
    monkeypatch.setattr(components, "LOOKUPS", 1 << 12)
    found = [{(r.node, r.root) for r in components.resolve(
        buckets, items, shingle_sets(5), 75, 100, passage_dedup.DIRECT, block).collect()}
        for block in (components.BLOCK, passage_dedup.TOGETHER)]
    roots = dict(found[0])
    assert found[0] == found[1] and all(roots[i * 7] == roots[700 + i] for i in range(100))
    assert len(set(roots.values())) == 700 and copies[1] * 2 < copies[0]
