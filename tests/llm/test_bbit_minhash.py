"""b-bit MinHash: estimates, recall of the bands, and components against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from workweave.llm import bbit_minhash as op

SCHEMA = "doc_id long, text string, node long, n int, kept string, s0 int, row int, label string"


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def changed(rng, words, share):
    return [f"x{rng.randrange(10 ** 6)}" if rng.random() < share else w for w in words]


def shingles(text):
    words = brute.WORD.findall(brute.fold(text or ""))
    return {tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def expected(rows):
    """Components by all pairs; nodes are places in ``rows``, so ids may repeat or lack."""
    sets = {i: shingles(t) for i, (_, t) in enumerate(rows)}
    place = brute.least_by_links(sorted(sets), sets, 80, 100)
    ids = {}
    for i, p in place.items():
        if rows[i][0] is not None:
            ids.setdefault(p, []).append(rows[i][0])
    found = []
    for i, (doc, _) in enumerate(rows):
        least = min(ids.get(place[i], []), default=None) if sets[i] else doc
        found.append((doc, len(sets[i]), least, doc == least))
    return sorted(map(repr, found))


def answer(docs):
    return sorted(repr(tuple(r)) for r in op.near_copies(docs).collect())


def pair(rng, similarity, size=400):
    """Two sets of hashes with about the given Jaccard similarity."""
    common = round(2 * size * similarity / (1 + similarity))
    values = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
    return values[:size], np.concatenate([values[size - common: size], values[size:]])


@pytest.mark.parametrize("similarity", [0.0, 0.3, 0.6, 0.8, 0.95, 1.0])
def test_estimates_are_corrected_for_chance(similarity):
    rng = np.random.default_rng(3)
    pairs = [pair(rng, similarity) for _ in range(60)]
    values = np.concatenate([x for p in pairs for x in p])
    least = op.minima(values, np.arange(0, values.size, 400))
    guess = op.estimates(op.packed(least)[::2], op.packed(least)[1::2])
    # 60 pairs of 128 lanes
    assert abs(guess.mean() - similarity) < 0.03
    if similarity >= 0.8:
        assert (guess >= op.least_estimate()).all()
    if similarity <= 0.3:
        assert (guess < op.least_estimate()).all()


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    pairs = [pair(rng, 0.803) for _ in range(1500)]
    values = np.concatenate([x for p in pairs for x in p])
    keys = op.band_keys(op.minima(values, np.arange(0, values.size, 400)))
    found = (keys[::2] == keys[1::2]).any(axis=1)
    assert found.mean() >= 0.998 and op.BANDS * op.ROWS <= op.MINIMA


def test_spark_and_numpy_estimates_agree(spark):
    rng = np.random.default_rng(9)
    marks = op.packed(rng.integers(0, 1 << 32, (40, op.MINIMA), dtype=np.uint32))
    marks[20:, 0] = marks[:20, 0]
    signed = marks.view(np.int64)
    rows = [tuple(int(x) for x in (*signed[i], *signed[20 + i])) for i in range(20)]
    names = [f"{side}{s}" for side in ("a_", "b_") for s in op._SIGNATURE]
    got = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).select(
        op.estimate("a_", "b_").alias("e")).collect()
    want = op.estimates(marks[:20], marks[20:])
    assert sorted(round(r.e, 9) for r in got) == sorted(round(float(x), 9) for x in want)


def rows():
    rng = random.Random(17)
    bases = [prose(rng, n) for n in (60, 200, 3000, 12, 3)]
    texts = [" ".join(changed(rng, b, share)) for b in bases
             for share in (0, 0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.3)]
    # a chain: each text links with the next only
    chain = prose(rng, 200)
    for _ in range(12):
        chain = chain[12:] + prose(rng, 12)
        texts.append(" ".join(chain))
    texts += ["", None, " \t\n", "one", "ONE", "one two", "two one", "a a a a", "a a", "é É é", "é É"]
    made = [(500 - i, t) for i, t in enumerate(texts)]
    made += [made[0], made[0], (None, made[3][1]), (None, "alone in the world"), (None, None),
             (490, prose(rng, 50)[0]), (7, texts[1].upper())]
    return made


def test_components_match_all_pairs(spark):
    made = rows()
    docs = spark.createDataFrame([(d, t, 1, 2, "k", 3, 4, "l") for d, t in made], SCHEMA)
    assert answer(docs.repartition(5)) == expected(made)
    assert op.near_copies(docs.limit(0)).count() == 0


def test_hot_families(spark):
    """Groups of copies: exact ones, near ones that link, and like texts that do not."""
    rng = random.Random(23)
    base, frame = prose(rng, 300), prose(rng, 150)
    made = [(i, " ".join(base)) for i in range(150)]
    made += [(1000 + i, " ".join(changed(rng, base, rng.choice([0.01, 0.04, 0.07])))) for i in range(300)]
    # two thirds in common: proposed often, never linked
    made += [(2000 + i, " ".join([*frame, *prose(rng, 60)])) for i in range(300)]
    rng.shuffle(made)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert answer(docs.repartition(4)) == expected(made)


def test_blocks_join_what_pivots_leave(spark):
    """Two nodes that only a pair outside the pivots links; signatures decide nothing alone."""
    rng = random.Random(2)
    base = prose(rng, 400)
    made = [(i, " ".join(changed(rng, base, 0.055))) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumn("other", F.lit(1))
    assert answer(docs) == expected(made)
