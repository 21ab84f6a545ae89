"""Periodic runs against their definition, and the query's digests against hashlib and zlib."""

import hashlib
import random
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from workweave.llm import periodic_runs
from workweave.llm.queries import op12_periodic_runs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=4), st.integers(1, 9)), max_size=8))
def test_runs_match_their_definition(parts):
    words = [c for text, n in parts for c in text * n]
    assert periodic_runs.runs(words) == brute.periodic_runs(words)


def test_runs_in_poor_and_rich_texts():
    rng = random.Random(4)
    for kinds in (1, 2, 3, 5, 40):
        for _ in range(20):
            words = [rng.randrange(kinds) for _ in range(rng.randrange(160))]
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 12)
            words[at:at] = [rng.randrange(kinds) for _ in range(p)] * rng.randrange(3, 9)
            assert periodic_runs.runs(words) == brute.periodic_runs(words)


def test_segments_split_until_stable():
    # b is frequent in the whole text but not in the parts that c leaves
    words = list("bbxa") + list("aaaaaaa") + list("ybbz")
    assert [words[a:b] for a, b in periodic_runs.segments(words)] == [list("a" * 8)]
    assert periodic_runs.segments([]) == []


def test_long_texts_are_not_quadratic():
    words = [f"w{i}" for i in range(20_000)] * 6
    assert periodic_runs.runs(words) == [(0, 120_000, 20_000)]
    assert periodic_runs.runs(["a"] * 300_000) == [(0, 300_000, 1)]
    # one word goes each time: splitting gives up, the scan still finds the run
    peel = [f"v{i // 4}" for i in range(4_000)]
    assert periodic_runs.runs(peel + ["z"] * 9) == [(4_000, 9, 1)]


def test_ties_and_nothing():
    assert periodic_runs.strongest([]) is None
    assert periodic_runs.strongest([(9, 12, 3), (5, 8, 2), (0, 6, 2)]) == (5, 8, 2)
    found = [(0, 8, 2), (7, 12, 3)]
    words = list("ababababcdbcdbcdbcd")
    assert periodic_runs.collapsed(words, []) == words
    assert periodic_runs.collapsed(words, found) == ["a", "b", "c", "d"]


def expected(doc, text):
    words = periodic_runs_words(text)
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute.periodic_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_runs_words(text):
    return brute.WORD.findall(text or "")


def test_query_digests(spark, tmp_path):
    rng = random.Random(8)
    texts = ["", None, "one", "a b " * 40, "x y " * 30 + " ", "Ä\tä\x0bÄ\x0cä\r\n" * 9]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90))) for _ in range(60)]
    rows = [(i * 37 - 5, t) for i, t in enumerate(texts)] + [(-5, "a " * 6), (None, "z " * 7), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, [2], "b") for d, t in rows],
                                 "doc_id long, text string, runs int, best array<int>, seed string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected(d, t)) for d, t in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 2
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_periodic_runs(spark, f"{tmp_path}/none").count() == 0
