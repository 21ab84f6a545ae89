"""Periodic runs: stretches of words that repeat with a period, four times over or more.

A run is a stretch of consecutive words in which words ``q`` apart are identical, ``q`` being the
least such distance, of at least ``max(6, 4 * q)`` words, that no neighbouring word extends. Every
word of a run stands in it four times at least. So words that are rarer than that within a segment
are in no run there: they split it, and the parts are split again by their own counts until none
changes. What survives is scanned at every lag. A run of period ``q`` holds four places that are
multiples of ``q`` in a row, all with one word, so a lag only looks at multiples of itself: a
segment of ``n`` words costs about ``n log n`` and not its square.

Words are parted by ASCII white space and compared byte for byte. Null and empty texts have no
words, no runs and an empty collapsed text. Each row is judged by itself: repeated rows give
repeated results, null ids are kept, other columns are ignored. A long text needs memory in
proportion to itself and to nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.llm.tables import batches_of, documents

LEAST, REPEATS = 6, 4
#: Splitting may look at each word so many times on average; segments that are then still changing
#: are scanned as they are. This changes no result, as the scan needs no splitting to be right.
LOOKS = 64

Run = tuple[int, int, int]
RUN = "struct<start: long, length: long, period: long>"


def segments(words: Sequence) -> list[tuple[int, int]]:
    """Stretches in which every word stands ``REPEATS`` times or more, as far as runs need."""
    done, open_, looks = [], [(0, len(words))], LOOKS * len(words)
    while open_:
        a, b = open_.pop()
        if b - a < LEAST:
            continue
        part = words[a:b]
        count = Counter(part)
        looks -= b - a
        if looks < 0 or min(count.values()) >= REPEATS:
            done.append((a, b))
            continue
        if max(count.values()) < REPEATS:
            continue
        cuts = [a - 1, *[i for i, w in enumerate(part, a) if count[w] < REPEATS], b]
        open_ += [(x + 1, y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x > LEAST]
    return done


def _same(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on, in the direction ``step``, equal the one a lag further."""
    far = ids.size - lag - at if step > 0 else at + 1
    done, size = 0, 64
    while done < far:
        n = min(size, far - done)
        if step > 0:
            a, b = at + done, at + done + n
            differ = np.flatnonzero(ids[a:b] != ids[a + lag: b + lag])
        else:
            a, b = at - done - n + 1, at - done + 1
            differ = np.flatnonzero((ids[a:b] != ids[a + lag: b + lag])[::-1])
        if differ.size:
            return done + int(differ[0])
        done, size = done + n, 2 * size
    return done


def _scan(ids: np.ndarray) -> list[Run]:
    """The runs of one segment. Lags go up, so a run is first met at its least period; at a
    multiple of that it is the same stretch and passed over."""
    found: list[Run] = []
    long: list[Run] = []
    for lag in range(1, ids.size // REPEATS + 1):
        spaced = ids[::lag]
        same = spaced[1:] == spaced[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not hits.size:
            continue
        places = hits * lag
        long = [r for r in long if r[1] > 3 * lag]
        for start, length, period in long:
            if lag % period == 0:
                places = places[(places < start) | (places + lag >= start + length)]
        passed = -1
        for at in places.tolist():
            if at < passed:
                continue
            passed = at + _same(ids, at, lag, 1)
            start = at + 1 - _same(ids, at, lag, -1)
            if passed - start + lag >= max(LEAST, REPEATS * lag):
                found.append((start, passed - start + lag, lag))
                long.append(found[-1])
    return found


def runs(words: Sequence) -> list[Run]:
    """``start, length, period`` of every run, by start and period."""
    found: list[Run] = []
    for a, b in segments(words):
        number: dict = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words[a:b]), np.int32, b - a)
        found += [(a + start, length, period) for start, length, period in _scan(ids)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: Sequence[Run]) -> Run | None:
    """The run with the most repetitions; ties go to the earliest, then to the least period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: Sequence, found: Sequence[Run]) -> list:
    """The words without those that a run holds after its first period."""
    if not found:
        return list(words)
    stay = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        stay[start + period: start + length] = False
    return [words[i] for i in np.flatnonzero(stay).tolist()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ("start", "length", "period")
    for batch in batches:
        many, best, texts, sizes = [], [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = (text.as_py() or b"").split()
            found = runs(words)
            top = strongest(found)
            sizes.append(len(words))
            many.append([dict(zip(names, r, strict=True)) for r in found])
            best.append(None if top is None else dict(zip(names, top, strict=True)))
            texts.append(b" ".join(collapsed(words, found)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(many, pa.list_(run)),
             pa.array(best, run), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "best", "collapsed"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` for every row of ``docs(doc_id, text)``.

    ``runs`` lists all runs by start and period, ``best`` is the one with the most repetitions
    (null without a run), ``collapsed`` holds the words that stay, one space between them.
    """
    with batches_of(docs, 2000):
        return documents(docs).mapInArrow(
            _rows, f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")


def _looped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, seed in zip(batch.column("text").cast(pa.binary()).to_pylist(),
                              batch.column("seed").to_pylist(), strict=True):
            words = (text or b"").split() if seed is not None and seed % 10 == 0 else []
            if words:
                n, turn = len(words), seed // 10
                a = turn % n
                p = 1 + (n - a) // (3 + turn % 8)
                times, rest = divmod(n - a, p)
                loop = words[a: a + p]
                text = b" ".join(words[:a] + loop * times + loop[:rest])
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "text"])


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in which a tenth of the documents, told by the checksum of their id, ends in
    a loop: words from a place on repeat with a period. Rows without an id stay as they are."""
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("seed")
    with batches_of(docs, 2000):
        return documents(docs).select("doc_id", "text", seed).mapInArrow(
            _looped, "doc_id long, text string")
