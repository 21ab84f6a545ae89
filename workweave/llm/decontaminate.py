"""Benchmark decontamination: template windows with typed placeholders and consistent slots.

Words are runs of ASCII letters, digits and all other characters beyond ASCII, with A-Z in lower
case. A word with a digit, or a number word, becomes the placeholder NUMBER; a unit becomes UNIT;
a capitalised word that does not open a sentence becomes NAME. Windows of eight canonical words
with at least five literal ones are looked up in a hash table of the windows of all benchmark
items (an item of fewer words is one window), and beside them all windows of the plain words, so
that copies are found whatever their case and however many of their words are slots. An item of
fewer than five words without a number counts only where it is a whole sentence or line. Where a
document holds windows of an item near each other, the slots of these windows must be filled consistently: the same value of the item always
by the same value of the document, and different ones by different ones. A document that covers
at least 0.6 of an item's words in that way holds the item, verbatim or with other parameters.

Null and empty texts hold nothing; items without a word are matched by nothing; items that
repeat are reported each, and of stretches that cover equally much of an item the first counts.
Other columns are ignored. The table of windows is sent to all tasks in
parts of bounded size: a benchmark beyond the bound takes further passes over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workweave.llm.words import Words, mix, pieces, run_hash

WINDOW, LITERAL, COVERED = 8, 5, 0.6
#: An item of so many words, or with a number, counts wherever it stands.
TELLING = 5
#: Characters of benchmark text whose windows go to the tasks at once.
PART_CHARS = 16_000_000

# Words taken as numbers and as units.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion half third quarter twice double triple dozen").split()
UNIT_WORDS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram "
    "kilograms ounce ounces pound pounds ton tons ml cl l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years cent "
    "cents dollar dollars euro euros usd eur gbp percent degree degrees meter meters metre metres "
    "kilometer kilometers kilometre kilometres mph kph hz khz mhz ghz w kw mw v j kj cal kcal").split()

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3A, 0x3F]] = True
_NUMBER, _UNIT, _NAME = mix(np.array([11, 13, 17], dtype=np.uint64))


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(Words(pa.array([" ".join(words)]), _SEPARATOR).hash)


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    counts = np.concatenate([[0], np.cumsum(flags)])
    return counts[ends] > counts[starts]


class Canonical:
    """Canonical words of texts: ``code`` with placeholders, ``hash`` of the words as they are."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, _SEPARATOR)
        data, starts, ends = words.data, words.starts, words.ends
        self.first, self.hash = words.first, words.hash
        number = _between(_DIGIT[data], starts, ends) | np.isin(words.hash, _hashes(NUMBER_WORDS))
        unit = np.isin(words.hash, _hashes(UNIT_WORDS)) & ~number
        lead = data[starts] if starts.size else data[:0]
        second = data[np.minimum(starts + 1, data.size - 1)] if starts.size else data[:0]
        capital = (lead >= 0x41) & (lead <= 0x5A) & (ends - starts > 1) & (
            ((second >= 0x61) & (second <= 0x7A)) | (second >= 0x80))
        capital |= (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (ends - starts > 3)
        opens = np.ones(starts.size, dtype=bool)
        if starts.size > 1:
            opens[1:] = _between(_STOP[data], ends[:-1], starts[1:])
        opens[self.first[:-1][self.first[:-1] < starts.size]] = True
        self.opens = np.append(opens, True)
        name = capital & ~opens & ~number & ~unit
        self.slot = number | unit | name
        self.code = words.hash.copy()
        for kind, code in ((number, _NUMBER), (unit, _UNIT), (name, _NAME)):
            self.code[kind] = code
        self.literal = np.concatenate([[0], np.cumsum(~self.slot)])

    def windows(self, width: int, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of one text each, and their hash: of the words as they are,
        or with placeholders and then of those windows that hold enough literals."""
        start = np.arange(max(0, self.code.size - width + 1))
        owner = np.searchsorted(self.first, start, side="right") - 1
        fits = start + width <= self.first[owner + 1]
        if not plain:
            fits &= self.literal[start + width] - self.literal[start] >= min(LITERAL, width)
        start = start[fits]
        return start, run_hash(self.hash if plain else self.code, start, start + width)


class Templates:
    """Windows of benchmark items in a hash table."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = ids
        self.items = [Canonical(pa.array([t], pa.string())) for t in texts]
        # a short item without a number is found by chance in the middle of a sentence
        self.telling = [x.code.size >= TELLING or bool((x.code == _NUMBER).any()) for x in self.items]
        at: dict[tuple[int, bool], list[tuple[np.ndarray, int, np.ndarray]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            width = min(WINDOW, item.code.size)
            for plain in (False, True) if width else ():
                start, value = item.windows(width, plain)
                at[width, plain].append((value, i, start))
        self.tables = {}
        for kind, found in at.items():
            value = np.concatenate([v for v, _, _ in found])
            item = np.repeat([i for _, i, _ in found], [v.size for v, _, _ in found])
            start = np.concatenate([s for _, _, s in found])
            order = np.argsort(value, kind="stable")
            screen = np.zeros(1 << 20, dtype=bool)
            screen[(value & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables[kind] = (value[order], item[order], start[order], screen)

    def hits(self, texts: pa.Array) -> list[list[tuple[int, int, int, float, bool]]]:
        """Per text its items: id, first word, number of words, share covered, whether verbatim."""
        doc = Canonical(texts)
        matches: dict[tuple[int, int], list[tuple[int, int, int, bool]]] = defaultdict(list)
        for (width, plain), (values, item, at, screen) in self.tables.items():
            start, value = doc.windows(width, plain)
            near = screen[(value & np.uint64((1 << 20) - 1)).astype(np.int64)]
            start, value = start[near], value[near]
            low = np.searchsorted(values, value)
            high = np.searchsorted(values, value, side="right")
            for k in np.flatnonzero(high > low):
                row = int(np.searchsorted(doc.first, start[k], side="right")) - 1
                whole = doc.opens[start[k]] and doc.opens[start[k] + width]
                for j in range(low[k], high[k]):
                    if not (whole or self.telling[item[j]]):
                        continue
                    matches[row, int(item[j])].append((int(start[k]), int(at[j]), width, plain))
        found: list[list[tuple[int, int, int, float, bool]]] = [[] for _ in range(len(texts))]
        for (row, i), pairs in matches.items():
            best = self._best(doc, self.items[i], sorted(pairs))
            if best:
                first, words, share, same = best
                found[row].append((self.ids[i], first - int(doc.first[row]), words, share, same))
        return [sorted(x, key=lambda hit: (hit[0] is None, hit[0])) for x in found]

    @staticmethod
    def _best(doc: Canonical, item: Canonical, pairs: list[tuple[int, int, int, bool]]):
        """The stretch of the document that covers most of the item with consistent slots."""
        size, best = item.code.size, None
        reach, low = size + size // 2 + WINDOW, 0
        for high in range(len(pairs)):
            while pairs[high][0] - pairs[low][0] > reach:
                low += 1
            last = high + 1 == len(pairs) or pairs[high + 1][0] - pairs[low][0] > reach
            if not last:
                continue
            forward: dict[int, int] = {}
            backward: dict[int, int] = {}
            covered, same, end = set(), True, 0
            # windows of equal words first: other values must fit them
            for d, t, width, plain in sorted(pairs[low: high + 1], key=lambda pair: not pair[3]):
                slots = [(int(item.hash[t + k]), int(doc.hash[d + k])) for k in range(width)
                         if item.slot[t + k]]
                if plain or all(forward.get(x, y) == y and backward.get(y, x) == x for x, y in slots):
                    forward.update(slots)
                    backward.update((y, x) for x, y in slots)
                    covered.update(range(t, t + width))
                    same &= all(x == y for x, y in slots)
                    end = max(end, d + width)
            share = len(covered) / size
            if share >= COVERED and (best is None or share > best[2]):
                best = (pairs[low][0], end - pairs[low][0], share, same)
        return best


def templates(benchmark: DataFrame) -> list[Templates]:
    """The hash tables of ``benchmark(item_id, text)``, each of a bounded number of characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(chars // PART_CHARS) + 1
    tables = []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        tables.append(Templates([r.item_id for r in rows], [r.text for r in rows]))
    return tables


def _scan(table: Templates) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hits = table.hits(piece.column("text"))
                row = pa.array([i for i, x in enumerate(hits) for _ in x], pa.int32())
                columns = list(zip(*[hit for x in hits for hit in x], strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(row),
                     *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["doc_id", "item_id", "first_word", "n_words", "covered", "verbatim"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, covered, verbatim`` per document and item it holds."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    parts = [plain.mapInArrow(_scan(table), "doc_id long, item_id long, first_word long, "
                              "n_words long, covered double, verbatim boolean")
             for table in templates(benchmark)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def holds_any(text: Column, benchmark: DataFrame) -> Column:
    """Whether a text holds some item of the benchmark."""
    held = F.lit(False)
    for table in templates(benchmark):

        @F.pandas_udf("boolean")
        def flagged(texts, table=table):
            import pandas as pd

            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            return pd.Series([bool(x) for piece in pieces(batch, "text")
                              for x in table.hits(piece.column("text"))], dtype=bool)

        held = held | flagged(text)
    return held
