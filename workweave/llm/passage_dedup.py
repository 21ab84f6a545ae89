"""Substring dedup: passages that repeat across documents, by MinHash bands over paragraphs.

Passages begin and end anywhere in a line, so paragraphs are cut by content: in every run of 27
consecutive 5-word shingles the one with the least hash is an anchor, and the 24 words from an
anchor on are a paragraph. Of any 51 equal words one paragraph at least lies inside, at the same
place in each copy. Beside these, the lines of a text and the blocks between its blank lines are
paragraphs of their own, whole, from 6 words on. Words are those between ASCII white space, with
A-Z in lower case. MinHash bands propose pairs of paragraphs, the exact Jaccard similarity of
their 5-word shingles decides (0.75 or more), and components join what links.

Bands alone miss a pair now and then, so what they leave is proposed by shingles: under any order
that holds everywhere, two paragraphs that link share one of the first ``n - ceil(0.75 n) + 1`` of
both. First come the shingles of a fixed part of the hash space that one text alone holds, then the
others of that part, rarest first, then the rest. Paragraphs whose first shingles all stand in one
text alone link with no other text; neither bands nor shingles of them are sent. So every link
between different texts is found but for 64-bit hashes; links inside one text alone are not sought.

A component in two documents or more is a repeat. The document with the least ``doc_id`` keeps it
and the others lose it; repeats within one document alone are left. From the ends of what repeats,
a passage goes on over the words that some other document holds at the same place too, and the
least of these documents keeps them. Null texts have no paragraphs; rows that share a ``doc_id``
are one document; a row with a null ``doc_id`` never keeps a passage. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.llm.blocks import (BATCH, blocks, dealt, gathered, in_rows, met, numbers, opens,
                                  parts)
from workweave.llm.components import connected, linked, resolve, sketches
from workweave.llm.minhash import bands, tune_bands
from workweave.llm.ngram_join import shingle_sets
from workweave.llm.tables import batches_of, documents, passing, removing_shuffles, save
from workweave.llm.words import Words, mix, pieces, run_hash, signed, unsigned

WIDTH, RUN, LENGTH = 5, 27, 24
#: Words of the shortest line or block that is a paragraph.
SHORT = WIDTH + 1
#: Equal words beyond the last paragraph they hold; more would hold another one.
REACH = RUN + LENGTH - 1
PART, WHOLE = 75, 100
RECALL, ROWS = 0.995, 3
#: Part of the hash space whose shingles are all told, so that one text alone is known to hold them.
COUNTED = np.uint64(int(0.4 * (1 << 64)))
#: Lengths of the runs beyond an end that are compared at a time; most ends go on for a few words.
STRETCHES = (1, 1), (2, 8), (9, 20), (21, REACH)
#: Pairs of two blocks of paragraphs that are compared without a trie.
DIRECT = 4096
#: Paragraphs in a block of the last comparison, on average; they are short, so many fit a task.
TOGETHER = 2048
#: Nodes of a bucket whose pairs are all listed.
FEW = 32
#: The lower half of 64 bits.
HALF = np.uint64(0xFFFFFFFF)
#: Kinds of rows in buckets: a band key, and a first shingle that a smaller set is found by or not.
BAND, LEAD, FOLLOW = 2, 1, 0
#: Columns that are packed: rows of nodes, texts of documents, and what is told of these: nodes that
#: repeat, and runs beyond an end (``more`` is their length, and as bits their side and whether a
#: passage ends there).
NODES = {"node": np.int64, "doc": np.int64, "text_hash": np.int64, "kind": np.int8}
TEXTS = {"text_hash": np.int64, "doc": np.int64, "none": np.int8}
MARKS = {"node": np.int64, "root": np.int64, "kept": np.int64}
RUNS = {"place": np.int32, "root": np.int64, "more": np.int32}
#: Kinds of rows of nodes, as bits: of a document without an id, of the one that brings the text, and
#: what is told of the node.
NONE, HOLDER, NOTE = 1, 2, 4
#: Paragraphs at most so many words apart belong to one passage.
GAP = 4


def anchors(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the least value, by its upper 32 bits, in each run of RUN between a start and
    its end (the first of equal ones); of fewer values in all of them."""
    place = np.uint64(0xFFFFFFFF)
    least = keys = (shingles & ~place) | np.arange(shingles.size, dtype=np.uint64)
    for step in (1, 2, 4, 8, RUN - 16):  # runs of 2, 4, 8, 16 and RUN values
        least = np.minimum(least[:-step], least[step:])
    full = ends - starts >= RUN
    inside = np.zeros(least.size + 1, dtype=np.int64)
    inside[starts[full]] += 1
    inside[ends[full] - RUN + 1] -= 1
    short = [keys[a:b].min() for a, b in zip(starts[~full], ends[~full], strict=True) if a < b]
    at = np.concatenate([least[np.cumsum(inside[:-1]) > 0], np.array(short, dtype=np.uint64)])
    return np.unique((at & place).astype(np.int64))


def _own(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each line, and of each block of a text that blank lines part."""
    if words.starts.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
    between = np.concatenate([[0], breaks[words.starts[1:]] - breaks[words.ends[:-1]]])
    opens = np.unique(words.first[:-1][np.diff(words.first) > 0])
    between[opens] = 0
    starts, ends = [], []
    for least in (1, 2):
        parts = np.flatnonzero(between >= least)
        at = np.union1d(parts, opens)
        end = np.append(at[1:], words.starts.size)
        if least == 2:  # a text without a blank line is no block
            text = np.searchsorted(opens, at, side="right")
            keep = np.isin(text, np.searchsorted(opens, parts, side="right"))
            at, end = at[keep], end[keep]
        starts.append(at)
        ends.append(end)
    at, end = np.concatenate(starts), np.concatenate(ends)
    return at[end - at >= SHORT], end[end - at >= SHORT]


class Paragraphs:
    """Paragraphs of a batch: text, first word, end and node."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts)
        self.every = every = words.windows(WIDTH)
        long = np.flatnonzero(words.counts >= LENGTH)
        a, b = words.first[long], words.first[long + 1]
        cut = anchors(every, a, b - WIDTH + 1)
        cut = cut[cut + LENGTH <= b[np.searchsorted(a, cut, side="right") - 1]]
        at, to = _own(words)
        spans = np.unique(np.concatenate([cut, at]) << 32 | np.concatenate([cut + LENGTH, to]))
        self.at, self.to = spans >> 32, spans & 0xFFFFFFFF
        self.row = np.searchsorted(words.first, self.at, side="right") - 1
        self.node = run_hash(words.hash, self.at, self.to)

    def sets(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of these paragraphs end to end, repeats included, and where each begins."""
        at, group, starts = self._windows(which)
        return self.every[at], starts

    def ranked(self, which: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct shingles of these paragraphs by their ``rank`` (one for each window):
        paragraph, rank and place of each, and the number of each paragraph."""
        at, group, _ = self._windows(which)
        both = np.sort(group << 32 | rank[at])
        both = both[np.append(True, both[1:] != both[:-1])[: both.size]]
        group = both >> 32
        size = np.bincount(group, minlength=which.size)
        place = np.arange(both.size) - (np.cumsum(size) - size)[group]
        return group, both & 0xFFFFFFFF, place, size

    def _windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.to[which] - self.at[which] - WIDTH + 1
        starts = np.cumsum(size) - size
        group = np.repeat(np.arange(which.size), size)
        return self.at[which][group] + np.arange(group.size) - starts[group], group, starts


def reached(size: np.ndarray, part: int, whole: int) -> np.ndarray:
    """So many first shingles of a set meet those of a partner that shares ``part`` of ``whole``."""
    return size + (-size * part) // whole + 1


def points(words: Words, row: np.ndarray, at: np.ndarray, to: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of words in the code points of their texts."""
    count = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    base = count[words.at[row]]
    return count[words.starts[at]] - base, count[words.ends[to - 1]] - base


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph: its node, and the document and text that it stands in."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            found = Paragraphs(piece.column("text"))
            doc, at = piece.column("doc_id"), pa.array(found.row)
            kind = np.where(doc.is_null().to_numpy(zero_copy_only=False), NONE, 0).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(found.node)), doc.fill_null(0).take(at),
                 piece.column("text_hash").take(at), pa.array(kind[found.row])], names=[*NODES])


def _notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is told of nodes, as rows beside those of documents."""
    for batch in batches:
        kind = pa.array(np.full(batch.num_rows, NOTE, dtype=np.int8))
        yield pa.RecordBatch.from_arrays([*batch.columns, kind], names=[*NODES])


class Holders:
    """Rows of nodes, sorted by node: their groups, the least and the greatest document of each,
    and the row that tells of it, or -1."""

    def __init__(self, node: np.ndarray, doc: np.ndarray, text: np.ndarray, kind: np.ndarray):
        order = np.argsort(node, kind="stable")
        self.node, self.doc, self.text, self.kind = (x[order] for x in (node, doc, text, kind))
        new = opens(self.node)
        self.at, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        named = (self.kind & (NONE | NOTE)) == 0
        self.low, self.high = extremes(self.doc, named, self.at)
        self.note = np.full(self.at.size, -1)
        notes = np.flatnonzero(self.kind & NOTE)
        self.note[self.group[notes]] = notes


def extremes(doc: np.ndarray, named: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of the ``named`` documents of each group that begins ``at``;
    without any, the greatest and the least number."""
    if not at.size:
        return doc[:0], doc[:0]
    none = np.iinfo(np.int64)
    return (np.minimum.reduceat(np.where(named, doc, none.max), at),
            np.maximum.reduceat(np.where(named, doc, none.min), at))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the nodes that two documents hold or that a note asks for; of the latter, the least
    document is the HOLDER that brings the text."""
    for rows in gathered(batches, **NODES):
        x = Holders(*rows)
        own = (x.kind & NOTE) == 0
        asked = x.note >= 0
        holds = own & asked[x.group] & np.where(
            (x.low <= x.high)[x.group], (x.doc == x.low[x.group]) & ((x.kind & NONE) == 0), True)
        holds = np.flatnonzero(holds)
        kind = x.kind.copy()
        kind[holds[opens(x.group[holds])]] |= HOLDER
        keep = own & (asked | (x.low < x.high))[x.group]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[keep]) for c in (x.node, x.doc, x.text, kind)], names=[*NODES])


def _bringing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, doc, kind = (numbers(batch.column(c), NODES[c])[0] for c in ("node", "doc", "kind"))
        own = (kind & HOLDER) > 0
        none = (kind[own] & NONE) > 0
        yield pa.RecordBatch.from_arrays([pa.array(doc[own], mask=none), pa.array(node[own])],
                                         names=["holder", "node"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the greatest document of each node that has a label."""
    for rows in gathered(batches, **NODES):
        x = Holders(*rows)
        told = (x.note >= 0) & (x.low <= x.high)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.doc[x.note[told]]), pa.array(x.low[told]), pa.array(x.high[told])],
            names=["root", "low", "high"])


def _delivered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that repeat, with root and keeper, for each text that holds them."""
    for rows in gathered(batches, **NODES):
        x = Holders(*rows)
        told = x.note >= 0
        root = np.where(told, x.doc[x.note], x.node[x.at])
        kept = np.where(told, x.text[x.note], x.low)
        keep = ((x.kind & NOTE) == 0) & (told | (x.low < x.high))[x.group]
        group = x.group[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (x.text[keep], x.doc[keep], x.kind[keep] & NONE, x.node[keep],
                                   root[group], kept[group])], names=[*TEXTS, *MARKS])


def _in_texts(kinds: dict[str, type], most: int = 0) -> Callable:
    """A row for each text of a document, with the numbers told of it; and whether a run of ``most``
    words is among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, doc, none, *columns in gathered(batches, **TEXTS, **kinds):
            order = np.lexsort((doc, none, text))
            at = np.flatnonzero(opens(text[order], none[order], doc[order]))
            rows = [pa.array(doc[order[at]], mask=none[order[at]] > 0), pa.array(text[order[at]])]
            names = ["doc_id", "text_hash", *kinds]
            if most:
                whole = columns[names.index("more") - 2][order] >> 2 == most
                rows.append(pa.array(np.logical_or.reduceat(whole, at)))
                names.insert(2, "on")
            yield pa.RecordBatch.from_arrays([*rows, *[in_rows(x[order], at) for x in columns]],
                                             names=names)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the shingles by which its paragraphs may be found."""
    for batch in batches:
        seen = np.zeros(0, dtype=np.int64)
        for piece in pieces(batch, "text"):
            found = Paragraphs(piece.column("text"))
            text = piece.column("text_hash").to_numpy()
            values, rank = np.unique(found.every, return_inverse=True)
            group, rank, place, size = found.ranked(np.arange(found.at.size), rank)
            told = (values[rank] < COUNTED) | (place < reached(size, PART, WHOLE)[group])
            both = np.unique(found.row[group[told]] << 32 | rank[told])
            row = both >> 32
            _, first = np.unique(text, return_index=True)
            new = np.zeros(text.size, dtype=bool)
            new[first] = ~np.isin(text[first], seen)  # equal texts of a batch tell once
            seen = np.concatenate([seen, text[new]])
            both, row = both[new[row]], row[new[row]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(values[both & 0xFFFFFFFF])), pa.array(text[row])],
                names=["token", "text_hash"])


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the shingles that two texts or more hold, how many texts do, for each of them."""
    for token, text in gathered(batches, token=np.uint64, text_hash=np.int64):
        token, text = met(token, text)
        order = np.lexsort((text, token))
        order = order[opens(token[order], text[order])]
        token, text = token[order], text[order]
        new = opens(token)
        n = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(text[n > 1]), pa.array(signed(token[n > 1])),
             pa.array(n[n > 1].astype(np.int32))], names=["text_hash", "token", "n"])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, with the shingles that it shares with others."""
    for text, token, n in gathered(batches, text_hash=np.int64, token=np.int64, n=np.int32):
        order = np.argsort(text)
        at = np.flatnonzero(opens(text[order]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(text[order][at]), in_rows(token[order], at), in_rows(n[order], at)],
            names=["text_hash", "known", "held"])


def _order(found: Paragraphs, known: pa.Array, held: pa.Array
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window its rank in the order of shingles; by rank the shingle, and whether other
    texts hold it, as ``known`` tells of each text; so many hold it as ``held`` does."""
    row = np.repeat(np.arange(len(known)), found.words.counts).astype(np.uint64)
    _, first, inverse = np.unique(mix(found.every ^ mix(row + np.uint64(1))),
                                  return_index=True, return_inverse=True)
    value, row = found.every[first], row[first]
    tokens, size = numbers(known, np.uint64)
    of = np.repeat(np.arange(size.size), size).astype(np.uint64)
    keys = mix(tokens ^ mix(of + np.uint64(1)))
    ranks = np.argsort(keys)
    keys, count = keys[ranks], numbers(held, np.int32)[0][ranks]
    own = mix(value ^ mix(row + np.uint64(1)))
    at = np.minimum(np.searchsorted(keys, own), max(keys.size - 1, 0))
    shared = keys[at] == own if keys.size else np.zeros(own.size, dtype=bool)
    counted = value < COUNTED
    rarity = np.where(counted & shared, count[at], 0) if keys.size else np.zeros(own.size, np.int64)
    order = np.lexsort((value, rarity, np.where(counted, shared, 2)))
    rank = np.empty(order.size, dtype=np.int64)
    rank[order] = np.arange(order.size)
    return rank[inverse], value[order], shared[order]


def _banded(count: int, rows: int) -> Callable:
    """Band keys of each paragraph. Where ``known`` has the shingles that a text shares with others,
    paragraphs that may link with them: their band keys, and their first shingles as buckets too.

    Of two that link, the shared shingle is among yet fewer first ones of the smaller set, those
    of the kind LEAD. ``origin`` is the text of a band key; two texts hold a shingle anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = Paragraphs(piece.column("text"))
                text = found.words.text_hash()[found.row].view(np.int64)
                order = np.lexsort((text, found.node))
                new = np.ones(order.size, dtype=bool)
                new[1:] = found.node[order][1:] != found.node[order][:-1]
                # the least and the greatest text of each node tell whether it has a second one
                low, high = order[new], order[np.append(new[1:], True)[: new.size]]
                token, sketch = np.zeros(0, np.uint64), np.zeros(low.size, np.uint64)
                leads = np.zeros(0, dtype=bool)
                if "known" in piece.schema.names:
                    rank, value, shared = _order(found, piece.column("known"), piece.column("held"))
                    group, rank, place, size = found.ranked(low, rank)
                    sketch = sketches(value[rank], np.cumsum(size) - size)
                    sent = shared[rank] & (place < reached(size, PART, WHOLE)[group])
                    group, place, token = group[sent], place[sent], value[rank[sent]]
                    leads = place < reached(size, 2 * PART, PART + WHOLE)[group]
                    live, group = np.unique(group, return_inverse=True)
                    low, high, size, sketch = low[live], high[live], size[live], sketch[live]
                else:
                    group, size = np.zeros(0, np.int64), found.to[low] - found.at[low] - WIDTH + 1
                keys = bands(*found.sets(low), count, rows)
                node, a, b = found.node[low], text[low], text[high]
                twice = np.flatnonzero(a != b)
                of = np.concatenate([np.repeat(np.arange(low.size), count),
                                     np.repeat(twice, count), group])
                origin = [np.repeat(a, count), np.repeat(b[twice], count), a[group]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate([keys.ravel(), keys[twice].ravel(), token]))),
                     pa.array(signed(node[of])), pa.array(np.concatenate(origin)),
                     pa.array(size[of].astype(np.int32)),
                     pa.array(np.concatenate([np.full(of.size - token.size, BAND, dtype=np.int8),
                                              np.where(leads, LEAD, FOLLOW).astype(np.int8)])),
                     pa.array(signed(sketch[of]))],
                    names=["bucket", "node", "origin", "size", "kind", "sketch"])

    return run


def _marked(run: Callable) -> Callable:
    """The rows of ``_banded`` in fewer numbers: ``mark`` is the sketch beside a shingle; beside a
    band key, half the bits of the text's hash and of the sketch. ``more`` is size and kind."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            size, kind = (batch.column(c).to_numpy() for c in ("size", "kind"))
            origin, sketch = (unsigned(batch.column(c).to_numpy()) for c in ("origin", "sketch"))
            half = (origin & ~HALF) | ((sketch >> np.uint64(32)) ^ (sketch & HALF))
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("node"),
                 pa.array(signed(np.where(kind == BAND, half, sketch))),
                 pa.array(size.astype(np.int64) << 2 | kind)],
                names=["bucket", "node", "mark", "more"])

    return mark


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the buckets with nodes of two texts or more, each two nodes ``a, b`` that may link; beyond
    FEW nodes, the ``bucket`` with each node ``a`` and its ``size``. Rows that do not lead stay only
    beside a smaller set that does."""
    for key, node, mark, more in gathered(batches, bucket=np.int64, node=np.int64, mark=np.uint64,
                                          more=np.int64):
        key, node, mark, more = met(key, node, mark, more)
        order = np.lexsort((node, key))
        key, node, mark, more = (x[order] for x in (key, node, mark, more))
        size, kind = more >> 2, more & 3
        new = opens(key)
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        if not at.size:
            continue
        last = np.append(at[1:], key.size) - 1
        origin = mark >> np.uint64(32)
        texts = np.minimum.reduceat(origin, at) < np.maximum.reduceat(origin, at)
        least = np.minimum.reduceat(np.where(kind != FOLLOW, size, np.iinfo(np.int64).max), at)
        keep = ((node[at] != node[last])[group] & ((kind != BAND) | texts[group])
                & ((kind != FOLLOW) | (size > least[group])))
        key, node, mark, size, kind = (x[keep] for x in (key, node, mark, size, kind))
        new = opens(key, node)
        key, node, mark, size, kind = (x[new] for x in (key, node, mark, size, kind))
        new = opens(key)
        group = np.cumsum(new) - 1
        n = np.bincount(group)[group]
        later = np.where(n <= FEW, n - 1 - (np.arange(n.size) - np.flatnonzero(new)[group]), 0)
        a = np.repeat(np.arange(n.size), later)
        b = a + 1 + np.arange(a.size) - np.repeat(np.cumsum(later) - later, later)
        bits = mark[a] ^ mark[b]
        bits = np.bitwise_count(np.where(kind[a] == BAND, bits & HALF, bits)).astype(np.int64)
        close = ((WHOLE * np.minimum(size[a], size[b]) >= PART * np.maximum(size[a], size[b]))
                 & ((WHOLE + PART) * bits <= (WHOLE - PART) * (size[a] + size[b])))
        a, b = node[a[close]], node[b[close]]
        order = np.lexsort((b, a))
        order = order[opens(a[order], b[order])]
        many = n > FEW
        bucket = np.append(np.zeros(order.size, np.int64), key[many])
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, mask=np.arange(bucket.size) < order.size),
             pa.array(np.append(a[order], node[many])),
             pa.array(np.append(b[order], node[many])),
             pa.array(np.append(np.zeros(order.size, np.int64), size[many]).astype(np.int32))],
            names=["bucket", "a", "b", "size"])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the paragraphs that are ``wanted`` of each document."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            found = Paragraphs(piece.column("text"))
            nodes, new = np.unique(found.node, return_index=True)
            asked = np.isin(nodes, unsigned(piece.column("wanted").flatten().to_numpy()))
            nodes, new = nodes[asked], new[asked]
            words, data = found.words, found.words.data.tobytes()
            texts = [data[a:b].decode() for a, b in zip(
                words.starts[found.at[new]], words.ends[found.to[new] - 1], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(nodes)), pa.array(texts, pa.string())], names=["node", "item"])


def _spans(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The paragraphs of texts that are among their ``nodes``: words, and text, first word, end, root
    and keeper of each."""
    found = Paragraphs(piece.column("text"))
    marks, size = numbers(piece.column("node"), np.uint64)
    row = np.repeat(np.arange(size.size), size).astype(np.uint64)
    keys = mix(marks ^ mix(row + np.uint64(1)))
    order = np.argsort(keys)
    keys = keys[order]
    own = mix(found.node ^ mix(found.row.astype(np.uint64) + np.uint64(1)))
    at = np.minimum(np.searchsorted(keys, own), keys.size - 1)
    told = np.flatnonzero(keys[at] == own)
    of = order[at[told]]
    return (found.words, found.row[told], found.at[told], found.to[told],
            numbers(piece.column("root"), np.int64)[0][of],
            numbers(piece.column("kept"), np.int64)[0][of])


def _passage(row: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether a passage begins with a span of words, of spans sorted by text and first word."""
    if not row.size:
        return np.zeros(0, dtype=bool)
    new = opens(row)
    new[1:] |= at[1:] > np.maximum.accumulate(to)[:-1] + GAP
    return new


def _ends(least: int, most: int) -> Callable:
    """Of each end of passages, and of paragraphs like those at an end elsewhere, the runs of
    ``least`` to ``most`` words beyond it; equal runs beside paragraphs of one component have the
    same key. The first stretch asks all paragraphs that repeat, the others where runs go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                if least > 1:
                    words = Words(piece.column("text"))
                    more, size = numbers(piece.column("more"), np.int32)
                    row = np.repeat(np.arange(size.size), size)
                    on = np.flatnonzero(more >> 2 == least - 1)
                    row, more = row[on], more[on]
                    edge = words.first[row] + numbers(piece.column("place"), np.int32)[0][on]
                    root = numbers(piece.column("root"), np.int64)[0][on]
                    yield _runs(piece, words, row, edge, root, more & 3, least, most)
                    continue
                words, row, at, to, root, _ = _spans(piece)
                new = _passage(row, at, to)
                first, passage = np.flatnonzero(new), np.cumsum(new) - 1
                last = np.maximum.reduceat(to, first) if first.size else to
                ends = np.concatenate([at == at[first][passage], 2 | (to == last[passage])])
                yield _runs(piece, words, np.append(row, row), np.append(at, to),
                            np.append(root, root), ends, least, most)

    return run


def _runs(piece: pa.RecordBatch, words: Words, row: np.ndarray, edge: np.ndarray, root: np.ndarray,
          ends: np.ndarray, least: int, most: int) -> pa.RecordBatch:
    """``ends`` tells by 2 that a run goes to the right, and by 1 that a passage ends there."""
    right = ends & 2 > 0
    room = np.where(right, words.first[row + 1] - edge, edge - words.first[row])
    size = np.clip(room, least - 1, most) - least + 1
    of = np.repeat(np.arange(row.size), size)
    k = np.arange(of.size) - np.repeat(np.cumsum(size) - size, size) + least
    at = np.where(right[of], edge[of], edge[of] - k)
    key = mix(run_hash(words.hash, at, at + k) ^ mix(unsigned(root))[of]
              ^ right[of].astype(np.uint64))
    doc = piece.column("doc_id")
    none = np.where(doc.is_null().to_numpy(zero_copy_only=False), NONE, 0).astype(np.int8)
    row = row[of]
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(key)), piece.column("text_hash").take(pa.array(row)),
         doc.fill_null(0).take(pa.array(row)), pa.array(none[row]),
         pa.array((edge[of] - words.first[row]).astype(np.int32)), pa.array(root[of]),
         pa.array((k << 2 | ends[of]).astype(np.int32))], names=["key", *TEXTS, *RUNS])


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs that two documents or more hold, beyond the end of a passage in one of them, and
    the least of these documents. Elsewhere paragraphs tell what repeats."""
    for rows in gathered(batches, key=np.uint64, **TEXTS, **RUNS):
        key, text, doc, none, place, root, more = met(*rows)
        new = opens(key)
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        if not at.size:
            continue
        low, high = extremes(doc, none == 0, at)
        keep = ((low < high) & (np.maximum.reduceat(more & 1, at) > 0))[group]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (text[keep], doc[keep], none[keep], place[keep], root[keep],
                                   more[keep], low[group[keep]])], names=[*TEXTS, *RUNS, "kept"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of texts: paragraphs that repeat and runs beyond their ends, joined."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, row, at, to, _, kept = _spans(piece)
            place, more, keeper = (piece.column(c) for c in ("places", "mores", "keepers"))
            of = pc.list_parent_indices(place).to_numpy().astype(np.int64)
            place, size = numbers(place.flatten(), np.int32)
            more, keeper = numbers(more.flatten(), np.int32)[0], numbers(keeper.flatten(), np.int64)[0]
            of = np.repeat(of, size)
            edge, k = words.first[of] + place, more >> 2
            right = more & 2 > 0
            row, kept = np.append(row, of), np.append(kept, keeper)
            at = np.append(at, np.where(right, edge, edge - k))
            to = np.append(to, np.where(right, edge + k, edge))
            doc = piece.column("doc_id")
            own = (doc.fill_null(0).to_numpy()[row] == kept) & ~doc.is_null().to_numpy(
                zero_copy_only=False)[row]
            gone = (~own).astype(np.int64)
            order = np.lexsort((to, at, row, gone))
            row, at, to, kept, gone = (x[order] for x in (row, at, to, kept, gone))
            apart = gone * (words.starts.size + GAP + 1)  # what goes lies behind all that stays
            new = _passage(row + gone * len(doc), at + apart, to + apart)
            first = np.flatnonzero(new)
            if first.size:
                to = np.maximum.reduceat(to, first)
                kept = np.minimum.reduceat(kept, first)
            row, at, gone = row[first], at[first], gone[first] > 0
            start, end = points(words, row, at, to)
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row)), piece.column("text_hash").take(pa.array(row)),
                 *[pa.array(x.astype(np.int32)) for x in (at - words.first[row], to - at, start, end)],
                 pa.array(kept), pa.array(gone)],
                names=["doc_id", "text_hash", "first_word", "n_words", "start", "end", "kept_by",
                       "removed"])


def passages(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id, first_word, n_words, start, end, kept_by, removed`` for each repeated passage.

    Paragraphs that touch, or nearly so, are one passage. ``start`` and ``end`` count code points;
    ``kept_by`` is the least ``doc_id`` that keeps a part of it.
    """
    docs = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    with removing_shuffles(docs), passing(docs, "passages"):
        count = parts(docs)
        nodes, labels = _labels(docs, _buckets(docs, recall, count), count)
        marks = _marks(nodes, labels, count)
        with batches_of(docs, BATCH):
            runs = _beyond(docs, marks, count)
            every = marks.join(runs.withColumnsRenamed({"doc_id": "run_id", "text_hash": "run_hash"}),
                               F.col("doc_id").eqNullSafe(F.col("run_id"))
                               & (F.col("text_hash") == F.col("run_hash")), "left"
                               ).drop("run_id", "run_hash")
            # rows that are equal in all have equal passages
            found = save(_texts(docs, every).mapInArrow(
                _whole, "doc_id long, text_hash long, first_word int, n_words int, start int, end int, "
                "kept_by long, removed boolean").distinct(), "passages")
    return found.drop("text_hash")


def _texts(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """The texts that ``notes`` tell something of, one row for each text of a document."""
    return docs.alias("d").join(
        notes.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id"))
        & (F.col("d.text_hash") == F.col("a.text_hash"))).select("d.*", *[
            f"a.{c}" for c in notes.columns if c not in ("doc_id", "text_hash")])


def _buckets(docs: DataFrame, recall: float, count: int) -> DataFrame:
    """Pairs ``a, b`` of paragraphs that may link, and ``bucket, a, size`` of large buckets."""
    with passing(docs, "bands"):
        # one row each of the texts that share a shingle with another one
        with batches_of(docs, BATCH):
            told = dealt(blocks(docs, _told, count, "token", ["token", "text_hash"]))
            shared = blocks(told, _twice, count, "text_hash", ["text_hash", "token", "n"])
            known = save(dealt(shared).mapInArrow(
                _known, "text_hash long, known binary, held binary"), "known")
        rows = save(docs.where("text is not null").groupBy("text_hash")
                    .agg(F.min("doc_id").alias("row"))
                    .withColumnRenamed("text_hash", "row_hash"), "texts")
        known = known.join(rows, F.col("text_hash") == F.col("row_hash")).select(
            "row", "row_hash", "known", "held")
        texts = docs.join(known, F.col("doc_id").eqNullSafe(F.col("row"))
                          & (F.col("text_hash") == F.col("row_hash"))).select("text", "known", "held")
        banded = _marked(_banded(tune_bands(PART / WHOLE, recall, ROWS), ROWS))
        with batches_of(docs, BATCH):
            rows = blocks(texts, banded, count, "bucket", ["bucket", "node", "mark", "more"])
            return save(dealt(rows).mapInArrow(_likely, "bucket long, a long, b long, size int"),
                        "bands")


def _labels(docs: DataFrame, buckets: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the paragraphs that may repeat, and ``node, root`` of those that link with another
    one."""
    with passing(docs, "labels", "nodes"):
        pairs = save(buckets.where("bucket is null").select("a", "b").distinct(), "pairs").select(
            "a", "b", F.col("a").alias("label_a"), F.col("b").alias("label_b"))
        many = buckets.where("bucket is not null").select("bucket", F.col("a").alias("node"), "size")
        open_nodes = save(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
                          .union(many.select("node")).distinct(), "open")
        with batches_of(docs, BATCH):
            asked = _noted(open_nodes.withColumns({"doc": F.lit(0), "text_hash": F.lit(0)}), count)
            every = blocks(docs, _nodes, count, "node", [*NODES]).union(asked)
            nodes = save(blocks(dealt(every), _repeated, count, "node", [*NODES]), "nodes")
            # the document of a paragraph brings its text, and no other paragraph's
            where = save(nodes.mapInArrow(_bringing, "holder long, node long").groupBy("holder")
                         .agg(F.collect_set("node").alias("wanted")), "where")
        with batches_of(docs, 2000):
            items = save(docs.join(where, F.col("doc_id").eqNullSafe(F.col("holder")))
                         .select("text", "wanted").mapInArrow(_items, "node long, item string")
                         .dropDuplicates(["node"]), "items")
        sets = shingle_sets(WIDTH)
        links = linked(pairs, items, sets, PART, WHOLE, DIRECT).toDF("a", "b")
        if not many.isEmpty():
            links = links.union(resolve(many, items, sets, PART, WHOLE, DIRECT, TOGETHER)
                                .select("root", "node"))
        return nodes, save(connected(links), "labels")


def _noted(notes: DataFrame, count: int) -> DataFrame:
    return blocks(notes.select("node", F.col("doc").cast("long"), F.col("text_hash").cast("long")),
                  _notes, count, "node", [*NODES])


def _marks(nodes: DataFrame, labels: DataFrame, count: int) -> DataFrame:
    """For each text the nodes in it that repeat across documents, with root and keeper."""
    with batches_of(nodes, BATCH):
        named = labels.select("node", F.col("root").alias("doc"), F.lit(0).alias("text_hash"))
        repeats = save(dealt(nodes.union(_noted(named, count)))
                       .mapInArrow(_rooted, "root long, low long, high long")
                       .groupBy("root").agg(F.min("low").alias("kept_by"), F.max("high").alias("high"))
                       .where("kept_by < high").select("root", "kept_by"), "repeats")
        named = labels.join(repeats, "root").select(
            "node", F.col("root").alias("doc"), F.col("kept_by").alias("text_hash"))
        marks = blocks(dealt(nodes.union(_noted(named, count))), _delivered, count, "text_hash",
                       [*TEXTS, *MARKS])
        return save(dealt(marks).mapInArrow(
            _in_texts(MARKS), "doc_id long, text_hash long, node binary, root binary, kept binary"),
            "marks")


def _beyond(docs: DataFrame, marks: DataFrame, count: int) -> DataFrame:
    """For each text the runs beyond the ends of passages that another document holds there too."""
    # most ends go on in no other document, or for a few words, which the shorter runs tell
    found, asks = [], marks
    for least, most in STRETCHES:
        with passing(docs, "matched"):
            runs = dealt(blocks(_texts(docs, asks), _ends(least, most), count, "key",
                                ["key", *TEXTS, *RUNS]))
            told = blocks(runs, _agreed, count, "text_hash", [*TEXTS, *RUNS, "kept"])
            told = save(dealt(told).mapInArrow(
                _in_texts(RUNS | {"kept": np.int64}, most), "doc_id long, text_hash long, on boolean, "
                "place binary, root binary, more binary, kept binary"), "matched")
        found.append(told.select("doc_id", "text_hash", "place", "more", "kept"))
        asks = told.where("on").drop("on", "kept")
    return reduce(DataFrame.union, found).groupBy("doc_id", "text_hash").agg(*[
        F.collect_list(c).alias(name) for c, name in (
            ("place", "places"), ("more", "mores"), ("kept", "keepers"))])
