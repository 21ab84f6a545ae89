"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks of 512 bytes, 256 apart, that cover all of
it. Sixteen learned filters of four bytes slide over every chunk; each keeps its largest response
(max-pooling, then ReLU). Mean, maximum and minimum of these over all chunks go through a logistic
unit, which gives one probability that the document is good.

The network is fitted on at most TRAIN_DOCS labelled rows (those of least hash), of each at most
TRAIN_CHUNKS chunks, by Adam with balanced classes; scoring reads every byte of every document. The
same table gives the same network. Null and empty texts are scored as one zero byte. Label rows
with a null label or id are left out, and of several labels of a document the least counts. Without
labels every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workweave.llm.words import flat, mix, pieces

WIDTH, FILTERS, STEP = 4, 16, 256
CHUNK = 2 * STEP
TRAIN_DOCS, TRAIN_CHUNKS = 3000, 8
EPOCHS, GROUP, RATE = 14, 64, 0.01
CUT = 0.7


@dataclass
class Network:
    """``taps[j, byte, filter]`` is what a byte at offset ``j`` adds to a filter's response."""

    taps: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float


def chunks(text: bytes) -> list[bytes]:
    """The overlapping chunks of a text, each with the bytes that its last windows reach into."""
    text = text or b"\0"
    steps = -(-len(text) // STEP)
    return [text[k * STEP: k * STEP + CHUNK + WIDTH - 1] for k in range(max(1, steps - 1))]


def _pool(doc: np.ndarray, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, maximum and minimum over each document's chunks; and where documents begin."""
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    n = np.diff(np.append(at, doc.size))[:, None]
    return np.concatenate([np.add.reduceat(pooled, at) / n, np.maximum.reduceat(pooled, at),
                           np.minimum.reduceat(pooled, at)], axis=1), at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(doc: np.ndarray, data: np.ndarray, size: np.ndarray, good: np.ndarray) -> Network:
    """Fit to chunks: their document (ascending, from 0), bytes in rows, number of windows; and the
    documents' labels."""
    rng = np.random.default_rng(7)
    net = {"taps": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), "bias": np.full(FILTERS, 0.1),
           "weight": rng.normal(0, 0.1, 3 * FILTERS), "offset": np.zeros(1)}
    if good.size == 0 or good.min() == good.max():
        net["weight"][:] = 0
        return Network(net["taps"].astype(np.float32), net["bias"].astype(np.float32),
                       net["weight"], 0.0)
    each = np.where(good == 1, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    first = np.searchsorted(doc, np.arange(good.size + 1))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.items()}
    turn = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(good.size)
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, good.size, GROUP):
            group = np.sort(order[a: a + GROUP])
            rows = np.concatenate([np.arange(first[g], first[g + 1]) for g in group])
            own = np.repeat(np.arange(group.size), first[group + 1] - first[group])
            byte = data[rows]
            taps = net["taps"].astype(np.float32)
            value = taps[0][byte[:, :CHUNK]]
            for j in range(1, WIDTH):
                value += taps[j][byte[:, j: j + CHUNK]]
            value[np.arange(CHUNK)[None, :] >= size[rows][:, None]] = -1e9
            best = value.argmax(axis=1)
            top = np.take_along_axis(value, best[:, None, :], axis=1)[:, 0] + net["bias"]
            pooled = np.maximum(top, 0)
            merged, at = _pool(own, pooled)
            p = sigmoid(merged @ net["weight"] + net["offset"])
            error = (p - good[group]) * each[group] / group.size
            back = error[:, None] * net["weight"]
            mean, high, low = back[:, :FILTERS], back[:, FILTERS: 2 * FILTERS], back[:, 2 * FILTERS:]
            n = np.diff(np.append(at, own.size))[:, None]
            slope = (mean / n)[own]
            slope += high[own] * (pooled == merged[own, FILTERS: 2 * FILTERS])
            slope += low[own] * (pooled == merged[own, 2 * FILTERS:])
            slope *= top > 0
            grad = {"weight": merged.T @ error + 1e-4 * net["weight"],
                    "offset": np.array([error.sum()]), "bias": slope.sum(axis=0),
                    "taps": 1e-5 * net["taps"]}
            column = np.broadcast_to(np.arange(FILTERS), best.shape)
            for j in range(WIDTH):
                np.add.at(grad["taps"][j], (np.take_along_axis(byte, best + j, axis=1), column), slope)
            turn += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[k] -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
    return Network(net["taps"].astype(np.float32), net["bias"].astype(np.float32), net["weight"],
                   float(net["offset"][0]))


class Scorer:
    """Scores whole texts; two taps at a time are looked up as one for each pair of bytes."""

    def __init__(self, net: Network):
        self.net = net
        pair = np.arange(1 << 16)
        self.pairs = [net.taps[j][pair >> 8] + net.taps[j + 1][pair & 255] for j in range(0, WIDTH, 2)]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        data, at = flat(texts)
        length = np.diff(at)
        size = np.maximum(length, 1)  # an empty text is one zero byte
        first = np.concatenate([[0], np.cumsum(size)])
        # bytes of a text, then zeros for the windows that reach beyond its end
        room = size + WIDTH - 1
        begin = np.concatenate([[0], np.cumsum(room)])
        wide = np.zeros(int(begin[-1]) + 1, dtype=np.uint16)
        wide[np.arange(data.size) + np.repeat(begin[:-1] - at[:-1], length)] = data
        pair = (wide[:-1] << 8) | wide[1:]
        place = np.arange(int(first[-1])) + np.repeat(begin[:-1] - first[:-1], size)
        value = self.pairs[0][pair[place]]
        for j in range(1, len(self.pairs)):
            value += self.pairs[j][pair[np.minimum(place + 2 * j, pair.size - 1)]]
        steps = -(-size // STEP)
        base = np.cumsum(steps) - steps
        inner = np.arange(int(steps.sum())) - np.repeat(base, steps)
        segment = np.maximum.reduceat(value, np.repeat(first[:-1], steps) + STEP * inner)
        count = np.maximum(steps - 1, 1)
        doc = np.repeat(np.arange(size.size), count)
        left = np.repeat(base, count) + np.arange(doc.size) - np.repeat(np.cumsum(count) - count, count)
        right = np.where(steps[doc] > 1, left + 1, left)
        pooled = np.maximum(np.maximum(segment[left], segment[right]) + self.net.bias, 0)
        merged, _ = _pool(doc, pooled)
        return sigmoid(merged @ self.net.weight + self.net.offset)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most TRAIN_CHUNKS chunks of each text, chosen by a hash of id and place."""
    for batch in batches:
        ids, kept, n, place = [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                             strict=True):
            every = chunks((text or "").encode())
            key = mix(np.arange(len(every), dtype=np.uint64) + np.uint64(doc % (1 << 63)) * np.uint64(31))
            for k in sorted(np.argsort(key, kind="stable")[:TRAIN_CHUNKS].tolist()):
                ids.append(doc)
                kept.append(every[k].ljust(CHUNK + WIDTH - 1, b"\0"))
                n.append(min(CHUNK, max(1, len((text or "").encode()) - k * STEP)))
                place.append(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(place, pa.int32()), pa.array(n, pa.int32()),
             pa.array(kept, pa.binary())], names=["doc_id", "place", "n", "chunk"])


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> Network:
    """The network fitted to labelled documents that are not held out (a condition on ``doc_id``)."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("quality").cast("int").alias("quality"))
              .dropna().where(~held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect())
    known = {r.doc_id: r.quality for r in marked}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    if known:  # at most TRAIN_DOCS ids
        texts = texts.where(F.col("doc_id").isin(list(known)))
    else:
        texts = texts.limit(0)
    rows = texts.mapInArrow(_samples, "doc_id long, place int, n int, chunk binary").collect()
    unique = {(r.doc_id, r.place): r for r in rows}  # a document that repeats counts once
    rows = [unique[k] for k in sorted(unique)]
    ids = sorted({r.doc_id for r in rows})
    index = {d: i for i, d in enumerate(ids)}
    data = np.frombuffer(b"".join(bytes(r.chunk) for r in rows), dtype=np.uint8)
    return fit(np.array([index[r.doc_id] for r in rows], dtype=np.int64),
               data.reshape(len(rows), CHUNK + WIDTH - 1),
               np.array([r.n for r in rows], dtype=np.int64),
               np.array([known[d] for d in ids], dtype=np.int64))


def _scores(net: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(net)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 18):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(score(piece.column("text")))],
                    names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``."""
    net = train(docs, labels, held_out)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(_scores(net), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
