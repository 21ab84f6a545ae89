"""MinHash near-dedup with b-bit signatures: one document of each component of near copies stays.

A document is the set of its distinct 2-word shingles after A-Z are lower-cased; two link when
100 * intersection is at least 80 * union. Of every set 128 minima are taken. Bands of whole minima
propose pairs: a pair at the threshold shares one of them with a probability of ``RECALL`` or more.
Of each minimum the two low bits are kept, packed into four 64-bit numbers. Counting equal lanes of
two signatures and taking off the quarter that agrees by chance estimates their similarity; a pair
whose estimate is more than four standard deviations below the threshold is dropped without its
texts. All others are confirmed on their full sets, so every link is exact.

Equal sets are one node. Within a bucket nodes are compared with a pivot, then with four more, and
what links have not joined by then in blocks of bounded size; links only matter where they join
something, so a group of like nodes costs a multiple of its size. Nodes of one bucket that link
with nothing are all compared by signature, block by block, which grows with their square.

One row per input row. Null, empty and wordless texts have no shingles and link with nothing; a
null ``doc_id`` takes part, but the least id of a component is taken over the others (null without
any, and such rows are kept). Repeated rows count as copies and, having the same id, are kept
together. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from workweave.llm.components import connected
from workweave.llm.minhash import tune_bands
from workweave.llm.tables import batches_of, documents, early_semi_joins, passing, save
from workweave.llm.words import Words, mix, pieces, run_hash, signed, unsigned

WIDTH = 2
#: Sets link from a Jaccard similarity of PART / WHOLE on.
PART, WHOLE = 80, 100
MINIMA, BITS, ROWS, RECALL = 128, 2, 5, 0.9995
BANDS = tune_bands(PART / WHOLE, RECALL, ROWS)
#: Lanes of one 64-bit number, and such numbers of a signature.
LANES = 64 // BITS
PARTS = MINIMA // LANES
#: Lanes of different minima agree with this probability.
CHANCE = 2.0 ** -BITS
DEVIATIONS = 4
#: Nodes in a block of the last comparison, on average.
BLOCK = 256

_LOWEST = int("".join("0" * (BITS - 1) + "1" for _ in range(LANES)), 2)
_SIGNATURE = [f"s{i}" for i in range(PARTS)]
_KEYS = [f"k{i}" for i in range(BANDS)]


def least_estimate() -> float:
    """The estimate that a pair at the threshold falls below by ``DEVIATIONS`` only."""
    equal = CHANCE + (1 - CHANCE) * PART / WHOLE
    return PART / WHOLE - DEVIATIONS * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - CHANCE)


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least image of each run of hashes from ``starts`` on, under each of the functions."""
    rng = np.random.default_rng(11)
    low = (values >> np.uint64(32)).astype(np.uint32)
    found = np.empty((starts.size, MINIMA), dtype=np.uint32)
    for i in range(MINIMA):
        factor, shift = rng.integers(1, 1 << 32, 2, dtype=np.uint32)
        image = low ^ np.uint32(shift)
        image *= np.uint32(factor | 1)
        found[:, i] = np.minimum.reduceat(image, starts) if starts.size else 0
    return found


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima of a set, side by side."""
    lanes = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, PARTS, LANES)
    return np.bitwise_or.reduce(lanes << np.arange(0, 64, BITS, dtype=np.uint64), axis=2)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.empty((len(least), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(least), band + 1, dtype=np.uint64)
        for value in least[:, band * ROWS: (band + 1) * ROWS].T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value)
        keys[:, band] = key
    return keys


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures, their last axis being the parts of one."""
    differ, step = a ^ b, 1
    while step < BITS:
        differ |= differ >> np.uint64(step)
        step *= 2
    different = np.bitwise_count(differ & np.uint64(_LOWEST)).sum(axis=-1, dtype=np.int64)
    return (1 - different / MINIMA - CHANCE) / (1 - CHANCE)


def estimate(a: str, b: str) -> Column:
    """The same of the columns ``s0..`` that begin with ``a`` and ``b``."""
    different = F.lit(0)
    for name in _SIGNATURE:
        differ, step = F.col(a + name).bitwiseXOR(F.col(b + name)), 1
        while step < BITS:
            differ = differ.bitwiseOR(F.shiftrightunsigned(differ, step))
            step *= 2
        different = different + F.bit_count(differ.bitwiseAND(F.lit(_LOWEST)))
    return (1 - different / F.lit(MINIMA) - CHANCE) / (1 - CHANCE)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return list(Words(texts).shingles(WIDTH))


def _nodes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles end to end, where each set begins (and the last ends), and a hash of each."""
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int64)
    return values, at, run_hash(values, at[:-1], at[1:])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its node; a node's signature and band keys stand beside its first row."""
    for batch in batches:
        seen: set[int] = set()
        for piece in pieces(batch, "text"):
            sets = _sets(piece.column("text"))
            _, at, nodes = _nodes(sets)
            new = np.zeros(len(sets), dtype=bool)
            for i, node in enumerate(nodes.tolist()):
                if sets[i].size and node not in seen:
                    seen.add(node)
                    new[i] = True
            values, starts, _ = _nodes([sets[i] for i in np.flatnonzero(new)])
            least = minima(values, starts[:-1])
            row = np.cumsum(new) - 1
            columns = [piece.column("doc_id"), piece.column("row"), pa.array(signed(nodes)),
                       pa.array(np.diff(at))]
            for part in (*packed(least).T, *band_keys(least).T):
                column = np.zeros(len(sets), dtype=np.uint64)
                column[new] = part[row[new]]
                columns.append(pa.array(signed(column), mask=~new))
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "row", "node", "n", *_SIGNATURE, *_KEYS])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            nodes = _nodes(_sets(piece.column("text")))[2]
            yield pa.RecordBatch.from_arrays([pa.array(signed(nodes)), piece.column("text")],
                                             names=["node", "item"])


def _link(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return WHOLE * common >= PART * (a.size + b.size - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those that link by their full sets."""
    for batch in batches:
        _, first, which = np.unique(batch.column("a").to_numpy(), return_index=True,
                                    return_inverse=True)
        pivots = _sets(batch.column("item_a").take(pa.array(first)))
        others = _sets(batch.column("item_b"))
        keep = [_link(pivots[p], other) for p, other in zip(which.tolist(), others, strict=True)]
        yield batch.select(["label_a", "label_b"]).filter(pa.array(keep, pa.bool_()))


def _forest(block: pa.Table) -> pa.Table:
    """Links between the queries and the other nodes of a block, as far as they join labels that
    links before them have not. Signatures choose the pairs, full sets confirm them."""
    block = block.combine_chunks()
    label = block.column("label").to_numpy()
    size = block.column("n").to_numpy()
    marks = unsigned(np.stack([block.column(s).to_numpy() for s in _SIGNATURE], axis=1).ravel())
    marks = marks.reshape(-1, PARTS)
    asks = block.column("query").to_numpy(zero_copy_only=False)
    q, s = np.flatnonzero(asks), np.flatnonzero(~asks)
    sets = _sets(block.column("item").combine_chunks())
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    found: list[tuple[int, int]] = []
    for part in np.array_split(q, -(-q.size // BLOCK)) if q.size else []:
        guess = estimates(marks[part][:, None], marks[s][None])
        x, y = size[part][:, None], size[s][None]
        fits = WHOLE * np.minimum(x, y) >= PART * np.maximum(x, y)
        fits &= (guess >= least_estimate()) & (label[part][:, None] != label[s][None])
        i, j = np.nonzero(fits)
        order = np.argsort(-guess[i, j], kind="stable")
        for a, b in zip(part[i[order]].tolist(), s[j[order]].tolist(), strict=True):
            x, y = top(label[a]), top(label[b])
            if x != y and _link(sets[a], sets[b]):
                root[max(x, y)] = min(x, y)
                found.append((label[a], label[b]))
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"label_a": pa.array(pairs[:, 0]), "label_b": pa.array(pairs[:, 1])})


def _relabel(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    moved = save(connected(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
                 .select(F.col("node").alias("old"), F.col("root").alias("new")), "moved")
    return moved, save(labels.join(moved, labels.root == moved.old, "left")
                       .select("node", F.coalesce("new", "root").alias("root")), "labels")


def _shared(nodes: DataFrame) -> DataFrame:
    """``bucket, node`` of buckets with several nodes; of buckets with the same nodes one counts."""
    rows = nodes.select("node", F.explode(F.array(*_KEYS)).alias("bucket"))
    sign = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("s"),
        F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    once = save(sign.groupBy("n", "s", "low").agg(F.min("bucket").alias("bucket"))
                .select("bucket"), "once")
    return save(rows.join(once, "bucket", "left_semi").select("bucket", "node"), "buckets")


def _promising(rows: DataFrame, marks: DataFrame, pivots: int, turn: int) -> DataFrame:
    """Pairs of a node with pivots of its buckets that their signatures do not rule out, for each
    node those of the highest estimates."""
    slots = rows.withColumn("slot", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(pivots)))
    best = save(slots.groupBy("bucket", "slot").agg(F.max("rank").alias("rank")), "best")
    chosen = save(slots.join(best, ["bucket", "slot", "rank"], "left_semi").select(
        "bucket", F.col("node").alias("a"), F.col("label").alias("label_a")), "pivots")
    pairs = save(rows.join(chosen, "bucket").where("label <> label_a").select(
        "a", F.col("node").alias("b"), "label_a", F.col("label").alias("label_b")).distinct(),
        "proposed")
    sides = [marks.select(F.col("node").alias(side), *[
        F.col(c).alias(f"{side}_{c}") for c in ("n", *_SIGNATURE)]) for side in "ab"]
    close = WHOLE * F.least("a_n", "b_n") >= PART * F.greatest("a_n", "b_n")
    guessed = (pairs.join(sides[0], "a").join(sides[1], "b").where(close)
               .withColumn("estimate", estimate("a_", "b_"))
               .where(F.col("estimate") >= least_estimate()))
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("estimate"), "a"))
    return save(guessed.withColumn("place", place).where(F.col("place") <= pivots)
                .select("a", "b", "label_a", "label_b"), "promising")


def _blocks(rows: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """The rest of the comparisons: nodes beside the largest component of a bucket are queries
    against it and each other, a block of queries and a block of nodes at a time."""
    held = save(labels.groupBy("root").agg(F.count("*").alias("held"))
                .select(F.col("root").alias("label"), "held"), "held")
    largest = save(rows.join(held, "label").groupBy("bucket")
                   .agg(F.max_by("label", F.struct("held", "label")).alias("group")), "largest")
    members = save(rows.join(largest, "bucket").select(
        "group", "node", "label", (F.col("label") != F.col("group")).alias("query")).distinct(),
        "members")
    sizes = save(members.groupBy("group").agg(
        F.ceil(F.count_if("query") / BLOCK).cast("int").alias("asked"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("kept")), "sizes")
    dealt = members.join(sizes, "group")
    own = F.xxhash64("node")
    queries = dealt.where("query").select(
        "group", "node", "label", "query", F.pmod(own, F.col("asked")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("kept") - 1)).alias("y"))
    stored = dealt.select(
        "group", "node", "label", F.lit(False).alias("query"),
        F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("x"),
        F.pmod(own, F.col("kept")).cast("int").alias("y"))
    return save(save(queries.union(stored), "blocks").join(items, "node")
                .groupBy("group", "x", "y")
                .applyInArrow(_forest, "label_a long, label_b long"), "links")


def _labels(buckets: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, root`` of all nodes in ``buckets``."""
    weight = save(buckets.groupBy("node").agg(F.count("*").alias("weight")), "weight")
    # a node of many buckets is a good pivot; the hash spreads ties
    rank = F.col("weight") * F.lit(1 << 31) + F.pmod(F.xxhash64("node"), F.lit(1 << 31))
    rows = save(buckets.join(weight, "node").select(
        "bucket", "node", F.col("node").alias("label"), rank.alias("rank")), "rows")
    labels = weight.select("node", F.col("node").alias("root"))
    for turn, pivots in enumerate((1, 4)):
        pairs = _promising(rows, marks, pivots, turn)
        a = texts.select(F.col("node").alias("a"), F.col("item").alias("item_a"))
        b = texts.select(F.col("node").alias("b"), F.col("item").alias("item_b"))
        with batches_of(texts, 512):
            links = save(pairs.join(b, "b").join(a, "a").mapInArrow(
                _confirmed, "label_a long, label_b long"), "links")
        moved, labels = _relabel(labels, links)
        rows = save(rows.join(moved, rows.label == moved.old, "left").select(
            "bucket", "node", F.coalesce("new", "label").alias("label"), "rank"), "rows")
        mixed = save(rows.groupBy("bucket")
                     .agg(F.min("label").alias("low"), F.max("label").alias("high"))
                     .where("low < high").select("bucket"), "mixed")
        rows = save(rows.join(mixed, "bucket", "left_semi"), "live")
        # what is settled needs no text any more
        left = save(rows.select("node").distinct(), "open")
        texts = save(texts.join(left, "node", "left_semi"), "items")
    return _relabel(labels, _blocks(rows, labels, texts.join(marks, "node")))[1]


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the least ``doc_id`` that links reach, the row's own included; the rows
    that bear it themselves are kept.
    """
    docs = documents(docs).select("doc_id", "text",
                                  F.coalesce("doc_id", F.xxhash64("text")).alias("row"))
    fields = ", ".join(f"{c} long" for c in ("doc_id", "row", "node", "n", *_SIGNATURE, *_KEYS))
    with passing(docs, "rooted", "least"):
        with batches_of(docs, 2000):
            marked = save(docs.mapInArrow(_signatures, fields), "signatures")
        rows = marked.select("doc_id", "node", "n")
        nodes = save(marked.where(f"{_SIGNATURE[0]} is not null").groupBy("node").agg(
            F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", *_SIGNATURE, *_KEYS)]),
            "nodes")
        buckets = _shared(nodes)
        needed = save(nodes.join(buckets.select("node").distinct(), "node", "left_semi")
                      .select("node", "row", "n", *_SIGNATURE), "needed")
        with batches_of(docs, 2000), early_semi_joins(docs):
            texts = save(docs.join(needed.where("n > 0").select("row"), "row", "left_semi")
                         .select("text").mapInArrow(_texts, "node long, item string")
                         .join(needed.select("node"), "node", "left_semi")
                         .dropDuplicates(["node"]), "texts")
        labels = _labels(buckets, needed.drop("row"), texts)
        rooted = save(rows.join(labels, "node", "left").select(
            "doc_id", "n", F.coalesce("root", "node").alias("root")), "rooted")
        least = save(rooted.where("n > 0").groupBy("root")
                     .agg(F.min("doc_id").alias("component_id")), "least")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rooted.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
