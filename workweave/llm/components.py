"""Connected components of links, and links found inside buckets of likely partners.

Nodes are 64-bit hashes, so their numeric order is random: hooking every node to its least
neighbour halves a component or better in each round, whatever its shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from workweave.llm import trie
from workweave.llm.tables import batches_of, passing, save

#: Nodes in a block of the last comparison, on average.
BLOCK = 256
#: Shingles of pairs that are looked up at a time.
LOOKUPS = 1 << 21


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a record batch: at most one edge per node, from the node to its least root."""
    for batch in batches:
        a = batch.column("a").to_numpy(zero_copy_only=False)
        b = batch.column("b").to_numpy(zero_copy_only=False)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = np.arange(nodes.size)
        left, right = at[: a.size], at[a.size:]
        while True:  # hook the larger root to the smaller, then halve the paths
            x, y = parent[left], parent[right]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if np.array_equal(low, high):
                break
            np.minimum.at(parent, high, low)
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
        moved = np.flatnonzero(parent != np.arange(nodes.size))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[parent[moved]]), pa.array(nodes[moved])], names=["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the same for a component.

    Distributed union-find: batches are reduced to forests, then each round hooks every node to
    its least neighbour and contracts the edges. Nothing but an empty-test reaches the driver.
    """
    left = save(edges.where("a <> b").select("a", "b").mapInArrow(_local_forest, "a long, b long"),
                "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hooks = save(both.groupBy("a").agg(F.min("b").alias("up"))
                     .select(F.col("a").alias("old"), F.least("a", "up").alias("up")), "hooks")
        labels = save(labels.join(hooks, labels.root == hooks.old, "left")
                      .select("node", F.coalesce("up", "root").alias("root")), "labels")
        far = hooks.select(F.col("old").alias("old_b"), F.col("up").alias("up_b"))
        left = save(left.join(hooks, F.col("a") == F.col("old"))
                    .select(F.col("up").alias("a"), "b")
                    .join(far, F.col("b") == F.col("old_b"))
                    .select("a", F.col("up_b").alias("b")).where("a <> b").distinct(), "edges")
    return labels


def meet(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, part: int, whole: int
         ) -> np.ndarray:
    """For each pair of places in ``sets``, whether the two sets link."""
    size = np.array([x.size for x in sets], dtype=np.int64)
    first = np.cumsum(size) - size
    _, rank = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    held = np.sort(np.repeat(np.arange(size.size), size) << 32 | rank)
    few, many = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    # a set without tokens links with nothing
    close = np.flatnonzero((few > 0) & (whole * few >= part * many))
    less = np.where(size[a] <= size[b], a, b)[close]
    more = np.where(size[a] <= size[b], b, a)[close]
    both = np.zeros(a.size, dtype=np.int64)
    cuts = np.searchsorted(np.cumsum(size[less]), np.arange(LOOKUPS, size[less].sum(), LOOKUPS))
    for x, y in zip(np.append(0, cuts), np.append(cuts, close.size), strict=True):
        n = size[less[x:y]]
        of = np.repeat(np.arange(n.size), n)
        at = first[less[x:y]][of] + np.arange(of.size) - (np.cumsum(n) - n)[of]
        asked = more[x:y][of] << 32 | rank[at]
        found = np.minimum(np.searchsorted(held, asked), held.size - 1)
        both[close[x:y]] = np.bincount(of[held[found] == asked], minlength=n.size)
    return (both > 0) & (whole * both >= part * (size[a] + size[b] - both))


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit sketch of each set of distinct tokens that begins at ``starts``: each token turns
    one bit over. Two sketches differ in no more bits than tokens that only one of the sets holds."""
    if not starts.size:
        return np.zeros(0, dtype=np.uint64)
    return np.bitwise_xor.reduceat(np.uint64(1) << (values & np.uint64(63)), starts)


class Sketched:
    """Sets with sketches of as many words as their size asks for, to rule pairs out unseen: two
    that link differ in at most ``(whole - part) / (whole + part)`` of the sum of their sizes."""

    def __init__(self, sets: list[np.ndarray], part: int, whole: int):
        self.part, self.whole = part, whole
        self.size = np.array([x.size for x in sets], dtype=np.int64)
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        mean = every.size // max(1, len(sets))
        self.words = next((w for w in (1, 4) if mean < 32 * w), 16)
        owner = np.repeat(np.arange(len(sets)), self.size)
        word = (every >> np.uint64(6)).astype(np.int64) % self.words
        cell = owner * self.words + word
        bit = np.uint64(1) << (every & np.uint64(63))
        order = np.argsort(cell, kind="stable")
        cell, bit = cell[order], bit[order]
        opens = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: cell.size])
        self.sketch = np.zeros(len(sets) * self.words, dtype=np.uint64)
        if opens.size:
            self.sketch[cell[opens]] = np.bitwise_xor.reduceat(bit, opens)
        self.sketch = self.sketch.reshape(len(sets), self.words)

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets at ``a`` and ``b`` may link."""
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        bits = np.zeros(np.broadcast(a, b).shape, dtype=np.int64)
        for word in self.sketch.T:
            bits += np.bitwise_count(word[a] ^ word[b])
        return ((small > 0) & (self.whole * small >= self.part * large)
                & ((self.whole + self.part) * bits <= (self.whole - self.part) * (small + large)))


def _pairs(sets: Callable, part: int, whole: int, direct: int) -> Callable:
    """Of pairs with both items, those that link; pairs with the same ``a`` are joined together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy(zero_copy_only=False)
            _, first, group = np.unique(a, return_index=True, return_inverse=True)
            queries = sets(batch.column("item_a").take(pa.array(first)))
            stored = sets(batch.column("item_b"))
            keep: list[int] = []
            if direct:
                every, at = [*queries, *stored], first.size + np.arange(a.size)
                close = np.flatnonzero(Sketched(every, part, whole).close(group, at))
                keep = close[meet(every, group[close], at[close], part, whole)].tolist()
                group = group[:0]
            for g, rows in enumerate(np.split(np.argsort(group, kind="stable"),
                                              np.cumsum(np.bincount(group))[:-1])):
                if rows.size:
                    hits = trie.join([stored[r] for r in rows], [queries[g]], part, whole)
                    keep += [int(rows[s]) for _, s in hits]
            yield batch.select(["label_a", "label_b"]).take(pa.array(sorted(keep), pa.int64()))

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of each ``group, x, y`` of a sorted partition, whole: as many of such blocks as a
    batch ends, and where each begins. One block at a time is held beside the batch."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        key = np.stack([rows.column(k).to_numpy() for k in ("group", "x", "y")], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if cuts.size:
            yield rows.slice(0, cuts[-1]), np.append(0, cuts[:-1])
            rows = rows.slice(cuts[-1])
        rest = rows
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, dtype=np.int64)


def _blocks(sets: Callable, part: int, whole: int, direct: int) -> Callable:
    """Links between the queries and the stored items of each pair of blocks: of up to ``direct``
    pairs, or such a part that their sketches leave, by looking up their tokens, of more by tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches):
            rows = rows.combine_chunks()
            asks = rows.column("query").to_numpy().astype(bool)
            label = rows.column("label").to_numpy()
            every = sets(rows.column("item").combine_chunks())
            block = np.repeat(np.arange(starts.size), np.diff(np.append(starts, asks.size)))
            asked = np.bincount(block[asks], minlength=starts.size)
            kept = np.bincount(block[~asks], minlength=starts.size)
            small = asked * kept <= direct
            q, s = np.flatnonzero(asks & small[block]), np.flatnonzero(~asks)
            times = kept[block[q]]
            a = np.repeat(q, times)
            b = s[(np.cumsum(kept) - kept)[block[a]] + np.arange(a.size)
                  - np.repeat(np.cumsum(times) - times, times)]
            sketched = Sketched(every, part, whole)
            close = (label[a] != label[b]) & sketched.close(a, b)
            a, b = [a[close]], [b[close]]
            found = []
            for i in np.flatnonzero(~small):
                at = np.arange(starts[i], starts[i] + asked[i] + kept[i])
                q, s = at[asks[at]], at[~asks[at]]
                close = [np.nonzero(sketched.close(x[:, None], s) & (label[x][:, None] != label[s]))
                         for x in np.array_split(q, -(-q.size * s.size // LOOKUPS))] if direct else []
                # as many in a hundred pairs as in a block of BLOCK by BLOCK items
                if direct and sum(x.size for x, _ in close) <= direct * max(
                        1, q.size * s.size // BLOCK ** 2):
                    for part_of, (x, y) in zip(np.array_split(q, len(close)), close, strict=True):
                        a.append(part_of[x])
                        b.append(s[y])
                    continue
                hits = trie.join([every[r] for r in s], [every[r] for r in q], part, whole)
                pairs = np.array(hits, dtype=np.int64).reshape(-1, 2)
                found.append(np.stack([q[pairs[:, 0]], s[pairs[:, 1]]], axis=1))
            a, b = np.concatenate(a), np.concatenate(b)
            linked = meet(every, a, b, part, whole)
            found.append(np.stack([a[linked], b[linked]], axis=1))
            pairs = label[np.concatenate(found)]
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                             names=["label_a", "label_b"])

    return run


def _relabel(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    moved = save(connected(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
                 .select(F.col("node").alias("old"), F.col("root").alias("new")), "moved")
    return moved, save(labels.join(moved, labels.root == moved.old, "left")
                       .select("node", F.coalesce("new", "root").alias("root")), "labels")


def linked(pairs: DataFrame, items: DataFrame, sets: Callable, part: int, whole: int, direct: int
           ) -> DataFrame:
    """``label_a, label_b`` of the ``pairs(a, b, label_a, label_b)`` whose items link."""
    a = items.select(F.col("node").alias("a"), F.col("item").alias("item_a"))
    b = items.select(F.col("node").alias("b"), F.col("item").alias("item_b"))
    with batches_of(items, 512):
        return save(pairs.join(b, "b").join(a, "a").mapInArrow(
            _pairs(sets, part, whole, direct), "label_a long, label_b long"), "links")


def _once(buckets: DataFrame) -> DataFrame:
    """``bucket, n`` of the buckets with ``n`` nodes, two or more; those with the same nodes count
    once."""
    sign = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("s"),
        F.min("node").alias("low"), F.max("node").alias("high"),
        (F.count("sketch") if "sketch" in buckets.columns else F.lit(0)).alias("told")
        ).where("low < high")
    return save(sign.groupBy("n", "s", "low").agg(F.max_by("bucket", "told").alias("bucket"))
                .select("bucket", "n"), "once")


def few(buckets: DataFrame, most: int, part: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """``a, b, label_a, label_b`` for every two nodes in a bucket of up to ``most`` nodes that may
    link, and the larger buckets.

    ``buckets(bucket, node, size, sketch)`` tells the ``sketch`` of a node in one of its rows at
    least. Two sets that link differ in at most ``(whole - part) / (whole + part)`` of the sum of
    their sizes; where the sketches differ in more bits than that, they don't. This is the plain form,
    by which tests tell that ``passage_dedup`` lists the same pairs in its tasks.
    """
    rows = save(buckets.join(_once(buckets), "bucket"), "buckets")
    known = save(rows.groupBy("node").agg(F.max("sketch").alias("known")), "sketches")
    small = save(rows.where(F.col("n") <= most).join(known, "node").select(
        "bucket", "node", "size", "known"), "few")
    a, b = small.alias("a"), small.alias("b")
    size = F.col("a.size") + F.col("b.size")
    close = ((whole * F.least("a.size", "b.size") >= part * F.greatest("a.size", "b.size"))
             & F.coalesce((whole + part) * F.bit_count(F.col("a.known").bitwiseXOR(F.col("b.known")))
                          <= (whole - part) * size, F.lit(True)))
    pairs = save(a.join(b, "bucket").where((F.col("a.node") < F.col("b.node")) & close).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")
    return (pairs.select("a", "b", F.col("a").alias("label_a"), F.col("b").alias("label_b")),
            rows.where(F.col("n") > most).select("bucket", "node", "size"))


def resolve(buckets: DataFrame, items: DataFrame, sets: Callable, part: int, whole: int,
            direct: int = 0, block: int = BLOCK) -> DataFrame:
    """``node, root`` of the nodes in ``buckets(bucket, node, size)``.

    ``items(node, item)`` holds texts, of which ``sets`` makes a list of sorted distinct tokens.
    Two nodes link when ``whole * intersection >= part * union``; those that share a bucket are
    compared unless links already put them into one component (or ``size``, where it is not null,
    rules it out), so the components are those of all links inside buckets. Tries compare them; with
    ``direct``, they do so only in blocks of more pairs than that, as a trie of few items is dear. An
    item is sent to as many tasks as its group has blocks of ``block`` items on average.

    A bucket of like nodes costs a multiple of its size and not its square. First each node meets
    the pivot that stands in most buckets, then four others. What then still carries different
    labels within a bucket is compared in blocks: a bucket is told by its largest component; all
    nodes beside that component are queries against it and against each other, and a query block
    meets a stored block in one task of bounded size. Grouped sides are written before a join:
    both sides of it are then plain shuffles, of which Spark can split a hot key.
    """
    named = buckets.select("bucket", "node", "size")
    rows = save(named.join(_once(named), "bucket", "left_semi"), "buckets")
    weight = save(rows.groupBy("node").agg(F.count("*").alias("weight")), "weight")
    # spreads ties, and tells nodes of equal weight apart
    rank = F.col("weight") * F.lit(1 << 31) + F.pmod(F.xxhash64("node"), F.lit(1 << 31))
    rows = save(rows.join(weight, "node").select(
        "bucket", "node", "size", F.col("node").alias("label"), rank.alias("rank")), "rows")
    labels = weight.select("node", F.col("node").alias("root"))

    for turn, pivots in enumerate((1, 4)):
        with passing(rows, "labels", "live", "items"):
            slots = rows.withColumn("slot", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(pivots)))
            best = save(slots.groupBy("bucket", "slot").agg(F.max("rank").alias("rank")), "best")
            chosen = save(slots.join(best, ["bucket", "slot", "rank"], "left_semi").select(
                "bucket", F.col("node").alias("a"), F.col("size").alias("size_a"),
                F.col("label").alias("label_a"), F.col("rank").alias("rank_a")), "pivots")
            close = F.coalesce(whole * F.least("size", "size_a") >= part * F.greatest("size", "size_a"),
                               F.lit(True))
            order = F.desc("rank_a") if turn == 0 else F.xxhash64("a", F.lit(turn))
            pairs = save(rows.join(chosen, "bucket")
                         .where((F.col("label") != F.col("label_a")) & close)
                         .select("a", F.col("node").alias("b"), "label_a",
                                 F.col("label").alias("label_b"), "rank_a").distinct()
                         .withColumn("place", F.row_number().over(
                             Window.partitionBy("b").orderBy(order)))
                         .where(F.col("place") <= pivots).drop("place", "rank_a"), "pairs")
            links = linked(pairs, items, sets, part, whole, direct)
            moved, labels = _relabel(labels, links)
            rows = save(rows.join(moved, rows.label == moved.old, "left").select(
                "bucket", "node", "size", F.coalesce("new", "label").alias("label"), "rank"), "rows")
            mixed = save(rows.groupBy("bucket")
                         .agg(F.min("label").alias("low"), F.max("label").alias("high"))
                         .where("low < high").select("bucket"), "mixed")
            rows = save(rows.join(mixed, "bucket", "left_semi"), "live")
            # what is settled needs no text any more
            items = save(items.join(save(rows.select("node").distinct(), "open"), "node", "left_semi"),
                         "items")

    held = save(labels.groupBy("root").agg(F.count("*").alias("held"))
                .select(F.col("root").alias("label"), "held"), "held")
    largest = save(rows.join(held, "label").groupBy("bucket")
                   .agg(F.max_by("label", "held").alias("group")), "largest")
    asks = F.col("label") != F.col("group")
    members = save(rows.join(largest, "bucket").select("group", "node", "label",
                                                       asks.alias("query")).distinct(), "members")
    sizes = save(members.groupBy("group").agg(
        F.ceil(F.count_if("query") / block).cast("int").alias("asked"),
        F.ceil(F.count("*") / block).cast("int").alias("kept")), "sizes")
    dealt = members.join(sizes, "group")
    own = F.xxhash64("node")
    queries = dealt.where("query").select(
        "group", "node", "label", "query", F.pmod(own, F.col("asked")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("kept") - 1)).alias("y"))
    stored = dealt.select(
        "group", "node", "label", F.lit(False).alias("query"),
        F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("x"),
        F.pmod(own, F.col("kept")).cast("int").alias("y"))
    blocks = (save(queries.union(stored), "blocks").join(items, "node")
              .repartition("group", "x", "y").sortWithinPartitions("group", "x", "y"))
    with batches_of(items, 2000):
        links = save(blocks.mapInArrow(_blocks(sets, part, whole, direct), "label_a long, label_b long"),
                     "links")
    return _relabel(labels, links)[1]
