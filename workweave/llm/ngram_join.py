"""N-gram Jaccard join: documents whose word shingles overlap, by prefix tokens and a trie.

A document is the set of its distinct 5-word shingles; two link when 100 * intersection is at
least 75 * union. Linked pairs share a shingle among the first ``n - ceil(0.75 n) + 1`` of both
under any order that holds for all documents. The order here: shingles in a fixed part of the hash
space first, rarest first by their document count; then the others; then those that are frequent
everywhere. So a document meets others only if most of its shingles occur elsewhere too, and only
part of the shingles has to be counted. Candidates are verified by a join of tries.

The result has one row per input row. Null, empty and wordless texts have no shingles and link
with nothing; rows with the same text are one node, whichever their ids; a null ``doc_id`` takes
part, but the least id of a component is taken over the others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from workweave.llm.components import resolve
from workweave.llm.tables import batches_of, documents, early_semi_joins, passing, save
from workweave.llm.words import Words, mix, pieces, signed, unsigned

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Part of the hash space whose shingles are counted; prefixes take a quarter of a document.
COUNTED = 0.4
#: A shingle in more than one of so many documents is frequent; it is put last in the order.
FREQUENT = 1000
#: Tells the row of a document itself from those of its shingles.
OWN_ROW = np.uint64(0x5851F42D4C957F2D)
#: Frequent shingles told to all tasks, at most; the less frequent of them may as well be counted.
MOST_FREQUENT = 200_000


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """So many first shingles of a set of ``n`` must meet those of any partner."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def _profile(width: int, share: int) -> Callable:
    """Per row its node and set size; then shingles frequent within the batch, with their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            local: list[np.ndarray] = []
            rows = 0
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"))
                sets = list(words.shingles(width))
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), piece.column("text_hash"),
                    pa.array(signed(words.text_hash())),
                    pa.array(np.array([s.size for s in sets], dtype=np.int64)),
                    pa.array(np.zeros(len(sets), dtype=bool))],
                    names=["doc_id", "text_hash", "node", "n", "frequent"])
                rows += len(sets)
                local.extend(sets)
            values, count = np.unique(np.concatenate([*local, np.zeros(0, np.uint64)]),
                                      return_counts=True)
            often = count >= max(3, 2 * rows // share)
            if often.any():
                none = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    none, none, pa.array(signed(values[often])),
                    pa.array(count[often].astype(np.int64)),
                    pa.array(np.ones(int(often.sum()), dtype=bool))],
                    names=["doc_id", "text_hash", "node", "n", "frequent"])

    return run


def _prefixes(width: int, frequent: np.ndarray, counted: int) -> Callable:
    """Shingles by which a document may be found: all in the counted part and, where these are too
    few for its prefix, the next ones of the order, which are ``late``. A frequent one stands in
    ``hot``. A document's ``size`` and the number of its ``counted`` shingles travel once, in a row
    of a key of its own, which is neither late nor not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"))
                nodes = words.text_hash()
                tokens, owner, sizes, part, hot, late = [], [], [], [], [], []
                for node, found in zip(nodes, words.shingles(width), strict=True):
                    if found.size == 0 or node in seen:
                        continue
                    seen.add(node)
                    common = np.isin(found, frequent, assume_unique=True)
                    rare, common = found[~common], found[common]
                    cut = int(np.searchsorted(rare, np.uint64(counted)))
                    lack = max(0, prefix_length(found.size) - cut)
                    take = min(rare.size, cut + lack)
                    more = common[: max(0, lack - (rare.size - cut))]
                    n = take + more.size
                    tokens += [rare[:take], more, mix(np.array([node ^ OWN_ROW]))]
                    owner.append(np.full(n + 1, node, dtype=np.uint64))
                    sizes.append(found.size)
                    part.append(cut)
                    hot.append(np.arange(n + 1) >= take)
                    hot[-1][n] = False
                    late.append(np.arange(n + 1) >= cut)
                if owner:
                    token, node = np.concatenate(tokens), np.concatenate(owner)
                    warm, after = np.concatenate(hot), np.concatenate(late)
                    own = np.zeros(token.size, dtype=bool)
                    own[np.cumsum([x.size for x in owner]) - 1] = True
                    place = np.cumsum(own) - own
                    yield pa.RecordBatch.from_arrays([
                        pa.array(signed(np.where(warm, mix(token ^ mix(node)), token))),
                        pa.array(signed(node)), pa.array(after, mask=own),
                        pa.array(np.array(sizes, np.int32)[place], mask=~own),
                        pa.array(np.array(part, np.int32)[place], mask=~own),
                        pa.array(signed(token), mask=~warm)],
                        names=["key", "node", "late", "size", "counted", "hot"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            nodes = signed(Words(piece.column("text")).text_hash())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), piece.column("text")],
                                             names=["node", "item"])


def shingle_sets(width: int) -> Callable[[pa.Array], list[np.ndarray]]:
    def sets(texts: pa.Array) -> list[np.ndarray]:
        return list(Words(texts).shingles(width))

    return sets


def components(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the least ``doc_id`` that links reach, the row's own included.
    """
    docs = documents(docs)
    with passing(docs, "rooted", "least"):
        with batches_of(docs, 2000):
            profile = save(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
                _profile(width, FREQUENT),
                "doc_id long, text_hash long, node long, n long, frequent boolean"), "profile")
        rows = profile.where("not frequent").select("doc_id", "text_hash", "node", "n")
        total = rows.count()
        # any set serves as the frequent one, so cutting it at a size for all tasks changes no link
        often = (profile.where("frequent").groupBy("node").agg(F.sum("n").alias("n"))
                 .where(F.col("n") * FREQUENT >= F.lit(total)).where("n >= 8")
                 .orderBy(F.desc("n"), "node").limit(MOST_FREQUENT).select("node"))
        frequent = np.sort(unsigned(np.array([r.node for r in often.collect()], dtype=np.int64)))
        with batches_of(docs, 2000):
            found = docs.mapInArrow(
                _prefixes(width, frequent, int(COUNTED * (1 << 64))),
                "key long, node long, late boolean, size int, counted int, hot long")
            found = save(_candidates(found), "shared")
        # one row of each node that has a candidate; a row without an id goes by its text
        needed = save(found.select("node").distinct().join(
            rows.where("n > 0").groupBy("node").agg(
                F.min(F.coalesce("doc_id", "text_hash")).alias("row"), F.min("n").alias("n")),
            "node"), "needed")
        with batches_of(docs, 2000), early_semi_joins(docs):
            texts = save(docs.withColumn("row", F.coalesce("doc_id", F.xxhash64("text")))
                         .join(needed.where("n > 0").select("row"), "row", "left_semi")
                         .select("text").mapInArrow(_texts, "node long, item string")
                         .join(needed.select("node"), "node", "left_semi")
                         .dropDuplicates(["node"]), "texts")

        labels = resolve(found, texts, shingle_sets(width), NUMERATOR, DENOMINATOR)
        rooted = save(rows.join(labels, "node", "left").select(
            "doc_id", "text_hash", "n", F.coalesce("root", "node").alias("root")), "rooted")
        least = save(rooted.where("n > 0").groupBy("root")
                     .agg(F.min("doc_id").alias("component_id")), "least")
    return rooted.join(least, "root", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def _candidates(found: DataFrame) -> DataFrame:
    """Buckets of the prefix tokens that two nodes share.

    The rows of a token meet in one place, and those of one node only are dropped; a node then
    keeps the rarest tokens that its prefix still lacks. Frequent tokens, which only documents
    made of such have in their prefix, need no counting, so no hot key is gathered: the key of
    their rows is made from token and node.
    """
    token = Window.partitionBy("key")
    shared = (found.withColumn("df", F.count("*").over(token))
              .withColumn("low", F.min("node").over(token))
              .withColumn("high", F.max("node").over(token))
              .where("hot is not null or low < high or late is null")
              .dropDuplicates(["key", "node"])
              .withColumn("bucket", F.coalesce("hot", "key")))
    # all rows of a node meet once; late ones are in the prefix whatever the others are
    own = Window.partitionBy("node")
    part = Window.partitionBy("node", "late")
    size = F.max("size").over(own)
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(NUMERATOR) / F.lit(DENOMINATOR)) + 1
    return (shared.withColumn("n", size.cast("long")).withColumn("all", F.max("counted").over(own))
            .withColumn("alone", F.col("all") - F.count("*").over(part))
            .withColumn("place", F.row_number().over(part.orderBy("df", "bucket")))
            .where("late is not null")
            .where(F.col("late") | (F.col("place") <= F.least(prefix, F.col("all")) - F.col("alone")))
            .select("bucket", "node", F.col("n").cast("int").alias("size")))


def one_each(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """The rows of ``docs`` less those whose component has a member of lower ``doc_id``."""
    with passing(docs, "late"):
        late = save(components(docs, width)
                    .where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
                    .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"))
                    .distinct(), "late")
    return docs.join(late, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc"))
                     & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")), "left_anti")
