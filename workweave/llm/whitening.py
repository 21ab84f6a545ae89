"""Embedding whitening: vectors on the first principal components, each with unit variance.

An entry ``c`` becomes the whole number ``floor(64 * c) + 1000000``, so counts and sums are exact.
A first pass over the vectors gives their number and sums, a second one the covariance of what is
left after centring (exact whole numbers until the division by n). The components are eigenvectors
of that matrix, found interval by interval with contour integration (``feast``), an interval per
task. A last pass projects. Only tables as wide as a vector leave the tasks: d sums, d * d products.

Left out are vectors that are null, hold a null or an entry that is not finite or whose whole number
is beyond 2**62, and vectors of another length than most vectors have (of lengths equally frequent
the greatest counts). An eigenvalue below ``FLOOR`` of the largest is rounding, so its component is
left out, as nothing has unit variance there: of equal vectors, of a single one and of an empty
table no component is left. Vectors may be longer than 0 and up to ``WIDEST``. Null and repeated
ids stay, every row is a vector of its own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.llm import feast
from workweave.llm.tables import batches_of, save

SCALE, OFFSET = 64, 1_000_000
MOST = 32
FLOOR = 1e-10
#: Length of vectors up to which a matrix of products is held in a task.
WIDEST = 4096
_EXACT = 1 << 62
_SUMS = "length int, n long, sums array<decimal(38,0)>"


def _vectors(df: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows that take part, whatever their length."""
    vector = F.col("embedding").cast("array<double>")
    good = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c * SCALE) < float(_EXACT)))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(good)


def _whole(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The whole numbers of a batch of vectors, all of the same length."""
    column = batch.column("vector")
    return (np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            .reshape(len(column), length) + OFFSET)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths).tolist():
            x = _whole(batch.filter(pa.array(lengths == length)), length)
            safe = x.size == 0 or int(np.abs(x).max()) < _EXACT // len(x)
            total = (x if safe else x.astype(object)).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([length], pa.int32()), pa.array([len(x)], pa.int64()),
                 pa.array([[Decimal(int(s)) for s in total]], pa.list_(pa.decimal128(38, 0)))],
                names=["length", "n", "sums"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: as 64-bit numbers where they fit, else as Python's."""
    most = max([abs(s) for s in sums] + [n * max(int(x.max()), -int(x.min()))] if x.size else [0])
    if most < _EXACT:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, row by row; null where 64 bits do not hold one."""
    about = (y.astype(float) ** 2).sum(axis=1)
    fits = about < 9.3e18
    exact = (np.abs(y[fits].astype(np.int64)).astype(np.uint64) ** np.uint64(2)).sum(
        axis=1, dtype=np.uint64)
    found: list[int | None] = [None] * len(y)
    for at, value in zip(np.flatnonzero(fits).tolist(), exact.tolist(), strict=True):
        found[at] = value if value < 1 << 63 else None
    return found


def _products(rows: Callable[[pa.RecordBatch], np.ndarray], width: int) -> Callable:
    """Sums of products of the columns of ``rows``, a table of ``width`` rows from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            part = rows(batch)
            total += part.T @ part
        yield _lines(np.arange(width), total)

    return run


def _lines(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)),
         pa.array(list(values), pa.list_(pa.float64()))], names=["line", "entries"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each ``line``; all of a line are in one partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for line, entries in zip(batch.column("line").to_pylist(), batch.column("entries"),
                                 strict=True):
            values = entries.values.to_numpy()
            total[line] = total[line] + values if line in total else values
    if total:
        yield _lines(np.array(list(total)), np.stack(list(total.values())))


def _matrix(vectors: DataFrame, rows: Callable, width: int, label: str) -> np.ndarray:
    with batches_of(vectors, 2000):
        lines = save(vectors.mapInArrow(_products(rows, width), "line int, entries array<double>")
                     .repartition("line").mapInArrow(_added, "line int, entries array<double>"),
                     label)
    matrix = np.zeros((width, width))
    for row in lines.collect():
        matrix[row.line] = row.entries
    return (matrix + matrix.T) / 2


def _pairs(matrix: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, vectors = feast.solve(matrix, low, high, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))],
                    names=["value", "vector"])

    return run


def components(df: DataFrame, matrix: np.ndarray, most: int = MOST
               ) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors as columns, the entry of greatest
    size of each being positive. Every interval of the spectrum is solved by a task of its own."""
    parts = feast.intervals(matrix, most, FLOOR)
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    spark = df.sparkSession
    asked = spark.createDataFrame(parts, "low double, high double, count int")
    found = asked.repartition(len(parts), "low").mapInArrow(
        _pairs(matrix), "value double, vector array<double>").collect()
    found = sorted(found, key=lambda r: -r.value)[:most]
    vectors = np.array([r.vector for r in found]).T
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.array([r.value for r in found]), vectors * sign


@dataclass
class Whitening:
    """A fitted whitening: number, length and sums of vectors, variances, and the projection."""

    n: int
    length: int
    sums: list[int]
    explained: list[float]
    onto: np.ndarray

    def _rows(self, df: DataFrame) -> DataFrame:
        return _vectors(df).where(F.size("vector") == self.length)

    def _whitened(self) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
        n, length, sums, onto = self.n, self.length, self.sums, self.onto

        def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            y = centred(_whole(batch, length), n, sums)
            return y, (y / n).astype(float) @ onto

        return of

    def transform(self, df: DataFrame) -> DataFrame:
        """``vec_id, n, deviation, whitened``; ``deviation`` is the exact sum of squares of
        ``n * x - sums`` (null beyond 64 bits), ``whitened`` has one value per component."""
        of, n = self._whitened(), self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, z = of(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([n] * len(z), pa.int64()),
                     pa.array(deviations(y), pa.int64()),
                     pa.array(list(z), pa.list_(pa.float64()))],
                    names=["vec_id", "n", "deviation", "whitened"])

        with batches_of(df, 2000):
            return self._rows(df).mapInArrow(
                run, "vec_id long, n long, deviation long, whitened array<double>")

    def identity_error(self, df: DataFrame) -> float:
        """How far the covariance of the whitened vectors, measured by a pass over them, is from
        the identity: the largest absolute entry of the difference."""
        of, k = self._whitened(), len(self.explained)
        if not k:
            return 0.0

        def rows(batch: pa.RecordBatch) -> np.ndarray:
            z = of(batch)[1]
            return np.concatenate([z, np.ones((len(z), 1))], axis=1)  # the ones give the means

        products = _matrix(self._rows(df), rows, k + 1, "whitened") / self.n
        mean = products[:k, k]
        return float(np.abs(products[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def fit(df: DataFrame, most: int = MOST) -> Whitening:
    """The whitening of all vectors of ``df(vec_id, embedding)`` by their ``most`` first components."""
    vectors = _vectors(df)
    with batches_of(df, 2000):
        parts = save(vectors.mapInArrow(_sums, _SUMS), "sums")
    top = (parts.groupBy("length").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), F.desc("length")).first())
    if top is None or not top.length:
        return Whitening(0 if top is None else top.n, 0, [], [], np.zeros((0, 0)))
    n, length = top.n, top.length
    if length > WIDEST:
        raise ValueError(f"vectors of {length} entries; up to {WIDEST} are supported")
    added = (parts.where(F.col("length") == length).select(F.posexplode("sums").alias("at", "x"))
             .groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect())
    sums = [int(r.x) for r in added]

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return (centred(_whole(batch, length), n, sums) / n).astype(float)

    matrix = _matrix(vectors.where(F.size("vector") == length), rows, length, "products") / n
    values, axes = components(df, matrix, most)
    return Whitening(n, length, sums, (values / np.trace(matrix)).tolist() if values.size else [],
                     axes / np.sqrt(values))
