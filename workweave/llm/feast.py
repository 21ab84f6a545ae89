"""Eigenpairs of a symmetric matrix in an interval, by contour integration and inertia counts.

``count_above`` tells by the inertia of a shifted matrix how many eigenvalues lie above a value.
``intervals`` cuts the upper end of the spectrum into intervals of few eigenvalues, at places where
no eigenvalue lies. ``solve`` finds the eigenpairs of one interval: a quadrature of shifted complex
solves around it projects a block of vectors onto its eigenspace (FEAST), Rayleigh-Ritz extracts
the pairs, and both repeat until the residuals vanish and the inertia count is met. Intervals do
not depend on each other. Matrices are as wide as one vector, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues of one interval, where the spectrum lets itself be cut so finely.
FEW = 8
#: Quadrature points on the upper half of a contour.
POINTS = 12
ROUNDS = 40
#: After so many rounds without success the block doubles, for eigenvalues close to the contour.
WIDEN = 4
#: Residuals, against the largest eigenvalue. About rounding of a product with the matrix.
PRECISION = 4e-15
#: Pivot choice that bounds the growth of elements in 1 x 1 and 2 x 2 steps alike.
_ALPHA = (1 + 17 ** 0.5) / 8


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are negative, zero and positive.

    A symmetric elimination with 1 x 1 and 2 x 2 pivots keeps these counts. The pivot is the
    largest entry of the diagonal unless an entry beside it is much larger. What is left within
    rounding of nothing counts as zero.
    """
    a = np.array(a, dtype=float)
    nothing = 1e-15 * len(a) * np.abs(a).max(initial=0.0)
    negative = positive = 0
    while a.size:
        n = a.shape[0]
        size = np.abs(a)
        r = int(np.argmax(np.diagonal(size)))
        p, q = divmod(int(np.argmax(size)), n)
        if size[p, q] <= nothing:
            return int(negative), n, int(positive)
        if size[r, r] >= _ALPHA * size[p, q]:
            rest = np.delete(np.arange(n), r)
            pivot, side = a[r, r], a[rest, r]
            negative, positive = negative + (pivot < 0), positive + (pivot > 0)
            a = a[np.ix_(rest, rest)] - np.outer(side, side / pivot)
        else:  # such a block has one eigenvalue of each sign
            rest = np.delete(np.arange(n), [p, q])
            block, side = a[np.ix_([p, q], [p, q])], a[np.ix_(rest, [p, q])]
            negative, positive = negative + 1, positive + 1
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
            a = (a + a.T) / 2
    return int(negative), 0, int(positive)


def count_above(matrix: np.ndarray, value: float) -> int:
    return inertia(matrix - value * np.eye(matrix.shape[0]))[2]


def intervals(matrix: np.ndarray, most: int, floor: float) -> list[tuple[float, float, int]]:
    """``low, high, count`` of intervals from the top down that hold the ``most`` largest
    eigenvalues, of those above ``floor`` times the largest; the last may hold more.

    A cut is taken only where eigenvalues within rounding of it do not change the count.
    """
    if not matrix.size or not matrix.any():
        return []
    # no eigenvalue exceeds the largest sum of a row
    top = float(np.abs(matrix).sum(axis=1).max()) * 1.01
    close = 1e-11 * top

    def clear(value: float) -> bool:
        return count_above(matrix, value - close) == count_above(matrix, value + close)

    low, high = 0.0, top  # the largest eigenvalue lies between
    while high - low > 1e-3 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if count_above(matrix, middle) else (low, middle)
    bottom = floor * low
    total = count_above(matrix, bottom)
    # what is left out below must not lie beside the lowest contour
    near, far = bottom, low
    while far - near > near:
        middle = (near * far) ** 0.5
        near, far = (middle, far) if count_above(matrix, middle) == total else (near, middle)
    bottom = (bottom * near) ** 0.5
    found: list[tuple[float, float, int]] = []
    open_ = [(bottom, top, total, 0)]
    while open_:
        a, b, below, above = open_.pop()  # counts above a and above b; highest interval last
        if above >= min(most, total) or below == above:
            continue
        if below - above > FEW and b - a > 64 * close:
            cut = next((c for c in (a + (b - a) * t for t in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65))
                        if clear(c)), None)
            if cut is not None:
                middle = count_above(matrix, cut)
                open_ += [(a, cut, below, middle), (cut, b, middle, above)]
                continue
        found.append((a, b, below - above))
    return found


def solve(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, falling, and unit eigenvectors as
    columns. Raises ``ArithmeticError`` if fewer or more are found."""
    n = matrix.shape[0]
    scale = float(np.abs(matrix).sum(axis=1).max())
    middle, radius = (low + high) / 2, (high - low) / 2
    # Gauss points on the upper half of the circle; the lower half is its mirror image
    at, weight = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi / 2 * (1 - at))
    # a wider block converges faster, as what lies just outside has room in it
    rng = np.random.default_rng(13)
    block = rng.standard_normal((n, min(n, 2 * count + 4)))
    for turns in range(1, ROUNDS + 1):
        image = np.zeros_like(block)
        for z, w in zip(turn, weight, strict=True):
            shifted = (middle + radius * z) * np.eye(n) - matrix
            image += w / 2 * (radius * z * np.linalg.solve(shifted, block)).real
        basis, size, _ = np.linalg.svd(image, full_matrices=False)
        basis = basis[:, size > size[0] * 1e-14]
        small = basis.T @ matrix @ basis
        values, turned = np.linalg.eigh((small + small.T) / 2)
        vectors = basis @ turned
        inside = (values > low) & (values < high)
        rest = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        if inside.sum() == count and rest[inside].max() <= PRECISION * n ** 0.5 * scale:
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], vectors[:, inside][:, order]
        block = vectors
        if turns % WIDEN == 0:
            more = rng.standard_normal((n, min(block.shape[1], n - block.shape[1])))
            block = np.concatenate([block, more], axis=1)
    raise ArithmeticError(
        f"{int(inside.sum())} of {count} eigenvalues between {low} and {high}, residual "
        f"{rest[inside].max(initial=0.0) / scale}")
