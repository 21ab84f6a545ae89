"""Set-similarity join of two lists of sets with a prefix tree."""

from __future__ import annotations

import numpy as np

#: Cells of the table that tells which query holds which token; larger query lists are halved.
CELLS = 1 << 26
#: Up to so many comparisons a tree costs more than it saves.
FEW = 8


def _link(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    if whole * min(a.size, b.size) < part * max(a.size, b.size) or not a.size or not b.size:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return whole * common >= part * (a.size + b.size - common)


def _known(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the vocabulary of all sets' tokens end to end, and the set of each."""
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    at = np.searchsorted(vocabulary, every)
    at[at == vocabulary.size] = 0
    hit = vocabulary[at] == every if vocabulary.size else np.zeros(every.size, dtype=bool)
    return at[hit], owner[hit]


def join(stored: list[np.ndarray], queries: list[np.ndarray], part: int, whole: int
         ) -> list[tuple[int, int]]:
    """``(query, stored)`` positions with ``whole * intersection >= part * union``.

    Sets are sorted distinct tokens; empty ones match nothing. The stored sets, without tokens that
    no query holds, are paths of a trie under one order of tokens for all: those in most sets come
    first, so that like sets share long paths. The trie is walked for all queries together. The
    overlap on a shared path is counted once; a subtree is left when no query's overlap so far,
    with all that remains of the subtree's longest path, reaches what its smallest set needs.
    """
    if not stored or not queries:
        return []
    if len(stored) * len(queries) <= FEW:  # no paths to share: a merge of each pair
        return [(i, j) for i, q in enumerate(queries) for j, s in enumerate(stored)
                if _link(q, s, part, whole)]
    held = np.unique(np.concatenate(queries))
    vocabulary = np.intersect1d(np.unique(np.concatenate(stored)), held, assume_unique=True)
    if vocabulary.size * len(queries) > CELLS and len(queries) > 1:
        half = len(queries) // 2
        return join(stored, queries[:half], part, whole) + [
            (q + half, s) for q, s in join(stored, queries[half:], part, whole)]

    at, owner = _known(stored, vocabulary)
    count = np.bincount(at, minlength=vocabulary.size)
    rank = np.empty(vocabulary.size, dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(vocabulary.size)
    cuts = np.searchsorted(owner, np.arange(1, len(stored)))
    paths = [np.sort(x) for x in np.split(rank[at], cuts)]
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
    paths = [paths[i] for i in order]
    length = np.array([p.size for p in paths])
    size = np.array([stored[i].size for i in order])
    shared = np.zeros(len(paths), dtype=np.int64)
    for i, (a, b) in enumerate(zip(paths, paths[1:], strict=False), 1):
        m = min(a.size, b.size)
        differ = np.flatnonzero(a[:m] != b[:m])
        shared[i] = differ[0] if differ.size else m

    holds = np.zeros((max(1, vocabulary.size), len(queries)), dtype=np.uint8)
    at, owner = _known(queries, vocabulary)
    holds[rank[at], owner] = 1
    asked = np.array([q.size for q in queries])

    def need(n: int) -> np.ndarray:
        return np.maximum(1, -(-part * (asked + n) // (part + whole)))

    found: list[tuple[int, int]] = []
    trail = [(0, np.zeros(len(queries), dtype=np.int64))]  # depth, overlap of each query there
    i = 0
    while i < len(paths):
        depth, path = int(shared[i]), paths[i]
        while trail[-1][0] > depth:
            trail.pop()
        above, overlap = trail[-1]
        if above < depth:
            overlap = overlap + holds[path[above:depth]].sum(axis=0, dtype=np.int64)
            trail.append((depth, overlap))
        nearer = np.flatnonzero(shared[i + 1:] <= depth)
        end = i + 1 + int(nearer[0]) if nearer.size else len(paths)
        rest = int(length[i:end].max()) - depth
        if not (overlap + rest >= need(int(size[i:end].min()))).any():
            i = end
            continue
        total = overlap + holds[path[depth:]].sum(axis=0, dtype=np.int64)
        found += [(int(q), order[i]) for q in np.flatnonzero(total >= need(int(size[i])))]
        i += 1
    return found
