"""Plain versions of the operators, one text or pair at a time."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def least_by_links(nodes, sets, part, whole):
    """Least node that links reach, for every node."""
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            both = len(sets[a] & sets[b])
            if both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def word_sets(rows):
    sets = {}
    for doc, text in rows:
        words = WORD.findall(fold(text or ""))
        sets[doc] = ({tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))}
                     if words else set())
    return sets


def ngram_components(rows):
    sets = word_sets(rows)
    return {d: (len(sets[d]), c) for d, c in
            least_by_links(sorted(sets), sets, 75, 100).items()}


def dedup_lines(rows, part=80, whole=100):
    """Texts with one line of each component of similar lines."""
    seen = []
    for doc, text in sorted(rows):
        for number, line in enumerate((text or "").split("\n")):
            form = " ".join(line.lower().split())
            if form:
                seen.append((doc, number, form))
    forms = sorted({f for *_, f in seen})
    sets = {f: {f[i:i + 9] for i in range(max(1, len(f) - 8))} for f in forms}
    component = least_by_links(forms, sets, part, whole)
    first, gone = {}, set()
    for doc, number, form in seen:
        if first.setdefault(component[form], (doc, number)) != (doc, number):
            gone.add((doc, number))
    return {doc: None if text is None else "\n".join(
        line for number, line in enumerate(text.split("\n")) if (doc, number) not in gone)
        for doc, text in rows}


def best_fit(sizes, length):
    """Number of sequences by best-fit decreasing, a piece at a time."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= size
        else:
            rooms.append(length - size)
    return len(rooms)


def periodic_runs(words):
    """Every run by its definition: each period tried at each place, least period kept."""
    found, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                part = words[i: j + q]
                least = next(p for p in range(1, q + 1)
                             if all(x == y for x, y in zip(part, part[p:])))
                if least == q:
                    found.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))
