"""Ordered lists of people under a batch of edits: assign, unassign, move.

A person's place in a list is a number, and order is the order of numbers. A move takes a number
between those of its new neighbours, so it touches one person however long the list is; when no
number is left between two, all are dealt anew with gaps between. Who stands last of a department
is kept in a heap per department. An edit so costs the logarithm of the list's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distance of neighbours when places are dealt.
GAP = 1 << 128

_ROW = ("list_id, cast(null as long) as seq, ord, person_id, dept_ids, cast(null as string) as op, "
        "cast(null as string) as from_dept, cast(null as string) as to_dept, "
        "cast(null as long) as before_id")
_EDIT = ("list_id, seq, cast(null as long) as ord, person_id, cast(null as array<string>) as dept_ids, "
         "op, from_dept, to_dept, before_id")


class People:
    """One list while it is edited."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.depts: dict[int, list[str]] = {}
        self.after: dict[int | None, int | None] = {None: None}
        self.before: dict[int | None, int | None] = {None: None}
        self.last: dict[str | None, list[tuple[int, int]]] = {}

    # None is the border: it stands before the first and after the last
    def _link(self, person: int, follower: int | None) -> None:
        ahead = self.before[follower]
        self.after[ahead], self.before[person] = person, ahead
        self.after[person], self.before[follower] = follower, person

    def _unlink(self, person: int) -> None:
        ahead, follower = self.before.pop(person), self.after.pop(person)
        self.after[ahead], self.before[follower] = follower, ahead

    def in_order(self) -> Iterator[int]:
        person = self.after[None]
        while person is not None:
            yield person
            person = self.after[person]

    def _set_place(self, person: int) -> None:
        ahead, follower = self.before[person], self.after[person]
        low = self.place[ahead] if ahead is not None else None
        high = self.place[follower] if follower is not None else None
        if low is None or high is None:
            free = (0 if high is None else high - GAP) if low is None else low + GAP
        elif high - low > 1:
            free = (low + high) // 2
        else:
            self._deal()
            return
        self.place[person] = free
        self._offer(person)

    def _deal(self) -> None:
        self.place = {p: i * GAP for i, p in enumerate(self.in_order())}
        self.last = {}
        for p, place in self.place.items():
            for d in self.depts[p] or [None]:
                self.last.setdefault(d, []).append((-place, p))
        for heap in self.last.values():
            heapify(heap)

    def _offer(self, person: int) -> None:
        for d in self.depts[person] or [None]:
            heappush(self.last.setdefault(d, []), (-self.place[person], person))

    def _last_of(self, dept: str | None) -> int | None:
        heap = self.last.get(dept, [])
        while heap:
            place, p = heap[0]
            here = self.depts.get(p)
            if here is not None and self.place.get(p) == -place and (
                    dept in here if dept is not None else not here):
                return p
            heappop(heap)  # moved or left since
        return None

    def add(self, person: int, depts: list[str]) -> None:
        self.depts[person] = depts
        self._link(person, None)
        self._set_place(person)

    def edit(self, op: str, person: int, from_dept: str | None, to_dept: str | None,
             before: int | None) -> None:
        """Edits of people who are not in the list do nothing."""
        if person not in self.depts:
            return
        depts = self.depts[person]
        if op == "assign":
            if to_dept is not None and to_dept not in depts:
                self.depts[person] = [*depts, to_dept]
                self._offer(person)
        elif op == "unassign":
            self.depts[person] = [d for d in depts if d != from_dept]
            self._offer(person)
        elif op == "move":
            self._unlink(person)
            del self.place[person]
            if before is not None:
                follower = before if before in self.place else None
            else:
                last = self._last_of(to_dept)
                follower = self.after[last] if last is not None else None
            depts = [d for d in depts if d != from_dept]
            self.depts[person] = depts + (
                [to_dept] if to_dept is not None and to_dept not in depts else [])
            self._link(person, follower)
            self._set_place(person)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists one after the other: their people, then their edits, as the rows come."""
    def result(name: int, people: People) -> pa.RecordBatch:
        order = list(people.in_order())
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(order), pa.int64()), pa.array(range(len(order)), pa.int64()),
             pa.array(order, pa.int64()),
             pa.array([people.depts[p] for p in order], pa.list_(pa.string()))],
            names=["list_id", "pos", "person_id", "dept_ids"])

    current, people = None, People()
    for batch in batches:
        for row in batch.to_pylist():
            if row["list_id"] != current:
                if people.depts:
                    yield result(current, people)
                current, people = row["list_id"], People()
            if row["op"] is None:
                people.add(row["person_id"], row["dept_ids"] or [])
            else:
                people.edit(row["op"], row["person_id"], row["from_dept"], row["to_dept"],
                            row["before_id"])
    if people.depts:
        yield result(current, people)


def replayed(people: DataFrame, edits: DataFrame) -> DataFrame:
    """(list_id, pos, person_id, dept_ids): every list after all its edits, in order of ``seq``.

    ``people`` has ``list_id, ord, person_id, dept_ids``; ``edits`` has ``list_id, seq, op,
    person_id, from_dept, to_dept, before_id``. ``assign`` adds ``to_dept``, ``unassign`` takes
    ``from_dept`` away. ``move`` does both and sets the person before ``before_id`` (at the end if
    that one is not in the list), or without it behind the last of ``to_dept`` (of those without
    any department, if that is null; at the end if there is none).

    Every edit depends on the order that the one before it left, so a list is replayed by one task.
    It holds the list alone: edits stream through, sorted, and are not gathered.
    """
    rows = people.selectExpr(*_columns(_ROW)).unionByName(edits.selectExpr(*_columns(_EDIT)))
    typed = rows.select(F.col("list_id").cast("long"), F.col("seq").cast("long"),
                        F.col("ord").cast("long"), F.col("person_id").cast("long"), "dept_ids",
                        "op", "from_dept", "to_dept", F.col("before_id").cast("long"))
    return typed.repartition("list_id").sortWithinPartitions(
        "list_id", F.asc_nulls_first("seq"), "ord").mapInArrow(
        _replay, "list_id long, pos long, person_id long, dept_ids array<string>")


def _columns(listed: str) -> list[str]:
    return [c.strip() for c in listed.split(", ")]
