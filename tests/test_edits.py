import json
import random

import pytest
from pyspark.sql import functions as F

from workweave.operators import merge as M
from workweave.operators import sequences as S
from workweave.operators import usage as U
from workweave.sources import plan_document as P

ROW = "id int, v string, ord int"


def _frame(spark, rows):
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(rows.items())], ROW)


def _merged(spark, b, m, t):
    got = M.merge_rows(*(_frame(spark, x) for x in (b, m, t)), ["id"], "ord")
    return {r.id: r.v for r in got.orderBy("part", "ord").collect()}


def test_every_merge_case(spark):
    b = {1: "x", 2: "x", 3: "x", 4: "x", 5: "x", 6: "x", 7: "x"}
    m = {9: "new", 2: "mine", 3: "x", 4: "x", 5: "mine", 7: "x", 8: "both-m"}
    t = {1: "x", 2: "theirs", 3: "theirs", 5: "x", 6: "changed", 7: "x", 8: "both-t", 10: "their new"}
    # 1, 6 deleted here; 4 deleted there; mine first and in its order
    got = _merged(spark, b, m, t)
    assert got == {9: "new", 2: "mine", 3: "theirs", 5: "mine", 7: "x", 8: "both-m", 10: "their new"}
    assert list(got) == [9, 2, 3, 5, 7, 8, 10]
    kinds = {r.id: r.kind for r in M.true_conflicts(
        *(_frame(spark, x).drop("ord") for x in (b, m, t)), ["id"]).collect()}
    assert kinds == {2: "changed twice", 6: "deleted here", 8: "added twice"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unchanged_side_yields(spark, seed):
    rnd = random.Random(seed)

    def version():
        return {i: rnd.choice("abc") for i in rnd.sample(range(30), 20)}

    base, other = version(), version()
    assert _merged(spark, base, base, other) == other
    assert _merged(spark, base, other, base) == other


def test_settings_and_years(spark):
    kv = "key string, value string"
    b, m, t = (spark.createDataFrame(list(d.items()), kv) for d in (
        {"a": "1", "b": "1", "c": "1"}, {"a": "2", "b": "1"}, {"a": "3", "b": "4", "c": "1", "d": "5"}))
    got = {r.key: r.value for r in M.merge_settings(b, m, t, "key").collect()}
    assert got == {"a": "2", "b": "4", "d": "5"}
    y = "year int, id int, v string"
    base = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "x"), (3, 2, "x")], y)
    mine = spark.createDataFrame([(2, 1, "x"), (3, 1, "m"), (3, 2, "x"), (5, 1, "m")], y)
    theirs = spark.createDataFrame([(1, 1, "t"), (3, 1, "x"), (3, 2, "t"), (6, 1, "t")], y)
    held = [v.select("year").distinct() for v in (base, mine, theirs)]
    rows = {(r.year, r.id): r.v for r in M.merge_years(base, mine, theirs, "year", ["id"], held).collect()}
    assert rows == {(3, 1): "m", (3, 2): "t", (5, 1): "m", (6, 1): "t"}


def test_first_meeting(spark):
    a, b = _frame(spark, {1: "a"}), _frame(spark, {1: "b", 2: "b"})
    none = spark.createDataFrame([], ROW)
    values = lambda df: {r.id: r.v for r in df.collect()}
    assert values(M.first_meeting(None, a, none, ["id"], "ord")) == {1: "a"}
    assert values(M.first_meeting(None, none, b, ["id"], "ord")) == {1: "b", 2: "b"}
    assert values(M.first_meeting(None, a, b, ["id"], "ord")) == {1: "b", 2: "b"}
    assert values(M.first_meeting(b, a, b, ["id"], "ord")) == {1: "a"}


def test_canonical_form_ignores_map_order(spark):
    df = spark.sql("SELECT 1 AS k, map('b', 2, 'a', 1) AS m UNION ALL SELECT 1, map('a', 1, 'b', 2)")
    assert df.select(M.canonical(df)).distinct().count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_change_set_matches_sequential_application(spark, seed):
    rnd = random.Random(seed)
    table = {i: ("n", i) for i in range(10)}
    changes = []
    for seq in range(80):
        op = rnd.choice(["add", "update", "update", "delete"])
        key = rnd.randrange(14)
        changes.append((key, seq, op, f"s{seq}" if op == "add" or rnd.random() < 0.5 else None,
                        seq if op == "add" or rnd.random() < 0.5 else None))
    want = dict(table)
    for key, _seq, op, a, b in changes:
        if op == "add":
            want[key] = (a, b)
        elif op == "delete":
            want.pop(key, None)
        elif key in want:
            want[key] = (a if a is not None else want[key][0], b if b is not None else want[key][1])
    rows = spark.createDataFrame([(k, *v) for k, v in table.items()], "k int, a string, b int")
    batch = spark.createDataFrame(changes, "k int, seq int, op string, a string, b int")
    got = {r.k: (r.a, r.b) for r in M.apply_changes(rows, batch, "k").collect()}
    assert got == want


def test_block_scans_match_plain_windows(spark):
    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(4), i, rnd.randrange(-5, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, seq int, x int")
    got = S.running_sums(df, ["k"], ["seq"], S.block_of("seq", 16), {"s": F.col("x")}).collect()
    before = S.running_sums(df, ["k"], ["seq"], S.block_of("seq", 16), {"s": F.col("x")}, False).collect()
    prev = S.previous(df, [], "seq", S.block_of("seq", 16), ["x"]).collect()
    total = {}
    want, want_before = {}, {}
    for k, seq, x in rows:
        want_before[seq] = total.get(k, 0)
        total[k] = total.get(k, 0) + x
        want[seq] = total[k]
    assert {r.seq: r.s for r in got} == want
    assert {r.seq: r.s for r in before} == want_before
    assert {r.seq: (r.prev.x if r.prev else None) for r in prev} == {
        i: (rows[i - 1][2] if i else None) for i in range(300)}


def test_budget_stops_after_the_crossing_call(spark):
    calls = spark.createDataFrame([("r", i, 0.3) for i in range(8)], "run_id string, seq int, cost double")
    allowed = lambda **kw: [r.allowed for r in U.admitted(calls, **kw).orderBy("seq").collect()]
    assert sum(allowed(max_usd=1.0, max_calls=60)) == 4
    assert sum(allowed(max_usd=0.0, max_calls=3)) == 3
    assert sum(allowed(max_usd=0.0, max_calls=0)) == 8


def test_exactly_half_of_a_budget_is_not_more_than_half(spark):
    spent = [("half", 0.001), ("half", 0.004), ("edge", 0.0085), ("more", 0.004999999), ("over", 0.02)]
    spent += [("tenths", 0.0005)] * 17
    calls = spark.createDataFrame([(r, 1, 1, c) for r, c in spent],
                                  "run_id string, input_tokens int, output_tokens int, cost double")
    got = U.budget_left(U.totals(calls, ["run_id"]), max_usd=0.01, max_calls=6).collect()
    assert {r.run_id: (r.level, r.usd_left) for r in got} == {
        "half": ("warn", 0.005), "edge": ("error", 0.0015), "tenths": ("error", 0.0015),
        "more": ("ok", 0.005000001), "over": ("error", 0.0)}
    free = U.budget_left(U.totals(calls, ["run_id"]), max_usd=0, max_calls=6).collect()
    assert {r.level for r in free} == {"error"}


def test_cache_lookup_matches_brute_force(spark):
    from datetime import datetime, timedelta

    rnd = random.Random(9)
    t0 = datetime(2024, 1, 1)
    asked = [(rnd.choice("ab"), t0 + timedelta(hours=rnd.randrange(900)), i) for i in range(80)]
    stored = [(rnd.choice("ab"), t0 + timedelta(hours=rnd.randrange(900), minutes=1), f"r{i}") for i in range(6)]
    q = spark.createDataFrame(asked, "key string, asked_at timestamp_ntz, id int")
    s = spark.createDataFrame(stored, "key string, created_at timestamp_ntz, response string")
    got = {r.id: r.response for r in U.cache_lookup(q, s).collect()}
    for key, at, i in asked:
        live = [(c, r) for k, c, r in stored if k == key and at - timedelta(hours=168) < c <= at]
        assert got[i] == (max(live)[1] if live else None)
    assert any(got.values()) and not all(got.values())


def test_usable_answers(spark):
    texts = ['{"a": 1}', 'Text\n```json\n[1, 2]\n```', 'Gern: {"a": [1]} fertig', "kein JSON",
             "null", "", '{"a": [1, 2', "x [1] y {", '```\n{"b": 2}```', "5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(U.usable_json(F.col("t"))).collect()]
    assert got == [True, True, True, False, False, False, False, True, True, True]


def test_plan_files_are_read_and_cleaned(spark, tmp_path):
    plan = {"v": 1, "extra": 1, "years": {"2024": {
        "departments": [{"id": "A", "parentId": "A"}, {"id": "B", "name": "x", "parentId": "Q", "maxAbsent": 4}],
        "people": [{"id": "P", "deptId": "B"}, {"deptIds": ["B", "Z", "A", "B"], "entitlement": 25}],
        "absences": [{"id": "1", "personId": "P", "type": "?", "status": "beantragt", "start": "2024-01-02",
                      "end": "2024-01-03"}, {"id": "2", "personId": "P", "start": "2024-01-02"}],
        "closures": [{"start": "2024-12-24", "end": "2024-12-31"}]}}}
    (tmp_path / "p1.json").write_text(json.dumps(plan, indent=1))
    years = P.years(P.read_plans(spark, str(tmp_path)))
    d = {r.dept_id: (r.parent_id, r.name, r.max_absent) for r in P.clean_departments(years).collect()}
    assert d == {"A": (None, "Abteilung", 2), "B": (None, "x", 4)}
    people = [(r.person_id, r.name, r.dept_ids, r.entitlement) for r in P.clean_people(years).orderBy("ord").collect()]
    assert people == [("P", "Unbenannt", ["B"], 30.0), ("p1", "Unbenannt", ["B", "A"], 25.0)]
    absences = P.clean_absences(years).collect()
    assert [(r.absence_id, r.type, r.status) for r in absences] == [("1", "urlaub", "beantragt")]
    assert P.clean_closures(years).first().name == "Betriebsruhe"


def test_two_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCKS_OF_BLOCKS", 3)
    rnd = random.Random(8)
    rows = [(rnd.choice("aab"), i, rnd.randrange(9)) for i in rnd.sample(range(2000), 200)]
    df = spark.createDataFrame(rows, "k string, seq int, x int")
    got = S.running_sums(df, ["k"], ["seq"], S.block_of("seq", 8), {"s": F.col("x")}, levels=2)
    total, want = {}, {}
    for k, seq, x in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + x
        want[seq] = total[k]
    assert {r.seq: r.s for r in got.collect()} == want
    prev = S.previous(df, [], "seq", S.block_of("seq", 8), ["x"]).collect()
    ordered = sorted(r[1] for r in rows)
    before = dict(zip(ordered, [None, *ordered]))
    assert {r.seq: (r.prev.seq if r.prev else None) for r in prev} == before


def test_a_year_without_rows_is_not_a_deleted_year(spark):
    from workweave.operators import merge as M
    rows = lambda *r: spark.createDataFrame(list(r), "year int, id int, v string")
    held = spark.createDataFrame([(2024,)], "year int")
    base, mine = rows((2024, 1, "a")), rows()
    theirs = rows((2024, 1, "a"), (2024, 2, "b"))
    merged = M.merge_years(base, mine, theirs, "year", ["id"], years=(held, held, held))
    assert [(r.id, r.v) for r in merged.collect()] == [(2, "b")]
    gone = M.merge_years(base, mine, theirs, "year", ["id"], years=(held, held.limit(0), held))
    assert gone.count() == 0


def test_flags_of_years(spark):
    flags = lambda **f: spark.createDataFrame(
        [(int(y[1:]), v) for y, v in f.items()], "year int, locked boolean")
    rows = lambda *r: spark.createDataFrame(list(r), "year int, id int, v string")
    none = rows()
    got = M.year_verdicts(rows((6, 1, "a")), rows((6, 1, "a"), (8, 1, "n")), none, "year", ["id"], (
        flags(y1=False, y2=True, y3=False, y4=True, y5=False, y6=False),
        flags(y1=True, y2=True, y3=False, y5=True, y6=False, y7=True),
        flags(y1=False, y2=False, y4=False, y9=True)))
    assert {r.year: (r.verdict, r.locked) for r in got.collect()} == {
        1: ("rows", True), 2: ("rows", False), 3: ("drop", None), 4: ("drop", False),
        5: ("mine", True), 6: ("drop", None), 7: ("mine", True), 8: ("mine", None), 9: ("theirs", True)}


def _edited(people, edits):
    """The list after every edit, one after the other."""
    people = [(p, list(d)) for p, d in people]
    for _, op, p, f, t, before in edits:
        at = next((i for i, x in enumerate(people) if x[0] == p), None)
        if at is None:
            continue
        depts = people[at][1]
        if op == "assign":
            if t is not None and t not in depts:
                depts.append(t)
        elif op == "unassign":
            people[at] = (p, [d for d in depts if d != f])
        else:
            del people[at]
            depts = [d for d in depts if d != f]
            depts += [t] if t is not None and t not in depts else []
            if before is not None:
                spot = next((i for i, x in enumerate(people) if x[0] == before), len(people))
            else:
                spot = max((i + 1 for i, x in enumerate(people) if (t in x[1] if t is not None else not x[1])),
                           default=len(people))
            people.insert(spot, (p, depts))
    return people


PEOPLE = "list_id int, ord int, person_id int, dept_ids array<string>"
EDITS = "list_id int, seq int, op string, person_id int, from_dept string, to_dept string, before_id int"


@pytest.mark.parametrize("seed", range(4))
def test_ordered_edits_match_a_list(spark, seed, monkeypatch):
    from workweave.operators import ordering as O
    if seed % 2:
        monkeypatch.setattr(O, "GAP", 4)  # places run out and are dealt anew
    rnd = random.Random(seed)
    people, edits, want = [], [], {}
    for l in range(4):
        mine = [(p, rnd.sample("ABC", rnd.randrange(3))) for p in rnd.sample(range(20), 12)] if l else []
        batch = [(s, rnd.choice(["assign", "unassign", "move", "move", "move"]), rnd.randrange(20),
                  rnd.choice(["A", "B", "C", None]), rnd.choice(["A", "B", "C", None]),
                  rnd.choice([None, None, rnd.randrange(22)])) for s in range(120)]
        people += [(l, i, *x) for i, x in enumerate(mine)]
        edits += [(l, *e) for e in batch]
        want |= {(l, i): (p, d) for i, (p, d) in enumerate(_edited(mine, batch))}
    people.append((9, 0, 1, None))  # a list without edits, a person without departments
    want[9, 0] = (1, [])
    rnd.shuffle(edits)
    got = O.replayed(spark.createDataFrame(people, PEOPLE).repartition(3), spark.createDataFrame(edits, EDITS))
    assert {(r.list_id, r.pos): (r.person_id, r.dept_ids) for r in got.collect()} == want


def _walked(depts):
    """Parents after a walk up from each department, in stored order."""
    rows = [{"id": d.get("id") or f"d{i}", "up": d.get("parentId") or None} for i, d in enumerate(depts)]
    known = {r["id"] for r in rows}
    for r in rows:
        if r["up"] not in known:
            r["up"] = None
    for r in rows:
        seen, at = {r["id"]}, r
        while at["up"]:
            if at["up"] in seen:
                r["up"] = None
                break
            seen.add(at["up"])
            at = next(x for x in rows if x["id"] == at["up"])
    return [(r["id"], r["up"]) for r in rows]


def test_department_trees_are_repaired_in_order(spark):
    import json
    rnd = random.Random(12)
    docs = []
    for k in range(150):
        n = rnd.randrange(9)
        names = [rnd.choice("ABCDEF") if k % 3 == 0 else f"N{i}" for i in range(n)]
        docs.append([{"id": None if rnd.random() < 0.1 else names[i],
                      "parentId": rnd.choice([None, "", "gone", *names, f"d{i}"])} for i in range(n)])
    plans = spark.createDataFrame(
        [(str(k), json.dumps({"years": {"2024": {"departments": d}}})) for k, d in enumerate(docs)],
        "plan_id string, data string")
    got = {}
    for r in P.clean_departments(P.years(P.parse_plans(plans))).orderBy("ord").collect():
        got.setdefault(int(r.plan_id), []).append((r.dept_id, r.parent_id))
    assert got == {k: _walked(d) for k, d in enumerate(docs) if d}
