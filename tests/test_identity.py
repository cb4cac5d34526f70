"""Student resolution against a row-by-row replay."""

import random

import pytest

from gradeloom.operators import identity
from gradeloom.operators.identity import judge_students, resolve_students


def safe(name):
    kept = "".join(c for c in name if c.isalnum() or c in " _-").strip()
    return (kept or "Student").replace(" ", "_")


def replay(students, rows):
    """Rows of one workbook in order against ``students``, a list of (id, name, roll) that grows."""
    known = students
    before = len(known)
    collisions = 0
    verdicts = []
    for roll, name in rows:
        with_roll = [s for s in known if roll and s[2] == roll]
        with_name = [s for s in known if name and s[1] == name]
        r = with_roll[0] if len(with_roll) == 1 else None
        n = with_name[0] if len(with_name) == 1 else None
        if len(with_roll) > 1:
            verdicts.append((None, False, f"roll number '{roll}' matches multiple students"))
        elif len(with_name) > 1:
            verdicts.append((None, False, f"name '{name}' matches multiple students"))
        elif r and n and r[0] != n[0]:
            verdicts.append((None, False, f"roll '{roll}' resolves to '{r[1]}' but name '{name}' resolves to '{n[1]}'"))
        elif r and name and r[1] != name:
            verdicts.append((None, False, f"roll '{roll}' belongs to '{r[1]}', not '{name}'"))
        elif n and roll and n[2] != roll:
            verdicts.append((None, False, f"name '{name}' has roll '{n[2]}', not '{roll}'"))
        elif r or n:
            verdicts.append(((r or n)[0], False, None))
        else:
            base = "imp_" + safe(roll or name)
            new_id = base
            while any(s[0] == new_id for s in known):
                collisions += 1
                new_id = f"{base}_{collisions}"
            known.append((new_id, name or roll, roll))
            verdicts.append((new_id, True, None))
    return verdicts, known[before:]


def check(spark, cases):
    """``cases``: {(institution, workbook): rows} with students per institution."""
    students, books = cases
    student = spark.createDataFrame(
        [(i, n, *s) for i, known in students.items() for n, s in enumerate(known)],
        "institution_id string, seq bigint, id string, name string, roll_no string",
    )
    rows = spark.createDataFrame(
        [(i, w, n, *row) for (i, w), content in books.items() for n, row in enumerate(content)],
        "institution_id string, workbook string, ord bigint, roll string, name string",
    )
    verdict, made = resolve_students(rows, student)
    got = {(r.institution_id, r.workbook, r.ord): (r.student_id, r.is_new, r.error) for r in verdict.collect()}
    new = {}
    for r in sorted(made.collect(), key=lambda r: r.ord):
        new.setdefault((r.institution_id, r.workbook), []).append((r.student_id, r.name, r.roll_no))
    known = {i: [tuple(s) for s in rows] for i, rows in students.items()}
    for (i, w), content in sorted(books.items()):
        verdicts, created = replay(known[i], content)
        assert [got[(i, w, n)] for n in range(len(content))] == verdicts, (students[i], content)
        assert new.get((i, w), []) == created


def test_conflicts_and_new_students(spark):
    stored = [("s1", "Aarav", "6A01"), ("s2", "Bhavna", "6A02"), ("s3", "Twin", "1"), ("s4", "Twin", "2"), ("s5", "X", "2"), ("imp_9", "Y", "77")]
    rows = [
        ("6A01", "Aarav"), ("6A01", "Bhavna"), ("6A01", ""), ("", "Bhavna"), ("6A01", "Nobody"), ("zz", "Aarav"),
        ("", "Twin"), ("2", ""), ("7A01", "New"), ("7A01", "New"), ("7A01", "Other"), ("q", "New"),
        ("r1", ""), ("", "r1"), ("r2", "r1"), ("", "solo"), ("solo", ""), ("", "solo"), ("9", "Nine"), ("9.", "Nine2"),
    ]
    check(spark, ({"i": stored}, {("i", "w"): rows}))


def test_chain_and_hot_key(spark):
    chain = [(f"r{k // 2}", f"n{(k + 1) // 2}") for k in range(9)]
    hot = [("r", f"n{k}") for k in range(40)] + [(f"x{k}", "n1") for k in range(5)]
    check(spark, ({"a": [], "b": [("s", "n3", "q")]}, {("a", "w1"): chain, ("a", "w2"): hot, ("b", "w1"): chain + hot}))


def test_id_collisions_are_numbered_in_order(spark):
    stored = [("imp_a_1", "p", "q"), ("imp_b", "u", "v"), ("imp_a_3", "k", "l")]
    rows = [("a", ""), ("a.", ""), ("a..", ""), ("b", ""), ("b_2", ""), ("b!", ""), ("a_2", ""), ("a!", ""), ("b_4", "")]
    check(spark, ({"i": stored}, {("i", "w"): rows, ("i", "w2"): list(reversed(rows))}))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_books(spark, seed):
    rng = random.Random(seed)
    keys = ["", "a", "b", "c", "d", "a.", "b_1", "e"]
    students = {}
    books = {}
    for i in range(6):
        students[f"i{i}"] = [
            (f"s{n}" if rng.random() < 0.6 else f"imp_{rng.choice('abc')}{n or ''}", rng.choice(keys), rng.choice(keys))
            for n in range(rng.randint(0, 4))
        ]
        ids = [s[0] for s in students[f"i{i}"]]
        students[f"i{i}"] = [s for n, s in enumerate(students[f"i{i}"]) if s[0] not in ids[:n]]
        for w in range(rng.choice([1, 3, 8])):
            rows = [(rng.choice(keys), rng.choice(keys)) for _ in range(rng.randint(1, 14))]
            books[(f"i{i}", f"w{w}")] = [r for r in rows if r != ("", "")]
    books = {k: v for k, v in books.items() if v}
    check(spark, (students, books))


def test_people_of_several_workbooks_stay_apart(spark):
    books = {
        ("i", "w1"): [("A.1", "Bo"), ("R1", "Ann")],
        ("i", "w2"): [("A1", "Cy"), ("R2", "Ann")],
        ("i", "w3"): [("", "Ann"), ("A1", "Cy")],
        ("j", "w1"): [("A1", "Cy")],
    }
    check(spark, ({"i": [], "j": []}, books))


def test_a_long_run_of_taken_numbers(spark):
    stored = [(f"imp_Student_{n}", f"n{n}", f"r{n}") for n in range(1, 10_001)] + [("imp_Student", "n0", "r0")]
    check(spark, ({"i": stored}, {("i", "w"): [("", "Student"), ("Student.", ""), ("", "Student!")]}))


def fast_replay(taken, rows):
    """As ``replay`` for rows of one workbook that clash with no stored student, in linear time."""
    rolls, names, ids, count, out = set(), set(), set(taken), 0, []
    for roll, name in rows:
        if (roll and roll in rolls) or (name and name in names):
            continue
        base = new = "imp_" + safe(roll or name)
        while new in ids:
            count += 1
            new = f"{base}_{count}"
        ids.add(new)
        rolls.add(roll)
        names.add(name or roll)
        out.append((new, name or roll, roll))
    return out


def made_by(spark, stored, rows):
    student = spark.createDataFrame([("i", n, s, f"stored {n}", f"stored {n}") for n, s in enumerate(stored)], "institution_id string, seq bigint, id string, name string, roll_no string")
    frame = spark.createDataFrame([("i", "w", n, *row) for n, row in enumerate(rows)], "institution_id string, workbook string, ord bigint, roll string, name string")
    _, made = resolve_students(frame, student)
    return [(r.student_id, r.name, r.roll_no) for r in made.orderBy("ord").collect()]


def counting(monkeypatch, name):
    calls, inner = [], getattr(identity, name)
    monkeypatch.setattr(identity, name, lambda *a, **k: (calls.append(1), inner(*a, **k))[1])
    return calls


def test_a_chain_of_ten_thousand_rows_in_log_rounds(spark, monkeypatch):
    rows = [(f"r{k // 2}", f"n{(k + 1) // 2}") for k in range(10_000)]
    rounds, steps = counting(monkeypatch, "_firsts"), counting(monkeypatch, "settle")
    assert made_by(spark, [], rows) == fast_replay([], rows)
    assert len(rounds) <= 2 and len(steps) <= 40  # written tables, those of ids and verdicts among them


def test_chains_in_any_order_and_without_names(spark):
    rng = random.Random(9)
    rows = [(f"r{k // 2}", f"n{(k + 1) // 2}") for k in range(400)]
    rows += [(f"q{k}", "") for k in range(50)] + [(f"p{k}", f"q{k}") for k in range(50)] + [("", f"q{k}") for k in range(0, 50, 3)]
    rng.shuffle(rows)
    assert made_by(spark, [], rows) == fast_replay([], rows)


def test_dense_conflicts(spark):
    rng = random.Random(10)
    rows = [(f"r{rng.randrange(40)}" if rng.random() < 0.9 else "", f"n{rng.randrange(40)}") for _ in range(700)]
    assert made_by(spark, [], rows) == fast_replay([], rows)


def test_ten_thousand_rows_over_as_many_gaps(spark, monkeypatch):
    stored = ["imp_Student"] + [f"imp_Student_{n}" for n in range(1, 20_001, 2)]
    rows = [("Student" + "." * k, "") for k in range(10_000)]
    rounds, steps = counting(monkeypatch, "_named"), counting(monkeypatch, "_after_runs")
    assert made_by(spark, stored, rows) == fast_replay(stored, rows)
    assert len(rounds) == 1 and len(steps) <= 2 * 5


def test_gaps_of_several_names_in_one_count(spark):
    rng = random.Random(11)
    stored = [f"imp_{b}" for b in "ABC"] + [f"imp_{rng.choice('ABC')}_{rng.randrange(1, 40)}" for _ in range(40)]
    rows = [(rng.choice("ABC") + "." * k, "") for k in range(24)] + [("A_9", ""), ("B_7", ""), ("C_2", "")]
    rng.shuffle(rows)
    stored = list(dict.fromkeys(stored))
    assert made_by(spark, stored, rows) == fast_replay(stored, rows)


def test_verdicts_are_added_to_the_rows(spark):
    """Holders are looked up once for each roll and name; a student made by a row is known to the later ones only."""
    student = spark.createDataFrame([("i", 0, "s1", "Ines", "R1")], "institution_id string, seq bigint, id string, name string, roll_no string")
    rows = [("i", "w", n, roll, name, f"more{n}") for n, (roll, name) in enumerate([("R2", "Tom"), ("R1", "Ines"), ("R2", "Tom"), ("", "Tom"), ("R1", "Tom"), ("R2", "Tom")])]
    frame = spark.createDataFrame(rows, "institution_id string, workbook string, ord bigint, roll string, name string, more string")
    judged, made = judge_students(frame, student)
    plain, made_too = resolve_students(frame, student)
    shared = ["institution_id", "workbook", "ord", "student_id", "is_new", "error"]
    assert judged.columns == [*frame.columns, "student_id", "is_new", "error"] and plain.columns == shared
    assert sorted(map(str, judged.select(*shared).collect())) == sorted(map(str, plain.collect()))
    got = {r.more: (r.student_id, r.is_new) for r in judged.collect()}
    new = "imp_R2"
    want = {"more0": (new, True), "more1": ("s1", False), "more4": (None, False)}
    assert got == {**want, **dict.fromkeys(("more2", "more3", "more5"), (new, False))}
    assert [tuple(r) for r in made.collect()] == [tuple(r) for r in made_too.collect()] == [("i", "w", 0, new, "Tom", "R2")]
