import pytest

from gradeloom.operators import semester


@pytest.fixture(scope="module")
def marks(spark):
    rows = [("Nadia", "1", n, s, float(m)) for n, (s, m) in enumerate([("Botany", 77), ("Zoology", 93), ("Drama", 38), ("Greek", 54)])]
    rows += [("Tie", "1", n, s, float(m)) for n, (s, m) in enumerate([("Choir", 71), ("Dance", 71), ("Chess", 58)])]
    rows += [("Four", "2", n, f"S{n}", float(m)) for n, m in enumerate([91, 96, 64, 51])]
    rows += [("Zero", "1", 0, "Art", 0.0)]
    return spark.createDataFrame(rows, "student_name string, semester string, seq bigint, subject string, mark double")


def test_totals_and_grades(marks):
    row = semester.semester_totals(marks).where("student_name = 'Nadia'").first()
    assert (row.total_marks, row.maximum_marks, row.overall_percentage, row.number_of_subjects) == (262.0, 400, 65.5, 4)
    graded = semester.graded_subjects(marks).where("student_name = 'Nadia'").orderBy("seq").collect()
    assert [r.grade for r in graded] == ["B+", "A+", "F", "C"]
    table = semester.subject_table(semester.graded_subjects(marks)).where("student_name = 'Nadia'").orderBy("number").collect()
    assert [(r.number, r.subject) for r in table] == [(1, "Botany"), (2, "Zoology"), (3, "Drama"), (4, "Greek")]


def test_highest_and_histogram(marks):
    best = {r.student_name: r.highest_subject for r in semester.highest_subjects(marks).collect()}
    assert best["Tie"] == "Choir" and best["Nadia"] == "Zoology"
    counts = semester.grade_counts(semester.graded_subjects(marks)).where("student_name = 'Four'").collect()
    assert [(r.grade, r.subjects) for r in sorted(counts, key=lambda r: (-r.subjects, r.first_seq))] == [("A+", 2), ("B", 1), ("C", 1)]


def test_summary_text(marks):
    text = semester.summary_text(marks).where("student_name = 'Nadia'").first().summary
    assert text == (
        "STUDENT: Nadia\n\nSEMESTER: 1\n\nTOTAL: 262/400\n\nOVERALL: 65.50%\n\nSUBJECTS: 4\n\n"
        "Performance Summary\n-------------------\nHighest: Zoology\nScore: 93%\n\n"
        "B+: 1 subject(s)\nA+: 1 subject(s)\nF: 1 subject(s)\nC: 1 subject(s)\n"
    )


def test_charts(marks):
    shares = {(r.student_name, r.subject): (r.share, r.label) for r in semester.pie_shares(marks).collect()}
    assert shares["Tie", "Chess"] == (58 / 200, "29.0%") and shares["Zero", "Art"] == (None, None)
    points = semester.radar_series(marks).where("student_name = 'Tie'").orderBy("point").collect()
    assert [(r.point, r.subject) for r in points] == [(0, "Choir"), (1, "Dance"), (2, "Chess"), (3, "Choir")]
    assert points[0].angle == points[3].angle == 0.0 and points[1].angle == pytest.approx(2.0943951)


def test_typed_marks(spark):
    typed = spark.createDataFrame([("0",), (" 100 ",), ("100.5",), ("-1",), ("nan",), ("x",)], "answer string")
    good, bad = semester.check_marks(typed)
    assert sorted(r.mark for r in good.collect()) == [0.0, 100.0]
    assert {r.answer: r.message.split()[-1] for r in bad.collect()} == {"100.5": "100.", "-1": "100.", "nan": "100.", "x": "number."}
