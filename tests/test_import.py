import copy
import tempfile
from types import SimpleNamespace

import pytest
from helpers import cells_of, config, configs_of, domain_of

from gradeloom.operators import importing, labels, results, sheets
from gradeloom.plans import import_queries
from gradeloom.plans.campus import Campus
from gradeloom.sources.schemas import SCHEMAS
from gradeloom.sources.store import Store

NATIVE = ["Roll No", "Student Name", "Quiz", "Lab", "Essay", "Final"]
LONG = ["Student", "Roll No", "Class", "Subject", "Marks"]
WIDE = ["Student", "Roll No", "Class", "Geography", "Biology"]
ROW1 = ["H-11", "Ines Duarte", 17, 24, 41, 88]
ROW2 = ["H-12", "Tomas Varga", 20, 27, 45, "AB"]
ONE = [("Total", 100, 1.0)]


def with_second_maths(document):
    document["seed"]["offerings"].append({"id": "geo_w", "org_unit_id": "wing_n", "course_id": "geo"})
    return document


# name: (sheets, hint, legacy, change of the configuration)
CASES = {
    "native": ({"geo_n": [NATIVE, ROW1, ROW2], "notes": [["", None], [""]]}, None, False, None),
    "statuses": ({"GEOG": [NATIVE, ["H-11", "Ines Duarte", "E", "A", "", 85]]}, None, False, None),
    "over": ({"Geography": [NATIVE, ROW1, ROW2, ["H-13", "Leila Haddad", 9, 8, 150, 31]]}, None, False, None),
    "hinted": ({"Marks": [NATIVE[:4], ROW1[:4]]}, "geo_n", False, {"excel": {"expect_course_prefix": False}}),
    "unhinted": ({"Marks": [NATIVE[:4], ROW1[:4]]}, None, False, {"excel": {"expect_course_prefix": False}}),
    "badhint": ({"Marks": [NATIVE[:4], ROW1[:4]]}, "none", False, {"excel": {"expect_course_prefix": False}}),
    "otherhint": ({"geo_n": [NATIVE[:4], ROW1[:4]]}, "bio_n", False, None),
    "new": ({"geo_n": [NATIVE[:3], ["K-70", "New Student", 12], ["K-70", "New Student", None]]}, None, False, None),
    "conflict": ({"geo_n": [NATIVE[:3], ["H-11", "Tomas Varga", 12], [None, None, 3]]}, None, False, None),
    "nosheet": ({"no_such": [NATIVE[:3], ["H-11", None, 12]]}, None, False, None),
    "bogus": ({"geo_n": [[*NATIVE[:3], "Bogus", "Worse"], ["H-11", None, 12, 1, 2]]}, None, False, None),
    "dup": ({"geo_n": [["Roll No", "Quiz", " quiz ", "Quiz"], ["H-11", 1, 2, 3]]}, None, False, None),
    "nobody": ({"geo_n": [["Quiz", "Lab"], [1, 2]]}, None, False, None),
    "layout": ({"geo_n": [["Roll No", "Marks"], [1, 2]]}, None, False, None),
    "prefixed": ({"any": [["Roll", "geo_n: Quiz", "BIOL|final", "Remark"], ["H-12", 20, 150, "good"], ["H-13", "x", None, 1]]}, None, False, None),
    "nosuffix": ({"any": [["Roll", "geo_n: Quiz", "BIOL|"], ["H-12", 20, 15]]}, None, False, None),
    "badprefix": ({"any": [["Roll", "art: Quiz", "geo_n:Zed"], ["H-12", 20, 15]]}, None, False, None),
    "folded": ({"geo_n": [["reg no", "  quiz ", "Final"], [" H-11 ", 5.0, 7.5]]}, None, False, None),
    "ambiguous": ({"Geography": [NATIVE, ROW1]}, None, False, with_second_maths),
    "long": ({"x": [LONG, ["Ines Duarte", "H-11", None, "Geography", 80], ["Ines Duarte", "H-11", "2", "BIOL", 70]]}, None, False, ONE),
    "longbad": (
        {"x": [LONG, ["Ines Duarte", "H-11", None, None, 80], ["Ines Duarte", None, "Z", "Biology", 70],
               [None, "H-11", "", "Art", 1], [None, "H-11", "", "Latin", None], [None, "H-11", "", "Latin", "oops"],
               [None, "H-11", "North", "Latin", 5], ["", "", "", "Latin", 5]]},
        None, False, ONE),
    "longmany": ({"x": [LONG, ["Ines Duarte", "H-11", None, "Geography", 80]]}, None, False, None),
    "wide": ({"x": [WIDE, ["Ines Duarte", "H-11", None, 80, 70], ["Leila Haddad", "H-13", "2", None, " "], ["Leila Haddad", "H-13", "2", "", None]]}, None, True, ONE),
    "longtwo": ({"x": [LONG, ["Ines Duarte", "H-11", None, "Geography", 80]]}, None, True, lambda d: with_second_maths({**d, "assessment_schemes": [{"id": "main", "assessments": [{"name": "Total", "max_marks": 100}]}]})),
    "marksonly": ({"x": [["Roll No", "Marks"], ["H-11", 1]]}, None, True, ONE),
    "legacynobody": ({"x": [["Geo"], [1]]}, None, True, ONE),
}


def document(name):
    change = CASES[name][3]
    base = config(name, scheme=change if isinstance(change, list) else None)
    if isinstance(change, dict):
        base.update(change)
    return change(base) if callable(change) else base


@pytest.fixture(scope="module")
def run(spark):
    configs, errors = configs_of(spark, [document(n) for n in CASES])
    assert errors.isEmpty()
    domain = domain_of(spark, configs)
    cells = cells_of(spark, {(n, "wb"): c[0] for n, c in CASES.items()})
    books = spark.createDataFrame(
        [(n, "wb", c[1], c[2]) for n, c in CASES.items()],
        "institution_id string, workbook string, offering_hint string, legacy boolean",
    )
    plan = importing.validate(cells, books, configs.import_settings(), domain)
    marks, errors = {n: [] for n in CASES}, {n: [] for n in CASES}
    for r in sorted(plan.marks.collect(), key=lambda r: (r.ord, r.col_no)):
        marks[r.institution_id].append((r.student_id, r.assessment_id, r.obtained, r.status))
    rendered = importing.render_errors(plan.errors).collect()
    for r in sorted(rendered, key=lambda r: (r.sheet_no, r.row_no, r.col_no)):
        errors[r.institution_id].append(r.text)
    return plan, domain, marks, errors


def test_errors(run):
    _, _, _, errors = run
    assert errors == {
        "native": [], "statuses": [],
        "over": ["Geography row 4 (Essay): mark 150 exceeds maximum 50"],
        "hinted": [],
        "unhinted": ["Marks row 1: --offering is required when excel.expect_course_prefix is false"],
        "badhint": ["Marks row 1: no course offering with id 'none'"],
        "otherhint": ["geo_n row 1: sheet 'geo_n' resolves to offering 'geo_n', not '--offering bio_n'"],
        "new": ["geo_n row 3: student row has no marks"],
        "conflict": [
            "geo_n row 2 (H-11 Tomas Varga): roll 'H-11' resolves to 'Ines Duarte' but name 'Tomas Varga' resolves to 'Tomas Varga'",
            "geo_n row 3: missing student identity",
        ],
        "nosheet": ["no_such row 1: no course offering matches 'no_such'"],
        "bogus": ["geo_n row 1: no assessment named 'Bogus' for offering 'geo_n'"],
        "dup": ["geo_n row 1: invalid header: duplicate header ' quiz '"],
        "nobody": ["geo_n row 1: invalid header: no student identity column (expected 'Roll No'/'Student Name')"],
        "layout": ["geo_n row 1: invalid header: cannot determine legacy column layout"],
        "prefixed": [
            "any row 2 (Final): mark 150 exceeds maximum 100",
            "any row 3 (Quiz): unrecognised mark value 'x'",
        ],
        "nosuffix": ["any row 1: prefixed column 'BIOL|' has no assessment name"],
        "badprefix": ["any row 1: no course offering matches 'art'"],
        "folded": [],
        "ambiguous": ["Geography row 1: 'Geography' is ambiguous across offerings (geo_n, geo_w)"],
        "long": [],
        "longbad": [
            "x row 2 (Subject): missing subject",
            "x row 3 (Biology): no class/org unit named 'Z'",
            "x row 4 (Art): no course matches legacy subject 'Art'",
            "x row 5 (Latin): missing mark",
            "x row 6 (Latin): unrecognised mark value 'oops'",
            "x row 7 (Latin): subject 'Latin' has no offering for the default period",
            "x row 8: missing student identity",
        ],
        "longmany": ["x row 2 (Geography): legacy import needs exactly one assessment for offering 'geo_n' (found 4)"],
        "wide": ["x row 3: student row has no marks", "x row 4: student row has no marks"],
        "longtwo": ["x row 2 (Geography): subject 'Geography' is ambiguous across offerings (geo_n, geo_w)"],
        "marksonly": ["x row 1: legacy long layout needs 'Subject' and 'Marks' columns"],
        "legacynobody": ["x row 1: invalid header: legacy sheet needs a student identity column"],
    }


def test_marks(run):
    _, _, marks, _ = run

    def entered(student, offering, **values):
        return [(student, f"{offering}#{k[1:]}", float(v), "entered") for k, v in values.items()]

    assert marks["native"] == [
        *entered("p1", "geo_n", _1=17, _2=24, _3=41, _4=88), *entered("p2", "geo_n", _1=20, _2=27, _3=45),
        ("p2", "geo_n#4", 0.0, "absent"),
    ]
    assert marks["statuses"] == [
        ("p1", "geo_n#1", 0.0, "exempt"), ("p1", "geo_n#2", 0.0, "absent"), *entered("p1", "geo_n", _4=85)
    ]
    assert len(marks["over"]) == 11 and ("p3", "geo_n#4", 31.0, "entered") in marks["over"]
    assert marks["hinted"] == entered("p1", "geo_n", _1=17, _2=24)
    assert marks["new"] == entered("imp_K-70", "geo_n", _1=12)
    assert marks["prefixed"] == entered("p2", "geo_n", _1=20)
    assert marks["folded"] == entered("p1", "geo_n", _1=5, _4=7.5)
    assert marks["long"] == [*entered("p1", "geo_n", _1=80), *entered("p1", "bio_n", _1=70)]
    assert marks["wide"] == marks["long"]
    assert all(marks[n] == [] for n in ("unhinted", "conflict", "bogus", "dup", "prefixed_none") if n in marks)


def test_notes_and_preview(run):
    plan, domain, marks, _ = run
    assert [(r.institution_id, r.note) for r in plan.notes.collect()] == [("native", "Sheet 'notes': empty, ignored.")]
    counts = {r.institution_id: tuple(r)[2:] for r in importing.preview(plan, domain.offering).collect()}
    assert counts["native"] == (0, 2, 8, 0) and counts["new"] == (1, 1, 1, 1) and counts["over"] == (0, 3, 11, 1)


def test_apply(spark, run):
    plan, domain, marks, errors = run
    with pytest.raises(importing.ImportRefused):
        importing.apply_plan(plan, domain)
    applied = importing.apply_plan(plan, domain, skip_invalid=True)
    written = sum(map(len, marks.values()))
    assert applied.report.collect()[0].asDict() == {
        "students_created": 1, "enrollments_created": 1, "enrollments_updated": 0, "marks_written": written,
        "skipped": sum(map(len, errors.values())),
    }
    new = applied.student.where("id = 'imp_K-70'").collect()
    assert [(r.institution_id, r.name, r.roll_no, r.seq) for r in new] == [("new", "New Student", "K-70", 3)]
    opened = applied.enrollment.where("student_id = 'imp_K-70'").collect()[0]
    assert (opened.id, opened.year_id, opened.term_id, opened.org_unit_id) == (
        "enroll_imp_K-70_Y24_autumn_room_2", "Y24", "autumn", "room_2",
    )
    taken = applied.enrollment_course.where(f"enrollment_id = '{opened.id}'").collect()
    assert [r.offering_id for r in taken] == ["geo_n"]

    after = copy.copy(domain)
    after.student, after.enrollment = applied.student, applied.enrollment
    after.enrollment_course, after.mark = applied.enrollment_course, applied.mark
    totals = {(r.institution_id, r.student_id): r for r in results.student_results(after).collect()}
    courses = {(r.institution_id, r.student_id, r.offering_id): r for r in results.course_results(after).collect()}
    assert courses["native", "p1", "geo_n"].percentage == 83.8
    assert courses["native", "p2", "geo_n"].percentage == 65.0
    assert totals["new", "imp_K-70"].number_of_courses == 1
    # a second time nothing is new, and the tables stay as they are
    again = importing.apply_plan(plan, after, skip_invalid=True)
    report = again.report.collect()[0]
    assert (report.students_created, report.enrollments_created, report.marks_written) == (0, 0, written)
    assert sorted(map(tuple, again.mark.collect())) == sorted(map(tuple, applied.mark.collect()))
    assert sorted(map(tuple, again.enrollment_course.collect())) == sorted(map(tuple, applied.enrollment_course.collect()))


def test_an_import_is_one_version_of_the_store(spark, run):
    plan, domain = run[:2]
    store = Store(spark, tempfile.mkdtemp(prefix="gradeloom-store-"), shards=4)
    store.write(replaced={name: getattr(domain, name) for name in SCHEMAS})
    before = store.versions()
    applied = importing.apply_plan(plan, domain, skip_invalid=True)
    for _ in range(2):  # storing it again changes nothing
        importing.commit(store, applied, domain.institution)
        after = store.domain()
        for entity, columns in (("student", ["id", "name"]), ("enrollment", ["id"]), ("enrollment_course", ["enrollment_id", "offering_id"]), ("mark", ["id", "obtained", "status"])):
            want = getattr(applied, entity).select("institution_id", *columns).collect()
            assert sorted(getattr(after, entity).select("institution_id", *columns).collect()) == sorted(want)
        order = [[(r.institution_id, r.id) for r in t.orderBy("institution_id", "seq").collect()] for t in (after.mark, applied.mark)]
        assert order[0] == order[1]
    assert len(store.versions()) == len(before) + 2


def test_subjects_meet_an_index_of_offerings(spark):
    """60 requests for a course of 60 offerings: no table on the way has more rows than requests and offerings."""
    offering = spark.createDataFrame([("i", f"o{k:02}", "c", "Y", f"t{k % 30}", f"u{k % 59}") for k in range(60)] + [("i", "x", "d", "Y", None, "u1")], "institution_id string, id string, course_id string, year_id string, term_id string, org_unit_id string")
    course = spark.createDataFrame([("i", "c", "Art", "A"), ("i", "d", "Law", "Law"), ("i", "e", "Ode", ""), ("i", "f", "Two", "T"), ("i", "g", "Two", "U")], "institution_id string, id string, name string, code string")
    settings = spark.createDataFrame([("i", "Y", "t3")], "institution_id string, default_year string, default_term string")
    asked = [("i", "Art", f"u{k}") for k in range(60)] + [("i", "A", None), ("i", "Law", ""), ("i", "Law", "u1"), ("i", "Ode", ""), ("i", "Two", ""), ("i", "None", "u1")]
    requests = spark.createDataFrame(asked, "institution_id string, subject string, org_unit_id string")
    answers = labels.resolve_subjects(requests, offering, course, settings)
    got = {(r.subject, r.org_unit_id): (r.offering_id, r.error) for r in answers.collect()}
    want = {("Art", f"u{k}"): (f"o{k:02}", None) for k in range(1, 59)}
    want["Art", "u0"] = (None, "subject 'Art' is ambiguous across offerings (o00, o59)")
    want["Art", "u59"] = (None, "subject 'Art' has no offering for the default period")
    want["A", ""] = (None, "subject 'A' is ambiguous across offerings (o03, o33)")
    want["Law", ""] = (None, "subject 'Law' has no offering for the default period")
    want["Law", "u1"] = ("x", None)
    want["Ode", ""] = (None, "no course offering exists for subject 'Ode'")
    want["Two", ""] = (None, "subject 'Two' matches multiple courses")
    want["None", "u1"] = (None, "no course matches legacy subject 'None'")
    assert got == want


def test_cells_read_the_entries_once(spark, tmp_path):
    tables = {
        "nation": ([(n, f"NATION_{n}") for n in (0, 4, 21)], "n_nationkey bigint, n_name string"),
        "supplier": ([(k, (0, 4, 21)[k % 3], 1000.0 * k) for k in range(9)], "s_suppkey bigint, s_nationkey bigint, s_acctbal double"),
        "orders": (
            [(k, 7 * k, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")[k % 4], "FOP"[k % 3]) for k in range(20)] * 2,
            "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string",
        ),
        "lineitem": (
            [(k % 20, k % 9, k % 7 or None, float(k % 50), "ANR"[k % 3]) for k in range(90)] * 2,
            "l_orderkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = import_queries._campus(Campus(spark, str(tmp_path)))["cell"]
    once = import_queries._campus(Campus(spark, str(tmp_path))).settled("imp_entry", "imp_row")["cell"]
    assert any("orders.parquet" in f for f in plain.inputFiles()) and not any("orders.parquet" in f for f in once.inputFiles())
    assert plain.count() > 0 and plain.exceptAll(once).isEmpty() and once.exceptAll(plain).isEmpty()


def test_the_message_of_a_label_stands_once(spark):
    """A label that names many offerings and holds for many cells: its message is not copied to each of them in the plan."""
    school = config("many", scheme=ONE)
    school["seed"]["offerings"] += [{"id": f"geo_{k}", "org_unit_id": "room_2", "course_id": "geo"} for k in range(40)]
    configs, errors = configs_of(spark, [school])
    assert errors.isEmpty()
    rows = [["Ines Duarte", "H-11", None, "Geography", k] for k in range(30)]
    cells = cells_of(spark, {("many", "wb"): {"x": [LONG, *rows, ["Ines Duarte", "H-11", None, "Biology", 300]]}})
    books = spark.createDataFrame([("many", "wb", None, False)], "institution_id string, workbook string, offering_hint string, legacy boolean")
    plan = importing.validate(cells, books, configs.import_settings(), domain_of(spark, configs))
    places = {(r.column_name, r.message): r["count"] for r in plan.places.groupBy("column_name", "message").count().collect()}
    assert places == {("Geography", None): 30, ("Biology", "mark 300 exceeds maximum 100"): 1}
    ids = ", ".join(sorted(["geo_n", *[f"geo_{k}" for k in range(40)]]))
    message = f"subject 'Geography' is ambiguous across offerings ({ids})"
    assert [r.label_error for r in plan.texts.collect()] == [message]
    found = plan.errors.groupBy("column_name", "message").count().collect()
    assert {tuple(r) for r in found} == {("Geography", message, 30), ("Biology", "mark 300 exceeds maximum 100", 1)}


def test_applied_tables_are_worked_out_when_asked_for(run, monkeypatch):
    plan, domain = run[:2]
    settle, written = importing.settle, []
    monkeypatch.setattr(importing, "settle", lambda df: written.append(df) or settle(df))
    applied = importing.apply_plan(plan, domain, skip_invalid=True)
    assert not written
    assert applied.mark.columns[:3] == ["institution_id", "seq", "id"] and not written
    assert applied.student.where("id = 'imp_K-70'").count() == 1 and len(written) == 1
    assert applied.student is applied.student and len(written) == 1


def test_new_students_do_not_write_the_verdicts(spark, monkeypatch):
    rows = spark.createDataFrame([("i", "w", 1, 2, "R1", None)], "institution_id string, workbook string, sheet_no bigint, row_no bigint, roll string, name string")
    monkeypatch.setattr(import_queries, "_once", lambda c, name, make: make())
    monkeypatch.setattr(import_queries, "_campus", lambda c: {"imp_row": rows})
    monkeypatch.setattr(import_queries, "_domain", lambda c: SimpleNamespace(student=None))
    monkeypatch.setattr(import_queries, "resolve_students", lambda asked, student: (asked.columns, "made"))
    assert import_queries.e05_new_student_ids(None) == "made"
    assert import_queries.c17_student_identity(None) == ["institution_id", "workbook", "ord", "roll", "name"]


def test_cells_are_made_without_writing_entries(spark, tmp_path, monkeypatch):
    """Keys repeat and are null; the cells are those of the tables' SELECTs, and entries and rows are not written on the way."""
    tables = {
        "region": ([(k, f"REGION{k}") for k in range(5)], "r_regionkey bigint, r_name string"),
        "nation": ([(k, f"NATION_{k}", k % 5) for k in range(25)] + [(None, "NOWHERE", 1), (3, "NATION_3", 3)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "supplier": ([(k, k % 25, float(k * 700 % 6000)) for k in range(40)] + [(7, 7, None), (8, 8, 5600.0), (None, 1, 2.0)], "s_suppkey bigint, s_nationkey bigint, s_acctbal double"),
        "orders": (
            [(k, k % 11 or None, "FOP"[k % 3], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"][k % 5]) for k in range(30)]
            + [(4, 9, "P", "5-LOW"), (4, 9, "F", "1-URGENT"), (5, 5, "P", "1-URGENT"), (None, 1, "F", "2-HIGH"), (6, 6, None, None)],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
        ),
        "lineitem": (
            [(k % 31, k % 43, k % 7 or None, float(k % 50), "ANR"[k % 3]) for k in range(400)] * 2 + [(None, 3, 1, 4.0, "A"), (4, None, 1, 4.0, "A"), (4, 8, 2, None, None)],
            "l_orderkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    settle, written = import_queries.settle, []
    monkeypatch.setattr(import_queries, "settle", lambda df: written.append(df) or settle(df))
    made = import_queries._cells(Campus(spark, str(tmp_path)))
    plain = import_queries._campus(Campus(spark, str(tmp_path)))["cell"]
    assert plain.where("row_no > 1 AND col_no IS NULL").count() and [f.dataType for f in made.schema] == [f.dataType for f in plain.schema]
    assert plain.exceptAll(made).isEmpty() and made.exceptAll(plain).isEmpty()
    assert [f.columns for f in written if "row_no" in f.columns] == [plain.columns]


def test_cells_of_a_row_meet_once(spark):
    """Repeated cells and repeated mark columns count each; cells are dealt by blocks of rows and never again by rows."""
    sheet, cell = "institution_id string, workbook string, sheet_no bigint", ("i", "w", 1, "s")
    cells = spark.createDataFrame(
        [(*cell, 1, 1, "Roll No", "text"), (*cell, 2, 1, " R1 ", "text"), (*cell, 2, 3, "7", "int"), (*cell, 2, 3, "7", "int"), (*cell, 2, 4, "8", "int"),
         (*cell, 2, 5, "9", "int"), (*cell, 70_000, 2, "Ines", "text"), (*cell, 70_000, 3, "", "text"), ("i", None, 1, "s", 2, 3, "7", "int")],
        "institution_id string, workbook string, sheet_no bigint, sheet string, row_no bigint, col_no int, value string, value_kind string",
    )
    roles = "roll_col int, name_col int, class_col int, subject_col int, marks_col int"
    classified = spark.createDataFrame(
        [(*cell, 1, None, 1, 2, None, None, None, "native", None)] * 2, f"{sheet}, sheet string, header_row bigint, offering_hint string, {roles}, layout string, error string"
    )
    column = f"{sheet}, col_no int, offering_id string, assessment_id string, assessment_name string, max_marks double"
    columns = spark.createDataFrame([(*cell[:3], 3, "o", "a", "Quiz", 10.0), (*cell[:3], 4, "o", "b", "Lab", 20.0), (*cell[:3], 4, "o", "b", "Lab", 20.0)], column)
    subjects = spark.createDataFrame([], f"{sheet}, col_no int, subject string")
    rows = importing.sheet_rows(importing.filled(cells), importing.sheet_facts(classified, columns, subjects))
    got = {r.row_no: (r.roll, r.name, sorted((m.col_no, m.column_name, m.value, m.max_marks) for m in r.marks)) for r in rows.collect()}
    quiz, lab = (3, "Quiz", "7", 10.0), (4, "Lab", "8", 20.0)
    assert got == {2: ("R1", "", [quiz, quiz, lab, lab]), 70_000: ("", "Ines", [])}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan and not any("hashpartitioning" in line and "row_no#" in line.split("hashpartitioning")[1].split("ENSURE")[0] and "block#" not in line for line in plan.splitlines())


def test_sheets_are_judged_without_rows_and_a_message_stands_once(spark, monkeypatch):
    """A label that names many offerings fails many sheets, by their names and by a column; rows are not read for it."""
    school = config("many")
    school["seed"]["offerings"] += [{"id": f"geo_{k}", "org_unit_id": "room_2", "course_id": "geo"} for k in range(40)]
    configs, _ = configs_of(spark, [school])
    books = {("many", f"w{k}"): {"Geography": [NATIVE, ROW1], "any": [["Roll", "Geography: Quiz", "art: Quiz"], ["H-12", 20, 1]]} for k in range(4)}
    books["many", "w9"] = {"x": [["Roll", "art: Quiz", "Geography|Quiz"], ["H-12", 20, 1]], "y": [["Quiz"], [1]], "geo_n": [NATIVE, ROW1]}
    known = spark.createDataFrame([("many", book, None, False) for _, book in books], "institution_id string, workbook string, offering_hint string, legacy boolean")
    monkeypatch.setattr(importing, "sheet_rows", lambda *_: pytest.fail("rows were read"))
    plan = importing.validate(cells_of(spark, books), known, configs.import_settings(), domain_of(spark, configs))
    header = "invalid header: no student identity column (expected 'Roll No'/'Student Name')"
    places = {(r.sheet, r.row_no, r.message): r["count"] for r in plan.sheet_places.groupBy("sheet", "row_no", "message").count().collect()}
    assert places == {("Geography", 1, None): 4, ("any", 1, None): 4, ("x", 1, None): 1, ("y", 1, header): 1}
    ids = ", ".join(sorted(["geo_n", *[f"geo_{k}" for k in range(40)]]))
    unclear = f"'Geography' is ambiguous across offerings ({ids})"
    told = {(r.sheet, r.message): r["count"] for r in plan.told_sheets(plan.sheet_places).groupBy("sheet", "message").count().collect()}
    art = "no course offering matches 'art'"
    assert told == {("Geography", unclear): 4, ("any", unclear): 4, ("x", art): 1, ("y", header): 1}


def test_native_marks_ask_for_no_subjects(spark, monkeypatch):
    configs, _ = configs_of(spark, [config("one", scheme=ONE)])
    books = {("one", "wb"): {"geo_n": [["Roll No", "Total"], ["H-11", 7], ["H-12", "AB"]], "x": [LONG, ["Ines Duarte", "H-11", None, "Geography", 80]]}}
    known = spark.createDataFrame([("one", "wb", None, False)], "institution_id string, workbook string, offering_hint string, legacy boolean")
    plan = importing.validate(cells_of(spark, books), known, configs.import_settings(), domain_of(spark, configs))
    subjects = importing._with_subjects
    monkeypatch.setattr(importing, "_with_subjects", lambda *_: pytest.fail("subjects were asked for"))
    native = [("p1", "geo_n#1", 7.0), ("p2", "geo_n#1", 0.0)]
    assert sorted((r.student_id, r.assessment_id, r.obtained) for r in plan.native_marks.collect()) == native
    monkeypatch.setattr(importing, "_with_subjects", subjects)
    assert sorted((r.student_id, r.assessment_id, r.obtained) for r in plan.marks.collect()) == sorted([*native, ("p1", "geo_n#1", 80.0)])


def test_large_sheets_are_read_in_blocks(spark, monkeypatch):
    """Rows of a large sheet are dealt to blocks; a small one, however far its rows lie apart, is one block and meets its facts once."""
    monkeypatch.setattr(sheets, "BLOCK_CELLS", 4)
    cells = spark.createDataFrame(
        [("i", "w", 1, "s", n, col, f"{n}{col}", "text") for n in range(1, 12) for col in (1, 2)] + [("i", "w", 2, "t", n, 1, "a", "text") for n in (1, 70_000, 140_000, 280_000)],
        "institution_id string, workbook string, sheet_no bigint, sheet string, row_no bigint, col_no int, value string, value_kind string",
    )
    sizes = sheets.sheet_sizes(cells)
    # no aggregate over cells sorts them
    assert sizes._jdf.queryExecution().executedPlan().toString().count("HashAggregate") >= 2
    assert [tuple(r) for r in sizes.orderBy("sheet_no").collect()] == [("i", "w", 1, "s", 1, 22), ("i", "w", 2, "t", 1, 4)]
    large = sheets.large_sheets(sizes)
    assert [tuple(r) for r in large.collect()] == [("i", "w", 1, 6)]
    blocks = sheets.with_blocks(cells, large)
    assert blocks.where("sheet_no = 2").select("block").distinct().count() == 1 < blocks.where("sheet_no = 1").select("block").distinct().count()
    assert blocks.groupBy("sheet_no", "row_no").agg({"block": "max"}).count() == blocks.select("sheet_no", "row_no", "block").distinct().count()
    roles = "roll_col int, name_col int, class_col int, subject_col int, marks_col int"
    facts = spark.createDataFrame(
        [("i", "w", n, "s", 1, 1, None, None, None, None, "native", [(2, "Quiz", "o", "a", 10.0)]) for n in (1, 2)],
        f"institution_id string, workbook string, sheet_no bigint, sheet string, header_row bigint, {roles}, layout string,"
        " columns array<struct<col_no int, column_name string, offering_id string, assessment_id string, max_marks double>>",
    )
    assert sheets.in_blocks(facts, large).groupBy("sheet_no").count().orderBy("sheet_no").collect() == [(1, 6), (2, 1)]
    rows = importing.sheet_rows(cells, facts)
    got = sorted((r.sheet_no, r.row_no, r.roll, [m.value for m in r.marks]) for r in rows.collect())
    assert got == [(1, n, f"{n}1", [f"{n}2"]) for n in range(2, 12)] + [(2, n, "a", []) for n in (70_000, 140_000, 280_000)]
