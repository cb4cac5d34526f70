"""An invented academy, and workbooks written as lists of rows."""

import json

from gradeloom.operators.provision import provision
from gradeloom.operators.results import Domain
from gradeloom.session import settle
from gradeloom.sources.config_json import parse_configs
from gradeloom.sources.schemas import SCHEMAS

BANDS = [(90, "A+"), (80, "A"), (70, "B+"), (60, "B"), (50, "C"), (40, "D"), (0, "F")]


def config(inst="harbour", name="Harbour Lane Academy", scheme=None, courses=None, students=None, threshold=35):
    courses = courses or [("geo", "Geography", "GEOG"), ("bio", "Biology", "BIOL"), ("lat", "Latin", "LATN")]
    students = students or [("p1", "Ines Duarte", "H-11"), ("p2", "Tomas Varga", "H-12"), ("p3", "Leila Haddad", "H-13")]
    scheme = scheme or [("Quiz", 20, 0.2), ("Lab", 30, 0.3), ("Essay", 50, 0.2), ("Final", 100, 0.3)]
    offerings = [f"{c[0]}_n" for c in courses]
    return {
        "institution": {
            "id": inst, "name": name, "org_levels": ["Wing", "Room"],
            "default_grade_scale_id": "std", "default_rule_set_id": "rules",
        },
        "grade_scales": [{"id": "std", "bands": [{"min_percentage": m, "grade": g} for m, g in BANDS]}],
        "rule_sets": [
            {"id": "rules", "grade_scale_id": "std", "pass_percentage": 40, "per_course_pass_percentage": threshold}
        ],
        "assessment_schemes": [
            {"id": "main", "assessments": [{"name": n, "max_marks": m, "weight": w} for n, m, w in scheme]}
        ],
        "seed": {
            "academic_years": [{"id": "Y24", "name": "Year 2024"}],
            "terms": [{"id": "autumn", "year_id": "Y24", "name": "Autumn Term", "order": 1}],
            "org_units": [
                {"id": "wing_n", "level": "Wing", "name": "North"},
                {"id": "room_2", "level": "Room", "name": "2", "parent_id": "wing_n"},
            ],
            "courses": [{"id": i, "name": n, "code": c} for i, n, c in courses],
            "offerings": [{"id": f"{c[0]}_n", "org_unit_id": "room_2", "course_id": c[0]} for c in courses],
            "students": [{"id": i, "name": n, "roll_no": r} for i, n, r in students],
            "enrollments": [
                {"id": f"e{n}", "student_id": s[0], "org_unit_id": "room_2", "course_ids": offerings}
                for n, s in enumerate(students, 1)
            ],
        },
    }


def configs_of(spark, documents):
    texts = spark.createDataFrame([(f"{n}.json", json.dumps(d)) for n, d in enumerate(documents)], "file string, text string")
    return parse_configs(texts)


def domain_of(spark, configs, marks=()):
    tables = provision(configs)
    tables["mark"] = spark.createDataFrame(
        [(i, n, f"{s}:{a}", s, a, float(o), st) for n, (i, s, a, o, st) in enumerate(marks)], SCHEMAS["mark"]
    )
    return Domain(**{name: settle(table) for name, table in tables.items()})


def marks_of(inst, student, offering, values):
    return [
        (inst, student, f"{offering}#{n}", 0 if v is None else v, "absent" if v is None else "entered")
        for n, v in enumerate(values, 1)
    ]


def kind_of(value):
    if value is None:
        return "blank"
    return {str: "text", bool: "bool", int: "int", float: "float"}[type(value)]


def cells_of(spark, books):
    """``books``: {(institution, workbook): {sheet: rows}} with plain Python values."""
    cells = []
    for (inst, book), sheets in books.items():
        for sheet_no, (sheet, rows) in enumerate(sheets.items(), 1):
            for row_no, row in enumerate(rows, 1):
                for col_no, value in enumerate(row, 1):
                    text = None if value is None else str(value)
                    cells.append((inst, book, sheet, sheet_no, row_no, col_no, text, kind_of(value)))
    return spark.createDataFrame(
        cells,
        "institution_id string, workbook string, sheet string, sheet_no int, row_no bigint, col_no int, value string, value_kind string",
    )
