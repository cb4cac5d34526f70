import math

import pytest
from helpers import config, configs_of, domain_of, marks_of
from pyspark.sql import functions as F

from gradeloom.operators import reports, results
from gradeloom.operators.orgtree import OrgCycleError, org_paths

HARBOUR = {
    "p1": {"geo_n": [17, 24, 41, 88], "bio_n": [12, 21, 33, 64], "lat_n": [14, 15, 30, 50]},
    "p2": {"geo_n": [20, 27, 45, None], "bio_n": [18, 27, 44, 90], "lat_n": [16, 24, 40, 75]},
    "p3": {"geo_n": [4, 6, 10, 20], "bio_n": [5, 9, 12, 25], "lat_n": [6, 9, 11, 30]},
}
HARBOUR_SCHEME = [(20, 0.2), (30, 0.3), (50, 0.2), (100, 0.3)]
GUILD = {
    "g1": {"weld_n": [48, 72], "carp_n": [30, 63], "tile_n": [57, 45]},
    "g2": {"weld_n": [24, 18], "carp_n": [33, 27], "tile_n": [30, 36]},
}
GUILD_SCHEME = [(60, 0.45), (90, 0.55)]


def weighted(marks, scheme):
    """The rule in plain Python: weighted mean of rounded percentages, rounded."""
    parts = [round((o or 0) / m * 100, 2) * w for o, (m, w) in zip(marks, scheme)]
    return round(math.fsum(parts) / math.fsum(w for _, w in scheme), 2)


def odd_document():
    """Overrides, zero maxima, repeated and unknown courses, two enrollments."""
    d = config("odd", "Odd", scheme=[("A", 50, 0.0), ("B", 100, 0.0)])
    d["rule_sets"] += [
        {"id": "raw", "grade_scale_id": "short", "aggregation": "raw_total_percentage", "decimals": 0},
        {"id": "free", "per_course_pass_percentage": None, "grade_scale_id": "missing"},
    ]
    d["grade_scales"].append({"id": "short", "bands": [{"min_percentage": 0, "grade": "N"}, {"min_percentage": 50, "grade": "Y"}]})
    seed = d["seed"]
    seed["offerings"][0]["rule_set_id"] = "raw"
    seed["offerings"][1].update(rule_set_id="free", max_marks=0)
    seed["offerings"][2].update(rule_set_id="unheard", term_id=None)
    seed["offerings"].append({"id": "plain", "org_unit_id": "room_2", "course_id": "gone", "assessment_scheme_id": "none"})
    seed["enrollments"][0]["course_ids"] = ["geo_n", "geo_n", "nowhere", "bio_n", "lat_n", "plain"]
    seed["enrollments"][1].update(term_id=None, org_unit_id="lost", course_ids=[])
    seed["enrollments"][2]["student_id"] = "p1"
    return d


@pytest.fixture(scope="module")
def domain(spark):
    guild = config(
        "guild", "Riverside Guild", scheme=[("Practical", 60, 0.45), ("Theory", 90, 0.55)],
        courses=[("weld", "Welding", "W1"), ("carp", "Carpentry", "W2"), ("tile", "Tiling", "W3")],
        students=[("g1", "Oskar Lind", "G-1"), ("g2", "Mina Okoye", "G-2")], threshold=40,
    )
    empty = config("empty", "No Marks")
    configs, _ = configs_of(spark, [config(), guild, empty, odd_document()])
    marks = []
    for inst, students in (("harbour", HARBOUR), ("guild", GUILD)):
        for student, offerings in students.items():
            for offering, values in offerings.items():
                marks += marks_of(inst, student, offering, values)
    marks += [
        ("odd", "p1", "geo_n#1", 30, "entered"), ("odd", "p1", "geo_n#2", 40, "entered"),
        ("odd", "p1", "bio_n#1", 25, "entered"), ("odd", "p1", "bio_n#2", 90, "exempt"),
        ("odd", "p1", "lat_n#1", 50, "entered"),
    ]
    return domain_of(spark, configs, marks)


@pytest.fixture(scope="module")
def students(domain):
    return {(r.institution_id, r.student_id): r for r in results.student_results(domain).collect()}


@pytest.fixture(scope="module")
def courses(domain):
    rows = results.course_results(domain).collect()
    return {(r.institution_id, r.student_id, r.offering_id): r for r in rows}, rows


def test_harbour(students, courses):
    by_key, _ = courses
    got = {k[1:]: (r.percentage, r.grade) for k, r in by_key.items() if k[0] == "harbour"}
    assert {k: p for k, (p, _) in got.items()} == {(s, o): weighted(m, HARBOUR_SCHEME) for s, taken in HARBOUR.items() for o, m in taken.items()}
    assert got["p1", "geo_n"] == (83.8, "A") and got["p1", "bio_n"] == (65.4, "B") and got["p1", "lat_n"] == (56.0, "C")
    assert got["p2", "geo_n"] == (65.0, "B")
    p1 = students["harbour", "p1"]
    assert (p1.total_obtained, p1.total_maximum, p1.overall_percentage, p1.grade, p1.passed) == (205.2, 300.0, 68.4, "B", True)
    assert (p1.org_path, p1.year_name, p1.term_name, p1.number_of_courses) == ("Wing North > Room 2", "Year 2024", "Autumn Term", 3)
    assert (students["harbour", "p2"].overall_percentage, students["harbour", "p2"].passed) == (77.7, True)
    p3 = students["harbour", "p3"]
    assert (p3.overall_percentage, p3.grade, p3.passed) == (24.9, "F", False)
    failed = sorted((r.pos, r.course_name) for k, r in by_key.items() if k[:2] == ("harbour", "p3") and not r.passed)
    assert [name for _, name in failed] == ["Geography", "Biology", "Latin"]


def test_guild(students, courses):
    by_key, _ = courses
    for student, taken in GUILD.items():
        assert {o: by_key["guild", student, o].percentage for o in taken} == {o: weighted(m, GUILD_SCHEME) for o, m in taken.items()}
    assert (students["guild", "g1"].overall_percentage, students["guild", "g1"].passed) == (70.42, True)
    assert by_key["guild", "g2", "weld_n"].percentage == 29.0 and not by_key["guild", "g2", "weld_n"].passed
    assert (students["guild", "g2"].overall_percentage, students["guild", "g2"].grade) == (38.25, "F")


def test_totals_are_no_part_of_the_plan_of_students(domain):
    plan = results.student_results(domain)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum_obtained" in plan and "total_weight" not in plan


def test_no_marks(students):
    rows = [r for k, r in students.items() if k[0] == "empty"]
    assert len(rows) == 3
    assert {(r.total_obtained, r.overall_percentage, r.grade, r.passed) for r in rows} == {(0.0, 0.0, "F", False)}


def test_odd_rules(students, courses):
    by_key, rows = courses
    geo = [r for r in rows if r.institution_id == "odd" and r.offering_id == "geo_n"]
    # raw total, decimals of the default rule set, scale of the override, listed twice
    assert [(r.percentage, r.grade, r.maximum) for r in geo] == [(46.67, "N", 100.0)] * 2
    bio = by_key["odd", "p1", "bio_n"]
    # no positive weight: plain mean of 50 and 0; unknown scale; no threshold; maximum 0 counts as 100
    assert (bio.percentage, bio.grade, bio.passed, bio.maximum) == (25.0, "", True, 100.0)
    lat = by_key["odd", "p1", "lat_n"]
    assert (lat.percentage, lat.grade, lat.passed) == (0.0, "F", True)
    plain = by_key["odd", "p1", "plain"]
    assert (plain.percentage, plain.course_name, plain.grade) == (0.0, "", "F")
    p1, p2 = students["odd", "p1"], students["odd", "p2"]
    assert p1.number_of_courses == 5 and p1.total_obtained == 118.34
    assert (p2.number_of_courses, p2.total_maximum, p2.overall_percentage, p2.term_name, p2.org_path) == (0, 0.0, 0.0, "", "")
    assert ("odd", "p3") not in students


def test_components_and_rows(domain):
    components = results.component_results(domain).where("institution_id = 'harbour' AND student_id = 'p2' AND offering_id = 'geo_n'")
    rows = components.orderBy("order", "seq").collect()
    assert [(r.name, r.obtained, r.percentage, r.grade) for r in rows] == [
        ("Quiz", 20.0, 100.0, "A+"), ("Lab", 27.0, 90.0, "A+"), ("Essay", 45.0, 90.0, "A+"), ("Final", 0.0, 0.0, "F"),
    ]
    detail = reports.detail_rows(components).orderBy("order").first()
    assert (detail["Obtained"], detail["Max"], detail["Weight"], detail["%"]) == ("20", "20", "0.20", "100.00%")
    course = reports.course_rows(results.course_results(domain)).where("institution_id = 'harbour' AND student_id = 'p1' AND pos = 0").first()
    assert (course["Marks"], course["Percentage"], course["Result"]) == ("83.8/100", "83.80%", "Pass")


def test_one_student_and_institution(domain):
    rows = results.student_results(domain.only("guild"), student_id="g1").collect()
    assert [(r.institution_id, r.student_id) for r in rows] == [("guild", "g1")]
    assert results.student_results(domain.only("guild"), student_id="nobody").isEmpty()
    asked = domain.student.sparkSession.createDataFrame([("guild", "g1"), ("harbour", "g1"), ("guild", "nobody")], "institution_id string, student_id string")
    told = {(r.institution_id, r.student_id): (r.student_name, r.error) for r in results.requested_results(domain, asked).collect()}
    assert told["guild", "g1"] == (rows[0].student_name, None)
    assert told["guild", "nobody"] == (None, "No student with id 'nobody' was found.")
    assert told["harbour", "g1"][0] is None and "g1" in told["harbour", "g1"][1]


def test_org_paths_and_cycles(spark):
    schema = "institution_id string, id string, level string, name string, parent_id string"
    chain = [("i", f"u{n}", "L", str(n), f"u{n - 1}" if n else None) for n in range(11)] + [("j", "u3", "L", "x", "gone")]
    got = {(r.institution_id, r.id): r.org_path for r in org_paths(spark.createDataFrame(chain, schema)).collect()}
    assert got["i", "u10"] == " > ".join(f"L {n}" for n in range(11)) and got["j", "u3"] == "L x"
    loop = spark.createDataFrame([("i", "a", "L", "1", "b"), ("i", "b", "L", "2", "a"), ("i", "c", "L", "3", None)], schema)
    with pytest.raises(OrgCycleError):
        org_paths(loop)


def test_nan_mark_grades_last(spark, domain):
    marks = domain.mark.where("institution_id = 'harbour' AND student_id = 'p1'").withColumn("obtained", F.lit(float("nan")))
    from dataclasses import replace

    row = results.student_results(replace(domain, mark=marks).only("harbour"), student_id="p1").first()
    assert row.grade == "F" and row.passed is False


def test_manifest(spark, domain):
    reporting = spark.createDataFrame(
        [("harbour", ["pdf", "excel"], True), ("guild", ["pdf"], False), ("empty", ["excel"], True)],
        "institution_id string, formats array<string>, include_chart boolean",
    )
    rows = reports.report_manifest(results.student_results(domain), reporting).collect()
    harbour = {r.file_name for r in rows if (r.institution_id, r.student_id) == ("harbour", "p1")}
    assert harbour == {"Ines_Duarte_Result.xlsx", "Ines_Duarte_chart.png", "Ines_Duarte_Result.pdf"}
    assert {r.kind for r in rows if r.institution_id == "guild"} == {"pdf"}
    assert all(r.writers == 1 for r in rows)
