"""The tables of the model. Every id is unique inside its institution only.

``seq`` is the position of the first insert: it decides every order the
results depend on and need not be dense. The ordered course list of an
enrollment is the child table ``enrollment_course`` (ordered by ``pos``), so
that no row grows with the number of courses.
"""

SCHEMAS = {
    "institution": (
        "institution_id string, seq bigint, name string, institution_type string, org_levels array<string>, "
        "default_grade_scale_id string, default_rule_set_id string"
    ),
    "academic_year": (
        "institution_id string, seq bigint, id string, name string, start_date string, end_date string, status string"
    ),
    "term": "institution_id string, seq bigint, id string, year_id string, name string, order int, status string",
    "org_unit": "institution_id string, seq bigint, id string, level string, name string, parent_id string",
    "student": "institution_id string, seq bigint, id string, name string, roll_no string, extra string",
    "enrollment": (
        "institution_id string, seq bigint, id string, student_id string, year_id string, term_id string, "
        "org_unit_id string"
    ),
    "enrollment_course": "institution_id string, enrollment_id string, pos bigint, offering_id string",
    "course": "institution_id string, seq bigint, id string, name string, code string",
    "offering": (
        "institution_id string, seq bigint, id string, year_id string, term_id string, org_unit_id string, "
        "course_id string, assessment_scheme_id string, grade_scale_id string, rule_set_id string, max_marks double"
    ),
    "assessment": (
        "institution_id string, seq bigint, id string, offering_id string, name string, max_marks double, "
        "weight double, kind string, order int"
    ),
    "mark": (
        "institution_id string, seq bigint, id string, student_id string, assessment_id string, obtained double, "
        "status string"
    ),
    "grade_scale": (
        "institution_id string, seq bigint, id string, name string, "
        "bands array<struct<min_percentage:double,grade:string>>"
    ),
    "rule_set": (
        "institution_id string, seq bigint, id string, grade_scale_id string, pass_percentage double, "
        "per_course_pass_percentage double, aggregation string, decimals int"
    ),
}

# What identifies one row of a table.
KEYS = {
    name: ["institution_id"]
    if name == "institution"
    else ["institution_id", "enrollment_id", "pos"]
    if name == "enrollment_course"
    else ["institution_id", "id"]
    for name in SCHEMAS
}
