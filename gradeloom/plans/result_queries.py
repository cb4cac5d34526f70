"""Results, rules, reports: queries over the campus tables."""

from pyspark.sql import functions as F

from gradeloom.functions.grading import effective_mark, grade_for
from gradeloom.functions.numeric import exact_sums, fmt_f, fmt_g, py_round
from gradeloom.operators import reports, results
from gradeloom.operators.orgtree import org_paths
from gradeloom.operators.rules import institution_rules, offering_rules
from gradeloom.operators.upsert import latest_marks
from gradeloom.plans.campus import SCALES, Campus
from gradeloom.plans.registry import ORACLE_TABLES, query, sql_bands, sql_round, sql_round_by


def _sql_grade(scale: str, x: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {sql_bands(x, bands)}" for name, bands in SCALES.items())
    return f"(CASE {scale} {cases} ELSE '' END)"


ORACLE_TABLES.update(
    {
        "mark": """
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY institution_id, student_id, assessment_id
                                             ORDER BY write_no DESC) AS rn,
                       min(write_no) OVER (PARTITION BY institution_id, student_id, assessment_id) AS seq
                FROM {mark_log}) WHERE rn = 1""",
        "first_enrollment": """
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY institution_id, student_id ORDER BY seq) AS rn
                FROM {enrollment}) WHERE rn = 1""",
        "taken": """
            SELECT c.institution_id, e.student_id, c.pos, c.offering_id
            FROM {enrollment_course} c
            JOIN {first_enrollment} e ON e.institution_id = c.institution_id AND e.id = c.enrollment_id
            JOIN {student} s ON s.institution_id = e.institution_id AND s.id = e.student_id""",
        "ruled": """
            SELECT o.institution_id, o.id AS offering_id, o.course_id, o.max_marks, r.id AS used_rule_set_id,
                   COALESCE(NULLIF(o.grade_scale_id, ''), r.grade_scale_id, i.default_grade_scale_id) AS scale,
                   r.aggregation, r.per_course_pass_percentage, COALESCE(d.decimals, 2) AS decimals
            FROM {offering} o JOIN {institution} i ON i.institution_id = o.institution_id
            LEFT JOIN {rule_set} r ON r.institution_id = o.institution_id
                AND r.id = COALESCE(NULLIF(o.rule_set_id, ''), i.default_rule_set_id)
            LEFT JOIN {rule_set} d ON d.institution_id = o.institution_id AND d.id = i.default_rule_set_id""",
        "grid": f"""
            SELECT *, {sql_round_by("CASE WHEN component_max > 0 THEN raw / component_max * 100 ELSE 0e0 END", "decimals")} AS percentage,
                   {sql_round_by("raw", "decimals")} AS obtained
            FROM (SELECT t.institution_id, t.student_id, t.pos, t.offering_id, o.course_id, o.used_rule_set_id,
                         o.scale, o.aggregation, o.per_course_pass_percentage, o.decimals, o.max_marks,
                         a.id AS assessment_id, a.name, a."order", a.seq, a.max_marks AS component_max, a.weight,
                         CASE WHEN m.status = 'entered' THEN m.obtained ELSE 0e0 END AS raw
                  FROM {{taken}} t
                  JOIN {{ruled}} o ON o.institution_id = t.institution_id AND o.offering_id = t.offering_id
                  LEFT JOIN {{assessment}} a ON a.institution_id = t.institution_id AND a.offering_id = t.offering_id
                  LEFT JOIN {{mark}} m ON m.institution_id = t.institution_id AND m.student_id = t.student_id
                       AND m.assessment_id = a.id)""",
        "course_sums": """
            SELECT institution_id, student_id, pos, offering_id, course_id, used_rule_set_id, scale, aggregation,
                   per_course_pass_percentage, decimals, COALESCE(NULLIF(max_marks, 0), 100) AS maximum,
                   count(assessment_id) AS n, {sum:weight} AS tw, {sum:component_max} AS tm, {sum:obtained} AS so,
                   {sum:percentage} AS sp, {sum:percentage * weight} AS spw
            FROM {grid} GROUP BY ALL""",
        "course_pct": """
            SELECT *, CASE WHEN used_rule_set_id IS NULL OR n = 0 THEN 0e0
                           WHEN aggregation = 'raw_total_percentage'
                               THEN CASE WHEN tm > 0 THEN so / tm * 100 ELSE 0e0 END
                           WHEN tw <= 0 THEN sp / n ELSE spw / tw END AS raw_percentage
            FROM {course_sums}""",
        "course_result": f"""
            SELECT r.institution_id, r.student_id, r.pos, r.offering_id, r.course_id, r.scale, r.decimals,
                   COALESCE(c.name, '') AS course_name, COALESCE(c.code, '') AS course_code, r.maximum, r.percentage,
                   {sql_round_by("r.percentage / 100 * r.maximum", "r.decimals")} AS obtained,
                   {_sql_grade("r.scale", "r.percentage")} AS grade,
                   COALESCE(r.percentage >= r.per_course_pass_percentage, TRUE) AS passed
            FROM (SELECT *, {sql_round_by("raw_percentage", "decimals")} AS percentage FROM {{course_pct}}) r
            LEFT JOIN {{course}} c ON c.institution_id = r.institution_id AND c.id = r.course_id""",
        "org_path": """
            SELECT u.institution_id, u.id,
                   concat(CASE WHEN g.id IS NULL THEN '' ELSE concat(g.level, ' ', g.name, ' > ') END,
                          CASE WHEN p.id IS NULL THEN '' ELSE concat(p.level, ' ', p.name, ' > ') END,
                          u.level, ' ', u.name) AS org_path
            FROM {org_unit} u
            LEFT JOIN {org_unit} p ON p.institution_id = u.institution_id AND p.id = u.parent_id
            LEFT JOIN {org_unit} g ON g.institution_id = u.institution_id AND g.id = p.parent_id""",
        "student_sums": """
            SELECT e.institution_id, e.student_id, s.seq AS student_seq, s.name AS student_name, s.roll_no,
                   i.name AS institution_name, i.default_grade_scale_id, i.default_rule_set_id,
                   e.year_id, e.term_id, e.org_unit_id, d.id AS rule_id, d.pass_percentage,
                   COALESCE(d.decimals, 2) AS decimals, count(c.pos) AS number_of_courses,
                   COALESCE({sum:c.obtained}, 0) AS so, COALESCE({sum:c.maximum}, 0) AS sm,
                   COALESCE(bool_and(c.passed), TRUE) AS all_passed
            FROM {first_enrollment} e
            JOIN {student} s ON s.institution_id = e.institution_id AND s.id = e.student_id
            JOIN {institution} i ON i.institution_id = e.institution_id
            LEFT JOIN {rule_set} d ON d.institution_id = e.institution_id AND d.id = i.default_rule_set_id
            LEFT JOIN {course_result} c ON c.institution_id = e.institution_id AND c.student_id = e.student_id
            GROUP BY ALL""",
        "student_result": f"""
            SELECT r.institution_id, r.student_seq, r.student_id, r.student_name, r.roll_no, r.institution_name,
                   COALESCE(y.name, '') AS year_name, COALESCE(t.name, '') AS term_name,
                   COALESCE(p.org_path, '') AS org_path, r.number_of_courses, r.total_obtained, r.total_maximum,
                   r.overall_percentage, {_sql_grade("r.default_grade_scale_id", "r.overall_percentage")} AS grade,
                   CASE WHEN r.rule_id IS NULL THEN TRUE WHEN r.overall_percentage < r.pass_percentage THEN FALSE
                        ELSE r.all_passed END AS passed
            FROM (SELECT *, CASE WHEN total_maximum > 0
                                 THEN {sql_round_by("total_obtained / total_maximum * 100", "decimals")}
                                 ELSE 0e0 END AS overall_percentage
                  FROM (SELECT *, {sql_round_by("so", "decimals")} AS total_obtained,
                               {sql_round_by("sm", "decimals")} AS total_maximum FROM {{student_sums}})) r
            LEFT JOIN {{academic_year}} y ON y.institution_id = r.institution_id AND y.id = r.year_id
            LEFT JOIN {{term}} t ON t.institution_id = r.institution_id AND t.id = r.term_id
            LEFT JOIN {{org_path}} p ON p.institution_id = r.institution_id AND p.id = r.org_unit_id""",
    }
)

COURSE_COLUMNS = (
    "institution_id, student_id, pos, offering_id, course_id, course_name, course_code, obtained, maximum, "
    "percentage, grade, passed"
)


@query("course_result", f"SELECT {COURSE_COLUMNS} FROM {{course_result}}")
def course_result(c: Campus):
    return results.course_results(c.domain())


@query(
    "component_result",
    f"""SELECT g.institution_id, g.student_id, g.pos, g.offering_id, COALESCE(c.name, '') AS course_name, g."order", g.seq,
              g.assessment_id, g.name, g.obtained, g.component_max AS max_marks, g.weight, g.percentage,
              {_sql_grade("g.scale", "g.percentage")} AS grade
       FROM {{grid}} g LEFT JOIN {{course}} c ON c.institution_id = g.institution_id AND c.id = g.course_id
       WHERE g.assessment_id IS NOT NULL""",
)
def component_result(c: Campus):
    return results.component_results(c.domain())


@query("student_result", "SELECT * FROM {student_result}")
def student_result(c: Campus):
    return results.student_results(c.domain())


@query(
    "b01_grade_lookup",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               {_sql_grade("scale", "mark")} AS grade
        FROM (SELECT *, l_quantity * 2 AS mark, CASE l_returnflag WHEN 'A' THEN 'default' WHEN 'N' THEN 'strict'
                     ELSE 'coarse' END AS scale FROM {{lineitem}})""",
)
def b01_grade_lookup(c: Campus):
    scale = F.when(F.col("l_returnflag") == "A", "default").when(F.col("l_returnflag") == "N", "strict").otherwise("coarse")
    scales = c.grade_scale().where(F.col("institution_id") == "0").select(F.col("id").alias("scale"), "bands")
    return (
        c["lineitem"]
        .withColumn("scale", scale)
        .join(scales, "scale", "left")
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            grade_for(F.col("l_quantity") * 2.0, F.col("bands")).alias("grade"),
        )
    )


@query(
    "b06_effective_mark",
    """SELECT institution_id, student_id, assessment_id, write_no,
              CASE WHEN status = 'entered' THEN obtained ELSE 0e0 END AS effective FROM {mark_log}""",
)
def b06_effective_mark(c: Campus):
    return c["mark_log"].select(
        "institution_id", "student_id", "assessment_id", "write_no",
        effective_mark(F.col("obtained"), F.col("status")).alias("effective"),
    )


@query(
    "b07_component_percentage",
    "SELECT institution_id, student_id, pos, assessment_id, obtained, percentage FROM {grid} WHERE assessment_id IS NOT NULL",
)
def b07_component_percentage(c: Campus):
    return results.component_results(c.domain()).select(
        "institution_id", "student_id", "pos", "assessment_id", "obtained", "percentage"
    )


@query("b08_course_obtained", "SELECT institution_id, student_id, pos, obtained, maximum FROM {course_result}")
def b08_course_obtained(c: Campus):
    return results.course_results(c.domain()).select("institution_id", "student_id", "pos", "obtained", "maximum")


@query("b09_course_passed", "SELECT institution_id, student_id, pos, passed FROM {course_result}")
def b09_course_passed(c: Campus):
    return results.course_results(c.domain()).select("institution_id", "student_id", "pos", "passed")


@query("b10_student_passed", "SELECT institution_id, student_id, overall_percentage, passed FROM {student_result}")
def b10_student_passed(c: Campus):
    return results.student_results(c.domain()).select("institution_id", "student_id", "overall_percentage", "passed")


@query(
    "b11_decimals",
    """SELECT i.institution_id, s.id AS student_id, COALESCE(d.decimals, 2) AS decimals
       FROM {student} s JOIN {institution} i ON i.institution_id = s.institution_id
       LEFT JOIN {rule_set} d ON d.institution_id = i.institution_id AND d.id = i.default_rule_set_id""",
)
def b11_decimals(c: Campus):
    rules = institution_rules(c["institution"], c["rule_set"], c.grade_scale())
    return c["student"].join(rules, "institution_id").select("institution_id", F.col("id").alias("student_id"), "decimals")


@query("b12_one_student", "SELECT * FROM {student_result} WHERE student_id = '7'")
def b12_one_student(c: Campus):
    return results.student_results(c.domain(), student_id="7")


@query(
    "b12_requested_students",
    """SELECT a.institution_id, a.student_id, r.student_name, r.overall_percentage, r.passed,
              CASE WHEN r.student_id IS NULL THEN concat('No student with id ''', a.student_id, ''' was found.') END AS error
       FROM (SELECT DISTINCT CAST((c_custkey + c_nationkey % 2) % 5 AS VARCHAR) AS institution_id, CAST(c_custkey AS VARCHAR) AS student_id
             FROM {customer}) a
       LEFT JOIN {student_result} r ON r.institution_id = a.institution_id AND r.student_id = a.student_id""",
)
def b12_requested_students(c: Campus):
    place = ((F.col("c_custkey") + F.col("c_nationkey") % 2) % 5).cast("string")
    asked = c["customer"].select(place.alias("institution_id"), F.col("c_custkey").cast("string").alias("student_id"))
    return results.requested_results(c.domain(), asked).select(
        "institution_id", "student_id", "student_name", "overall_percentage", "passed", "error"
    )


@query(
    "b13_course_rows",
    """SELECT institution_id, student_id, pos, course_name AS "Course",
              printf('%g/%g', obtained, maximum) AS "Marks", printf('%.2f%%', percentage) AS "Percentage",
              grade AS "Grade", CASE WHEN passed THEN 'Pass' ELSE 'Fail' END AS "Result" FROM {course_result}""",
)
def b13_course_rows(c: Campus):
    return reports.course_rows(results.course_results(c.domain()))


@query(
    "b14_detail_rows",
    f"""SELECT g.institution_id, g.student_id, g.pos, g."order", g.seq, COALESCE(c.name, '') AS "Course",
              g.name AS "Assessment", printf('%g', g.obtained) AS "Obtained", printf('%g', g.component_max) AS "Max",
              printf('%.2f', g.weight) AS "Weight", printf('%.2f%%', g.percentage) AS "%",
              {_sql_grade("g.scale", "g.percentage")} AS "Grade"
       FROM {{grid}} g LEFT JOIN {{course}} c ON c.institution_id = g.institution_id AND c.id = g.course_id
       WHERE g.assessment_id IS NOT NULL AND g.name <> ''""",
)
def b14_detail_rows(c: Campus):
    return reports.detail_rows(results.component_results(c.domain()))


@query(
    "b15_student_summary",
    """SELECT institution_id, student_seq, student_id, concat(student_name, ' (', roll_no, ')') AS student,
              org_path, year_name, term_name, printf('%g/%g', total_obtained, total_maximum) AS total_marks,
              printf('%.2f%%', overall_percentage) AS overall_percentage, grade AS overall_grade,
              CASE WHEN passed THEN 'Pass' ELSE 'Fail' END AS result FROM {student_result}""",
)
def b15_student_summary(c: Campus):
    return reports.student_summary(results.student_results(c.domain()))


@query(
    "b16_report_titles",
    """SELECT institution_id, student_id,
              CASE institution_id WHEN '0' THEN concat(institution_name, ' - ', term_name, ' Result')
                   WHEN '1' THEN concat('{missing} result of {', 'student}')
                   WHEN '2' THEN concat('\x01', rpad(roll_no, CAST(greatest(12, length(roll_no)) AS INTEGER), '.'), '\x02 ', left(student_name, 3))
                   ELSE concat(student_name, '/', roll_no, '/', year_name) END AS title
       FROM {student_result}""",
)
def b16_report_titles(c: Campus):
    template = (
        F.when(F.col("institution_id") == "0", "{institution} - {term} Result")
        .when(F.col("institution_id") == "1", "{missing} result of {student}")
        .when(F.col("institution_id") == "2", "{{{roll:.<12}}} {student:.3}")
        .otherwise("{student}/{roll}/{year}")
    )
    return results.student_results(c.domain()).select(
        "institution_id", "student_id", reports.report_title(template).alias("title")
    )


@query(
    "c01_first_enrollment",
    "SELECT institution_id, student_id, id AS enrollment_id, year_id, term_id, org_unit_id FROM {first_enrollment}",
)
def c01_first_enrollment(c: Campus):
    return results.first_enrollments(c["enrollment"])


@query(
    "c02_taken_offerings",
    """SELECT t.institution_id, t.student_id, t.pos, t.offering_id FROM {taken} t
       JOIN {offering} o ON o.institution_id = t.institution_id AND o.id = t.offering_id""",
)
def c02_taken_offerings(c: Campus):
    known = c["offering"].select("institution_id", F.col("id").alias("offering_id"))
    return results.taken_courses(c.domain()).join(known, ["institution_id", "offering_id"], "left_semi").select(
        "institution_id", "student_id", "pos", "offering_id"
    )


@query(
    "c03_offering_course",
    """SELECT o.institution_id, o.id AS offering_id, COALESCE(c.name, '') AS course_name, COALESCE(c.code, '') AS course_code
       FROM {offering} o LEFT JOIN {course} c ON c.institution_id = o.institution_id AND c.id = o.course_id""",
)
def c03_offering_course(c: Campus):
    return results.graded_offerings(c.domain()).select(
        "institution_id",
        "offering_id",
        F.coalesce("course_name", F.lit("")).alias("course_name"),
        F.coalesce("course_code", F.lit("")).alias("course_code"),
    )


@query("c04_period_names", "SELECT institution_id, student_id, year_name, term_name FROM {student_result}")
def c04_period_names(c: Campus):
    return results.student_results(c.domain()).select("institution_id", "student_id", "year_name", "term_name")


@query(
    "c05_offering_assessments",
    """SELECT o.institution_id, o.id AS offering_id, count(a.id) AS n_assessments,
              COALESCE({sum:a.weight}, 0) AS total_weight, COALESCE({sum:a.max_marks}, 0) AS total_max
       FROM {offering} o LEFT JOIN {assessment} a ON a.institution_id = o.institution_id AND a.offering_id = o.id
       GROUP BY 1, 2""",
)
def c05_offering_assessments(c: Campus):
    return results.graded_offerings(c.domain()).select(
        "institution_id",
        "offering_id",
        F.coalesce("n_assessments", F.lit(0)).alias("n_assessments"),
        F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"),
        F.coalesce("total_max", F.lit(0.0)).alias("total_max"),
    )


@query(
    "c06_marks_of_components",
    """SELECT g.institution_id, g.student_id, g.pos, g.assessment_id, m.status FROM {grid} g
       LEFT JOIN {mark} m ON m.institution_id = g.institution_id AND m.student_id = g.student_id
            AND m.assessment_id = g.assessment_id WHERE g.assessment_id IS NOT NULL""",
)
def c06_marks_of_components(c: Campus):
    marks = latest_marks(c["mark_log"]).select("institution_id", "student_id", "assessment_id", "status")
    return (
        results.component_results(c.domain())
        .select("institution_id", "student_id", "pos", "assessment_id")
        .join(marks, ["institution_id", "student_id", "assessment_id"], "left")
    )


@query("c07_rule_set_of_offering", "SELECT institution_id, offering_id, used_rule_set_id FROM {ruled}")
def c07_rule_set_of_offering(c: Campus):
    ruled = offering_rules(c["offering"], c["institution"], c["rule_set"], c.grade_scale())
    return ruled.select("institution_id", "offering_id", "used_rule_set_id")


@query("c08_grade_scale_of_offering", "SELECT institution_id, offering_id, scale AS used_grade_scale_id FROM {ruled}")
def c08_grade_scale_of_offering(c: Campus):
    ruled = offering_rules(c["offering"], c["institution"], c["rule_set"], c.grade_scale())
    return ruled.select("institution_id", "offering_id", "used_grade_scale_id")


@query(
    "c09_org_path",
    """SELECT * FROM (
           WITH RECURSIVE unit AS MATERIALIZED (SELECT institution_id, id, parent_id, concat(level, ' ', name) AS label FROM {org_deep}),
           walk AS (
               SELECT u.institution_id, u.id, u.label AS org_path FROM unit u
               LEFT JOIN unit p ON p.institution_id = u.institution_id AND p.id = u.parent_id WHERE p.id IS NULL
               UNION ALL
               SELECT u.institution_id, u.id, concat(w.org_path, ' > ', u.label) FROM walk w
               JOIN unit u ON u.institution_id = w.institution_id AND u.parent_id = w.id)
           SELECT institution_id, id, org_path FROM walk)""",
)
def c09_org_path(c: Campus):
    return org_paths(c["org_deep"])


@query(
    "c10_roster",
    """SELECT DISTINCT c.institution_id, c.offering_id, e.student_id, s.name AS student_name, s.roll_no,
              min(e.seq) AS seq
       FROM {enrollment_course} c JOIN {enrollment} e ON e.institution_id = c.institution_id AND e.id = c.enrollment_id
       JOIN {student} s ON s.institution_id = e.institution_id AND s.id = e.student_id GROUP BY 1, 2, 3, 4, 5""",
)
def c10_roster(c: Campus):
    return results.roster(c["enrollment"], c["enrollment_course"], c["student"])


@query(
    "c19_record_mark",
    """SELECT institution_id, seq, concat(student_id, ':', assessment_id) AS id, student_id, assessment_id, obtained,
              status FROM {mark}""",
)
def c19_record_mark(c: Campus):
    return latest_marks(c["mark_log"])


@query(
    "c21_offering_list",
    """SELECT o.institution_id, row_number() OVER (PARTITION BY o.institution_id ORDER BY o.seq) AS number,
              o.id AS offering_id, COALESCE(c.name, o.course_id) AS course_name
       FROM {offering} o LEFT JOIN {course} c ON c.institution_id = o.institution_id AND c.id = o.course_id""",
)
def c21_offering_list(c: Campus):
    return reports.offering_list(c["offering"], c["course"])


_COURSE_BRANCH = "SELECT institution_id, student_id, pos, raw_percentage FROM {course_pct} WHERE "


def _raw_percentages(c: Campus):
    domain = c.domain()
    offerings = results.graded_offerings(domain)
    return (
        results.taken_courses(domain)
        .join(offerings, ["institution_id", "offering_id"])
        .join(results.mark_contributions(domain, offerings), ["institution_id", "student_id", "offering_id"], "left")
        .withColumn("raw_percentage", results.course_percentage())
    )


def _branch(c: Campus, condition: str):
    return _raw_percentages(c).where(condition).select("institution_id", "student_id", "pos", "raw_percentage")


_RULED = "used_rule_set_id IS NOT NULL"


@query(
    "d01_weighted_course_pct",
    f"SELECT institution_id, student_id, pos, {sql_round('raw_percentage', 8)} AS raw_percentage FROM {{course_pct}} "
    f"WHERE {_RULED} AND aggregation <> 'raw_total_percentage' AND n > 0 AND tw > 0",
)
def d01_weighted_course_pct(c: Campus):
    rows = _branch(c, "has_rules AND aggregation <> 'raw_total_percentage' AND total_weight > 0")
    return rows.withColumn("raw_percentage", py_round(F.col("raw_percentage"), 8))


@query("d02_unweighted_mean", f"{_COURSE_BRANCH} {_RULED} AND aggregation <> 'raw_total_percentage' AND n > 0 AND tw <= 0")
def d02_unweighted_mean(c: Campus):
    return _branch(c, "has_rules AND aggregation <> 'raw_total_percentage' AND total_weight <= 0")


@query("d03_raw_total_pct", f"{_COURSE_BRANCH} {_RULED} AND aggregation = 'raw_total_percentage' AND n > 0")
def d03_raw_total_pct(c: Campus):
    return _branch(c, "has_rules AND aggregation = 'raw_total_percentage' AND n_assessments > 0")


@query("d04_no_components", f"{_COURSE_BRANCH} {_RULED} AND n = 0")
def d04_no_components(c: Campus):
    return _branch(c, "has_rules AND n_assessments IS NULL")


@query("d05_no_rule_set", f"{_COURSE_BRANCH} used_rule_set_id IS NULL")
def d05_no_rule_set(c: Campus):
    return _branch(c, "NOT has_rules")


@query(
    "d06_student_totals",
    "SELECT institution_id, student_id, total_obtained, total_maximum, overall_percentage FROM {student_result}",
)
def d06_student_totals(c: Campus):
    return results.student_results(c.domain()).select(
        "institution_id", "student_id", "total_obtained", "total_maximum", "overall_percentage"
    )


@query(
    "d07_all_courses_passed",
    "SELECT institution_id, student_id, count(*) AS number_of_courses, bool_and(passed) AS all_passed FROM {course_result} GROUP BY 1, 2",
)
def d07_all_courses_passed(c: Campus):
    return results.student_totals(results.course_results(c.domain())).select(
        "institution_id", "student_id", "number_of_courses", "all_passed"
    )


@query(
    "e04_course_bars",
    """SELECT institution_id, student_id, pos, course_name, percentage, printf('%.1f%%', percentage) AS label
       FROM {course_result}""",
)
def e04_course_bars(c: Campus):
    return reports.course_bars(results.course_results(c.domain()))


@query("f01_results_in_order", "SELECT institution_id, student_seq, student_id, grade FROM {student_result}")
def f01_results_in_order(c: Campus):
    return results.in_stored_order(
        results.student_results(c.domain()).select("institution_id", "student_seq", "student_id", "grade")
    )


_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEYS = _KEY.split(", ")


@query(
    "h01_round",
    f"SELECT {_KEY}, {sql_round('l_extendedprice * l_discount * l_tax', 2)} AS r2, "
    f"{sql_round('l_quantity * l_discount / 4', 1)} AS r1, {sql_round('l_quantity / 4', 0)} AS r0, "
    f"{sql_round('l_extendedprice * (1 - l_discount) / 7', 5)} AS r5 FROM {{lineitem}}",
)
def h01_round(c: Campus):
    q, p, d, t = (F.col(x) for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return c["lineitem"].select(
        *_KEYS,
        py_round(p * d * t, 2).alias("r2"),
        py_round(q * d / 4.0, 1).alias("r1"),
        py_round(q / 4.0, 0).alias("r0"),
        py_round(p * (F.lit(1.0) - d) / 7.0, 5).alias("r5"),
    )


@query(
    "h01_exact_sum",
    """SELECT l_suppkey, count(*) AS n, {sum:l_quantity * l_discount} AS total,
              {sum:l_extendedprice * (1 - l_discount)} AS revenue,
              CAST(sum(CAST(l_quantity * l_discount * pow(2e0, 75) AS HUGEINT)) AS DOUBLE) / pow(2e0, 975) AS tiny,
              CAST(sum(CAST(l_extendedprice * (l_discount - 0.04e0) * pow(2e0, 75) AS HUGEINT)) AS DOUBLE) * pow(2e0, 725) AS huge,
              CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax * pow(2e0, 75) AS HUGEINT)
                            ELSE CAST(l_extendedprice * pow(2e0, 75) AS HUGEINT) - CAST(l_extendedprice * pow(2e0, 75) AS HUGEINT) END)
                   AS DOUBLE) / pow(2e0, 75) AS cancelled
              FROM {lineitem} GROUP BY 1""",
)
def h01_exact_sum(c: Campus):
    q, p, d = (F.col(x) for x in ("l_quantity", "l_extendedprice", "l_discount"))
    # Scaling by powers of two is exact: far below and far above the usual range.
    down, up = F.lit(2.0**-450), F.lit(2.0**400)
    even = F.col("l_linenumber") % 2 == 0
    both = c["lineitem"].withColumn("_x", F.explode(F.when(even, F.array("l_tax")).otherwise(F.array(p, -p))))
    sums = {"total": q * d, "revenue": p * (F.lit(1.0) - d), "tiny": q * d * down * down, "huge": p * (d - F.lit(0.04)) * up * up}
    found = exact_sums(c["lineitem"], ["l_suppkey"], sums, {"n": (F.count(F.lit(1)), F.sum)})
    return found.join(exact_sums(both, ["l_suppkey"], {"cancelled": F.col("_x")}), "l_suppkey")


@query(
    "h02_general_format",
    f"SELECT {_KEY}, printf('%g', l_extendedprice) AS price, printf('%g', l_quantity * l_discount) AS part, "
    f"printf('%g', l_extendedprice * l_quantity) AS product, printf('%g', l_quantity * l_discount / 1e7) AS small, "
    f"printf('%g', (l_orderkey + 0.5) / 1048576 / 1024) AS tie, printf('%g', l_extendedprice * 1e200) AS huge, "
    f"printf('%g', l_extendedprice / 1e200) AS tiny FROM {{lineitem}}",
)
def h02_general_format(c: Campus):
    q, p, d = (F.col(x) for x in ("l_quantity", "l_extendedprice", "l_discount"))
    return c["lineitem"].select(
        *_KEYS,
        fmt_g(p).alias("price"),
        fmt_g(q * d).alias("part"),
        fmt_g(p * q).alias("product"),
        fmt_g(q * d / 1e7).alias("small"),
        fmt_g((F.col("l_orderkey") + 0.5) / 1048576 / 1024).alias("tie"),
        fmt_g(p * 1e200).alias("huge"),
        fmt_g(p / 1e200).alias("tiny"),
    )


@query(
    "h03_fixed_format",
    f"SELECT {_KEY}, printf('%.0f', l_quantity / 4) AS f0, printf('%.1f', l_quantity / 16) AS f1, "
    f"printf('%.2f', l_quantity * l_discount / 8) AS f2, printf('%.2f', l_extendedprice * 123456789e3) AS f3, "
    f"printf('%.0f', l_extendedprice * 1e25) AS f4 FROM {{lineitem}}",
)
def h03_fixed_format(c: Campus):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return c["lineitem"].select(
        *_KEYS, fmt_f(q / 4.0, 0).alias("f0"), fmt_f(q / 16.0, 1).alias("f1"), fmt_f(q * d / 8.0, 2).alias("f2"),
        fmt_f(F.col("l_extendedprice") * 123456789e3, 2).alias("f3"), fmt_f(F.col("l_extendedprice") * 1e25, 0).alias("f4"),
    )


@query(
    "h13_pass_label",
    "SELECT institution_id, student_id, CASE WHEN passed THEN 'Pass' ELSE 'Fail' END AS result FROM {student_result}",
)
def h13_pass_label(c: Campus):
    return reports.student_summary(results.student_results(c.domain())).select("institution_id", "student_id", "result")


@query(
    "a18_report_manifest",
    """SELECT institution_id, student_seq, student_id, kind, file_name,
              count(*) OVER (PARTITION BY institution_id, file_name) AS writers
       FROM (SELECT r.institution_id, r.student_seq, r.student_id, k.kind,
                    concat(replace(COALESCE(NULLIF(trim(regexp_replace(r.student_name, '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), ''),
                           'Student'), ' ', '_'), k.suffix) AS file_name
             FROM {student_result} r JOIN (VALUES ('excel', '_Result.xlsx', 'x'), ('chart', '_chart.png', 'c'),
                  ('pdf', '_Result.pdf', 'p')) k(kind, suffix, f)
               ON CASE r.institution_id WHEN '0' THEN contains('xcp', k.f) WHEN '1' THEN k.f = 'x'
                       WHEN '2' THEN k.f = 'p' WHEN '3' THEN contains('xcp', k.f) ELSE FALSE END)""".replace("{{", "{").replace("}}", "}"),
)
def a18_report_manifest(c: Campus):
    inst = F.col("institution_id")
    formats = (
        F.when(inst == "1", F.array(F.lit("excel")))
        .when(inst == "2", F.array(F.lit("pdf")))
        .when(inst == "4", F.array(F.lit("html")))
        .otherwise(F.array(F.lit("pdf"), F.lit("excel")))
    )
    reporting = c["institution"].select("institution_id", formats.alias("formats"), (inst != "2").alias("include_chart"))
    return reports.report_manifest(results.student_results(c.domain()), reporting)
