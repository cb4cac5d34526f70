"""Semester analysis of plain subject marks."""

from pyspark.sql import functions as F

from gradeloom.functions.grading import DEFAULT_BANDS
from gradeloom.operators import semester
from gradeloom.plans.campus import Campus
from gradeloom.plans.registry import ORACLE_TABLES, query, sql_bands

ORACLE_TABLES.update(
    {
        "graded": f"SELECT *, mark AS percentage, {sql_bands('mark', DEFAULT_BANDS)} AS grade FROM {{subject_mark}}",
        "totals": """
            SELECT student_name, semester, count(*) AS number_of_subjects, sum(mark) AS total_marks,
                   count(*) * 100 AS maximum_marks, sum(mark) / (count(*) * 100) * 100 AS overall_percentage
            FROM {subject_mark} GROUP BY 1, 2""",
        "counts": """
            SELECT student_name, semester, grade, count(*) AS subjects, min(seq) AS first_seq
            FROM {graded} GROUP BY 1, 2, 3""",
        "highest": """
            SELECT student_name, semester, subject AS highest_subject, mark AS highest_mark
            FROM (SELECT *, row_number() OVER (PARTITION BY student_name, semester ORDER BY mark DESC, seq) AS rn
                  FROM {subject_mark}) WHERE rn = 1""",
        "answers": """
            SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CASE WHEN l_quantity = 13 THEN 'many' WHEN l_quantity = 17 THEN 'nan' WHEN l_quantity > 48 THEN '101'
                        WHEN l_quantity < 3 THEN '-1' WHEN l_tax = 0 THEN CONCAT(' ', CAST(l_partkey % 100 AS STRING), ' ')
                        ELSE CONCAT(CAST(l_partkey % 100 AS STRING), '.5') END AS answer
            FROM {lineitem}""",
    }
)
_KEYS = "student_name, semester"


@query("b02_default_grade", f"SELECT {_KEYS}, seq, grade FROM {{graded}}")
def b02_default_grade(c: Campus):
    return semester.graded_subjects(c["subject_mark"]).select("student_name", "semester", "seq", "grade")


@query("b03_subject_percentage", f"SELECT {_KEYS}, seq, subject, percentage FROM {{graded}}")
def b03_subject_percentage(c: Campus):
    return semester.graded_subjects(c["subject_mark"]).select("student_name", "semester", "seq", "subject", "percentage")


@query("b04_subject_grades", f"SELECT {_KEYS}, seq, subject, mark, grade FROM {{graded}}")
def b04_subject_grades(c: Campus):
    return semester.graded_subjects(c["subject_mark"]).select("student_name", "semester", "seq", "subject", "mark", "grade")


def _answers(c: Campus):
    return c.sql(ORACLE_TABLES["answers"])


@query(
    "b05_valid_marks",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trim(answer) AS DOUBLE) AS mark
       FROM {answers} WHERE answer NOT IN ('many', 'nan', '101', '-1')""",
)
def b05_valid_marks(c: Campus):
    return semester.check_marks(_answers(c))[0]


@query(
    "b05_rejected_marks",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, answer,
              CASE answer WHEN 'many' THEN 'Please enter a valid number.'
                   ELSE 'Please enter marks between 0 and 100.' END AS message
       FROM {answers} WHERE answer IN ('many', 'nan', '101', '-1')""",
)
def b05_rejected_marks(c: Campus):
    return semester.check_marks(_answers(c))[1]


@query(
    "b17_subject_table",
    f"""SELECT {_KEYS}, row_number() OVER (PARTITION BY {_KEYS} ORDER BY seq) AS number, subject, mark, percentage, grade
        FROM {{graded}}""",
)
def b17_subject_table(c: Campus):
    return semester.subject_table(semester.graded_subjects(c["subject_mark"]))


@query(
    "b18_summary_text",
    f"""SELECT t.student_name, t.semester,
               concat('STUDENT: ', t.student_name, '\n\nSEMESTER: ', t.semester,
                      '\n\nTOTAL: ', printf('%.0f', t.total_marks), '/', t.maximum_marks,
                      '\n\nOVERALL: ', printf('%.2f', t.overall_percentage), '%\n\nSUBJECTS: ', t.number_of_subjects,
                      '\n\nPerformance Summary\n-------------------\nHighest: ', h.highest_subject,
                      '\nScore: ', printf('%.0f', h.highest_mark), '%\n\n', g.lines) AS summary
        FROM {{totals}} t JOIN {{highest}} h USING ({_KEYS})
        JOIN (SELECT {_KEYS}, string_agg(concat(grade, ': ', subjects, ' subject(s)\n'), ''
                     ORDER BY subjects DESC, first_seq) AS lines FROM {{counts}} GROUP BY 1, 2) g USING ({_KEYS})""",
)
def b18_summary_text(c: Campus):
    return semester.summary_text(c["subject_mark"])


@query(
    "b19_summary_block",
    f"""SELECT {_KEYS}, concat(printf('%.0f', total_marks), '/', maximum_marks) AS total_marks,
               printf('%.2f%%', overall_percentage) AS overall_percentage, student_name AS file_part FROM {{totals}}""",
)
def b19_summary_block(c: Campus):
    return semester.summary_block(semester.semester_totals(c["subject_mark"]))


@query(
    "b20_certificate_rows",
    f"""SELECT {_KEYS}, seq, subject, printf('%.0f/100', mark) AS marks, printf('%.0f%%', percentage) AS percentage,
               mark / 100 AS sheet_percentage, grade FROM {{graded}}""",
)
def b20_certificate_rows(c: Campus):
    return semester.certificate_rows(semester.graded_subjects(c["subject_mark"]))


@query("d08_semester_totals", "SELECT * FROM {totals}")
def d08_semester_totals(c: Campus):
    return semester.semester_totals(c["subject_mark"])


@query("d09_grade_counts", "SELECT * FROM {counts}")
def d09_grade_counts(c: Campus):
    return semester.grade_counts(semester.graded_subjects(c["subject_mark"]))


@query("d10_highest_subject", "SELECT * FROM {highest}")
def d10_highest_subject(c: Campus):
    return semester.highest_subjects(c["subject_mark"])


@query("d11_subject_counts", f"SELECT {_KEYS}, count(*) AS number_of_subjects FROM {{subject_mark}} GROUP BY 1, 2")
def d11_subject_counts(c: Campus):
    return semester.semester_totals(c["subject_mark"]).select("student_name", "semester", "number_of_subjects")


@query(
    "e01_serial_numbers",
    f"SELECT {_KEYS}, seq, row_number() OVER (PARTITION BY {_KEYS} ORDER BY seq) AS number FROM {{subject_mark}}",
)
def e01_serial_numbers(c: Campus):
    from gradeloom.operators.skew import number_rows

    return number_rows(c["subject_mark"].select("student_name", "semester", "seq"), semester.KEYS, "seq", "number")


@query(
    "e02_pie_shares",
    f"""SELECT {_KEYS}, seq, subject, share, printf('%.1f%%', share * 100) AS label
        FROM (SELECT *, mark / sum(mark) OVER (PARTITION BY {_KEYS}) AS share FROM {{subject_mark}})""",
)
def e02_pie_shares(c: Campus):
    return semester.pie_shares(c["subject_mark"])


@query(
    "e03_radar_series",
    f"""SELECT {_KEYS}, point, subject, CASE WHEN point = n THEN 0 ELSE point * (6.283185307179586e0 / n) END AS angle, mark
        FROM (SELECT *, unnest(CASE WHEN rn = 1 THEN [0, n] ELSE [rn - 1] END) AS point
              FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY seq) AS rn,
                           count(*) OVER (PARTITION BY {_KEYS}) AS n FROM {{subject_mark}}))""",
)
def e03_radar_series(c: Campus):
    return semester.radar_series(c["subject_mark"])


@query("e04_subject_bars", f"SELECT {_KEYS}, seq, subject, mark, printf('%.0f%%', mark) AS label FROM {{subject_mark}}")
def e04_subject_bars(c: Campus):
    return semester.bar_series(c["subject_mark"])


@query(
    "f03_first_and_best",
    f"""SELECT {_KEYS}, first(subject ORDER BY seq) AS first_subject, first(subject ORDER BY mark DESC, seq) AS best_subject
        FROM {{subject_mark}} GROUP BY 1, 2""",
)
def f03_first_and_best(c: Campus):
    first = c["subject_mark"].groupBy(*semester.KEYS).agg(F.min_by("subject", "seq").alias("first_subject"))
    best = semester.highest_subjects(c["subject_mark"]).select(
        *semester.KEYS, F.col("highest_subject").alias("best_subject")
    )
    return first.join(best, semester.KEYS)
