"""Component, course and student results as flat tables.

The three tables share the keys (institution_id, student_id, pos): ``pos`` is
the place of a course in the student's first enrollment.

A missing mark counts zero, so the grid of students x assessments is never
built to get course results: marks are summed per (student, offering), and
weights and maxima per offering. Only the component table expands the grid,
because its rows are that grid.
"""

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.grading import (
    component_percentage,
    course_passed,
    effective_mark,
    grade_for,
    student_passed,
)
from gradeloom.functions.numeric import exact_sums, py_round
from gradeloom.operators.orgtree import org_paths
from gradeloom.operators.rules import RAW_TOTAL, institution_rules, offering_rules
from gradeloom.session import by_rows, settle


@dataclass
class Domain:
    """The tables one calculation reads; any number of institutions."""

    institution: DataFrame
    academic_year: DataFrame
    term: DataFrame
    org_unit: DataFrame
    student: DataFrame
    enrollment: DataFrame
    enrollment_course: DataFrame
    course: DataFrame
    offering: DataFrame
    assessment: DataFrame
    mark: DataFrame
    grade_scale: DataFrame
    rule_set: DataFrame

    def only(self, institution_id: str) -> "Domain":
        """The same tables restricted to one institution."""
        tables = {f.name: getattr(self, f.name) for f in fields(self)}
        return Domain(**{n: t.where(F.col("institution_id") == institution_id) for n, t in tables.items()})


def first_enrollments(enrollment: DataFrame) -> DataFrame:
    """The enrollment that counts for each student: the first one stored."""
    rest = [c for c in enrollment.columns if c not in ("institution_id", "student_id")]
    first = enrollment.groupBy("institution_id", "student_id").agg(
        F.min_by(F.struct(*rest), F.struct("seq", "id")).alias("e")
    )
    return first.select(
        "institution_id",
        "student_id",
        F.col("e.id").alias("enrollment_id"),
        "e.year_id",
        "e.term_id",
        "e.org_unit_id",
    )


def enrolled_students(domain: Domain) -> DataFrame:
    """Known students with the enrollment that counts; others are dropped."""
    students = domain.student.select(
        "institution_id",
        F.col("seq").alias("student_seq"),
        F.col("id").alias("student_id"),
        F.col("name").alias("student_name"),
        "roll_no",
    )
    return students.join(first_enrollments(domain.enrollment), ["institution_id", "student_id"])


def taken_courses(domain: Domain) -> DataFrame:
    """(institution, student, pos, offering): the course list, duplicates kept."""
    first = first_enrollments(domain.enrollment)
    known = domain.student.select("institution_id", F.col("id").alias("student_id"))
    first = first.join(known, ["institution_id", "student_id"], "left_semi")
    return domain.enrollment_course.join(
        first.select("institution_id", "student_id", "enrollment_id"), ["institution_id", "enrollment_id"]
    ).select("institution_id", "student_id", "pos", "offering_id")


def graded_offerings(domain: Domain) -> DataFrame:
    """Per offering: rules, course labels, and the totals over its assessments."""
    totals = exact_sums(
        domain.assessment,
        ["institution_id", "offering_id"],
        {"total_weight": F.col("weight"), "total_max": F.col("max_marks")},
        {"n_assessments": (F.count(F.lit(1)), F.sum)},
    )
    courses = domain.course.select(
        "institution_id",
        F.col("id").alias("course_id"),
        F.col("name").alias("course_name"),
        F.col("code").alias("course_code"),
    )
    ruled = offering_rules(domain.offering, domain.institution, domain.rule_set, domain.grade_scale)
    return ruled.join(courses, ["institution_id", "course_id"], "left").join(
        totals, ["institution_id", "offering_id"], "left"
    )


def _uses_raw_total() -> Column:
    return F.coalesce(F.col("aggregation") == RAW_TOTAL, F.lit(False))


def mark_contributions(domain: Domain, offerings: DataFrame) -> DataFrame:
    """(institution, student, offering, earned): what the marks add up to.

    What one mark adds depends on how its offering aggregates: obtained marks
    (raw total), the percentage (no positive weights) or percentage x weight.
    Obtained marks and percentages are rounded first.
    """
    how = offerings.select("institution_id", "offering_id", "aggregation", "total_weight", "decimals")
    assessments = domain.assessment.select(
        "institution_id", F.col("id").alias("assessment_id"), "offering_id", "max_marks", "weight"
    ).join(how, ["institution_id", "offering_id"])
    obtained = effective_mark(F.col("obtained"), F.col("status"))
    percentage = py_round(component_percentage(F.col("_obtained"), F.col("max_marks")), F.col("decimals"))
    earned = (
        F.when(_uses_raw_total(), py_round(F.col("_obtained"), F.col("decimals")))
        .when(F.col("total_weight") > 0, percentage * F.col("weight"))
        .otherwise(percentage)
    )
    marks = domain.mark.select("institution_id", "student_id", "assessment_id", obtained.alias("_obtained"))
    earned_marks = (
        marks.where(F.col("_obtained") != 0)
        .join(assessments, ["institution_id", "assessment_id"])
        .select("institution_id", "student_id", "offering_id", earned.alias("_earned"))
    )
    return exact_sums(earned_marks, ["institution_id", "student_id", "offering_id"], {"earned": F.col("_earned")})


def course_percentage() -> Column:
    """Unrounded course percentage from ``earned`` and the offering totals."""
    earned = F.coalesce(F.col("earned"), F.lit(0.0))
    raw = F.when(F.col("total_max") > 0, F.try_divide(earned, F.col("total_max")) * 100.0).otherwise(F.lit(0.0))
    weighted = F.when(F.col("total_weight") > 0, F.try_divide(earned, F.col("total_weight"))).otherwise(
        F.try_divide(earned, F.col("n_assessments").cast("double"))
    )
    return (
        F.when(~F.col("has_rules") | F.col("n_assessments").isNull(), F.lit(0.0))
        .when(_uses_raw_total(), raw)
        .otherwise(weighted)
    )


def course_results(domain: Domain) -> DataFrame:
    """One row per student and course taken.

    The offerings with their rules are written once, as marks and courses both read them.
    """
    offerings = by_rows(settle(graded_offerings(domain)))
    rows = (
        taken_courses(domain)
        .join(offerings, ["institution_id", "offering_id"])
        .join(mark_contributions(domain, offerings), ["institution_id", "student_id", "offering_id"], "left")
    )
    rounded = rows.withColumn("percentage", py_round(course_percentage(), F.col("decimals")))
    maximum = F.coalesce(F.nullif(F.col("max_marks"), F.lit(0.0)), F.lit(100.0))
    return rounded.select(
        "institution_id",
        "student_id",
        "pos",
        "offering_id",
        "course_id",
        F.coalesce("course_name", F.lit("")).alias("course_name"),
        F.coalesce("course_code", F.lit("")).alias("course_code"),
        py_round(F.col("percentage") / 100.0 * maximum, F.col("decimals")).alias("obtained"),
        maximum.alias("maximum"),
        "percentage",
        F.when(F.col("bands").isNull(), F.lit("")).otherwise(grade_for(F.col("percentage"), F.col("bands"))).alias("grade"),
        course_passed(F.col("has_rules"), F.col("per_course_pass_percentage"), F.col("percentage")).alias("passed"),
    )


def component_results(domain: Domain) -> DataFrame:
    """One row per student, course taken and assessment of that course.

    Order inside a course: (``order``, ``seq``).
    """
    ruled = offering_rules(domain.offering, domain.institution, domain.rule_set, domain.grade_scale)
    courses = domain.course.select(
        "institution_id", F.col("id").alias("course_id"), F.col("name").alias("course_name")
    )
    assessments = (
        domain.assessment.select(
            "institution_id",
            F.col("id").alias("assessment_id"),
            "offering_id",
            "name",
            F.col("max_marks").alias("component_max"),
            "weight",
            "order",
            "seq",
        )
        .join(ruled.select("institution_id", "offering_id", "course_id", "decimals", "bands"), ["institution_id", "offering_id"])
        .join(courses, ["institution_id", "course_id"], "left")
    )
    marks = domain.mark.select(
        "institution_id",
        "student_id",
        "assessment_id",
        effective_mark(F.col("obtained"), F.col("status")).alias("_obtained"),
    )
    grid = (
        taken_courses(domain)
        .join(assessments, ["institution_id", "offering_id"])
        .join(marks, ["institution_id", "student_id", "assessment_id"], "left")
        .withColumn("_obtained", F.coalesce("_obtained", F.lit(0.0)))
        .withColumn(
            "percentage", py_round(component_percentage(F.col("_obtained"), F.col("component_max")), F.col("decimals"))
        )
    )
    return grid.select(
        "institution_id",
        "student_id",
        "pos",
        "offering_id",
        F.coalesce("course_name", F.lit("")).alias("course_name"),
        "order",
        "seq",
        "assessment_id",
        "name",
        py_round(F.col("_obtained"), F.col("decimals")).alias("obtained"),
        F.col("component_max").alias("max_marks"),
        "weight",
        "percentage",
        F.when(F.col("bands").isNull(), F.lit("")).otherwise(grade_for(F.col("percentage"), F.col("bands"))).alias("grade"),
    )


def student_totals(courses: DataFrame) -> DataFrame:
    """Unrounded totals per student over the rows of ``course_results``."""
    return exact_sums(
        courses,
        ["institution_id", "student_id"],
        {"sum_obtained": F.col("obtained"), "sum_maximum": F.col("maximum")},
        {"number_of_courses": (F.count(F.lit(1)), F.sum), "all_passed": (F.bool_and("passed"), F.bool_and)},
    )


def student_results(domain: Domain, student_id: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """One row per enrolled student; ``student_id``, of any institution, or the rows of
    asked(institution_id, student_id) restrict the report.

    The overall percentage is the ratio of the rounded totals. Totals are written once, since the driver holds
    the plan anew after each of its stages: two plans of half the joins take it a fraction of the memory.
    """
    students = enrolled_students(domain)
    courses = course_results(domain)
    if student_id is not None:
        students = students.where(F.col("student_id") == student_id)
        courses = courses.where(F.col("student_id") == student_id)
    if asked is not None:
        students = students.join(asked, ["institution_id", "student_id"], "left_semi")
        courses = courses.join(asked, ["institution_id", "student_id"], "left_semi")
    rules = institution_rules(domain.institution, domain.rule_set, domain.grade_scale)
    years = domain.academic_year.select("institution_id", F.col("id").alias("year_id"), F.col("name").alias("year_name"))
    terms = domain.term.select("institution_id", F.col("id").alias("term_id"), F.col("name").alias("term_name"))
    paths = org_paths(domain.org_unit).withColumnRenamed("id", "org_unit_id")
    joined = (
        students.join(by_rows(settle(student_totals(courses))), ["institution_id", "student_id"], "left")
        .join(rules, "institution_id")
        .join(years, ["institution_id", "year_id"], "left")
        .join(terms, ["institution_id", "term_id"], "left")
        .join(paths, ["institution_id", "org_unit_id"], "left")
    )
    zero = F.lit(0.0)
    totals = joined.withColumn(
        "total_obtained", py_round(F.coalesce("sum_obtained", zero), F.col("decimals"))
    ).withColumn("total_maximum", py_round(F.coalesce("sum_maximum", zero), F.col("decimals")))
    ratio = F.try_divide(F.col("total_obtained"), F.col("total_maximum")) * 100.0
    overall = F.when(F.col("total_maximum") > 0, py_round(ratio, F.col("decimals"))).otherwise(zero)
    graded = totals.withColumn("overall_percentage", overall)
    return graded.select(
        "institution_id",
        "student_seq",
        "student_id",
        "student_name",
        "roll_no",
        "institution_name",
        F.coalesce("year_name", F.lit("")).alias("year_name"),
        F.coalesce("term_name", F.lit("")).alias("term_name"),
        F.coalesce("org_path", F.lit("")).alias("org_path"),
        F.coalesce("number_of_courses", F.lit(0)).cast("bigint").alias("number_of_courses"),
        "total_obtained",
        "total_maximum",
        "overall_percentage",
        F.when(F.col("bands").isNull(), F.lit(""))
        .otherwise(grade_for(F.col("overall_percentage"), F.col("bands")))
        .alias("grade"),
        student_passed(
            F.col("has_rules"), F.col("pass_percentage"), F.col("overall_percentage"), F.col("all_passed")
        ).alias("passed"),
    )


def requested_results(domain: Domain, asked: DataFrame) -> DataFrame:
    """The row of ``student_results`` for each distinct row of asked(institution_id, student_id), and
    ``error``: what is said of a student who is not among the results of the institution."""
    wanted = asked.select("institution_id", "student_id").distinct()
    found = student_results(domain, asked=wanted).withColumn("_found", F.lit(True))
    missing = F.concat(F.lit("No student with id '"), "student_id", F.lit("' was found."))
    joined = wanted.join(found, ["institution_id", "student_id"], "left")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), missing)).drop("_found")


def in_stored_order(results: DataFrame) -> DataFrame:
    """Student order for a sink that keeps row order."""
    return results.orderBy("institution_id", "student_seq")


def roster(enrollment: DataFrame, enrollment_course: DataFrame, student: DataFrame) -> DataFrame:
    """Known students enrolled in each offering, once, in enrollment order."""
    who = enrollment.select("institution_id", F.col("id").alias("enrollment_id"), "student_id", "seq")
    pairs = (
        enrollment_course.join(who, ["institution_id", "enrollment_id"])
        .groupBy("institution_id", "offering_id", "student_id")
        .agg(F.min("seq").alias("seq"))
    )
    names = student.select(
        "institution_id", F.col("id").alias("student_id"), F.col("name").alias("student_name"), "roll_no"
    )
    return pairs.join(names, ["institution_id", "student_id"])
