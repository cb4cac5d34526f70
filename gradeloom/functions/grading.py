"""Percentages to letters, marks to percentages, pass or fail."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven-band scale used when none is configured.
DEFAULT_BANDS = (
    (90.0, "A+"),
    (80.0, "A"),
    (70.0, "B+"),
    (60.0, "B"),
    (50.0, "C"),
    (40.0, "D"),
    (0.0, "F"),
)


def grade_for(percentage: Column, bands: Column) -> Column:
    """The grade of the first band reached, else of the last band, else ''.

    ``bands`` is ARRAY<STRUCT<min_percentage, grade>> from high to low. NaN
    reaches no band.
    """
    reached = F.filter(bands, lambda band: ~F.isnan(percentage) & (percentage >= band["min_percentage"]))
    return F.coalesce(
        F.get(reached, 0)["grade"], F.try_element_at(bands, F.lit(-1))["grade"], F.lit("")
    )


def grade_by_bands(mark: Column, bands=DEFAULT_BANDS) -> Column:
    """The same rule for a scale known when the plan is written."""
    if not bands:
        return F.lit("")
    grade = None
    for minimum, letter in bands:
        reached = ~F.isnan(mark) & (mark >= minimum)
        grade = F.when(reached, letter) if grade is None else grade.when(reached, letter)
    return grade.otherwise(bands[-1][1])


def sort_bands(bands: Column) -> Column:
    """Bands from high to low; bands with the same minimum keep their order."""
    numbered = F.transform(
        bands, lambda band, n: F.struct((-band["min_percentage"]).alias("k"), n.alias("n"), band.alias("band"))
    )
    return F.transform(F.array_sort(numbered), lambda item: item["band"])


def effective_mark(obtained: Column, status: Column) -> Column:
    """Only an entered mark counts; absent, exempt and missing count zero."""
    return F.when(status == "entered", obtained).otherwise(F.lit(0.0))


def component_percentage(obtained: Column, max_marks: Column) -> Column:
    return F.when(max_marks > 0, obtained / max_marks * 100.0).otherwise(F.lit(0.0))


def reaches(percentage: Column, threshold: Column) -> Column:
    """``percentage >= threshold`` where NaN reaches nothing."""
    return ~F.isnan(percentage) & (percentage >= threshold)


def course_passed(has_rules: Column, threshold: Column, percentage: Column) -> Column:
    """No rule set or no threshold passes every course."""
    return F.when(~has_rules | threshold.isNull(), F.lit(True)).otherwise(reaches(percentage, threshold))


def student_passed(has_rules: Column, pass_percentage: Column, overall: Column, all_courses: Column) -> Column:
    """The overall threshold and every course; NaN is not below the threshold."""
    below = ~F.isnan(overall) & (overall < pass_percentage)
    return (
        F.when(~has_rules, F.lit(True))
        .when(below, F.lit(False))
        .otherwise(F.coalesce(all_courses, F.lit(True)))
    )


def pass_label(passed: Column) -> Column:
    return F.when(passed, F.lit("Pass")).otherwise(F.lit("Fail"))
