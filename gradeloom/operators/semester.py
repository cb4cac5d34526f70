"""One semester of plain subject marks out of 100.

Input: ``subject_mark(student_name, semester, seq, subject, mark)``; ``seq``
is the order in which the subjects were entered.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.grading import DEFAULT_BANDS, grade_by_bands
from gradeloom.functions.marks import read_float
from gradeloom.functions.numeric import exact_sums, fmt_f
from gradeloom.functions.text import safe_name, strip
from gradeloom.operators.skew import number_rows

KEYS = ["student_name", "semester"]


def check_marks(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split typed answers (column ``answer``) into marks and rejected rows."""
    mark = read_float(F.lower(strip(F.col("answer"))))
    read = answers.withColumn("mark", mark)
    # NaN compares above every number, so the range rejects it as well
    fine = F.coalesce((F.col("mark") >= 0) & (F.col("mark") <= 100), F.lit(False))
    message = F.when(F.col("mark").isNull(), "Please enter a valid number.").otherwise(
        "Please enter marks between 0 and 100."
    )
    good = read.where(fine).drop("answer")
    return good, read.where(~fine).withColumn("message", message).drop("mark")


def graded_subjects(subject_mark: DataFrame, bands=DEFAULT_BANDS) -> DataFrame:
    """Every subject with its percentage (the mark itself) and grade."""
    return subject_mark.select(
        *KEYS,
        "seq",
        "subject",
        "mark",
        F.col("mark").alias("percentage"),
        grade_by_bands(F.col("mark"), bands).alias("grade"),
    )


def semester_totals(subject_mark: DataFrame) -> DataFrame:
    """Total, maximum and unrounded overall percentage per student and semester."""
    totals = exact_sums(
        subject_mark, KEYS, {"total_marks": F.col("mark")}, {"number_of_subjects": (F.count(F.lit(1)), F.sum)}
    )
    maximum = F.col("number_of_subjects") * 100
    return totals.select(
        *KEYS,
        "number_of_subjects",
        "total_marks",
        maximum.alias("maximum_marks"),
        (F.col("total_marks") / maximum * 100.0).alias("overall_percentage"),
    )


def highest_subjects(subject_mark: DataFrame) -> DataFrame:
    """The subject with the highest mark; the first one on a tie."""
    best = F.max_by(F.struct("subject", "mark"), F.struct(F.col("mark"), -F.col("seq"))).alias("best")
    return subject_mark.groupBy(*KEYS).agg(best).select(
        *KEYS, F.col("best.subject").alias("highest_subject"), F.col("best.mark").alias("highest_mark")
    )


def grade_counts(graded: DataFrame) -> DataFrame:
    """Subjects per grade; order: ``subjects`` descending, then ``first_seq``."""
    return graded.groupBy(*KEYS, "grade").agg(
        F.count(F.lit(1)).alias("subjects"), F.min("seq").alias("first_seq")
    )


def subject_table(graded: DataFrame) -> DataFrame:
    """The numbered result table."""
    return number_rows(graded, KEYS, "seq", "number").select(*KEYS, "number", "subject", "mark", "percentage", "grade")


def certificate_rows(graded: DataFrame) -> DataFrame:
    """Texts of a certificate row and the share a spreadsheet cell holds."""
    return graded.select(
        *KEYS,
        "seq",
        "subject",
        F.concat(fmt_f(F.col("mark"), 0), F.lit("/100")).alias("marks"),
        F.concat(fmt_f(F.col("percentage"), 0), F.lit("%")).alias("percentage"),
        (F.col("percentage") / 100.0).alias("sheet_percentage"),
        "grade",
    )


def summary_block(totals: DataFrame) -> DataFrame:
    return totals.select(
        *KEYS,
        F.concat(fmt_f(F.col("total_marks"), 0), F.lit("/"), F.col("maximum_marks")).alias("total_marks"),
        F.concat(fmt_f(F.col("overall_percentage"), 2), F.lit("%")).alias("overall_percentage"),
        safe_name(F.col("student_name")).alias("file_part"),
    )


def summary_text(subject_mark: DataFrame, bands=DEFAULT_BANDS) -> DataFrame:
    """The summary paragraph of each student.

    The collected array holds one line per grade of the scale, never one per
    subject.
    """
    counts = grade_counts(graded_subjects(subject_mark, bands))
    line = F.concat(F.col("grade"), F.lit(": "), F.col("subjects"), F.lit(" subject(s)\n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("subjects")).alias("n"), "first_seq", line.alias("line"))))
    lines = counts.groupBy(*KEYS).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("lines"))
    block = (
        semester_totals(subject_mark).join(highest_subjects(subject_mark), KEYS).join(lines, KEYS)
    )
    text = F.concat(
        F.lit("STUDENT: "), F.col("student_name"),
        F.lit("\n\nSEMESTER: "), F.col("semester"),
        F.lit("\n\nTOTAL: "), fmt_f(F.col("total_marks"), 0), F.lit("/"), F.col("maximum_marks"),
        F.lit("\n\nOVERALL: "), fmt_f(F.col("overall_percentage"), 2),
        F.lit("%\n\nSUBJECTS: "), F.col("number_of_subjects"),
        F.lit("\n\nPerformance Summary\n-------------------\nHighest: "), F.col("highest_subject"),
        F.lit("\nScore: "), fmt_f(F.col("highest_mark"), 0),
        F.lit("%\n\n"), F.col("lines"),
    )
    return block.select(*KEYS, text.alias("summary"))


def pie_shares(subject_mark: DataFrame) -> DataFrame:
    """Share of each subject in the marks of its student; NULL when all are 0."""
    sums = exact_sums(subject_mark, KEYS, {"_sum": F.col("mark")})
    share = F.try_divide(F.col("mark"), F.col("_sum"))
    label = F.concat(fmt_f(share * 100.0, 1), F.lit("%"))
    return subject_mark.join(sums, KEYS).select(*KEYS, "seq", "subject", share.alias("share"), label.alias("label"))


def bar_series(subject_mark: DataFrame) -> DataFrame:
    return subject_mark.select(
        *KEYS, "seq", "subject", "mark", F.concat(fmt_f(F.col("mark"), 0), F.lit("%")).alias("label")
    )


def radar_series(subject_mark: DataFrame) -> DataFrame:
    """Points of a closed radar line: even angles, the first point repeated."""
    numbered = number_rows(subject_mark, KEYS, "seq", "number")
    sizes = subject_mark.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    step = F.lit(2 * math.pi) / F.col("_n")
    places = F.when(F.col("number") == 1, F.array(F.lit(0).cast("bigint"), F.col("_n"))).otherwise(
        F.array(F.col("number") - 1)
    )
    points = numbered.join(sizes, KEYS).withColumn("point", F.explode(places))
    angle = F.when(F.col("point") == F.col("_n"), F.lit(0.0)).otherwise(F.col("point") * step)
    return points.select(*KEYS, "point", "subject", angle.alias("angle"), "mark")
