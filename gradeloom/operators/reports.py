"""Report tables, chart series and the list of files a report run writes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.grading import pass_label
from gradeloom.functions.numeric import fmt_f, fmt_g
from gradeloom.functions.text import fill_template, safe_name
from gradeloom.operators.skew import number_rows

# Report defaults and file endings.
DEFAULT_REPORTING = {
    "title_template": "{institution} - {term} Result",
    "chart_title_template": "{student} Course Performance",
    "include_chart": True,
    "formats": ["excel", "pdf"],
}
FILE_ENDINGS = {"excel": "_Result.xlsx", "chart": "_chart.png", "pdf": "_Result.pdf"}


def _percent(x: Column, digits: int = 2) -> Column:
    return F.concat(fmt_f(x, digits), F.lit("%"))


def _out_of(obtained: str, maximum: str) -> Column:
    return F.concat(fmt_g(F.col(obtained)), F.lit("/"), fmt_g(F.col(maximum)))


def course_rows(courses: DataFrame) -> DataFrame:
    """The main table of a report, one row per course, ordered by ``pos``."""
    return courses.select(
        "institution_id",
        "student_id",
        "pos",
        F.col("course_name").alias("Course"),
        _out_of("obtained", "maximum").alias("Marks"),
        _percent(F.col("percentage")).alias("Percentage"),
        F.col("grade").alias("Grade"),
        pass_label(F.col("passed")).alias("Result"),
    )


def detail_rows(components: DataFrame) -> DataFrame:
    """The assessment table of a report; unnamed components are left out."""
    return components.where(F.col("name") != "").select(
        "institution_id",
        "student_id",
        "pos",
        "order",
        "seq",
        F.col("course_name").alias("Course"),
        F.col("name").alias("Assessment"),
        fmt_g(F.col("obtained")).alias("Obtained"),
        fmt_g(F.col("max_marks")).alias("Max"),
        fmt_f(F.col("weight"), 2).alias("Weight"),
        _percent(F.col("percentage")).alias("%"),
        F.col("grade").alias("Grade"),
    )


def student_summary(students: DataFrame) -> DataFrame:
    """Identity and totals block of a report."""
    return students.select(
        "institution_id",
        "student_seq",
        "student_id",
        F.concat("student_name", F.lit(" ("), "roll_no", F.lit(")")).alias("student"),
        "org_path",
        "year_name",
        "term_name",
        _out_of("total_obtained", "total_maximum").alias("total_marks"),
        _percent(F.col("overall_percentage")).alias("overall_percentage"),
        F.col("grade").alias("overall_grade"),
        pass_label(F.col("passed")).alias("result"),
    )


def report_title(template: Column) -> Column:
    """``template`` filled from the columns of ``student_results``."""
    return fill_template(
        template,
        {
            "institution": F.col("institution_name"),
            "term": F.col("term_name"),
            "year": F.col("year_name"),
            "student": F.col("student_name"),
            "roll": F.col("roll_no"),
        },
    )


def report_titles(students: DataFrame, reporting: DataFrame) -> DataFrame:
    """Report and chart title of each student under the institution's templates."""
    return students.join(reporting, "institution_id").select(
        "institution_id",
        "student_id",
        report_title(F.col("title_template")).alias("title"),
        report_title(F.col("chart_title_template")).alias("chart_title"),
    )


def course_bars(courses: DataFrame) -> DataFrame:
    """Bar chart series: one bar per course in course order."""
    return courses.select(
        "institution_id",
        "student_id",
        "pos",
        "course_name",
        "percentage",
        _percent(F.col("percentage"), 1).alias("label"),
    )


def report_manifest(students: DataFrame, reporting: DataFrame) -> DataFrame:
    """Files a report run writes: excel, then chart (only with pdf), then pdf.

    ``writers`` counts the students whose names lead to the same file.
    """
    has = {kind: F.array_contains("formats", kind) for kind in ("excel", "pdf")}
    wanted = {
        "excel": has["excel"],
        "chart": has["pdf"] & F.col("include_chart"),
        "pdf": has["pdf"],
    }
    kinds = F.array_compact(F.array(*[F.when(wanted[k], F.lit(k)) for k in ("excel", "chart", "pdf")]))
    ending = F.when(F.col("kind") == "excel", FILE_ENDINGS["excel"]).when(
        F.col("kind") == "chart", FILE_ENDINGS["chart"]
    ).otherwise(FILE_ENDINGS["pdf"])
    files = (
        students.join(reporting, "institution_id")
        .select("institution_id", "student_seq", "student_id", "student_name", F.explode(kinds).alias("kind"))
        .withColumn("file_name", F.concat(safe_name(F.col("student_name")), ending))
        .drop("student_name")
    )
    writers = files.groupBy("institution_id", "file_name").agg(F.count(F.lit(1)).alias("writers"))
    return files.join(writers, ["institution_id", "file_name"])


def offering_list(offering: DataFrame, course: DataFrame) -> DataFrame:
    """Numbered offerings for a choice; a missing course shows its id."""
    names = course.select("institution_id", F.col("id").alias("course_id"), F.col("name").alias("_name"))
    numbered = number_rows(
        offering.select("institution_id", "seq", F.col("id").alias("offering_id"), "course_id"),
        ["institution_id"],
        "seq",
        "number",
    )
    return numbered.join(names, ["institution_id", "course_id"], "left").select(
        "institution_id", "number", "offering_id", F.coalesce("_name", "course_id").alias("course_name")
    )
