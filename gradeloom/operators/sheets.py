"""Sheets as a cell table: headers, layouts and column roles.

``cells(institution_id, workbook, sheet, sheet_no, row_no, col_no, value,
value_kind)`` holds one row per stored cell, of any number of workbooks.
``workbooks(institution_id, workbook, offering_hint, legacy)`` holds how each
is to be read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import normal_header, strip
from gradeloom.operators.labels import resolve_assessments, resolve_hints, resolve_offerings
from gradeloom.session import settle

SHEET = ["institution_id", "workbook", "sheet_no"]

# Header texts that name the columns of a student row.
ROLL_HEADERS = (
    "roll no", "roll", "rollno", "reg no", "reg", "regno",
    "admission no", "adm no", "enrolment no", "enrollment no",
)
NAME_HEADERS = ("student name", "student", "name", "student's name")
CLASS_HEADERS = ("class", "section", "class/section", "class - section")
SUBJECT_HEADERS = ("subject", "subjects")
MARKS_HEADER = "marks"

BLOCK_CELLS = 1 << 18  # cells of a sheet that one task reads together


def filled(cells: DataFrame) -> DataFrame:
    """Cells that hold something; a row or sheet without any is blank."""
    return cells.where(F.coalesce("value", F.lit("")) != "")


def sheet_sizes(cells: DataFrame) -> DataFrame:
    """(sheet, header_row, n_cells): the first row with a filled cell, NULL if none, and how many are filled."""
    holds = F.coalesce(F.col("value"), F.lit("")) != ""
    # The name is a key here: the least text of a group would have all cells sorted.
    named = cells.groupBy(*SHEET, "sheet").agg(
        F.min(F.when(holds, F.col("row_no"))).alias("header_row"), F.count(F.when(holds, 1)).alias("n_cells")
    )
    return named.groupBy(*SHEET).agg(
        F.min("sheet").alias("sheet"), F.min("header_row").alias("header_row"), F.sum("n_cells").alias("n_cells")
    )


def sheet_list(cells: DataFrame) -> DataFrame:
    """(sheet, header_row): the first row with a filled cell, NULL if none."""
    return sheet_sizes(cells).drop("n_cells")


def large_sheets(sizes: DataFrame) -> DataFrame:
    """Sheets of more cells than a task should read, and the number of blocks their rows are dealt to."""
    blocks = F.ceil(F.col("n_cells") / F.lit(BLOCK_CELLS)).cast("bigint")
    return sizes.where(F.col("n_cells") > BLOCK_CELLS).select(*SHEET, blocks.alias("n_blocks"))


def import_notes(sheets: DataFrame) -> DataFrame:
    note = F.concat(F.lit("Sheet '"), F.col("sheet"), F.lit("': empty, ignored."))
    return sheets.where("header_row IS NULL").select(*SHEET, "sheet", note.alias("note"))


def header_cells(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Cells of the header rows with their comparison text ``norm``."""
    rows = sheets.where("header_row IS NOT NULL").withColumnRenamed("header_row", "row_no").select(*SHEET, "row_no")
    # Sheets share a few header rows; only cells of rows with these numbers meet the sheets.
    numbers = settle(rows.select("row_no").distinct())
    return (
        filled(cells)
        .join(numbers, "row_no", "left_semi")
        .join(rows, [*SHEET, "row_no"])
        .withColumn("norm", normal_header(F.col("value"), F.col("value_kind")))
        .select(*SHEET, "sheet", F.col("row_no").alias("header_row"), "col_no", "value", "norm")
    )


def _first_column(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("col_no")))


def classify_sheets(sheets: DataFrame, headers: DataFrame, workbooks: DataFrame) -> DataFrame:
    """Per non-blank sheet: identity columns, layout or header error."""
    norm = F.col("norm")
    earlier = F.min("col_no").over(Window.partitionBy(*SHEET, "norm"))
    marked = headers.withColumn("repeats", (norm != "") & (F.col("col_no") > earlier))
    roles = marked.groupBy(*SHEET).agg(
        _first_column(norm.isin(*ROLL_HEADERS)).alias("roll_col"),
        _first_column(norm.isin(*NAME_HEADERS)).alias("name_col"),
        _first_column(norm.isin(*CLASS_HEADERS)).alias("class_col"),
        _first_column(norm.isin(*SUBJECT_HEADERS)).alias("subject_col"),
        _first_column(norm == MARKS_HEADER).alias("marks_col"),
        F.min(F.when(F.col("repeats"), F.struct("col_no", "value"))).alias("repeat"),
    )
    known = sheets.where("header_row IS NOT NULL").join(roles, SHEET).join(workbooks, ["institution_id", "workbook"])
    subject, marks = F.col("subject_col").isNotNull(), F.col("marks_col").isNotNull()
    named = F.col("roll_col").isNotNull() | F.col("name_col").isNotNull()
    legacy = F.coalesce(F.col("legacy"), F.lit(False))
    plain = subject | marks
    problem = (
        F.when(F.col("repeat").isNotNull(), F.concat(F.lit("duplicate header '"), F.col("repeat.value"), F.lit("'")))
        .when((plain | legacy) & ~named, F.lit("legacy sheet needs a student identity column"))
        .when(plain & ~(subject & marks) & ~legacy, F.lit("cannot determine legacy column layout"))
        .when(~named, F.lit("no student identity column (expected 'Roll No'/'Student Name')"))
    )
    layout = (
        F.when(subject & marks, "legacy_long")
        .when(plain, F.when(subject, "legacy_wide").otherwise("legacy_long"))
        .when(legacy, "legacy_wide")
        .otherwise("native")
    )
    unreadable = (layout == "legacy_long") & ~(subject & marks)
    error = F.coalesce(
        F.concat(F.lit("invalid header: "), problem),
        F.when(unreadable, F.lit("legacy long layout needs 'Subject' and 'Marks' columns")),
    )
    return known.select(
        *SHEET, "sheet", "header_row", "offering_hint", "roll_col", "name_col", "class_col", "subject_col", "marks_col",
        F.when(problem.isNull(), layout).alias("layout"), error.alias("error"),
    )


def split_prefix(value: Column) -> tuple[Column, Column]:
    """``prefix: name`` or ``prefix|name``; a colon counts before a bar."""
    separator = F.when(F.contains(value, F.lit(":")), F.lit(":")).otherwise(F.lit("|"))
    at = F.locate(":", value)
    at = F.when(at > 0, at).otherwise(F.locate("|", value))
    prefix = F.substring(value, F.lit(1), at - 1)
    suffix = F.substring(value, at + F.length(separator), F.length(value))
    return strip(prefix), strip(suffix)


def native_columns(
    classified: DataFrame, headers: DataFrame, settings: DataFrame, offering: DataFrame, course: DataFrame, assessment: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Mark columns of native sheets with their assessment, and sheet errors.

    Without prefixed headers the sheet name (or the hint, where the
    institution expects no course names) gives the offering; with any, only
    prefixed columns count. The first failing step of a sheet, in the order of
    the steps and then of the columns, is its error.
    """
    good, failed, texts = judged_columns(classified, headers, settings, offering, course, assessment)
    told = failed.join(texts, "label_no", "left").withColumn("error", F.coalesce("error", "label_error"))
    return good, told.select(*SHEET, "sheet", "header_row", "error")


def judged_columns(
    classified: DataFrame, headers: DataFrame, settings: DataFrame, offering: DataFrame, course: DataFrame, assessment: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``native_columns``, but the message of a label that names no single offering stands once, in the third
    result (label_no, label_error): it may name many ids and hold for many sheets, whose errors have its ``label_no``.
    """
    native = classified.where("layout = 'native' AND error IS NULL").join(
        settings.select("institution_id", "expect_course_prefix"), "institution_id", "left"
    )
    by_name = F.coalesce(F.col("expect_course_prefix"), F.lit(True))
    native = native.withColumn("by_name", by_name).withColumn("hint", F.nullif(F.col("offering_hint"), F.lit("")))
    free = headers.where("norm <> ''").select(*SHEET, "col_no", "value").join(
        native.select(*SHEET, "sheet", "header_row", "by_name", "hint", "roll_col", "name_col"), SHEET
    )
    identity = F.coalesce(F.col("col_no") == F.col("roll_col"), F.lit(False)) | F.coalesce(
        F.col("col_no") == F.col("name_col"), F.lit(False)
    )
    prefixed = F.col("by_name") & F.col("value").rlike("[:|]")
    prefix, suffix = split_prefix(F.col("value"))
    free = settle(
        free.where(~identity)
        .withColumn("prefixed", prefixed)
        .withColumn("prefix", F.when(F.col("prefixed"), prefix))
        .withColumn("name", F.when(F.col("prefixed"), suffix).otherwise(strip(F.col("value"))))
    )
    # step 1: offerings of prefixed columns
    some = free.where("prefixed").select(*SHEET).distinct().withColumn("has_prefix", F.lit(True))
    asked_prefixes = free.where("prefixed AND name <> ''").select("institution_id", F.col("prefix").alias("label"))
    plain = settle(native.join(some, SHEET, "left").withColumn("has_prefix", F.coalesce("has_prefix", F.lit(False))))
    named = plain.where("by_name AND NOT has_prefix")
    asked = settle(asked_prefixes.unionByName(named.select("institution_id", F.col("sheet").alias("label"))).distinct())
    answers = resolve_offerings(asked, offering, course).withColumn("label_no", -1 - F.monotonically_increasing_id())
    answers = settle(answers)
    texts = answers.where("error IS NOT NULL").select("label_no", F.col("error").alias("label_error"))
    # Messages of an institution differ no later than in their labels; so this part of one gives their order.
    start = F.substring(F.col("error"), F.lit(1), F.length("label") + 40)
    offerings = answers.select(
        "institution_id", "label", "offering_id", start.alias("start"), F.when(F.col("error").isNotNull(), F.col("label_no")).alias("label_no")
    )
    hints = resolve_hints(plain.where("NOT by_name AND hint IS NOT NULL"), offering)
    # one offering per sheet without prefixes
    of_sheet = (
        plain.where("NOT has_prefix")
        .join(offerings.select("institution_id", F.col("label").alias("sheet"), F.col("offering_id").alias("named_id"), F.col("label_no").alias("named_no")), ["institution_id", "sheet"], "left")
        .join(hints.select("institution_id", "hint", F.col("offering_id").alias("hinted_id"), F.col("error").alias("hint_error")), ["institution_id", "hint"], "left")
    )
    differs = F.concat(
        F.lit("sheet '"), F.col("sheet"), F.lit("' resolves to offering '"), F.col("named_id"),
        F.lit("', not '--offering "), F.col("hint"), F.lit("'"),
    )
    sheet_error = F.when(
        F.col("by_name"),
        F.when(F.col("named_no").isNull() & (F.col("hint") != F.col("named_id")), differs),
    ).otherwise(
        F.when(F.col("hint").isNull(), F.lit("--offering is required when excel.expect_course_prefix is false")).otherwise(F.col("hint_error"))
    )
    of_sheet = settle(of_sheet.select(
        *SHEET, F.coalesce("hinted_id", "named_id").alias("sheet_offering"), sheet_error.alias("sheet_error"),
        F.when(F.col("by_name"), F.col("named_no")).alias("sheet_label"),
    ))
    columns = (
        free.join(some, SHEET, "left")
        .where("prefixed OR has_prefix IS NULL")
        .join(of_sheet, SHEET, "left")
        .join(offerings.select("institution_id", F.col("label").alias("prefix"), "offering_id", F.col("start").alias("prefix_error"), F.col("label_no").alias("prefix_no")), ["institution_id", "prefix"], "left")
    )
    no_name = F.concat(F.lit("prefixed column '"), F.col("value"), F.lit("' has no assessment name"))
    first_error = F.when(F.col("prefixed"), F.when(F.col("name") == "", no_name).otherwise(F.col("prefix_error")))
    columns = settle(columns.select(
        *SHEET, "col_no", "name",
        F.when(F.col("prefixed"), F.col("offering_id")).otherwise(F.col("sheet_offering")).alias("offering_id"),
        first_error.alias("error_1"), F.when(F.col("prefixed") & (F.col("name") != ""), F.col("prefix_no")).alias("label_1"),
    ))
    # step 2: the assessment of every column
    assessments = resolve_assessments(columns.where("offering_id IS NOT NULL AND name <> ''"), assessment)
    columns = settle(columns.join(
        assessments.withColumnRenamed("error", "error_2"), ["institution_id", "offering_id", "name"], "left"
    ))
    no_label = F.lit(None).cast("bigint")
    steps = F.when(F.col("error_1").isNotNull(), F.struct(F.lit(1).alias("step"), "col_no", F.col("error_1").alias("error"), F.col("label_1").alias("label_no"))).when(
        F.col("error_2").isNotNull(), F.struct(F.lit(2).alias("step"), "col_no", F.col("error_2").alias("error"), no_label.alias("label_no"))
    )
    column_errors = columns.groupBy(*SHEET).agg(F.min(steps).alias("first"))
    of_whole = F.col("sheet_error").isNotNull() | F.col("sheet_label").isNotNull()
    failed = (
        native.select(*SHEET, "sheet", "header_row")
        .join(of_sheet.select(*SHEET, "sheet_error", "sheet_label"), SHEET, "left")
        .join(column_errors, SHEET, "left")
        .withColumn("label_no", F.when(of_whole, F.col("sheet_label")).otherwise(F.col("first.label_no")))
        .withColumn("error", F.when(of_whole, F.col("sheet_error")).when(F.col("label_no").isNull(), F.col("first.error")))
        .where("error IS NOT NULL OR label_no IS NOT NULL")
        .select(*SHEET, "sheet", "header_row", "error", "label_no")
    )
    good = columns.where("assessment_id IS NOT NULL").join(failed.select(*SHEET), SHEET, "left_anti")
    return good.select(*SHEET, "col_no", "offering_id", "assessment_id", "assessment_name", "max_marks"), failed, texts


def subject_columns(classified: DataFrame, headers: DataFrame) -> DataFrame:
    """Columns of legacy wide sheets that hold the marks of a subject."""
    wide = classified.where("layout = 'legacy_wide' AND error IS NULL").select(*SHEET, "roll_col", "name_col", "class_col")
    taken = [F.coalesce(F.col("col_no") == F.col(c), F.lit(False)) for c in ("roll_col", "name_col", "class_col")]
    return (
        headers.where("norm <> ''")
        .join(wide, SHEET)
        .where(~(taken[0] | taken[1] | taken[2]))
        .select(*SHEET, "col_no", strip(F.col("value")).alias("subject"))
    )


def with_blocks(cells: DataFrame, large: DataFrame) -> DataFrame:
    """Add ``block``: 0, or the part of a large sheet that the row is dealt to. Joining per block keeps a huge sheet in parts."""
    dealt = F.pmod(F.xxhash64("row_no"), F.col("n_blocks"))
    return cells.join(large, SHEET, "left").withColumn("block", F.coalesce(dealt, F.lit(0).cast("bigint"))).drop("n_blocks")


def in_blocks(facts: DataFrame, large: DataFrame) -> DataFrame:
    """A row of ``facts``(sheet) for every block of its sheet."""
    last = F.coalesce(F.col("n_blocks"), F.lit(1).cast("bigint")) - 1
    return facts.join(large, SHEET, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("n_blocks")
