"""Validate workbooks into a plan; apply a plan to stored tables.

Validation never writes to the store. Students are resolved over all workbooks of an
institution in the order of their names, each workbook seeing the students that
earlier ones make; marks and errors of all workbooks of a run are judged together.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.marks import parse_mark, problem_text, read_float
from gradeloom.functions.text import clean_text, safe_name, strip
from gradeloom.operators.identity import BOOK, judge_students
from gradeloom.operators.labels import only_assessments, resolve_org_units, resolve_subjects
from gradeloom.operators.results import Domain
from gradeloom.operators.sheets import (
    SHEET,
    classify_sheets,
    filled,
    header_cells,
    import_notes,
    in_blocks,
    judged_columns,
    large_sheets,
    sheet_sizes,
    subject_columns,
    with_blocks,
)
from gradeloom.operators.skew import running_total
from gradeloom.session import settle

ROW = [*SHEET, "row_no"]
_LABEL = ["institution_id", "class_label", "subject"]
_ERROR = [*SHEET, "sheet", "row_no", "col_no", "column_name", "message"]
_ROWS_PER_SHEET = 1 << 36  # rows of a sheet fit below the sheet number in ``ord``


class ImportRefused(ValueError):
    """A plan with errors was applied without skipping them."""


@dataclass
class ImportPlan:
    """What a run would write, and what is wrong.

    ``marks``: institution_id, workbook, ord, col_no, sheet, row_no,
    column_name, student_id, offering_id, assessment_id, obtained, status.
    ``errors``: SHEET, sheet, row_no, col_no, column_name, message.
    ``new_students``: institution_id, workbook, ord, student_id, name, roll_no.
    ``notes``: SHEET, sheet, note.

    ``found`` gives the errors; they are gathered when first asked for. The message of a label stands once in ``texts``
    (label_no, label_error), since it may name many ids and hold for many cells; ``errors`` puts it in.
    """

    marks: DataFrame
    found: Callable[[], DataFrame]
    new_students: DataFrame
    notes: DataFrame
    texts: DataFrame | None = None

    @cached_property
    def places(self) -> DataFrame:
        """The errors, without the messages of labels."""
        return self.found()

    def with_messages(self, places: DataFrame) -> DataFrame:
        """``places``, some of the plan's, as errors with their messages."""
        return places if self.texts is None else _with_texts(places, self.texts)

    @property
    def errors(self) -> DataFrame:
        return self.with_messages(self.places)


def _with_texts(places: DataFrame, texts: DataFrame) -> DataFrame:
    return places.join(texts, "label_no", "left").withColumn("message", F.coalesce("message", "label_error")).select(*_ERROR)


def row_order(sheet_no: Column, row_no: Column) -> Column:
    """The place of a row in its workbook; fails loudly where sheet and row do not fit one number."""
    place = sheet_no.cast("bigint") * F.lit(_ROWS_PER_SHEET) + row_no
    fits = sheet_no.between(0, (1 << 26) - 1) & row_no.between(0, _ROWS_PER_SHEET - 1)
    return F.when(fits | sheet_no.isNull() | row_no.isNull(), place).otherwise(F.raise_error(F.lit("sheet or row number out of range")))


def _error(rows: DataFrame, column: Column, message: Column, col_no: Column | None = None, more: tuple = ()) -> DataFrame:
    place = F.lit(0) if col_no is None else col_no
    return rows.select(
        *SHEET, "sheet", F.col("row_no").cast("bigint").alias("row_no"), place.cast("int").alias("col_no"),
        column.alias("column_name"), message.alias("message"), *more,
    )


_COLUMN = ["col_no", "column_name", "offering_id", "assessment_id", "max_marks"]


def sheet_facts(classified: DataFrame, mark_columns: DataFrame, subjects: DataFrame) -> DataFrame:
    """Readable sheets with their mark columns: ``columns``, of _COLUMN; those of subjects know no offering yet."""
    native = mark_columns.withColumnRenamed("assessment_name", "column_name").select(*SHEET, *_COLUMN)
    wide = subjects.withColumnRenamed("subject", "column_name")
    both = native.unionByName(wide.select(*SHEET, "col_no", "column_name"), allowMissingColumns=True)
    columns = both.groupBy(*SHEET).agg(F.collect_list(F.struct(*_COLUMN)).alias("columns"))
    return classified.where("error IS NULL").drop("error", "offering_hint").dropDuplicates(SHEET).join(columns, SHEET, "left")


def sheet_rows(cells: DataFrame, facts: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Rows below the header of readable sheets with their identity texts and, in ``marks``, the cells of mark columns.

    Cells are shuffled once, by sheets and, where a sheet is one of ``large``, by blocks of its rows: so a sheet with a
    third of all cells is read in parts, and a row finds all its cells in its part. Rows, not cells, meet their sheets.
    """
    large = settle(large_sheets(sheet_sizes(cells))) if large is None else large
    part = [*SHEET, "block"]
    known = cells.where("institution_id IS NOT NULL AND workbook IS NOT NULL AND sheet_no IS NOT NULL AND row_no IS NOT NULL")
    dealt = with_blocks(known.select(*ROW, "col_no", "value", "value_kind"), large).repartition(*part)
    # A number that nearly tells the row comes first, so that sorting seldom compares texts.
    row = Window.partitionBy(F.xxhash64(*part, "row_no"), *part, "row_no").orderBy("col_no")
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.collect_list(F.struct("col_no", "value", "value_kind")).over(whole)
    rows = dealt.select(*part, "row_no", found.alias("cells"), F.row_number().over(row).alias("n")).where("n = 1")
    body = rows.join(in_blocks(facts, large), part).where("row_no > header_row")

    def here(column: Column) -> Column:
        return F.filter("cells", lambda cell: cell["col_no"] == column)

    def text_in(column: str) -> Column:
        texts = F.transform(here(F.col(column)), lambda cell: clean_text(cell["value"], cell["value_kind"]))
        return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.coalesce(F.array_max(texts), F.lit("")))

    def raw_in(column: str, what: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.array_max(here(F.col(column))[what]))

    def marks_of(column: Column) -> Column:
        known = [column[c].alias(c) for c in _COLUMN]
        return F.transform(here(column["col_no"]), lambda cell: F.struct(*known, cell["value"].alias("value"), cell["value_kind"].alias("value_kind")))

    return body.select(
        *ROW, "sheet", "layout",
        text_in("roll_col").alias("roll"),
        text_in("name_col").alias("name"),
        text_in("class_col").alias("class_label"),
        text_in("subject_col").alias("subject"),
        raw_in("marks_col", "value").alias("mark_value"),
        raw_in("marks_col", "value_kind").alias("mark_kind"),
        F.flatten(F.transform(F.coalesce("columns", F.array()), marks_of)).alias("marks"),
    )


def judge_rows(rows: DataFrame, student: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with a student, errors, new students)."""
    nobody = (F.col("roll") == "") & (F.col("name") == "")
    no_subject = (F.col("layout") == "legacy_long") & (F.col("subject") == "")
    asking = rows.where(~nobody & ~no_subject).withColumn("ord", row_order(F.col("sheet_no"), F.col("row_no")))
    verdict, made = judge_students(asking, student)
    judged = settle(verdict.where("institution_id IS NOT NULL AND workbook IS NOT NULL AND ord IS NOT NULL"))
    who = strip(F.concat_ws(" ", "roll", "name"))
    errors = (
        _error(rows.where(nobody), F.lit(""), F.lit("missing student identity"))
        .unionByName(_error(rows.where(~nobody & no_subject), F.lit("Subject"), F.lit("missing subject")))
        .unionByName(_error(judged.where("error IS NOT NULL"), who, F.col("error")))
    )
    return judged.where("error IS NULL").drop("error", "is_new"), errors, made


def _with_subjects(asked: DataFrame, domain: Domain, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add offering, assessment, max_marks and, where the label is wrong, ``label_no`` to rows asking for
    (institution_id, class_label, subject); the second result is (label_no, label_error), one row for each wrong label."""
    pairs = asked.select(*_LABEL).distinct()
    units = resolve_org_units(pairs.where("class_label <> ''"), domain.org_unit)
    placed = settle(
        pairs.join(units.withColumnRenamed("error", "unit_error"), ["institution_id", "class_label"], "left").withColumn(
            "org_unit_id", F.coalesce("org_unit_id", F.lit(""))
        )
    )
    subjects = settle(resolve_subjects(placed.where("unit_error IS NULL"), domain.offering, domain.course, settings))
    found = placed.join(subjects.withColumnRenamed("error", "subject_error"), ["institution_id", "subject", "org_unit_id"], "left")
    only = only_assessments(subjects.where("offering_id IS NOT NULL"), domain.assessment)
    found = found.join(only.withColumnRenamed("error", "only_error"), ["institution_id", "offering_id"], "left")
    error = F.coalesce("unit_error", "subject_error", "only_error").alias("label_error")
    answers = found.select(*_LABEL, "offering_id", "assessment_id", "max_marks", error)
    answers = settle(answers.withColumn("label_no", F.monotonically_increasing_id()))
    texts = answers.where("label_error IS NOT NULL").select("label_no", "label_error")
    answers = answers.withColumn("label_no", F.when(F.col("label_error").isNotNull(), F.col("label_no"))).drop("label_error")
    return asked.join(answers, _LABEL, "left"), texts


_ENTRY = [*ROW, "sheet", "ord", "student_id", "col_no", "column_name", "value", "value_kind", "offering_id", "assessment_id", "max_marks", "label_no", "single"]


def idle_rows(rows: DataFrame, used: DataFrame) -> DataFrame:
    """Errors of student rows without a mark: ``rows``(ROW, sheet, layout) that no row of ``used``, cells
    with a mark or an error of their own, belongs to. A row of the long layout is one mark and never idle."""
    idle = rows.where("layout <> 'legacy_long'").join(used.select(*ROW).distinct(), ROW, "left_anti")
    return _error(idle, F.lit(""), F.lit("student row has no marks"))


def validate(cells: DataFrame, workbooks: DataFrame, settings: DataFrame, domain: Domain) -> ImportPlan:
    """Judge every sheet, row and cell of the given workbooks.

    ``settings``: institution_id, expect_course_prefix, default_year,
    default_term. Only readable cells of known columns reach the mark parser;
    everything else becomes an error row with its place. Sheets are judged at once; rows, marks and
    errors when first asked for.
    """
    return ValidatedPlan(cells, workbooks, settings, domain)


class ValidatedPlan(ImportPlan):
    """The plan of a validation; ``classified``: its non-blank sheets with their layouts."""

    def __init__(self, cells: DataFrame, workbooks: DataFrame, settings: DataFrame, domain: Domain):
        self._cells, self._settings, self._domain = cells, settings, domain
        self._sizes = settle(sheet_sizes(cells))
        self.notes = import_notes(self._sizes)
        self._headers = settle(header_cells(cells, self._sizes))
        self.classified = settle(classify_sheets(self._sizes.drop("n_cells"), self._headers, workbooks))
        columns, failed, self._sheet_texts = judged_columns(
            self.classified, self._headers, settings, domain.offering, domain.course, domain.assessment
        )
        self._columns, self._failed = settle(columns), settle(failed)

    @property
    def sheet_places(self) -> DataFrame:
        """The errors that stand for whole sheets, at their header rows; those of labels without messages."""
        wrong = self.classified.where("error IS NOT NULL").select(*SHEET, "sheet", "header_row", "error")
        wrong = wrong.unionByName(self._failed, allowMissingColumns=True).withColumnRenamed("header_row", "row_no")
        return _error(wrong, F.lit(""), F.col("error"), more=("label_no",))

    @cached_property
    def _judged_rows(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        readable = self.classified.join(self._failed.select(*SHEET), SHEET, "left_anti")
        facts = settle(sheet_facts(readable, self._columns, subject_columns(readable, self._headers)))
        rows = sheet_rows(filled(self._cells), facts, settle(large_sheets(self._sizes)))
        return judge_rows(settle(rows), self._domain.student)

    @property
    def new_students(self) -> DataFrame:
        return self._judged_rows[2]

    def _found_cells(self, layout: str) -> DataFrame:
        """Cells of known columns: native ones have an assessment, wide ones a subject."""
        found = self._judged_rows[0].where(F.col("layout") == layout)
        return found.select(*ROW, "sheet", "ord", "student_id", "class_label", F.inline("marks")).withColumn("single", F.lit(False))

    @cached_property
    def _native(self) -> DataFrame:
        """Native cells with their marks."""
        return _parsed(self._found_cells("native").withColumn("label_no", F.lit(None).cast("bigint")))

    @cached_property
    def _legacy(self) -> tuple[DataFrame, DataFrame]:
        """Cells of legacy sheets with their marks, and the messages of their labels."""
        # legacy long: one mark per row
        long_rows = self._judged_rows[0].where("layout = 'legacy_long'").select(
            *ROW, "sheet", "ord", "student_id", "class_label", "subject", F.lit(0).alias("col_no"),
            F.col("subject").alias("column_name"), F.col("mark_value").alias("value"), F.col("mark_kind").alias("value_kind"),
            F.lit(True).alias("single"),
        )
        wide_cells = self._found_cells("legacy_wide").withColumn("subject", F.col("column_name"))
        asked = long_rows.unionByName(wide_cells.select(*long_rows.columns))
        legacy, texts = _with_subjects(asked, self._domain, self._settings)
        return _parsed(legacy), texts

    @cached_property
    def texts(self) -> DataFrame:
        return self._sheet_texts.unionByName(self._legacy[1])

    @cached_property
    def native_marks(self) -> DataFrame:
        """The marks of native sheets."""
        return settle(_marks(self._native))

    @cached_property
    def marks(self) -> DataFrame:
        return self.native_marks.unionByName(settle(_marks(self._legacy[0])))

    def told_sheets(self, places: DataFrame) -> DataFrame:
        """``places``, some of ``sheet_places``, as errors with their messages."""
        return _with_texts(places, self._sheet_texts)

    def found(self) -> DataFrame:
        rows, row_errors, _ = self._judged_rows
        judged = settle(self._native.unionByName(self._legacy[0]))
        problem = problem_text(F.col("problem"), F.col("value"), F.col("obtained"), F.col("max_marks"))
        message = F.when(F.col("label_no").isNull(), problem)
        cell_errors = _error(judged.where(_WRONG), F.col("column_name"), message, F.col("col_no"), ("label_no",))
        missing = judged.where(F.col("single") & ~F.expr(_WRONG) & F.col("status").isNull())
        other_errors = (
            row_errors.unionByName(_error(missing, F.col("column_name"), F.lit("missing mark")))
            .unionByName(idle_rows(rows, judged.where(F.expr(_WRONG) | F.col("status").isNotNull())))
        )
        return settle(other_errors.unionByName(cell_errors, allowMissingColumns=True).unionByName(self.sheet_places))


_WRONG = "label_no IS NOT NULL OR problem IS NOT NULL"


def _parsed(cells: DataFrame) -> DataFrame:
    """Cells with ``status``, ``obtained`` and ``problem`` of their marks, read once however often they are used."""
    mark = parse_mark(F.col("value"), F.col("value_kind"), F.col("max_marks"))
    return cells.select(*_ENTRY, F.inline(F.array(mark)))


def _marks(entries: DataFrame) -> DataFrame:
    return entries.where(~F.expr(_WRONG) & F.col("status").isNotNull()).select(
        *BOOK, "ord", "col_no", "sheet", "row_no", "column_name", "student_id", "offering_id", "assessment_id", "obtained", "status"
    )


def render_errors(errors: DataFrame) -> DataFrame:
    """``sheet row N (column): message``."""
    where_ = F.concat(
        "sheet",
        F.when(F.col("row_no").isNotNull(), F.concat(F.lit(" row "), "row_no")).otherwise(F.lit("")),
        F.when(F.col("column_name") != "", F.concat(F.lit(" ("), "column_name", F.lit(")"))).otherwise(F.lit("")),
    )
    return errors.withColumn("text", F.concat(where_, F.lit(": "), "message"))


_PERIOD = ["institution_id", "student_id", "year_id", "term_key", "org_key"]


def _period(rows: DataFrame) -> DataFrame:
    """Add comparable period keys: '' stands for no term and no org unit."""
    return rows.withColumn("term_key", F.coalesce("term_id", F.lit(""))).withColumn(
        "org_key", F.coalesce("org_unit_id", F.lit(""))
    )


def planned_enrollments(plan: ImportPlan, offering: DataFrame) -> DataFrame:
    """(student, period, offering_id, first): offerings the marks enroll in.

    ``first`` is the place of the first mark; it orders enrollments and the
    offerings inside one.
    """
    periods = _period(offering).select("institution_id", F.col("id").alias("offering_id"), "year_id", "term_key", "org_key")
    first = plan.marks.groupBy("institution_id", "student_id", "offering_id").agg(F.min(F.struct("workbook", "ord", "col_no")).alias("first"))
    return first.join(periods, ["institution_id", "offering_id"])


def preview(plan: ImportPlan, offering: DataFrame) -> DataFrame:
    """Counts per workbook before anything is written."""
    periods = _period(offering).select("institution_id", F.col("id").alias("offering_id"), "year_id", "term_key", "org_key")
    enrollments = (
        plan.marks.select(*BOOK, "student_id", "offering_id").distinct()
        .join(periods, ["institution_id", "offering_id"])
        .groupBy(*BOOK, "student_id", "year_id", "term_key", "org_key").agg(F.lit(1).alias("one"))
    )
    counted = [
        (plan.new_students, "students"), (enrollments, "enrollments"), (plan.marks, "marks"), (plan.places, "invalid"),
    ]
    parts = None
    for rows, name in counted:
        part = rows.groupBy(*BOOK).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    sums = [F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for _, name in counted]
    return parts.groupBy(*BOOK).agg(*sums)


def enrollment_id(student: Column, year: Column, term: Column, org: Column) -> Column:
    def part(value: Column, missing: str) -> Column:
        return safe_name(F.coalesce(F.nullif(value, F.lit("")), F.lit(missing)))

    return F.concat_ws("_", F.lit("enroll"), safe_name(student), safe_name(year), part(term, "na"), part(org, "na"))


class Applied:
    """Stored tables after an import, and one row of counters; each is worked out when first asked for.

    ``mark_writes`` holds the marks that the import writes, one for each key, with their order.
    """

    def __init__(self, plan: ImportPlan, domain: Domain):
        self._plan, self._domain = plan, domain

    @cached_property
    def _fresh(self) -> DataFrame:
        """Students that are not stored yet, the first of each id."""
        stored = self._domain.student
        fresh = self._plan.new_students.groupBy("institution_id", F.col("student_id").alias("id")).agg(
            F.min(F.struct("workbook", "ord", "name", "roll_no")).alias("s")
        )
        fresh = fresh.join(stored.select("institution_id", "id"), ["institution_id", "id"], "left_anti")
        return settle(_after(stored, fresh.select("institution_id", "id", "s.*")))

    @cached_property
    def student(self) -> DataFrame:
        new = self._fresh.select("institution_id", "seq", "id", "name", "roll_no", F.lit("{}").alias("extra"))
        return self._domain.student.unionByName(new, allowMissingColumns=True)

    @cached_property
    def _matched(self) -> DataFrame:
        """The offerings wanted, with the first stored enrollment of the same student and period, if any."""
        wanted = settle(planned_enrollments(self._plan, self._domain.offering))
        stored = _period(self._domain.enrollment).groupBy(*_PERIOD).agg(F.min_by("id", "seq").alias("enrollment_id"))
        return wanted.join(stored, _PERIOD, "left")

    @cached_property
    def _opened(self) -> DataFrame:
        """New enrollments."""
        opened = self._matched.where("enrollment_id IS NULL").groupBy(*_PERIOD).agg(F.min("first").alias("first"))
        new_id = enrollment_id(F.col("student_id"), F.col("year_id"), F.col("term_key"), F.col("org_key"))
        opened = opened.withColumn("id", new_id)
        # two periods may lead to one id; the later one replaces the earlier
        opened = opened.groupBy("institution_id", "id").agg(
            F.count(F.lit(1)).alias("created"), F.max(F.struct("first", "student_id", "year_id", "term_key", "org_key")).alias("e")
        )
        opened = opened.select("institution_id", "id", "created", "e.*").select("*", "first.workbook", "first.ord")
        return settle(_after(self._domain.enrollment, opened))

    @cached_property
    def enrollment(self) -> DataFrame:
        opened = self._opened
        replaced = self._domain.enrollment.join(opened.select("institution_id", "id"), ["institution_id", "id"], "left_anti")
        return replaced.unionByName(
            opened.select(
                "institution_id", "seq", "id", "student_id", "year_id",
                F.nullif(F.col("term_key"), F.lit("")).alias("term_id"), F.col("org_key").alias("org_unit_id"),
            ),
            allowMissingColumns=True,
        )

    @cached_property
    def _extended(self) -> DataFrame:
        """Offerings that stored enrollments lack."""
        course_key = ["institution_id", "enrollment_id", "offering_id"]
        return self._matched.where("enrollment_id IS NOT NULL").join(self._domain.enrollment_course, course_key, "left_anti")

    @cached_property
    def enrollment_course(self) -> DataFrame:
        opened, stored = self._opened, self._domain.enrollment_course
        course_key = ["institution_id", "enrollment_id", "offering_id"]
        started = self._matched.where("enrollment_id IS NULL").drop("enrollment_id").join(
            opened.select(*_PERIOD, F.col("id").alias("enrollment_id")), _PERIOD
        )
        added = self._extended.select(*course_key, "first").unionByName(started.select(*course_key, "first"))
        last = stored.groupBy("institution_id", "enrollment_id").agg(F.max("pos").alias("last_pos"))
        added = _numbered(added, ["institution_id", "enrollment_id"]).join(last, ["institution_id", "enrollment_id"], "left")
        added = added.select(
            "institution_id", "enrollment_id", (F.coalesce("last_pos", F.lit(-1)) + F.col("n")).alias("pos"), "offering_id"
        )
        replaced = opened.select("institution_id", F.col("id").alias("enrollment_id"))
        return stored.join(replaced, ["institution_id", "enrollment_id"], "left_anti").unionByName(added)

    @cached_property
    def _marks(self) -> tuple[DataFrame, DataFrame]:
        return _upsert_marks(self._domain.mark, self._plan.marks.withColumn("write_no", F.struct("workbook", "ord", "col_no")))

    @property
    def mark(self) -> DataFrame:
        return self._marks[0]

    @property
    def mark_writes(self) -> DataFrame:
        return self._marks[1]

    @cached_property
    def report(self) -> DataFrame:
        updated = self._extended.select("institution_id", "enrollment_id").distinct()
        return _counters(
            {
                "students_created": (self._fresh, F.lit(1)),
                "enrollments_created": (self._opened, F.col("created")),
                "enrollments_updated": (updated, F.lit(1)),
                "marks_written": (self._plan.marks, F.lit(1)),
                "skipped": (self._plan.places, F.lit(1)),
            }
        )


def apply_plan(plan: ImportPlan, domain: Domain, skip_invalid: bool = False) -> Applied:
    """The tables a plan leaves behind. Strict mode refuses any error.

    Nothing is stored here, see ``commit``; storing the frames twice gives the same tables.
    """
    if not skip_invalid and not plan.places.isEmpty():
        raise ImportRefused("cannot apply a plan with validation errors in strict mode")
    return Applied(plan, domain)


def commit(store, applied: Applied, institutions: DataFrame) -> int:
    """Store an import as one version, or nothing of it; ``institutions`` are those of the applied domain.

    Marks are appended to their log; the small tables of people replace those of the institutions.
    """
    people = {"student": applied.student, "enrollment": applied.enrollment, "enrollment_course": applied.enrollment_course}
    return store.write(replaced=people, saved={"mark": applied.mark_writes}, ended=institutions)


def _counters(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row with a sum per name."""
    sums = None
    for name, (rows, value) in parts.items():
        part = rows.agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("n")).withColumn("what", F.lit(name))
        sums = part if sums is None else sums.unionByName(part)
    return sums.agg(*[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in parts])


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``n``: a position that follows the order of ``first`` in a group.

    Positions need not be dense, so rows are numbered over the distinct places
    of the whole run, which are spread over all tasks.
    """
    place = rows.withColumn("_book", F.col("first.workbook")).withColumn("_ord", F.col("first.ord"))
    books = place.groupBy(*keys, "_book").agg(F.count(F.lit(1)).alias("_rows"))
    inside = running_total(place, [*keys, "_book"], "_ord", "_in", ties=("first",))
    before = Window.partitionBy(*keys).orderBy("_book").rowsBetween(Window.unboundedPreceding, -1)
    offsets = books.select(*keys, "_book", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    joined = inside.join(offsets, [*keys, "_book"])
    return joined.withColumn("n", F.col("_in") + F.col("_offset")).drop("_book", "_ord", "_in", "_offset")


def _after(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``seq`` after every stored position, by (workbook, ord)."""
    end = stored.groupBy("institution_id").agg(F.max("seq").alias("_end"))
    placed = rows.withColumn("first", F.struct("workbook", "ord", "id")) if "first" not in rows.columns else rows
    numbered = _numbered(placed, ["institution_id"])
    joined = numbered.join(end, "institution_id", "left")
    return joined.withColumn("seq", F.coalesce("_end", F.lit(-1)) + F.col("n")).drop("_end", "n")


def _upsert_marks(stored: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The marks after the writes, and the last write of each key in the order of the first ones."""
    keys = ["institution_id", "student_id", "assessment_id"]
    last = writes.groupBy(*keys).agg(
        F.max_by(F.struct("obtained", "status"), "write_no").alias("w"), F.min("write_no").alias("first")
    )
    last = last.withColumn("workbook", F.col("first.workbook")).withColumn("ord", F.col("first.ord"))
    last = last.withColumn("id", F.concat_ws(":", "student_id", "assessment_id"))
    numbered = _after(stored, last).select(*keys, F.col("seq").alias("new_seq"), "id", "w")
    merged = stored.join(numbered.withColumnRenamed("id", "new_id"), keys, "full_outer")
    last_writes = numbered.select(*keys, "id", "w.obtained", "w.status", F.col("new_seq").alias("write_no"))
    after = merged.select(
        "institution_id",
        F.coalesce("seq", "new_seq").alias("seq"),
        F.coalesce("id", "new_id").alias("id"),
        "student_id",
        "assessment_id",
        F.when(F.col("w").isNotNull(), F.col("w.obtained")).otherwise(F.col("obtained")).alias("obtained"),
        F.when(F.col("w").isNotNull(), F.col("w.status")).otherwise(F.col("status")).alias("status"),
    )
    return after, last_writes


def answer_writes(answers: DataFrame, stored: DataFrame) -> DataFrame:
    """Mark writes of typed answers, in the order of ``seq``.

    ``answers``: institution_id, session, seq, student_id, assessment_id, raw.
    ``q`` or ``quit`` ends a session; a blank answer writes the stored mark
    again if there is one; anything that is neither ``a``, ``absent`` nor a
    number from zero up is passed over. No maximum is checked here.
    """
    answer = F.lower(strip(F.col("raw")))
    typed = answers.withColumn("answer", answer)
    stops = typed.where(F.col("answer").isin("q", "quit")).groupBy("institution_id", "session").agg(F.min("seq").alias("stop"))
    heard = typed.join(stops, ["institution_id", "session"], "left").where("stop IS NULL OR seq < stop")
    number = read_float(F.col("answer"))
    old = stored.select(
        "institution_id", "student_id", "assessment_id",
        F.col("obtained").alias("old_obtained"), F.col("status").alias("old_status"),
    )
    known = heard.withColumn("number", number).join(old, ["institution_id", "student_id", "assessment_id"], "left")
    away, silent = F.col("answer").isin("a", "absent"), F.col("answer") == ""
    counts = F.col("number").isNotNull() & ((F.col("number") >= 0) | F.isnan("number"))
    status = F.when(away, "absent").when(silent, F.col("old_status")).when(counts, "entered")
    obtained = F.when(away, 0.0).when(silent, F.col("old_obtained")).otherwise(F.col("number"))
    return known.select(
        "institution_id", "student_id", "assessment_id", "seq", obtained.alias("obtained"), status.alias("status")
    ).where("status IS NOT NULL")
