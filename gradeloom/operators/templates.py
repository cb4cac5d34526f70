"""Blank import workbooks as a table of header cells."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.labels import resolve_hints
from gradeloom.operators.skew import number_rows
from gradeloom.session import settle

TITLE_LENGTH = 31


def _title(column):
    kept = F.substring(F.translate(column, "\\/?*[]:", ""), 1, TITLE_LENGTH)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("offering"))


def _numbered(column, number):
    """A title with a number at its end, cut in front of it to what a sheet name may hold."""
    digits = number.cast("string")
    return F.concat(F.substring(column, F.lit(1), F.lit(TITLE_LENGTH) - F.length(digits)), digits)


def sheet_titles(offering: DataFrame) -> DataFrame:
    """(institution_id, id, title): an id without characters a sheet name cannot hold.

    Titles of an institution differ even when case is ignored. Where one is taken, by
    the smallest id that leads to it, the next is that of the id and ``_2``, and
    then that with a number. Each round gives every loser of a collision a title
    that no other loser gets, so rounds are few even if many ids collide.
    """
    rows = offering.select("institution_id", "id", _title(F.col("id")).alias("title"), F.lit(0).alias("tries"))
    rows = settle(rows.dropDuplicates(["institution_id", "id"]))
    again = _title(F.concat("id", F.lit("_2")))
    while True:
        same = Window.partitionBy("institution_id", F.lower("title")).orderBy("tries", "id")
        ranked = rows.withColumn("behind", F.row_number().over(same) - 1)
        tries = F.col("tries") + F.col("behind")
        title = F.when(F.col("behind") == 0, F.col("title")).when(tries == 1, again).otherwise(_numbered(again, tries - 1))
        rows = settle(ranked.select("institution_id", "id", title.alias("title"), tries.alias("tries"), "behind"))
        if rows.where("behind > 0").isEmpty():
            return rows.select("institution_id", "id", "title")


# Fixed value: what an institution without course prefixes is told if it names no offering.
HINT_MISSING = "--offering is required when excel.expect_course_prefix is false"


def _single(settings: DataFrame) -> DataFrame:
    """Institutions that expect no course prefix, with their hint; an empty hint is none."""
    single = settings.where(~F.coalesce("expect_course_prefix", F.lit(True)))
    return single.select("institution_id", F.nullif(F.col("offering_hint"), F.lit("")).alias("hint")).distinct()


def template_errors(offering: DataFrame, settings: DataFrame) -> DataFrame:
    """(institution_id, offering_hint, error): institutions whose template cannot be made, since their
    hint is missing or no offering of theirs."""
    hints = _single(settings)
    answers = resolve_hints(hints.where("hint IS NOT NULL"), offering).where("error IS NOT NULL")
    missing = hints.where("hint IS NULL").select("institution_id", "hint", F.lit(HINT_MISSING).alias("error"))
    return missing.unionByName(answers.select("institution_id", "hint", "error")).withColumnRenamed("hint", "offering_hint")


def template_headers(
    offering: DataFrame, assessment: DataFrame, offering_hint: str | None = None, settings: DataFrame | None = None
) -> DataFrame:
    """(institution_id, offering_id, sheet, col_no, header), one sheet per
    offering, or the single sheet ``Marks`` for a hinted one.

    ``settings``(institution_id, expect_course_prefix, offering_hint) gives each institution its own
    layout and hint, see ``template_errors`` for those without a template; ``offering_hint`` is one for
    all. Assessment columns follow the identity columns by (order, id).
    """
    if settings is not None:
        hints = _single(settings)
        answers = resolve_hints(hints.where("hint IS NOT NULL"), offering).where("error IS NULL")
        named = sheet_titles(offering.join(hints, "institution_id", "left_anti")).withColumnRenamed("title", "sheet")
        named = named.unionByName(answers.select("institution_id", F.col("offering_id").alias("id"), F.lit("Marks").alias("sheet")))
    elif offering_hint is None:
        named = sheet_titles(offering).withColumnRenamed("title", "sheet")
    else:
        named = offering.where(F.col("id") == offering_hint).select("institution_id", "id", F.lit("Marks").alias("sheet"))
    named = named.withColumnRenamed("id", "offering_id")
    identity = named.select("*", F.posexplode(F.array(F.lit("Roll No"), F.lit("Student Name"))).alias("at", "header"))
    identity = identity.withColumn("col_no", F.col("at").cast("bigint") + 1).drop("at")
    columns = assessment.select("institution_id", "offering_id", "order", "id", F.col("name").alias("header"))
    placed = number_rows(columns, ["institution_id", "offering_id"], "order", "n", ties=("id",)).select(
        "institution_id", "offering_id", "header", (F.col("n") + 2).alias("col_no")
    )
    return identity.unionByName(named.join(placed, ["institution_id", "offering_id"]))
