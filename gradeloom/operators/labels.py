"""Labels to stored rows: one match or an error, never a guess.

Every function takes a table of distinct requests and returns it with the
match (NULL if there is none) and ``error`` (NULL if there is one match).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import strip
from gradeloom.session import settle


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _id_list(matches: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The ids a message names, in order; asked for ambiguous requests only."""
    ids = F.array_sort(F.collect_list("match_id"))
    return matches.groupBy(*keys).agg(F.array_join(ids, ", ").alias(out))


def resolve_offerings(requests: DataFrame, offering: DataFrame, course: DataFrame) -> DataFrame:
    """(institution_id, label) -> offering_id by id, course code or course name.

    The first of the three with exactly one match wins; otherwise the first
    with any match makes the label ambiguous.
    """
    keys = ["institution_id", "label"]
    of_course = offering.select("institution_id", F.col("id").alias("match_id"), "course_id").join(
        course.select("institution_id", F.col("id").alias("course_id"), "code", "name"), ["institution_id", "course_id"]
    )
    by_id = offering.select("institution_id", F.col("id").alias("label"), F.lit(1).alias("level"), F.col("id").alias("match_id"))
    by_code = of_course.select("institution_id", F.col("code").alias("label"), F.lit(2).alias("level"), "match_id")
    by_name = of_course.select("institution_id", F.col("name").alias("label"), F.lit(3).alias("level"), "match_id")
    asked = requests.select(*keys).distinct()
    matches = by_id.unionByName(by_code).unionByName(by_name).join(asked, keys, "left_semi")
    counts = matches.groupBy(*keys).agg(
        *[F.count(F.when(F.col("level") == n, 1)).alias(f"n{n}") for n in (1, 2, 3)],
        *[F.min(F.when(F.col("level") == n, F.col("match_id"))).alias(f"id{n}") for n in (1, 2, 3)],
    )
    found = F.when(F.col("n1") == 1, F.col("id1")).when(F.col("n2") == 1, F.col("id2")).when(F.col("n3") == 1, F.col("id3"))
    level = F.when(F.col("n1") > 0, 1).when(F.col("n2") > 0, 2).otherwise(3)
    counts = counts.select(*keys, found.alias("offering_id"), F.when(found.isNull(), level).alias("level"))
    unclear = matches.join(counts.where("level IS NOT NULL").select(*keys, "level"), [*keys, "level"], "left_semi")
    answered = asked.join(counts, keys, "left").join(_id_list(unclear, keys, "ids"), keys, "left")
    label = F.col("label")
    error = F.when(
        F.col("offering_id").isNull(),
        F.when(F.col("ids").isNull(), _say("no course offering matches '", label, "'")).otherwise(
            _say("'", label, "' is ambiguous across offerings (", F.col("ids"), ")")
        ),
    )
    return answered.select(*keys, "offering_id", error.alias("error"))


def resolve_hints(requests: DataFrame, offering: DataFrame) -> DataFrame:
    """(institution_id, hint) -> offering_id by id only."""
    known = offering.select("institution_id", F.col("id").alias("hint"), F.col("id").alias("offering_id"))
    asked = requests.select("institution_id", "hint").distinct()
    error = F.when(F.col("offering_id").isNull(), _say("no course offering with id '", F.col("hint"), "'"))
    return asked.join(known, ["institution_id", "hint"], "left").withColumn("error", error)


def resolve_assessments(requests: DataFrame, assessment: DataFrame) -> DataFrame:
    """(institution_id, offering_id, name) -> assessment of that offering.

    A unique exact name wins, then a unique name regardless of case and
    surrounding space.
    """
    keys = ["institution_id", "offering_id", "name"]
    asked = requests.select(*keys).distinct()
    stored = assessment.select(
        "institution_id", "offering_id", F.col("name").alias("stored_name"), F.col("id").alias("match_id"), "max_marks"
    )
    folded = F.lower(strip(F.col("name")))
    matches = asked.withColumn("folded", folded).join(
        stored.withColumn("folded", F.lower(strip(F.col("stored_name")))), ["institution_id", "offering_id", "folded"]
    )
    exact = F.col("stored_name") == F.col("name")
    hit = F.struct("match_id", "stored_name", "max_marks")
    counts = matches.groupBy(*keys).agg(
        F.count(F.when(exact, 1)).alias("n_exact"),
        F.min(F.when(exact, hit)).alias("exact"),
        F.count(F.lit(1)).alias("n_folded"),
        F.min(hit).alias("folded"),
    )
    found = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_folded") == 1, F.col("folded"))
    counts = counts.select(*keys, found.alias("found"), (found.isNull() & (F.col("n_exact") > 0)).alias("unclear"))
    unclear = matches.where(exact).join(counts.where("unclear").select(*keys), keys, "left_semi")
    answered = asked.join(counts, keys, "left").join(_id_list(unclear, keys, "ids"), keys, "left")
    error = F.when(
        F.col("found").isNull(),
        F.when(F.col("ids").isNotNull(), _say("assessment '", F.col("name"), "' is ambiguous (", F.col("ids"), ")")).otherwise(
            _say("no assessment named '", F.col("name"), "' for offering '", F.col("offering_id"), "'")
        ),
    )
    return answered.select(
        *keys,
        F.col("found.match_id").alias("assessment_id"),
        F.col("found.stored_name").alias("assessment_name"),
        F.col("found.max_marks").alias("max_marks"),
        error.alias("error"),
    )


def resolve_org_units(requests: DataFrame, org_unit: DataFrame) -> DataFrame:
    """(institution_id, class_label) -> org_unit_id by exact, unique name."""
    keys = ["institution_id", "class_label"]
    counts = org_unit.groupBy("institution_id", F.col("name").alias("class_label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("match_id")
    )
    label = F.col("class_label")
    error = (
        F.when(F.col("n").isNull(), _say("no class/org unit named '", label, "'"))
        .when(F.col("n") > 1, _say("class '", label, "' matches multiple org units"))
    )
    answered = requests.select(*keys).distinct().join(counts, keys, "left")
    return answered.select(*keys, F.when(F.col("n") == 1, F.col("match_id")).alias("org_unit_id"), error.alias("error"))


def resolve_subjects(requests: DataFrame, offering: DataFrame, course: DataFrame, settings: DataFrame) -> DataFrame:
    """(institution_id, subject, org_unit_id) -> offering_id of a plain subject.

    The subject must name one course. Its offerings are narrowed to the org
    unit if there is one, else to the default period of the institution.
    """
    keys = ["institution_id", "subject", "org_unit_id"]
    asked = requests.select(*keys).distinct()
    labels = F.array_distinct(F.array(F.coalesce("name", F.lit("")), F.coalesce("code", F.lit(""))))
    courses = (
        course.select("institution_id", F.col("id").alias("course_id"), F.explode(labels).alias("subject"))
        .groupBy("institution_id", "subject")
        .agg(F.count(F.lit(1)).alias("n_courses"), F.min("course_id").alias("course_id"))
    )
    named = asked.join(courses, ["institution_id", "subject"], "left").join(
        settings.select("institution_id", "default_year", "default_term"), "institution_id", "left"
    )
    # One row for each course, each (course, unit) and each (course, year, term): how many offerings, and the least.
    index = (
        offering.select("institution_id", "course_id", F.col("org_unit_id").alias("unit"), F.col("year_id").alias("year"), F.col("term_id").alias("term"), F.col("id").alias("match_id"))
        .groupingSets([["institution_id", "course_id"], ["institution_id", "course_id", "unit"], ["institution_id", "course_id", "year", "term"]],
                      "institution_id", "course_id", "unit", "year", "term")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.min("match_id").alias("least"))
    )
    of_course, of_unit, of_period = (index.where(F.col("level") == n) for n in (7, 3, 4))
    given = F.coalesce(F.col("org_unit_id"), F.lit("")) != ""
    # A request looks at one of the indexes: that of its unit or that of the default period.
    named = settle(
        named.withColumns({
            "org_unit_id": F.coalesce("org_unit_id", F.lit("")),
            "by_unit": F.when(given, F.col("org_unit_id")),
            "by_year": F.when(~given, F.col("default_year")),
            "by_term": F.when(~given, F.col("default_term")),
        })
    )
    at = ["institution_id", "course_id"]
    answered = named.join(of_course.select(*at, F.col("n").alias("n_all")), at, "left")
    answered = answered.join(
        of_unit.select(*at, F.col("unit").alias("by_unit"), F.struct("n", "least").alias("in_unit")), [*at, "by_unit"], "left"
    )
    answered = answered.join(
        of_period.select(*at, F.col("year").alias("by_year"), F.col("term").alias("by_term"), F.struct("n", "least").alias("in_period")),
        [*at, "by_year", "by_term"], "left",
    )
    fitting = F.when(F.col("n_courses") == 1, F.coalesce("in_unit", "in_period"))
    answered = answered.select("*", F.coalesce(fitting["n"], F.lit(0)).alias("n_fit"), fitting["least"].alias("fit"))
    # The ids of one unit or one period of a course are gathered once, however many requests ask for them.
    place = ["by_unit", "by_year", "by_term"]
    asked_for = answered.where("n_fit > 1").select(*at, *place).distinct()
    offered = offering.select("institution_id", "course_id", F.col("org_unit_id").alias("by_unit"), F.col("year_id").alias("by_year"), F.col("term_id").alias("by_term"), F.col("id").alias("match_id"))
    in_unit = offered.drop("by_year", "by_term").join(asked_for.where("by_unit IS NOT NULL"), [*at, "by_unit"])
    in_period = offered.drop("by_unit").join(asked_for.where("by_unit IS NULL"), [*at, "by_year", "by_term"])
    listed = _id_list(in_unit.unionByName(in_period), [*at, *place], "ids")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"l.{c}")) for c in [*at, *place]]
    answered = answered.alias("a").join(listed.alias("l"), reduce(Column.__and__, same), "left").select("a.*", "l.ids")
    subject = F.col("subject")
    error = (
        F.when(F.col("n_courses").isNull(), _say("no course matches legacy subject '", subject, "'"))
        .when(F.col("n_courses") > 1, _say("subject '", subject, "' matches multiple courses"))
        .when(F.col("n_fit") > 1, _say("subject '", subject, "' is ambiguous across offerings (", F.col("ids"), ")"))
        .when(F.col("n_fit") == 1, F.lit(None))
        .when(F.coalesce(F.col("n_all"), F.lit(0)) > 0, _say("subject '", subject, "' has no offering for the default period"))
        .otherwise(_say("no course offering exists for subject '", subject, "'"))
    )
    return answered.select(*keys, F.when(error.isNull(), F.col("fit")).alias("offering_id"), error.alias("error"))


def only_assessments(requests: DataFrame, assessment: DataFrame) -> DataFrame:
    """(institution_id, offering_id) -> its assessment, if there is just one."""
    keys = ["institution_id", "offering_id"]
    counts = assessment.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "max_marks")).alias("hit")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    error = F.when(
        n != 1,
        _say("legacy import needs exactly one assessment for offering '", F.col("offering_id"), "' (found ", n.cast("string"), ")"),
    )
    only = F.when(n == 1, F.col("hit"))
    answered = requests.select(*keys).distinct().join(counts, keys, "left")
    return answered.select(*keys, only["id"].alias("assessment_id"), only["max_marks"].alias("max_marks"), error.alias("error"))
