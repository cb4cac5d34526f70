"""Which rule set and grade scale apply, without guessing.

An override that names an unknown rule set yields no rule set at all; it does
not fall back to the default of the institution.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_TOTAL = "raw_total_percentage"
DEFAULT_DECIMALS = 2


def _rules(rule_set: DataFrame, as_id: str) -> DataFrame:
    return rule_set.select(
        "institution_id",
        F.col("id").alias(as_id),
        F.lit(True).alias("rules_found"),
        F.col("grade_scale_id").alias("rule_scale_id"),
        "pass_percentage",
        "per_course_pass_percentage",
        "aggregation",
        "decimals",
    )


def _scales(grade_scale: DataFrame, as_id: str) -> DataFrame:
    return grade_scale.select("institution_id", F.col("id").alias(as_id), "bands")


def institution_rules(institution: DataFrame, rule_set: DataFrame, grade_scale: DataFrame) -> DataFrame:
    """Per institution: default rule set, default scale and its decimals.

    ``decimals`` always comes from the default rule set (2 if there is none),
    whatever an offering overrides. The scale for whole students is the
    default scale of the institution, not that of its rule set.
    """
    joined = institution.join(
        _rules(rule_set, "default_rule_set_id"), ["institution_id", "default_rule_set_id"], "left"
    ).join(_scales(grade_scale, "default_grade_scale_id"), ["institution_id", "default_grade_scale_id"], "left")
    return joined.select(
        "institution_id",
        F.col("name").alias("institution_name"),
        "default_rule_set_id",
        "default_grade_scale_id",
        F.coalesce("rules_found", F.lit(False)).alias("has_rules"),
        "pass_percentage",
        F.coalesce("decimals", F.lit(DEFAULT_DECIMALS)).alias("decimals"),
        F.col("bands").alias("bands"),
    )


def offering_rules(offering: DataFrame, institution: DataFrame, rule_set: DataFrame, grade_scale: DataFrame) -> DataFrame:
    """Per offering: rule set, scale and the decimals of its institution.

    Rule set: override if given, else default of the institution. Scale:
    override of the offering, else the scale of its rule set, else the default
    of the institution.
    """
    base = institution_rules(institution, rule_set, grade_scale).select(
        "institution_id", "default_rule_set_id", "default_grade_scale_id", "decimals"
    )
    override = F.nullif(F.col("rule_set_id"), F.lit(""))
    ruled = (
        offering.join(base, "institution_id")
        .withColumn("used_rule_set_id", F.coalesce(override, F.col("default_rule_set_id")))
        .join(_rules(rule_set, "used_rule_set_id").drop("decimals", "pass_percentage"), ["institution_id", "used_rule_set_id"], "left")
        .withColumn(
            "used_grade_scale_id",
            F.coalesce(F.nullif(F.col("grade_scale_id"), F.lit("")), "rule_scale_id", "default_grade_scale_id"),
        )
    )
    return ruled.join(_scales(grade_scale, "used_grade_scale_id"), ["institution_id", "used_grade_scale_id"], "left").select(
        "institution_id",
        F.col("id").alias("offering_id"),
        "course_id",
        "max_marks",
        F.when(F.col("rules_found"), F.col("used_rule_set_id")).alias("used_rule_set_id"),
        F.when(F.col("bands").isNotNull(), F.col("used_grade_scale_id")).alias("used_grade_scale_id"),
        F.coalesce("rules_found", F.lit(False)).alias("has_rules"),
        "per_course_pass_percentage",
        "aggregation",
        "decimals",
        "bands",
    )
