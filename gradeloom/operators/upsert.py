"""Last write wins, first position stays."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_marks(log: DataFrame) -> DataFrame:
    """The mark table a log of writes leaves behind.

    One row per (institution, student, assessment): values of the write with
    the highest ``write_no``, position of the lowest. Repeated writes of a hot
    key are combined map-side.
    """
    keys = ["institution_id", "student_id", "assessment_id"]
    return (
        log.groupBy(*keys)
        .agg(
            F.min("write_no").alias("seq"),
            F.max_by(F.struct("obtained", "status"), "write_no").alias("last"),
        )
        .select(
            "institution_id",
            "seq",
            F.concat_ws(":", "student_id", "assessment_id").alias("id"),
            "student_id",
            "assessment_id",
            "last.obtained",
            "last.status",
        )
    )


def upsert(stored: DataFrame, writes: DataFrame, keys: list[str], write_no: str) -> DataFrame:
    """``stored`` after ``writes``: same columns, unique by ``keys``.

    ``writes`` has the columns of ``stored`` but ``seq`` and a ``write_no``
    column giving the order of the writes. New rows get positions after all
    stored ones, in write order. Only keys that are written take part in the
    aggregation; untouched rows pass through the join unchanged.
    """
    values = [c for c in stored.columns if c not in keys and c != "seq"]
    last = writes.groupBy(*keys).agg(
        F.min(write_no).alias("_first"), F.max_by(F.struct(*values), write_no).alias("_new")
    )
    end = stored.groupBy("institution_id").agg(F.max("seq").alias("_end"))
    old = stored.select(*keys, "seq", F.struct(*values).alias("_old"))
    merged = old.join(last, keys, "full_outer").join(end, "institution_id", "left")
    picked = F.coalesce(F.col("_new"), F.col("_old"))
    start = F.coalesce(F.col("_end"), F.lit(-1)) + 1
    columns = {
        **{k: F.col(k) for k in keys},
        **{v: picked[v] for v in values},
        "seq": F.coalesce(F.col("seq"), start + F.col("_first")),
    }
    return merged.select(*[columns[c].alias(c) for c in stored.columns])
