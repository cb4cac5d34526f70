"""Small helpers shared by the operators of this package."""

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of ASCII letters, ASCII digits and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sample(rows: DataFrame, size: int, *key: str) -> DataFrame:
    """At most ``size`` rows, those with the least hash of ``key``, which tells all rows apart.

    A first cut by the hash leaves about twice as many in all, so that no partition
    offers ``size`` rows of its own when there are many partitions.
    """
    place = F.xxhash64(*key)
    n = rows.count()
    share = min(1.0, (2 * size + 100) / max(n, 1))
    near = rows.filter(F.pmod(place, F.lit(1 << 40)) <= F.lit(int(share * (1 << 40))))
    return near.orderBy(F.pmod(place, F.lit(1 << 40)), *key).limit(size)


def grouped_sample(rows: DataFrame, size: int, group: str, *key: str) -> DataFrame:
    """At most ``size`` rows of each value of ``group``, those with the least hash of ``key``; keys may repeat.

    A count of the rows by group and range of hashes says below which range a group has ``size``
    rows; only those are ranked, and tasks rank before they send. The driver gets one number for
    each group.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    reach = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = rows.groupBy(group, F.shiftright(place, 24).alias("range")).agg(F.count("*").alias("n")).withColumn("sum", F.sum("n").over(reach))
    last = F.coalesce(F.min(F.when(F.col("sum") >= size, F.col("range"))), F.max("range"))
    cuts = ranges.where(F.col(group).isNotNull()).groupBy(group).agg(last.alias("last")).collect()
    if not cuts:
        return rows.limit(0)
    # As literals, so that no row travels before it is chosen.
    limits = F.create_map(*(F.lit(v) for row in cuts for v in row))
    near = rows.withColumn("_place", place).filter(F.shiftright("_place", 24) <= F.try_element_at(limits, F.col(group)))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_place", *key)))
    return ranked.filter(F.col("_rank") <= size).drop("_place", "_rank")


def worker_cache() -> dict:
    """Objects of this Python process, kept from task to task while Spark reuses the worker."""
    return sys.modules.setdefault("gradeloom_worker_cache", types.ModuleType("gradeloom_worker_cache")).__dict__


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def row_tie(text: Column) -> Column:
    """A number that tells apart rows which share a doc_id but not the text."""
    return F.xxhash64(text)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text) of ``docs``; any other column stays out of the way."""
    return docs.select(F.col("doc_id").cast("bigint"), row_tie(F.col("text")).alias("tie"), F.col("text"))


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not in ``decided``(doc_id, tie).

    ``docs`` is packed into one column meanwhile, so extra columns of any name
    pass through.
    """
    packed = docs.select(F.struct("*").alias("_row"))
    gone = decided.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (row_tie(F.col("_row.text")) == F.col("_tie"))
    return packed.join(gone, same, "left_anti").select("_row.*")
