"""Numbering rows of a group without putting the group into one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import settle

BLOCK = 65536


def block_of(order: Column, block: int = BLOCK) -> Column:
    """Which run of ``block`` consecutive positions an integer falls into."""
    return F.floor(order / F.lit(block)).cast("bigint")


def running_total(
    df: DataFrame, keys: list[str], order: str, out: str, weight: Column | None = None, ties: tuple = (), parts: int | None = None
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (default 1) over the group up to the row.

    Rows are dealt by ranges of (keys, order, ties) and, where these are equal, of
    their place in the input, so a group of any size, with dense, sparse or equal orders, is spread
    over as many partitions as its rows need. Sums run inside each partition, and the
    partitions of a group, one row each, carry the running offset. ``ties`` breaks
    equal values of ``order``; ``parts`` fixes the number of partitions.
    """
    weight = (F.lit(1) if weight is None else weight).cast("bigint")
    inside, offset = F.col("_n"), F.coalesce("_offset", F.lit(0))
    return _running(df, keys, order, out, weight, ties, parts, F.sum, (inside + offset).cast("bigint"))


def running_max(df: DataFrame, keys: list[str], order: str, out: str, value: Column, ties: tuple = ()) -> DataFrame:
    """Add ``out``: the largest ``value`` of the group up to the row, null before the first one that is not null.

    Where values grow with ``order`` and only some rows have one, it is the last one
    before a row. Groups are spread as in ``running_total``.
    """
    return _running(df, keys, order, out, value, ties, None, F.max, F.greatest("_n", "_offset"))


def _running(df, keys, order, out, value, ties, parts, combine, both) -> DataFrame:
    sort = [*keys, order, *ties, "_at"]
    placed = df.withColumn("_w", value).withColumn("_at", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(parts, *sort) if parts else placed.repartitionByRange(*sort)
    # Written, so that both readers below see the same partitions.
    cut = settle(dealt.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(order, *ties, "_at").rowsBetween(Window.unboundedPreceding, 0)
    running = cut.withColumn("_n", combine("_w").over(inside))
    sizes = cut.groupBy(*keys, "_part").agg(combine("_w").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", combine("_size").over(before).alias("_offset"))
    if keys:
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]]
        joined = running.alias("l").join(offsets.alias("r"), reduce(Column.__and__, same)).select("l.*", "r._offset")
    else:
        joined = running.join(offsets, "_part")
    return joined.withColumn(out, both).drop("_part", "_n", "_offset", "_w", "_at")


def number_rows(df: DataFrame, keys: list[str], order: str, out: str, ties: tuple = (), parts: int | None = None) -> DataFrame:
    """Add ``out``: the 1-based position of each row in its group by ``order``."""
    return running_total(df, keys, order, out, ties=ties, parts=parts)
