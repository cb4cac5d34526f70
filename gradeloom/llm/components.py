"""Connected components of a table of links, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import settle

FILE_ROWS = 500_000  # links in a file between rounds


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    moved = links.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.withColumnRenamed("least", "v"))


def _settled(links: DataFrame, rows: int) -> DataFrame:
    return settle(links.coalesce(max(1, rows // FILE_ROWS)))


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Every node below one root only, and no root below another."""
    ways = links.select("u", F.lit(1).alias("n")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
    below = ways.groupBy("u").agg(F.sum("n").alias("n"), F.count("*").alias("all"))
    return below.filter("n > 0 AND all > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links``(a, b): root is the component's least node.

    Each round hangs every node below the least node it knows; the number of rounds
    is logarithmic in the length of a chain. Minima are combined before the shuffle
    and joined back, so a node with very many links burdens no single task.
    """
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = settle(links.filter("a <> b").select(larger, smaller).distinct())
    rows = links.count()
    while rows and not _is_forest_of_stars(links):
        # A round makes no more links than it gets.
        links = _settled(_small_star(_large_star(links)).distinct(), rows)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def leaders(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links``(a, b): some node of its component, near enough for
    most nodes of a group around one node to get the same. Costs a fraction of ``components``."""
    both = _both(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    near = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("root")))
    for _ in range(2):
        up = near.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        near = near.join(up, "root").select("node", F.col("higher").alias("root"))
    return near
