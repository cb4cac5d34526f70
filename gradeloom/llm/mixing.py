"""Mixing sources to target weights by Poisson replication.

Every document gets its number of copies from a Poisson distribution whose mean is
the rate at which its source must be repeated. The draw is the distribution inverted
at a hash of the document and a seed, so it is the same in every run and on every
cluster, and it needs no coordination between sources. The copies are then put in the
order of another hash, over all sources.

A rate above STEP is drawn as the sum of equal smaller parts, each with a hash of its
own: a sum of Poisson variables is one with the sum of their means.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 8.0  # largest mean of one draw
ROWS = 32768  # documents expected in a partition of the mixture, if the session does not ask for smaller ones
SOURCES = 4096  # up to so many sources, counted first, their distributions (half a kilobyte each) go to every task
TERMS = 64  # beyond so many events a draw of mean STEP has less than 2**-52 left


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """(source, rate): how often a document of each source is wanted on average.

    ``weights``(source, weight) are the target shares, in any unit; sources without
    weight, or with a null, zero or negative one, are left out. Without ``weights``
    a source counts as its number of documents to the power ``alpha``. ``total`` is
    the wanted number of documents, as many as there are if it is not given. A null source
    is a source like others.
    """
    return _planned(docs, weights, alpha, total)[0]


def _planned(docs: DataFrame, weights: DataFrame | None, alpha: float, total: int | None) -> tuple[DataFrame, int, int]:
    """The rates, how many documents they will make on average, and the number of rates."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        wanted = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        targets = weights.groupBy(F.col("source").alias("_source")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        wanted = counts.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").filter("weight > 0")
    everything = wanted.agg(F.sum("weight"), F.count("*")).first()
    if not everything[1]:
        return wanted.select("source", F.lit(0.0).alias("rate")), 0, 0
    size = counts.agg(F.sum("n")).first()[0] if total is None else total
    return wanted.select("source", (F.col("weight") / F.lit(everything[0]) * F.lit(size) / F.col("n")).alias("rate")), size, everything[1]


def _distribution(mean: Column) -> Column:
    """Probabilities of at most 0, 1, ... events, as an array."""
    start = F.struct(F.array().cast("array<double>").alias("cdf"), F.exp(-mean).alias("p"), F.lit(0.0).alias("sum"))

    def step(state, k):
        reached = state["sum"] + state["p"]
        following = state["p"] * mean / k.cast("double")
        return F.struct(F.concat(state["cdf"], F.array(reached)).alias("cdf"), following.alias("p"), reached.alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["cdf"])


def replicated(docs: DataFrame, wanted: DataFrame, seed: int = 0, few: bool = False) -> DataFrame:
    """``docs`` with every row as often as drawn, in shuffled order: (_row, copy, place).

    ``_row`` holds the row, ``copy`` counts from 1, ``place`` is the sort key. Draws and
    places follow from the doc_id, for rows without one from the text. Rows with the same doc_id are
    drawn alike, as are those without one that have the same text. Sources that are not in ``wanted`` have no copies.
    ``few`` says that ``wanted`` was counted and is small: it is sent to the documents, which then stay where they are.
    """
    parts = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    plans = wanted.select(
        F.col("source").alias("_source"), parts.alias("_parts"), _distribution(F.col("rate") / parts).alias("_cdf")
    )
    plans = F.broadcast(plans) if few else plans
    text = F.col("text") if "text" in docs.columns else F.lit("")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key"), F.col("source").alias("_of"))
    drawn = rows.join(plans, F.col("_of").eqNullSafe(F.col("_source")))

    def events(part):
        u = uniform(F.lit(str(seed)), F.lit("n"), part.cast("string"), F.col("_key"))
        return F.size(F.filter("_cdf", lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda total, part: total + events(part))
    drawn = drawn.select("_row", "_key", copies.alias("_n")).filter("_n > 0")
    each = drawn.select("_row", "_key", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), F.col("copy").cast("string"), F.col("_key")))
    return each.select("_row", "copy", place.alias("place"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 0) -> DataFrame:
    """The mixture, globally shuffled: (_row, copy, place) ordered by ``place``.

    Places are uniform, so the first bits of a place name its partition: no rows are drawn a first time
    for a sample of the order, and partitions are alike in size whatever the sources are.
    """
    wanted, size, sources = _planned(docs, weights, alpha, total)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROWS))
    first_bits = F.conv(F.substring("place", 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    dealt = replicated(docs, wanted, seed, sources <= SOURCES).repartitionById(partitions, F.floor(first_bits * partitions).cast("int"))
    return dealt.sortWithinPartitions("place", "copy")
