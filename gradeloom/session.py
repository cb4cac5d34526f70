"""Session defaults and the one place where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}  # application id -> folder of a local session


def get_session(app_name: str = "gradeloom", **conf: str) -> SparkSession:
    """A session with the SQL settings the plans in this package rely on.

    The cluster manager keeps control of master, memory and executors; only
    settings that change results or skew handling are fixed here.
    """
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where that costs the reuse of a partitioning.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as the cluster names it.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="gradeloom-")
    return _local_dirs[context.applicationId]


def settle(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Used between the rounds of an iterative operator and where a result is
    read several times: the lineage ends, losing an executor costs nothing
    already settled, and the reader sees exact sizes for join planning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 50_000


def by_rows(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table that is not broadcast where it has many rows (or another one has: ``rows``).

    Spark weighs a table by its files, where repeated values take next to nothing: one of a megabyte may be
    hundreds in the driver.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > BROADCAST_ROWS else df
