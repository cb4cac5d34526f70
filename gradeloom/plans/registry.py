"""Named queries over the campus, each with the SQL that must agree with it."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.plans.campus import CAMPUS, Campus, as_sql

QUERIES: dict[str, Callable[[Campus], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Tables only an oracle needs: intermediate results written out in SQL.
ORACLE_TABLES: dict[str, str] = dict(CAMPUS)


def query(name: str, oracle: str | None = None):
    """Register a function from a campus to a DataFrame under ``name``."""

    def add(function: Callable[[Campus], DataFrame]) -> Callable[[Campus], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def load() -> None:
    """Import every module that registers queries."""
    from gradeloom.plans import config_queries, import_queries, result_queries, semester_queries  # noqa: F401


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](Campus(spark, sf_dir))

    return run


def oracle_text(name: str) -> str:
    # \x01 and \x02 stand for braces that are no table names
    return _write_sums(as_sql(ORACLES[name], ORACLE_TABLES)).replace("\x01", "{").replace("\x02", "}")


def _write_sums(text: str) -> str:
    """``{sum:x}`` becomes a sum over 128-bit multiples of 2**-75, which values of the tables are exactly."""
    unit = "37778931862957161709568e0"
    return re.sub(r"\{sum:([^{}]*)\}", rf"(CAST(sum(CAST((\1) * {unit} AS HUGEINT)) AS DOUBLE) / {unit})", text)


def sql_round(x: str, digits: int = 2) -> str:
    """Rounding to decimals by way of correctly rounded text."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def sql_round_by(x: str, digits: str) -> str:
    return f"(CASE {digits} WHEN 1 THEN {sql_round(x, 1)} ELSE {sql_round(x, 2)} END)"


def sql_bands(x: str, bands) -> str:
    """The grade of ``x`` on one scale."""
    cases = " ".join(f"WHEN {x} >= {m} THEN '{g}'" for m, g in bands)
    return f"(CASE {cases} ELSE '{bands[-1][1]}' END)"
