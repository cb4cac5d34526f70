"""Compare registered queries with their SQL, as multisets of rows."""

import datetime
import decimal
import math

from gradeloom.plans.registry import ORACLES, QUERIES, oracle_text, runnable


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, duck, sf_dir: str, name: str) -> str | None:
    """None when query and SQL agree, else what differs."""
    df = runnable(name)(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return None
    relation = duck.sql(oracle_text(name))
    if sorted(relation.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    want = rows_of(relation.columns, relation.fetchall())
    if got == want:
        return None if got else "no rows"
    here, there = set(got), set(want)
    extra = [r for r in got if r not in there][:3]
    lacking = [r for r in want if r not in here][:3]
    return f"{len(got)} rows vs {len(want)}; columns {sorted(df.columns)}; only here {extra}; only in SQL {lacking}"


def names() -> list[str]:
    return sorted(QUERIES)
