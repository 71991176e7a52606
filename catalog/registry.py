"""Registry of queries: a Spark callable and, where the result is expressible, the SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_zero(sql: str) -> str:
    """Turn ``round(..)`` into ``(round(..)+0.0)`` so that no engine reports a negative zero.

    ``round (`` with a space is left alone, for results in which the sign of zero is printed.
    """
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "(round(" + plain_zero(sql[j + 6:k - 1]) + ")+0.0::DOUBLE)")
        i = k
    return "".join(out) + sql[i:]


def query(sql: str | None = None):
    """Register a function under its own name."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = plain_zero(sql)
        return fn
    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Both engines sum in different orders, so results are compared to a few digits."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits) + F.lit(0.0))
    return df
