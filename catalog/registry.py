"""The query registry: each query is a callable over (spark, sf_dir) and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import twin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = twin.sql(sql)
        return fn

    return add


def rd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; never negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits) + F.lit(0.0)


def srd(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


# positions are short decimals, which would round either way at a tie; a small shift avoids every tie
SHIFT = 0.0000123456789


def rp(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + F.lit(SHIFT), 4) + F.lit(0.0)


def srp(expr: str, name: str) -> str:
    return f"round({expr} + {SHIFT:.13f}, 4) + 0.0::DOUBLE AS {name}"
