"""The registry of queries, and pieces of SQL that several of their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, digits: int = 6) -> Column:
    """A double rounded as the second engine does it: scaled in double precision, so what lies within an ulp of a tie goes up in both. A negative zero becomes plain."""
    x, scale = F.col(c) if isinstance(c, str) else c, 10.0**digits
    return F.when(F.abs(x) < 1e290, F.round(x * scale) / scale).otherwise(x) + F.lit(0.0)


def _hav(a: str, b: str, c: str, d: str) -> str:
    """Great-circle distance; least and greatest drop nulls, so the last term brings them back."""
    return f"(2 * 6371008.8 * asin(sqrt(least(greatest(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 0), 1))) + 0 * ({a} + {b} + {c} + {d}))"


def _wrap(a: str) -> str:
    return f"(CASE WHEN (({a}) - 360 * floor(({a}) / 360)) > 180 THEN (({a}) - 360 * floor(({a}) / 360)) - 360 ELSE (({a}) - 360 * floor(({a}) / 360)) END)"
