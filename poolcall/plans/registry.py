"""Registered queries: a Spark plan and, where SQL can say it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator for ``fn(fx) -> DataFrame`` where ``fx`` gives tables and fixture views."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from poolcall.plans.fixtures import Fixtures
            return fn(Fixtures(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            from poolcall.plans.fixtures import oracle
            ORACLES[name] = oracle(sql)
        return fn
    return deco


def r(x, d: int = 4) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), d) + F.lit(0.0)


def rq(x: str, d: int = 4) -> str:
    """The SQL form of :func:`r`."""
    return f"(round(CAST({x} AS DOUBLE), {d}) + 0.0::DOUBLE)"
