"""Registration of a module's queries: a decorator that keeps a query and its SQL together."""

from __future__ import annotations

from pyspark.sql import functions as F


def registrar():
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return keep

    return queries, oracle, query


def r6(column, name: str):
    """A double rounded to six digits, as both engines are compared."""
    return F.round(column, 6).alias(name)
