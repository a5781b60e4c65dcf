"""How a module registers its queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..fixtures import cte, view


def _after(head: str, sql: str) -> str:
    """sql behind the WITH of the views."""
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head[5:]},\n{sql[15:]}"
    return f"{head},\n{sql[5:]}" if sql.startswith("WITH ") else f"{head}\n{sql}"


def registry(found: dict):
    """A decorator: @query(sql, *views) on a function of one DataFrame for each view; sql may start after the WITH of the views."""

    def query(sql: str | None, *names: str, with_=True):
        def add(f):
            def run(spark: SparkSession, sf_dir: str):
                return f(*[view(spark, sf_dir, n) for n in names])

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            head = cte(*names)
            full = None if sql is None else sql if head == "WITH " else _after(head, sql.lstrip())
            found[f.__name__] = (run, full)
            return f

        return add

    return query
