"""Queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects queries and oracles of a module."""

    def __init__(self):
        self.queries, self.oracle = {}, {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return keep
