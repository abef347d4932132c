"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(c, k: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, k) + F.lit(0.0)


def day(c: str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def second(c: str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


class Registry(dict):
    """Query name to (function of (spark, sf_dir), oracle SQL or None)."""

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            assert name not in self, name
            self[name] = (fn, sql)
            return fn

        return keep
