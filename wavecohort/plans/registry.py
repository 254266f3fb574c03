"""Registered queries and their SQL.

SQL may begin a ``with`` list with ``$name``, which stands for the common table expressions of the proxy of that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PROXIES: dict[str, str] = {}


def expand(sql: str) -> str:
    done: set[str] = set()

    def put(m: re.Match) -> str:
        if m[1] in done:
            return ""
        done.add(m[1])
        return re.sub(r"\$(\w+)", put, PROXIES[m[1]])

    out = re.sub(r"\$(\w+)", put, sql)
    return re.sub(r",(\s*,)+", ",", re.sub(r"with\s*,", "with ", out))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = expand(sql)
        return f

    return add
