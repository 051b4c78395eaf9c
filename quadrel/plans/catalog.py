"""The register of queries: name -> function of (spark, sf_dir), and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relations import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(value, digits: int = 4) -> Column:
    """A result rounded for comparison: ties fall one way in every engine, and zero has no sign."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + 1e-9, digits) + 0.0


def steady(sql: str) -> str:
    """The same for every round(x, n) of a SQL text."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            out.append(sql[at : start + 6])
            at = start + 6
            continue
        depth, i, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        inner = steady(sql[start + 6 : comma])
        out.append(f"{sql[at:start]}(round(({inner}) + 1e-9::DOUBLE, {sql[comma + 1 : i - 1].strip()}) + 0.0::DOUBLE)")
        at = i
    return "".join(out) + sql[at:]


def query(*relations: str, sql: str | None = None):
    """Register the function under its name; sql may use the named relations."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = steady(with_ctes(relations, sql) if relations else sql)
        return f

    return add
