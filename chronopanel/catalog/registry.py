"""Registry of runnable queries and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronopanel.catalog.sql_roles import SQL_ROLES
from chronopanel.sources.roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(body: str) -> str:
    """Put the shared role CTEs a statement mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_ROLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL_ROLES[name])
                if name not in needed:
                    needed.append(name)

    body = body.strip()
    visit(body)
    head = re.match(r"WITH(\s+RECURSIVE)?\s+", body)
    recursive = bool(head and head.group(1))
    rest = body[head.end():] if head else None
    ctes = ",\n".join(f"{n} AS ({SQL_ROLES[n]})" for n in needed)
    if not ctes:
        return body
    prefix = "WITH RECURSIVE " if recursive else "WITH "
    return f"{prefix}{ctes}" + (f",\n{rest}" if rest is not None else f"\n{body}")


def query(name: str, sql: str | None = None):
    """Register ``fn(roles) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Roles], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = lambda spark, sf_dir: fn(Roles(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return wrap


def R(expression: str, digits: int = 6) -> str:
    """SQL twin of ``chronopanel.functions.rounding.rnd``."""
    return f"(round(CAST({expression} AS DOUBLE) + 1e-9, {digits}) + 0.0)"
