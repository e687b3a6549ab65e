"""The catalogue: every runnable query, the operators it covers and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    operators: tuple[str, ...]
    sql: str | None


CATALOG: dict[str, Entry] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, uses: tuple[str, ...] = ()) -> None:
    """Register a named SQL view that twins can build on."""
    if name in _CTES:
        raise ValueError(f"view {name} is defined twice")
    _CTES[name] = (body, uses)


def values_cte(name: str, columns: list[str], rows: list[tuple]) -> None:
    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, float):
            return f"CAST({value!r} AS DOUBLE)"
        if isinstance(value, int):
            return str(value)
        return "'" + str(value).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    cte(name, f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns)})")


def compose(body: str, uses: tuple[str, ...]) -> str:
    """``body`` with every view it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for needed in _CTES[name][1]:
            visit(needed)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return body
    views = ",\n".join(f"{name} AS ({_CTES[name][0]})" for name in ordered)
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body.removeprefix('WITH RECURSIVE ')}"
    if body.startswith("WITH "):
        return f"WITH {views},\n{body.removeprefix('WITH ')}"
    return f"WITH {views}\n{body}"


def query(name: str, operators: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query under ``name``; ``operators`` lists the inventory items it covers."""

    def register(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(fn, tuple(operators.split()), compose(sql, uses) if sql else None)
        return fn

    return register
