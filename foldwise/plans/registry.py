"""The named queries, and the oracle SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    body: str | None
    needs: tuple[str, ...]
    covers: tuple[str, ...]

    @property
    def sql(self) -> str | None:
        return with_fragments(self.body, list(self.needs)) if self.body else None


QUERIES: dict[str, Query] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(covers: str, sql: str | None = None, needs: str = ""):
    """Register a query under its function's name.

    ``needs`` names SQL fragments to put in front of ``sql`` as a WITH clause.
    """

    def keep(build):
        QUERIES[build.__name__] = Query(build, sql, tuple(needs.split()), tuple(covers.split()))
        return build

    return keep


def fragment(name: str, sql: str, needs: str = "") -> None:
    FRAGMENTS[name] = (tuple(needs.split()), sql.strip())


def with_fragments(sql: str, needs: list[str]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in FRAGMENTS[name][0]:
            visit(parent)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in order)
    return f"WITH {head}\n{sql.strip()}"
